"""Near-duplicate documents by an LSH forest over MinHash signatures.

Words are runs of non-blank characters with A-Z lowered; a document's set is its
distinct shingles of k words (all words as one shingle if there are fewer).
Documents with equal sets form a class, found by a fingerprint; the search is
over classes. A signature has ``COMPONENTS`` minima; tree t of ``TREES`` orders
the signatures by the components from 4t on, going round. In each order,
documents next to each other have the longest common prefixes. A region holds
what shares a prefix of ``DEPTHS[0]`` components, or of more where that region
is larger than ``REGION`` (adaptive depth); inside a region a document is a
candidate for its ``NEAR`` predecessors in the order and for the region's first
document, and the first document of a deeper region for the first one of the
region above. So the number of candidates is linear in the documents, however
large a group of copies is, and most of a group hangs together through its
neighbours in many orders.

Candidates are confirmed on full sets, made anew from the texts: for every
document first the partner that most trees propose, then all candidates whose
ends are not connected by then. A pair left out is inside one component already,
so no class changes by it.

The forest alone loses links where a region is crowded with documents that are
almost, but not quite, alike. So what it leaves is met in full: ``BANDS`` bands
of ``DEPTHS[0]`` components put the documents into buckets, and in each bucket
that holds several components all documents of different components are
compared, in tiles of about ``BLOCK`` by ``BLOCK``; none is cut. Buckets above
``CROWD`` that share documents are one crowd, compared once. A tile compares
signatures (``least_agreeing``); where few pairs remain, these are confirmed like
other candidates. Where many do, signatures cannot tell, and the tile is computed
again on full sets: incidence matrices of its shared shingles are multiplied,
which gives every intersection exactly, and only a spanning forest of its links
leaves the tile. The rows that move are linear in the documents of a bucket up to
``BLOCK``; in a larger crowd of n documents in different components each one
moves to n / ``BLOCK`` tiles, with its signature and in dense tiles with its text,
so there rows and comparisons alike grow with the square of n.

Defined cases: null and empty texts, and those without words, have the empty
set and are linked with nothing; rows of one doc_id are one node; a null doc_id
is linked with nothing and kept; equal rows are linked; an empty table gives an
empty result; further columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm import scratch
from evidentia.llm.components import connected

COMPONENTS = 64
TREES = 16
#: Components of a region's prefix, by level; the last level is the whole key and a part of the documents.
DEPTHS = (3, 8, 16)
KEY = 16
REGION = 2048
#: Predecessors in an order that are candidates; with one, all neighbours are met, the one of longest common prefix among them.
NEAR = 1
SALTS = 64
BANDS = COMPONENTS // DEPTHS[0]
#: Documents of a side of a tile; of a bucket that is merged with others; of a tile that is never dense.
BLOCK, CROWD, FEW = 1024, 512, 32
#: A tile is computed on full sets if it has more pairs left than DENSE for a document, or, between two blocks, than SPARSE: so the pairs that leave tiles are linear in the documents.
DENSE, SPARSE = 4, 32
#: Shingles that an incidence matrix holds at a time.
COLUMNS = 8192

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 1 << 63, COMPONENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64)
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text in UTF-8."""
    words = raw.lower().split()  # bytes: A-Z and blanks of ASCII only
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    width = min(k, len(words))
    n = len(words) - width + 1
    acc = h[:n] + np.uint64(width)
    for i in range(1, width):
        acc = (acc ^ (acc >> np.uint64(29))) * _P1 + h[i : i + n] * _P2
    acc = (acc ^ (acc >> np.uint64(32))) * _P3
    acc ^= acc >> np.uint64(29)
    acc.sort()
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]


def signature(s: np.ndarray) -> bytes:
    low = np.full(COMPONENTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):  # bounded memory for very long texts
        low = np.minimum(low, (s[None, at : at + 4096] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1))
    return ((low >> np.uint64(8)) & np.uint64(0xFFFF)).astype(">u2").tobytes()


def sketches(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, fingerprint, signature, body (the text, compressed)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text in part["text"]:
                raw = (text or "").encode("utf-8", "surrogatepass")
                s = shingle_set(raw, k)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s), zlib.compress(raw, 1)) if len(s) else (0, None, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "fingerprint", "signature", "body"])
            out.insert(0, "doc_id", part["doc_id"].to_numpy())
            yield out

    return documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_shingles long, fingerprint binary, signature binary, body binary")


def candidates(classes: DataFrame) -> DataFrame:
    """a, b (a > b), votes: pairs of documents that the forest proposes. ``classes`` (doc_id, signature) is a staged table."""
    turned = F.concat("signature", "signature")
    trees = classes.select("doc_id", F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring(turned, 8 * t + 1, 2 * KEY).alias("key")) for t in range(TREES)])).alias("x")).select("doc_id", "x.tree", "x.key")
    prefix = lambda depth: F.substring("key", 1, 2 * depth)
    region, level = prefix(DEPTHS[0]), F.lit(0)
    placed = trees.withColumn("region", region).withColumn("level", level)
    for i, depth in enumerate(DEPTHS):
        crowded = placed.where(F.col("level") == i).groupBy("tree", "region").count().where(F.col("count") > REGION).select("tree", "region", F.lit(True).alias("crowded"))
        crowded = scratch.stage(crowded, "crowded")
        if crowded.isEmpty():
            break
        deeper = prefix(DEPTHS[i + 1]) if i + 1 < len(DEPTHS) else F.concat("key", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("string").cast("binary"))
        placed = placed.join(crowded, ["tree", "region"], "left").select(
            "doc_id", "tree", "key", F.when(F.col("crowded"), deeper).otherwise(F.col("region")).alias("region"), F.when(F.col("crowded"), i + 1).otherwise(F.col("level")).alias("level")
        )
    order = Window.partitionBy("tree", "region").orderBy("key", "doc_id")
    near = [F.lag("doc_id", j).over(order) for j in range(1, NEAR + 1)]
    found = placed.select("doc_id", "tree", "key", "level", F.array(*near, F.first("doc_id").over(order)).alias("partners"))
    pairs = found.select("doc_id", F.explode(F.array_distinct("partners")).alias("other")).where("other IS NOT NULL AND other <> doc_id")
    # first documents of deeper regions meet the first one of the region they came from
    heads = found.where("level > 0").where(F.element_at("partners", -1) == F.col("doc_id")).withColumn("above", F.substring("key", 1, 2 * DEPTHS[0]))
    top = heads.groupBy("tree", "above").agg(F.min("doc_id").alias("other"))
    pairs = pairs.unionByName(heads.join(top, ["tree", "above"]).where("other <> doc_id").select("doc_id", "other"))
    return pairs.groupBy(F.greatest("doc_id", "other").alias("a"), F.least("doc_id", "other").alias("b")).agg(F.count("*").alias("votes"))


def confirm(pairs: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs u, v whose full sets have 100 * intersection >= percent * union."""
    left = bodies.select(F.col("doc_id").alias("a"), F.col("body").alias("body_a"))
    right = bodies.select(F.col("doc_id").alias("b"), F.col("body").alias("body_b"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sets: dict[int, np.ndarray] = {}  # of this batch
            keep = []
            for a, b, x, y in zip(part["a"], part["b"], part["body_a"], part["body_b"], strict=True):
                for i, body in ((a, x), (b, y)):
                    if i not in sets:
                        sets[i] = shingle_set(zlib.decompress(body), k)
                s, t = sets[a], sets[b]
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    keep.append(False)
                    continue
                both = np.concatenate((s, t))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            found = part[np.array(keep, bool)]
            yield pd.DataFrame({"u": found["a"], "v": found["b"]})

    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").mapInPandas(run, "u long, v long")


def least_agreeing(percent: int) -> int:
    """Components in which two signatures agree at least, but for one pair in 10^9 at the threshold."""
    p, below = percent / 100, 0.0
    for m in range(COMPONENTS):
        below += math.comb(COMPONENTS, m) * p**m * (1 - p) ** (COMPONENTS - m)
        if below > 1e-9:
            return m
    return COMPONENTS


def tiles(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, component, group, block) of the buckets with several components, and the tiles (group, block, i, j) of each block.

    ``nodes`` (doc_id, n_shingles, signature, component) is a staged table."""
    width = 2 * DEPTHS[0]
    band = lambda i: F.xxhash64(F.lit(i), F.substring("signature", width * i + 1, width))
    keys = nodes.select("doc_id", "component", F.explode(F.array(*map(band, range(BANDS)))).alias("bucket"))
    mixed = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    mixed = scratch.stage(mixed.select("bucket", "n"), "buckets")
    members = keys.join(mixed.hint("merge"), "bucket")
    crowded = mixed.where(F.col("n") > CROWD)
    if not crowded.isEmpty():
        crowds = scratch.stage(members.where(F.col("n") > CROWD).select("doc_id", "bucket"), "crowds")
        first = crowds.groupBy("doc_id").agg(F.min("bucket").alias("v"))
        crowd = connected(crowds.join(first, "doc_id").select(F.col("bucket").alias("u"), "v").distinct())
        members = members.join(crowd.select(F.col("node").alias("bucket"), F.col("component").alias("crowd")), "bucket", "left").withColumn("bucket", F.coalesce("crowd", "bucket"))
    members = scratch.stage(members.select("doc_id", "component", F.col("bucket").alias("group")).distinct(), "members")
    # a large component has blocks of its own, so that its documents need not meet each other
    whole = Window.partitionBy("group")
    large = F.col("n") > BLOCK // 2
    parts = members.groupBy("group", "component").agg(F.count("*").alias("n")).withColumn("others", F.sum(F.when(~large, F.col("n")).otherwise(0)).over(whole))
    blocks = F.ceil(F.when(large, F.col("n") / BLOCK).otherwise(F.col("others") / BLOCK)).cast("long")
    parts = parts.select("group", "component", F.when(F.col("others") + F.when(large, F.col("n")).otherwise(0) > BLOCK, blocks).otherwise(F.lit(1).cast("long")).alias("blocks"), large.alias("large"))
    own = F.xxhash64("component", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    placed = members.join(parts.hint("merge"), ["group", "component"]).withColumn("block", F.when(F.col("large"), own).otherwise(F.pmod(F.xxhash64("component"), F.col("blocks"))))
    placed = scratch.stage(placed.select("doc_id", "component", "group", "block", F.when(F.col("large"), F.col("component")).alias("tag")), "placed")
    one = placed.groupBy("group", "block").agg(F.max("tag").alias("tag"))
    two = one.select("group", F.col("block").alias("j"), F.col("tag").alias("tag_j"))
    met = one.withColumnRenamed("block", "i").join(two, "group").where("i <= j AND NOT coalesce(tag = tag_j, false)")
    ends = met.select("group", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return placed.drop("tag"), scratch.stage(ends, "tiles")


def _by_tile(meet):
    """``meet`` on whole tiles, a batch of tiles at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for part in parts:  # the last tile of a batch may go on in the next one
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            last = part.iloc[-1] if len(part) else None
            ends = len(part) if last is None else int((~((part["group"] == last["group"]) & (part["i"] == last["i"]) & (part["j"] == last["j"]))).sum())
            rest = part.iloc[ends:]
            if ends:
                yield from meet(part.iloc[:ends])
        if rest is not None and len(rest):
            yield from meet(rest)

    return run


def _starts(part: pd.DataFrame) -> np.ndarray:
    tile = part[["group", "i", "j"]].to_numpy()
    return np.append(np.flatnonzero(np.concatenate(([True], (tile[1:] != tile[:-1]).any(axis=1)))), len(part))


def _compare(percent: int):
    """Pairs u, v of a tile that signatures leave, or one row without u for a tile in which they leave many."""
    least = least_agreeing(percent)

    def may(size: np.ndarray, u, v) -> np.ndarray:
        return 100 * np.minimum(size[u], size[v]) >= percent * np.maximum(size[u], size[v])

    def meet(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        starts = _starts(part)
        n = np.diff(starts)
        tile = np.repeat(np.arange(len(n)), n)
        place = part[["group", "i", "j"]].to_numpy()
        block, doc, size, component = (part[c].to_numpy() for c in ("block", "doc_id", "n_shingles", "component"))
        across = place[:, 1] != place[:, 2]
        sig = np.frombuffer(b"".join(part["signature"]), np.uint16).reshape(len(part), COMPONENTS)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        x, d = np.flatnonzero(n[tile] <= FEW), 0
        while len(x):  # small tiles, all at once: pairs at distance d in the order
            d += 1
            x = x[x + d < len(part)]
            x = x[tile[x] == tile[x + d]]
            y = x + d
            near = (component[x] != component[y]) & ~(across[x] & (block[x] == block[y])) & may(size, x, y)
            u, v = x[near], y[near]
            near = (sig[u] == sig[v]).sum(axis=1) >= least
            found.append((u[near], v[near]))
        dense = []
        for t in np.flatnonzero(n > FEW):
            at, end = starts[t], starts[t + 1]
            own, held = [], 0
            most = SPARSE if across[at] else DENSE * n[t]
            for u in range(at, end - 1):
                same = (sig[u + 1 : end] == sig[u]).view(np.uint64).sum(axis=1)  # bytes of up to eight
                agree = (same * np.uint64(0x0101010101010101)) >> np.uint64(56)
                v = u + 1 + np.flatnonzero((agree >= least) & (component[u + 1 : end] != component[u]))
                v = v[may(size, u, v) & ~(across[u] & (block[v] == block[u]))]
                own.append((np.full(len(v), u), v))
                held += len(v)
                if held > most:
                    dense.append(at)
                    break
            else:
                found += own
        u, v = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield pd.DataFrame({"group": place[u, 0], "i": place[u, 1], "j": place[u, 2], "u": pd.array(doc[u], "Int64"), "v": pd.array(doc[v], "Int64")})
        yield pd.DataFrame({"group": place[dense, 0], "i": place[dense, 1], "j": place[dense, 2], "u": pd.array([None] * len(dense), "Int64"), "v": pd.array([None] * len(dense), "Int64")})

    return _by_tile(meet)


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of the sets of ``a`` with those of ``b``: a product of incidence matrices of the shared elements."""
    out = np.zeros((len(a), len(b)), np.float32)  # exact up to 2**24
    values = np.concatenate(a + b)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in a + b])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    edge = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(edge) - 1
    shared = np.bincount(column) > 1
    rank = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = rank[column[keep]], owner[keep]
    for at in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        m = np.zeros((len(a) + len(b), min(COLUMNS, int(shared.sum()) - at)), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def _multiply(k: int, percent: int):
    """A spanning forest of the links of each tile, from its full sets."""

    def meet(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        starts = _starts(part)
        for at, end in zip(starts[:-1], starts[1:], strict=True):
            tile = part.iloc[at:end]
            block, doc, component = (tile[c].to_numpy() for c in ("block", "doc_id", "component"))
            sets = [shingle_set(zlib.decompress(body), k) for body in tile["body"]]
            left = np.flatnonzero(block == tile["i"].iloc[0])
            right = np.flatnonzero(block == tile["j"].iloc[0])
            common = intersections([sets[x] for x in left], [sets[x] for x in right])
            size = np.array([len(s) for s in sets], np.float64)
            linked = (100.0 * common >= percent * (size[left][:, None] + size[right][None, :] - common)) & (component[left][:, None] != component[right][None, :])
            root = np.arange(len(doc))
            while True:  # the smallest document that each one is linked with, until nothing changes
                low = root.copy()
                low[left] = np.minimum(low[left], np.where(linked, root[right][None, :], len(doc)).min(axis=1))
                low[right] = np.minimum(low[right], np.where(linked, low[left][:, None], len(doc)).min(axis=0))
                low = low[low]
                if (low == root).all():
                    break
                root = low
            some = np.flatnonzero(root != np.arange(len(doc)))
            if len(some):
                yield pd.DataFrame({"u": doc[some], "v": doc[root[some]]})

    return _by_tile(meet)


def met_in_full(nodes: DataFrame, texts, k: int, percent: int) -> DataFrame:
    """Links u, v between different components of ``nodes`` that complete them; ``texts`` gives the bodies of a table of doc_ids."""
    members, ends = tiles(nodes)
    rows = members.join(ends.hint("merge"), ["group", "block"]).join(nodes.select("doc_id", "n_shingles", "signature").hint("merge"), "doc_id")
    rows = rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    left = scratch.stage(rows.mapInPandas(_compare(percent), "group long, i long, j long, u long, v long"), "left")
    pairs = left.where("u IS NOT NULL").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    links = confirm(pairs, texts(pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))), k, percent)
    dense = left.where("u IS NULL").select("group", "i", "j")
    if dense.isEmpty():
        return scratch.stage(links, "links")
    rows = members.join(ends.join(dense, ["group", "i", "j"]), ["group", "block"])
    rows = scratch.stage(rows, "dense")
    rows = rows.join(texts(rows.select("doc_id")).hint("merge"), "doc_id").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    return scratch.stage(links.unionByName(rows.mapInPandas(_multiply(k, percent), "u long, v long")), "links")


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per document."""
    base = scratch.stage(sketches(documents, k), "sketches")
    named = base.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.stage(named.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.max("signature").alias("signature"), F.max("n_shingles").alias("n_shingles")), "classes")
    pairs = scratch.stage(candidates(classes.select("doc_id", "signature").distinct()), "pairs")

    def texts(some: DataFrame) -> DataFrame:
        # texts move once, and only those of candidates move again; they are never broadcast, so that every size has one plan
        wanted = classes.select("fingerprint", "doc_id").join(some.distinct(), "doc_id", "left_semi").hint("merge")
        bodies = named.select("doc_id", "fingerprint", "body").join(wanted, ["doc_id", "fingerprint"], "left_semi")
        return scratch.stage(bodies.groupBy("doc_id").agg(F.max("body").alias("body")), "bodies")

    bodies = texts(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))

    both = pairs.select("a", "b", "votes", F.explode(F.array("a", "b")).alias("end"))
    best = both.groupBy("end").agg(F.max(F.struct("votes", F.greatest(-F.col("a"), -F.col("b")), "a", "b")).alias("m")).select("m.a", "m.b").distinct()
    first = scratch.stage(confirm(best, bodies, k, percent), "links")
    part = scratch.stage(connected(first), "parts")
    at_a = part.select(F.col("node").alias("a"), F.col("component").alias("at_a"))
    at_b = part.select(F.col("node").alias("b"), F.col("component").alias("at_b"))
    rest = pairs.join(best, ["a", "b"], "left_anti").join(at_a, "a", "left").join(at_b, "b", "left")
    rest = rest.where(F.coalesce("at_a", "a") != F.coalesce("at_b", "b")).select("a", "b")
    second = scratch.stage(confirm(rest, bodies, k, percent), "links")

    same = classes.select(F.col("doc_id").alias("first_doc"), "fingerprint")
    # a doc_id whose rows have different texts ties their classes together
    ties = named.select("doc_id", "fingerprint").distinct().join(same, "fingerprint").where("doc_id <> first_doc")
    odd = named.select("doc_id", "fingerprint").distinct().groupBy("doc_id").count().where("count > 1").select("doc_id")
    ties = ties.join(odd, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("first_doc").alias("v"))
    # the components found so far stand for their links: they are stars already
    stars = lambda found: found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    joined_up = scratch.stage(connected(stars(part).unionByName(second).unionByName(ties)), "parts")
    so_far = joined_up.withColumnRenamed("node", "doc_id").hint("merge")
    nodes = classes.select("doc_id", "n_shingles", "signature").join(so_far, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    more = met_in_full(scratch.stage(nodes, "nodes"), texts, k, percent)
    whole = connected(stars(joined_up).unionByName(more))
    of = scratch.stage(
        same.join(whole, F.col("first_doc") == F.col("node"), "left").select(F.col("fingerprint").alias("of_print"), F.coalesce("component", "first_doc").alias("component")), "components"
    )
    joined = base.select("doc_id", "n_shingles", "fingerprint").join(of, F.col("fingerprint") == F.col("of_print"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, of a doc_id's rows the one with the least text (null first), of several
    such the least of the others' texts; rows without doc_id all stay. Further columns may have any name."""
    kept = near_duplicates(documents.select("doc_id", "text"), k, percent).where("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("rows"))
    kept = scratch.stage(kept, "kept")
    rows = documents.select(F.struct("*").alias("row"))  # its columns can't clash with those made here
    stay = rows.where("row.doc_id IS NOT NULL").join(kept.hint("merge"), F.col("row.doc_id") == F.col("kept_id"))  # one plan at every size
    several = Window.partitionBy("kept_id").orderBy(F.col("row.text").asc_nulls_first(), F.to_json("row"))
    first = stay.where("rows > 1").withColumn("nth", F.row_number().over(several)).where("nth = 1")
    return stay.where("rows = 1").select("row.*").unionByName(first.select("row.*")).unionByName(documents.where("doc_id IS NULL"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 85 hundredths on shingles of three words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=3, percent=85)
