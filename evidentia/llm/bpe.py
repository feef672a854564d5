"""Byte-level BPE encoding and decoding of whole texts.

Overlapping chunk encoding: a text longer than one chunk is cut into chunks of
``CHUNK`` characters plus an overlap; chunks are pre-tokenised in parallel, each
from its own start. Two neighbours are stitched at the first position of their
overlap at which both have a pre-token boundary: from there on they agree, as a
pre-token depends on nothing before its start. The pieces between stitches are
then encoded, again in parallel, and their ids joined. By induction from the
first chunk every stitch is a boundary of the whole text, so the ids equal those
of the text encoded at once. Boundaries within ``MARGIN`` of a chunk's end may
depend on what follows and are not used. A text with a pair of chunks that never
agree (say one pre-token of many thousand characters) is encoded in one piece.
Decoding concatenates the tokens' raw bytes.

Scale: a text of one chunk is encoded where it is read, without a shuffle; only
long texts are dealt out again, chunk by chunk. Memory holds one Arrow batch of
texts (``spark.sql.execution.arrow.maxRecordsPerBatch`` is not relied on): its
texts become strings one at a time, and what is made of them leaves the task
``SLICES`` rows at a time.

Defined cases: null counts as empty and has no ids; control strings are ordinary
text; repeated rows give repeated results; an empty table gives an empty result;
further columns are not looked at. The vocabulary file's path is a parameter.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import scratch

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK = 16384
OVERLAP = 1024
#: Chunks and ids that leave a task together.
SLICES = 64
STRETCH = 65536
MARGIN = 8


class Codec:
    """Ranks of one vocabulary file: encodes a piece of text, decodes ids."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self._encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._pre = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for raw, rank in ranks.items():
            self.bytes_of[rank] = raw
        self.decimal = [str(i) for i in range(len(self.bytes_of))]

    def encode(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(text)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def boundaries(self, text: str, low: int, high: int) -> list[int]:
        """Starts of pre-tokens of ``text`` in low..high."""
        out = []
        for m in self._pre.finditer(text):
            at = m.start()
            if at > high:
                break
            if at >= low:
                out.append(at)
        return out


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _digest(c: Codec, ids) -> tuple[int, str, str]:
    """Number of ids and digests of their decimals and bytes, ``STRETCH`` ids at a time."""
    decimals, raw = hashlib.sha256(), hashlib.sha256()
    for at in range(0, len(ids), STRETCH):
        some = ids[at : at + STRETCH]
        some = some if isinstance(some, list) else some.tolist()
        decimals.update((" " * (at > 0) + " ".join(map(c.decimal.__getitem__, some))).encode())
        raw.update(c.decode(some))
    return len(ids), decimals.hexdigest(), raw.hexdigest()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` in pieces of ``SLICES`` rows; memory that this worker's earlier tasks have freed goes back first."""
    scratch.release()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICES):
            yield batch.slice(at, SLICES)


def _without(batch: pa.RecordBatch, dropped: str | None, **more: pa.Array) -> pa.RecordBatch:
    """``batch`` less one column, with ``more`` at its end."""
    names = [c for c in batch.schema.names if c != dropped]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *more.values()], [*names, *more])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their overlaps, each sliced once, ``SLICES`` at a time."""
    for part in _slices(batches):
        for doc_id, text in zip(part.column("doc_id"), part.column("text"), strict=True):
            doc_id, text = doc_id.as_py(), text.as_py()
            key = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
            last = -(-(len(text) - OVERLAP) // CHUNK) - 1
            for k in range(0, last + 1, SLICES):
                ks = range(k, min(k + SLICES, last + 1))
                n, chunks = len(ks), [text[i * CHUNK : (i + 1) * CHUNK + OVERLAP] for i in ks]
                columns = pa.array([doc_id] * n, pa.int64()), pa.array([key] * n), pa.array(ks, pa.int32()), pa.array([last] * n, pa.int32()), pa.array(chunks, pa.string())
                yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "key", "k", "last", "chunk"])


def _chunks(long_texts: DataFrame) -> DataFrame:
    """A row per chunk of a distinct (doc_id, text): key, copies, k, last, chunk (with overlap)."""
    rows = long_texts.select("doc_id", "text").mapInArrow(_cut, "doc_id long, key string, k int, last int, chunk string")
    return rows.groupBy("doc_id", "key", "k", "last").agg(F.first("chunk").alias("chunk"), F.count("*").alias("copies"))


def _pretokenise(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, ints = codec(path), pa.list_(pa.int32())
        for part in _slices(batches):
            heads, tails = [], []
            for k, last, text in zip(part.column("k").to_pylist(), part.column("last").to_pylist(), part.column("chunk"), strict=True):
                text = text.as_py()
                edge = len(text) if k == last else len(text) - MARGIN
                found = c.boundaries(text, 0, edge)
                heads.append([x for x in found if x <= min(OVERLAP, edge)] if k else [])
                tails.append([x - CHUNK for x in found if x >= CHUNK] if k < last else [])
            yield _without(part, None, heads=pa.array(heads, ints), tails=pa.array(tails, ints))

    return run


def _encode(path: str, column: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in _slices(batches):
            ids = [np.array(c.encode(t.as_py()), np.int32) for t in part.column(column)]
            yield _without(part, column, ids=pa.array(ids, pa.list_(pa.int32())))

    return run


def encode_long(long_texts: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: a row per row of ``long_texts``."""
    schema = "doc_id long, key string, k int, last int, chunk string, copies long"
    cut = _chunks(long_texts.select(F.col("doc_id").cast("long"), "text")).mapInArrow(_pretokenise(path), f"{schema}, heads array<int>, tails array<int>")
    cut = scratch.stage(cut, "chunks")  # three readers follow
    before = cut.select(F.col("doc_id").alias("b_doc"), F.col("key").alias("b_key"), (F.col("k") + 1).alias("b_k"), "tails").withColumnRenamed("tails", "b_tails")
    seams = (
        cut.select("doc_id", "key", "k", "heads")
        .where("k > 0")
        .join(before, F.col("doc_id").eqNullSafe(F.col("b_doc")) & (F.col("key") == F.col("b_key")) & (F.col("k") == F.col("b_k")))
        .select("doc_id", "key", F.struct("k", F.array_min(F.array_intersect("heads", "b_tails")).alias("at")).alias("seam"))
        .groupBy(F.col("doc_id").alias("s_doc"), F.col("key").alias("s_key"))
        .agg(F.map_from_entries(F.collect_list(F.struct(F.col("seam.k"), F.coalesce("seam.at", F.lit(-1))))).alias("seams"))
    )
    whole = F.array_contains(F.map_values("seams"), -1)
    joined = cut.select("doc_id", "key", "k", "last", "chunk", "copies").join(seams, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("key") == F.col("s_key")), "left")
    start = F.coalesce(F.element_at("seams", F.col("k")), F.lit(0))
    end = F.when(F.col("k") == F.col("last"), F.length("chunk")).otherwise(F.element_at("seams", F.col("k") + 1) + CHUNK)
    piece = F.when(F.coalesce(whole, F.lit(False)), F.when(F.col("k") == F.col("last"), F.col("chunk")).otherwise(F.substring("chunk", 1, CHUNK))).otherwise(
        F.substring(F.col("chunk"), start + 1, end - start)
    )
    pieces = joined.select("doc_id", "key", "k", "copies", piece.alias("piece"), F.coalesce(whole, F.lit(False)).alias("whole"))
    one = (
        pieces.where("whole")
        .groupBy("doc_id", "key", "copies")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "piece"))), lambda p: p["piece"]), "").alias("piece"))
        .select("doc_id", "key", F.lit(0).alias("k"), "copies", "piece")
    )
    ready = pieces.where("NOT whole").drop("whole").unionByName(one)
    coded = ready.mapInArrow(_encode(path, "piece"), "doc_id long, key string, k int, copies long, ids array<int>")
    joined_ids = coded.groupBy("doc_id", "key", "copies").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda p: p["ids"])).alias("ids"))
    return joined_ids.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))), "ids").select("doc_id", "ids")


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int): the ids of every whole text."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    is_long = F.length("text") > CHUNK + OVERLAP
    short = rows.where(~is_long).mapInArrow(_encode(path, "text"), "doc_id long, ids array<int>")
    return short.unionByName(encode_long(rows.where(is_long), path))


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded again."""
    path = path or public_tokenizers.path(VOCABULARY)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in _slices(batches):
            yield _framed(part, [_digest(c, c.encode(t.as_py())) for t in part.column("text")])

    def of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in _slices(batches):
            yield _framed(part, [_digest(c, ids.values.to_numpy()) for ids in part.column("ids")])

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    is_long = F.length("text") > CHUNK + OVERLAP
    short = rows.where(~is_long).mapInArrow(of_texts, schema)
    return short.unionByName(encode_long(rows.where(is_long), path).mapInArrow(of_ids, schema))


def _framed(part: pa.RecordBatch, found: list[tuple[int, str, str]]) -> pa.RecordBatch:
    columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text and of the bytes decoded from them."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
