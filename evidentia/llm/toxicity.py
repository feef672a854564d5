"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word (a run of letters and digits, lowered) is the sum of the embeddings of
its hash and of the hashes of its first three, four and five characters, so
that words never seen still have a place. Filters of width one, two and three
slide over the words; each is max-pooled over the whole text; a linear layer
of weights that are never negative gives a logit. The network is trained in numpy on a bounded sample of labelled
rows. A bag of the same hashed words tells the language of a text, and for each
language the threshold on the logit is calibrated on a fifth of the sample kept
apart; the score is the logistic of the distance to that threshold.

Scoring reads whole texts, a bounded number of words at a time, without a
shuffle. As filters are linear before pooling, a word's contributions are worked
out once and kept in a cache of bounded size.

Defined cases: null and empty texts are scored as texts without words; a
document with several labels counts as toxic if one says so; null labels are
left out; a null doc_id is in no labelled row; without labels of both kinds in
the training folds all scores are 0 (no toxic label) or 1 (only such); repeated
rows give repeated results; an empty table gives an empty result; further
columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import scratch
from evidentia.llm.langid import fold

BUCKETS = 1 << 15
DIM = 16
#: width of a filter -> number of filters
FILTERS = {1: 16, 2: 8, 3: 8}
#: Expected rows of the training sample, by label.
SAMPLE = {1: 2500, 0: 5000}
#: Bytes of text in the sample at most, in expectation; longer texts than FIT_TEXT are not drawn for it.
FIT_BYTES, FIT_TEXT = 64 << 20, 1 << 20
#: Passes over the sample: about STEPS batches in all, within these bounds.
STEPS, EPOCHS = 1200, (14, 30)
BATCH = 64
#: Share of a text's words that a pass of the training sees.
SHOWN = 0.35
RATE = 0.08
#: Words whose contributions are kept, and words worked on at once.
CACHE_WORDS = 150_000
STEP_WORDS = 100_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


_beginnings: dict[int, dict[str, int]] = {3: {}, 4: {}, 5: {}}


def _beginning(word: str, k: int) -> int:
    """Hash of the first k characters; words share few, so they are remembered."""
    known, start = _beginnings[k], word[:k]
    if start not in known:
        if len(known) > CACHE_WORDS:
            known.clear()
        known[start] = zlib.crc32(b"%d" % k + start.encode("utf-8", "surrogatepass")) % BUCKETS
    return known[start]


def hashes(word: str) -> tuple[int, int, int, int]:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS, _beginning(word, 3), _beginning(word, 4), _beginning(word, 5)


@dataclass
class ToxicityModel:
    embedding: np.ndarray  # buckets x DIM
    filters: dict[int, np.ndarray]  # width -> width x DIM x filters
    out: np.ndarray
    bias: float
    languages: list[str] = field(default_factory=list)
    by_word: np.ndarray | None = None  # buckets x languages
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None


class Scorer:
    """Scores texts under a model, with a bounded cache of words."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.columns = [(w, j, model.filters[w][j]) for w in model.filters for j in range(w)]
        self.project = np.concatenate([f for *_, f in self.columns], axis=1)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.empty((0, self.project.shape[1] + len(self.model.languages)), np.float32)

    def _learn(self, new: list[str]) -> None:
        ids = np.array([hashes(w) for w in new], dtype=np.int64)
        made = self.model.embedding[ids].sum(axis=1) @ self.project
        if self.model.languages:
            made = np.concatenate([made, self.model.by_word[ids].sum(axis=1)], axis=1)
        for w in new:
            self.index[w] = len(self.index)
        need = len(self.index)
        if need > len(self.rows):
            grown = np.empty((max(need, 2 * len(self.rows)), self.rows.shape[1]), np.float32)
            grown[: need - len(new)] = self.rows[: need - len(new)]
            self.rows = grown
        self.rows[need - len(new) : need] = made

    def logits(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Logit and language number of texts given as words; a text longer than a step is taken in overlapping stretches."""
        m = self.model
        n = len(texts)
        pooled = np.zeros((n, len(m.out)), np.float32)
        lang = np.zeros((n, max(1, len(m.languages))), np.float64)
        at = 0
        while at < n:
            end, total = at, 0
            while end < n and (end == at or total + len(texts[end]) <= STEP_WORDS):
                total += len(texts[end])
                end += 1
            group = texts[at:end]
            if total > STEP_WORDS:  # one long text
                for s in range(0, total, STEP_WORDS):
                    self._pool([group[0][max(0, s - 2) : s + STEP_WORDS]], pooled[at:end], lang[at:end])
            else:
                self._pool(group, pooled[at:end], lang[at:end])
            at = end
        return pooled @ m.out + m.bias, lang.argmax(axis=1)

    def _pool(self, group: list[list[str]], pooled: np.ndarray, lang: np.ndarray) -> None:
        known = self.index
        new = {w for text in group for w in text if w not in known}
        if len(known) + len(new) > CACHE_WORDS and known:
            self._clear()
            known = self.index
            new = {w for text in group for w in text}
        if new:
            self._learn(list(new))
        sizes = np.array([len(t) for t in group])
        full = np.flatnonzero(sizes)
        if not len(full):
            return
        idx = np.array([known[w] for t in group for w in t], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        left = np.repeat(starts + sizes[full], sizes[full]) - np.arange(len(idx))  # words from here to the text's end
        table = self.rows[idx]
        col, out = 0, 0
        for width, f in self.model.filters.items():
            k = f.shape[2]
            sum_ = table[:, col : col + k].copy()
            for j in range(1, width):  # words past the end count as zero
                sum_[:-j][left[:-j] > j] += table[j:, col + j * k : col + (j + 1) * k][left[:-j] > j]
            top = np.maximum.reduceat(sum_, starts, axis=0)
            pooled[full, out : out + k] = np.maximum(pooled[full, out : out + k], np.maximum(top, 0))
            col += width * k
            out += k
        if self.model.languages:
            lang[full] += np.add.reduceat(table[:, col:], starts, axis=0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        m = self.model
        if m.constant is not None:
            return np.full(len(texts), m.constant)
        logit, lang = self.logits([words(t) for t in texts])
        cut = np.array([m.thresholds.get(x, m.thresholds.get("", 0.0)) for x in m.languages] or [m.thresholds.get("", 0.0)])
        # clipped so that exp stays finite
        return 1 / (1 + np.exp(-np.clip(logit - cut[lang], -40, 40)))


def _train_languages(docs: list[np.ndarray], ids: np.ndarray, langs: list[str | None]) -> tuple[list[str], np.ndarray | None]:
    """Softmax regression on the mean of hashed words."""
    names = sorted({x for x in langs if x is not None})
    if len(names) < 2:
        return [], None
    w, g2 = np.zeros((BUCKETS, len(names)), np.float32), np.full((BUCKETS, len(names)), 1e-6, np.float32)
    for epoch in range(2):
        for i in np.random.default_rng(epoch).permutation(len(docs)):
            if langs[i] is None or not len(docs[i]):
                continue
            at, n = np.unique(ids[docs[i]].ravel(), return_counts=True)
            x = n / n.sum()
            z = x @ w[at] * 4
            p = np.exp(z - z.max())
            p /= p.sum()
            p[names.index(langs[i])] -= 1
            g = (x[:, None] * p).astype(np.float32)
            g2[at] += g * g
            w[at] -= 0.5 * g / np.sqrt(g2[at])
    return names, w


def fit(rows: pd.DataFrame) -> ToxicityModel:
    """Train on rows of text, lang and toxic; a fifth is kept for the thresholds."""
    rng = np.random.default_rng(7)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    filters = {w: rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, k)).astype(np.float32) for w, k in FILTERS.items()}
    total = sum(FILTERS.values())
    out = np.full(total, 0.3, np.float32)
    model = ToxicityModel(emb, filters, out, -0.5)
    y = rows["toxic"].to_numpy(np.int64)
    if not len(y) or y.min() == y.max():
        model.constant = float(y[0]) if len(y) else 0.0
        return model
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in words(t)], np.int32) for t in rows["text"]]
    ids = np.fromiter((h for w in index for h in hashes(w)), np.int32, 4 * len(index)).reshape(-1, 4)
    del index
    part = np.arange(len(y)) % 5 == 0
    model.languages, model.by_word = _train_languages(docs, ids, [x if isinstance(x, str) else None for x in rows["lang"]])

    g_emb, g_out, g_bias = np.full((BUCKETS, DIM), 1e-4, np.float32), np.full(total, 1e-2, np.float32), 1e-2
    g_filters = {w: np.full_like(f, 1e-3) for w, f in filters.items()}
    train = np.flatnonzero(~part)
    pos = max(1, int(y[train].sum()))
    weight = np.where(y == 1, min(10.0, (len(train) - pos) / pos), 1.0)
    epochs = min(max(EPOCHS[0], -(-STEPS * BATCH // max(1, len(train)))), EPOCHS[1])
    for _ in range(epochs):
        for b in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            # words dropped at random, so that one word of a text doesn't stand for all its others
            shown = {i: docs[i][rng.random(len(docs[i])) < SHOWN] for i in b}
            b = b[[len(shown[i]) > 0 for i in b]]
            if not len(b):
                continue
            flat = np.concatenate([shown[i] for i in b])
            starts = np.concatenate(([0], np.cumsum([len(shown[i]) for i in b])))
            distinct, inverse = np.unique(flat, return_inverse=True)
            vectors = emb[ids[distinct]].sum(axis=1)
            table = (vectors @ np.concatenate([f[j] for f in filters.values() for j in range(len(f))], axis=1))[inverse]
            left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(flat))
            pooled, arg = np.zeros((len(b), total), np.float32), np.zeros((len(b), total), np.int64)
            o = col = 0
            for w, f in filters.items():
                k = f.shape[2]
                s = table[:, col : col + k].copy()
                for j in range(1, w):
                    s[:-j] += table[j:, col + j * k : col + (j + 1) * k] * (left[:-j] > j)[:, None]
                col += w * k
                for i in range(len(b)):
                    seg = s[starts[i] : starts[i + 1]]
                    a = seg.argmax(axis=0)
                    arg[i, o : o + k] = a + starts[i]
                    pooled[i, o : o + k] = seg[a, np.arange(k)]
                o += k
            live = pooled > 0
            pooled *= live
            p = 1 / (1 + np.exp(-np.clip(pooled @ out + model.bias, -30, 30)))
            d = ((p - y[b]) * weight[b] / len(b)).astype(np.float32)
            d_pool = d[:, None] * out * live
            go, gb = pooled.T @ d, float(d.sum())
            g_out += go * go
            g_bias += gb * gb
            np.maximum(out - RATE * go / np.sqrt(g_out), 0, out=out)  # a filter can only speak for toxicity
            model.bias -= RATE * gb / np.sqrt(g_bias)
            touched, grads, o = [], [], 0
            for w, f in filters.items():
                k = f.shape[2]
                at, dp = arg[:, o : o + k], d_pool[:, o : o + k]
                gf = np.zeros_like(f)
                for j in range(w):
                    ok = left[at] > j
                    pos_ = np.where(ok, at + j, 0)
                    dd = dp * ok
                    gf[j] = np.einsum("bkd,bk->dk", vectors[inverse[pos_]], dd)
                    touched.append(pos_.ravel())
                    grads.append((dd[:, :, None] * f[j].T[None]).reshape(-1, DIM))
                g_filters[w] += gf * gf
                f -= RATE * gf / np.sqrt(g_filters[w])
                o += k
            pos_, gx = np.concatenate(touched), np.concatenate(grads)
            some = np.flatnonzero(np.abs(gx).sum(axis=1) > 0)
            if len(some):
                rows_at, where = np.unique(ids[flat[pos_[some]]], return_inverse=True)
                ge = np.zeros((len(rows_at), DIM), np.float32)
                np.add.at(ge, where.reshape(-1, 4), gx[some][:, None, :])
                g_emb[rows_at] += ge * ge
                emb[rows_at] -= RATE * ge / np.sqrt(g_emb[rows_at])

    del docs, ids
    scorer, kept = Scorer(model), list(rows["text"][part])
    found = [scorer.logits([words(t) for t in kept[i : i + 64]]) for i in range(0, len(kept), 64)]
    logit, lang = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    truth = y[part]
    model.thresholds[""] = threshold(logit, truth)
    for i, name in enumerate(model.languages):
        own = lang == i
        if truth[own].sum() >= 3 and (1 - truth[own]).sum() >= 5:
            model.thresholds[name] = threshold(logit[own], truth[own])
    del scorer, found
    scratch.release()
    return model


def threshold(logit: np.ndarray, truth: np.ndarray) -> float:
    """The middle of the widest stretch of cuts with the best F1."""
    if not truth.any():
        return 0.0
    order = np.argsort(-logit, kind="stable")
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + truth.sum())
    ranked = np.append(logit[order], logit.min() - 2)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    widest = max(best, key=lambda i: ranked[i] - ranked[i + 1])
    return float((ranked[widest] + ranked[widest + 1]) / 2)


def sample(documents: DataFrame, labels: DataFrame, sizes: dict[int, int] = SAMPLE, max_bytes: int = FIT_BYTES) -> pd.DataFrame:
    """About ``sizes`` rows (text, lang, toxic) of each label, and ``max_bytes`` of text in all, drawn by a hash of doc_id."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    texts = documents.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_TEXT)
    mean = texts.agg(F.avg(F.octet_length("text"))).first()[0] or 1.0  # the toxic ones are taken to be as long as others
    share = min(1.0, max_bytes / (sum(sizes.values()) * mean))
    rate = F.when(F.col("toxic") == 1, min(1.0, share * sizes[1] / max(1, counts.get(1, 0)))).otherwise(min(1.0, share * sizes[0] / max(1, counts.get(0, 0))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    drawn = one.where(draw < rate)  # about the sum of sizes, whatever the input
    rows = texts.select("doc_id", "text", "lang").join(F.broadcast(drawn), "doc_id")
    return rows.orderBy(F.xxhash64("doc_id", F.lit("order")), "text").select("text", "lang", "toxic").toPandas()


def scorer(model: ToxicityModel):
    """A Pandas UDF from text to score."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(model)
        for part in parts:
            # a few texts at a time, so that memory does not depend on their length
            yield pd.Series(np.concatenate([own.scores(list(part.iloc[i : i + 256])) for i in range(0, len(part), 256)]) if len(part) else np.zeros(0))

    return score


def keep_clean(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """Documents with a score below 0.5."""
    return documents.where(scorer(model)("text") < 0.5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text, learned from the folds other than 0 of 5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(fold(5) != 0)
    model = fit(sample(docs, labels))
    found = docs.select("doc_id", (fold(5) == 0).alias("held_out"), scorer(model)("text").alias("score"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
