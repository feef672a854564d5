"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters (letters lowered, any run of other characters
one blank, a blank at both ends) are hashed to ``BUCKETS``. Document frequencies
are counted over every document of the training folds, in one distributed pass.
The weights are then trained in the driver on a bounded sample, ``PER_LANGUAGE``
expected rows for each language and ``FIT_BYTES`` in all, by follow-the-regularised-leader with an
elastic-net penalty (L1 leaves most weights zero), and a temperature is fitted
on a fifth of that sample kept apart. Prediction reads whole texts, batch by
batch, and needs no shuffle.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as
is every text where there was nothing to learn from; with one language learned
its score is 1; a null doc_id belongs to the training folds; repeated rows give
repeated results; an empty table gives an empty result; further columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import scratch

BITS = 17
BUCKETS = 1 << BITS
PER_LANGUAGE = 1500
#: The sample has so many bytes of text at most, in expectation; longer texts than FIT_TEXT are not drawn for it.
FIT_BYTES, FIT_TEXT = 64 << 20, 1 << 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct buckets of a text's n-grams and their counts; None without letters."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[code]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stands for it
    a = np.empty(int(keep.sum()) + 2, np.uint32)
    a[0] = a[-1] = 32
    a[1:-1] = np.where(letter, code, 32)[keep]
    one = a * np.uint32(2654435761)
    two = (one[:-1] ^ (a[1:] * np.uint32(2246822519) + np.uint32(97))) * np.uint32(3266489917)
    three = (two[:-1] ^ (a[2:] * np.uint32(668265263) + np.uint32(193))) * np.uint32(374761393)
    shift = np.uint32(32 - BITS)
    every = np.concatenate([one >> shift, two >> shift, three >> shift])
    if len(every) > 40_000:
        counts = np.bincount(every, minlength=BUCKETS)
        at = np.flatnonzero(counts)
        return at, counts[at]
    every.sort()
    edge = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[edge].astype(np.int64), np.diff(np.concatenate((edge, [len(every)])))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at, n = found
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / (np.sqrt(x @ x) or 1.0)

    def probabilities(self, text: str | None) -> np.ndarray | None:
        found = grams(text)
        if found is None or not self.languages:
            return None
        at, x = self.features(found)
        return _softmax((x @ self.weights[at] + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        p = self.probabilities(text)
        if p is None:
            return UNKNOWN, 0.0
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def document_frequencies(documents: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents with letters, and of those that hold each bucket; over all documents."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = 0, np.zeros(BUCKETS, np.int64)
        for part in parts:
            for text in part["text"]:
                if (found := grams(text)) is not None:
                    n += 1
                    df[found[0]] += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(df[at], n)})

    # at most BUCKETS + 1 rows come back
    rows = documents.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)  # bucket -1 is the last
    return int(df[-1]), df[:-1]


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE, max_bytes: int = FIT_BYTES) -> pd.DataFrame:
    """About ``per_language`` rows (text, lang) of each language, and ``max_bytes`` of text in all, drawn by a hash of doc_id."""
    labelled = labelled.where(F.octet_length("text") <= FIT_TEXT)
    counts = {r["lang"]: (r["n"], r["bytes"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    if not counts:
        return pd.DataFrame({"text": [], "lang": []})
    rate = F.lit(0.0)
    for lang, (n, size) in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n, max_bytes / len(counts) / max(1, size)))).otherwise(rate)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(draw < rate).orderBy(F.xxhash64("doc_id", F.lit("order")), "text").select("text", "lang").toPandas()


def fit(n: int, df: np.ndarray, rows: pd.DataFrame, epochs: int = EPOCHS) -> LanguageModel:
    """FTRL on four fifths of ``rows``, the temperature on the rest."""
    idf = (np.log((1.0 + n) / (1.0 + df)) + 1.0).astype(np.float64)
    languages = sorted(rows["lang"].unique())
    k = len(languages)
    model = LanguageModel(languages, idf, np.zeros((BUCKETS, k)), np.zeros(k))
    data = []
    for text, lang in zip(rows["text"], rows["lang"], strict=True):
        if (found := grams(text)) is not None:
            at, x = model.features(found)
            data.append((at.astype(np.int32), x.astype(np.float32), languages.index(lang)))
    if k < 2 or not data:
        return model if data else LanguageModel([], idf, model.weights, model.bias)
    train, rest = [d for i, d in enumerate(data) if i % 5], data[::5]
    z, g2 = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights_at(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return -np.sign(zs) * np.maximum(np.abs(zs) - L1, 0) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(train)):
            at, x, y = train[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)  # the last row is the bias
            w = weights_at(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            new = g2[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(g2[at])) / ALPHA * w
            g2[at] = new
    w = weights_at(np.arange(BUCKETS + 1))
    model.weights, model.bias = w[:-1].astype(np.float32), w[-1]
    logits = np.array([x @ model.weights[at] + model.bias for at, x, _ in rest])
    truth = np.array([y for *_, y in rest])

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(truth)), truth]).mean())

    model.temperature = float(min(np.geomspace(0.2, 5, 60), key=loss)) if len(rest) else 1.0
    return model


def train(documents: DataFrame) -> LanguageModel:
    """Learn from the texts and the non-null languages of ``documents``."""
    labelled = documents.where("lang IS NOT NULL").select("doc_id", "text", "lang")
    model = fit(*document_frequencies(labelled), sample(labelled))
    scratch.release()
    return model


def predictor(model: LanguageModel):
    """A Pandas UDF from text to struct(lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([model.predict(t) for t in part], columns=["lang_pred", "score"])

    return predict


def keep_known(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """Documents whose language can be told: those predicted ``und`` go."""
    return documents.where(predictor(model)("text")["lang_pred"] != UNKNOWN)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text, learned from the folds other than 2 of 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(fold(4) != 2))
    found = docs.select("doc_id", (fold(4) == 2).alias("held_out"), predictor(model)("text").alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
