"""A corpus pipeline of five operators, each stage written as Parquet and reread.

language ID -> toxicity -> near-duplicates -> mixing -> byte-level BPE.

Both classifiers are fitted on the stage's own input (bounded samples, see
``langid`` and ``toxicity``), so each stage stands on its own. The mixing stage
repeats a document as often as the mix takes it, a part counting as a whole.
All stages but the last return the columns of ``documents``; the last returns
doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row of the mix.

Defined cases: null, empty and letterless texts have no language and go in the
first stage; rows without doc_id are linked with nothing, so all of them stay in
the third, and repeated ones share what the mix takes of their text; of several
rows of one doc_id one stays; null lang and source are values like others; very
long texts are worked on whole; an empty table gives an empty result. Further
columns of ``documents``, whatever their names, go through to the fourth stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import bpe, langid, mixing, neardup, scratch, toxicity


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go."""
    return langid.keep_known(docs, langid.train(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.keep_clean(docs, toxicity.fit(toxicity.sample(docs, labels)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    return neardup.keep_one(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of the bytes decoded from them."""
    return bpe.digests(docs)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixing", mix), ("bpe", encode)]

#: Trained classifiers and hash-based near-duplicate search have no SQL equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written under the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        mark = scratch.mark()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        scratch.drop(mark)
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
