"""The corpus pipeline on whole small tables with awkward rows."""

import hashlib
import shutil
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import mixing
from tests.conftest import SF


def table(spark, folder, rows, keep="true"):
    """A folder with the small documents that ``keep`` leaves, ``rows`` more, and the labels."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(keep)
    more = spark.createDataFrame(rows, docs.schema)
    docs.unionByName(more).write.parquet(f"{folder}/documents.parquet")
    shutil.copy(f"{SF}/labels.parquet", f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    text = "A plain note of the town council on the new bridge over the river and on the cost of its repair " * 3
    odd = [(9001, None, "en", "web", 0), (9002, "", "en", "web", 0), (9003, " \t\n", None, None, 3), (9004, "123 !!! 456", "en", "web", 11)]
    same = [(9010, text, "en", "web", len(text)), (9010, text, "en", "web", len(text)), (9011, text, None, None, len(text)), (9012, text + " end", "en", "books", len(text) + 4)]
    sf = table(spark, tmp_path, odd + same)
    got = corpus_pipeline.run(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r.doc_id for r in got}
    assert not found & {9001, 9002, 9003, 9004}  # no letter: no language
    assert found & {9010, 9011, 9012} <= {9010}  # one of a group, the smallest
    assert len(found) > 100 and all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)
    assert all(r.n_tokens > 0 for r in got)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    sf = table(spark, tmp_path, [], keep="false")
    got = corpus_pipeline.run(spark, sf)
    assert got.count() == 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)


#: Columns that stages make for themselves.
HELPERS = ("rows", "row", "kept_id", "nth", "kept", "mix_copies", "mix_doc", "mix_key", "copies", "copy", "equals", "times", "of_doc", "of_key", "text_key", "shuffle_key", "size", "target", "taken", "idx", "toxic", "score", "lang_pred", "component_id", "n_shingles", "fingerprint", "body", "key", "k", "last", "chunk", "ids", "heads", "tails", "piece", "seams")


def test_stages_take_clashing_names_and_rows_without_id(spark, tmp_path):
    text = "A plain note of the town council on the new bridge over the river and on the cost of its repair " * 3
    blank = [(None, text, "en", "web", 1)] * 3 + [(None, text, "en", "web", 2), (None, "Another note on the harbour and on the ships that call there every week.", None, None, None)]
    sf = table(spark, tmp_path, blank, keep="doc_id < 120")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wide = docs
    for i, c in enumerate(HELPERS):
        wide = wide.withColumn(c, F.lit(i))
    plain, clashing = docs, wide
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        plain, clashing = stage(spark, plain, sf), stage(spark, clashing, sf)
        plain.write.parquet(f"{tmp_path}/plain{n}")
        clashing.write.parquet(f"{tmp_path}/clash{n}")
        plain, clashing = spark.read.parquet(f"{tmp_path}/plain{n}"), spark.read.parquet(f"{tmp_path}/clash{n}")
        if n < 4:
            assert clashing.columns == wide.columns and plain.columns == docs.columns, name
        assert Counter(map(tuple, plain.collect())) == Counter(map(tuple, clashing.select(plain.columns).collect())), name
        if n == 2:
            assert plain.where("doc_id IS NULL").count() == 5


def test_mix_shares_copies_among_equal_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, "one two three four", "en", "a", None)] * 2 + [(None, "one two three four", "de", "a", None)] + [(i, "w " * 400, "en", "b", None) for i in range(20)] + [(77, "one two three four", "en", "a", 5)]
    docs = spark.createDataFrame(rows, schema)
    mixed = Counter(r.text for r in mixing.mix_documents(docs).collect())
    narrow = mixing.sized(docs, "text").cache()
    want = Counter()
    for r in mixing.taken(narrow, mixing.source_targets(narrow), "text").collect():
        want[r.text] += -(-r.taken // r.size)
    assert mixed == +want
    one = spark.createDataFrame(rows[:2], schema)
    assert mixing.mix_documents(one).count() == 2
