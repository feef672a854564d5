"""Every registered query of the library proper against its SQL, on the smallest tables."""

import pytest

from evidentia.plans import catalog
from tests.conftest import SF, same_rows

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    same_rows(catalog.queries()[name](spark, SF), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).columns


def test_whole_tables_against_plain_python(spark, tmp_path):
    import re

    texts = ["Licensed version of it.", "Version the is of der", "Up. A. B c", "**Demand:** grew\nx\n**Supply:** fell\n# Sources\n1. y", "# Title\nz **b**", "", None, "the licensed der is of"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: {r.doc_id: tuple(r)[1:] for r in catalog.queries()[name](spark, str(tmp_path)).collect()}

    def split(t):
        s = t and [x.strip(" ") for x in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", t.strip(" ")) if x.strip(" ")]
        return (None, None) if t is None else (len(s), max(map(len, s), default=None))

    def body(t):
        return t and re.sub(r"(?m)^\*\*[^*\n]{1,40}:\*\*\s*", "", re.sub(r"(?is)\n#+\s*(audit|sources).*\Z", "", t)).strip(" ")

    for name, by_hand in (("q_txt4_sentences_all", split), ("q_txt18_clean_body_all", lambda t: (body(t),))):
        assert run(name) == {i: by_hand(t) for i, t in enumerate(texts)}, name


def test_types_of_files(spark):
    from pyspark.sql import functions as F

    from evidentia.operators import retrieval as rt

    texts = ["Cap Rate and tenant", "buyer, seller, acquirer, net yield", "buyer seller acquirer net yield acquisition", "tender zoning", None, "plot ratio; WALE; vendor", "asking rent wale vendor tenderer"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.array_join(rt.present_types(rt.marker_scores(F.col("t"))), ",").alias("k")).orderBy("i").collect()
    assert [r.k for r in rows] == ["sales", "", "sales", "", "", "land,sales,rent", "rent,sales"]
    assert [r[0] for r in spark.createDataFrame([("Outlook 2025", "a forecast"), ("Outlook", "x"), (None, None)], "n string, t string").select(rt.report_like(F.col("n"), F.col("t"))).collect()] == [True, False, False]


def test_links_to_reports(spark):
    from evidentia.operators import retrieval as rt

    html = '<a href="/x/Q1.PDF?v=1">First report</a> says <b>this</b> <a href="other.html">Not a report</a><A class="c" href="../research/two">Second</A> tail <a href="https://o.org/insight/3">no</a><a href="/x/Q1.PDF?v=2">First again</a><a href="//cdn.org/a.pdf"><i>Third one</i></a>'
    got = [tuple(r) for r in rt.links(spark.createDataFrame([(1, "https://h.org/d/page?q=/z", html), (2, None, None)], "page_id long, url string, html string")).collect()]
    assert sorted(got) == sorted([
        (1, "https://h.org/x/Q1.PDF?v=1", "First report", "says this Not a report Second tail no First again Third one"),
        (1, "https://h.org/d/../research/two", "Second", "tail no First again Third one"),
        (1, "https://cdn.org/a.pdf", "Third one", ""),
    ])


def test_prose_lines_by_hand(spark, tmp_path):
    import hashlib

    pages = ["RENTS ROSE\nVacancy tightened to 3.2% as net absorption remained positive in the market, and so it was.\nGrade A rent chart\nMarina Bay  1,250,000  4.1%  SGD 12.50 psf\n\nsource: the agency is here\nThe outlook is stable for the year.", "Too short is this.", None, ""]
    want = ["Vacancy tightened to 3.2% as net absorption remained positive in the market, and so it was. Marina Bay  1,250,000  4.1%  SGD 12.50 psf\n\nThe outlook is stable for the year.", "", None, ""]
    spark.createDataFrame(list(enumerate(pages)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.digest for r in catalog.queries()["q_flt19_prose_filter"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in (0, 1, 3)] == [hashlib.md5(want[i].encode()).hexdigest() for i in (0, 1, 3)]
