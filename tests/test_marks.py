"""Marks reach the documents of their key, in one broadcast or in several passes."""

import pytest
from pyspark.sql import functions as F

from foliolens.operators import boolean, near, search
from foliolens.plans.marks import with_marks
from tests.rules import CORPUS, document


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1000, 7])
def test_each_document_gets_the_mark_of_its_key(spark, most):
    docs = spark.createDataFrame([(n % 5 if n % 7 else None, f"f{n % 30:02d}" if n % 11 else None, n) for n in range(300)], "d int, f string, n int")
    marks = docs.select("d", "f").distinct().filter("d IS NULL OR d > 1").withColumn("mark", F.concat_ws("/", "d", "f"))
    want = sorted(r.n for r in docs.filter("d IS NULL OR d > 1").collect())
    got = with_marks(docs, marks, ["d", "f"], most).collect()
    assert sorted(r.n for r in got) == want
    assert all(r.mark == "/".join(str(x) for x in (r.d, r.f) if x is not None) for r in got)


def test_no_marks_give_no_documents(spark):
    docs = spark.createDataFrame([(1, "a")], "d int, f string")
    assert with_marks(docs, docs.filter("false").withColumn("m", F.lit(1)), ["f"]).count() == 0


def test_snippets_cross_no_shuffle(spark):
    """One name in nine of ten documents: rows of contexts are made where the texts are."""
    rows = [document(1 + n % 3, "hot.pdf" if n % 10 else f"{n}.pdf", f"the cat and {n} " * 5) for n in range(60)]
    corpus = spark.createDataFrame(rows, CORPUS)
    hits = search.search(corpus, "cat")
    for df in (boolean.search_any_rows(corpus, ["cat", "the"]), boolean.search_all(corpus, ["the", "cat"]),
               boolean.merge_near_rows(hits, [near.search_near(corpus, "cat", "and", 1)])):
        text = plan(df)
        assert "SortMergeJoin" not in text and "Exchange hash" not in text and df.count() > 0
    assert boolean.search_any_rows(corpus, ["cat", "the"]).count() == 600
