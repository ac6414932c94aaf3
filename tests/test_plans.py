"""What the physical plans must look like to hold at scale."""

import os

import pytest
from pyspark.sql import functions as F

from foliolens import session
from foliolens.operators import boolean, near, ranking, search
from foliolens.plans.merge import first_contexts
from foliolens.plans.query import query, query_many
from foliolens.plans.skew import drop_by_key, keep_by_key
from foliolens.sources import index
from tests.rules import CORPUS, document, scanned


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "index")
    rows = [document(d, f"{n}.pdf", f"the cat and {n} " * 5) for d in (1, 2) for n in range(20)]
    index.write_index(spark.createDataFrame(rows, CORPUS), path)
    return index.read_index(spark, path)


def test_searches_are_one_scan_without_shuffle_or_python(corpus):
    frames = [
        search.search(corpus, "the"), search.search_matches(corpus, "the"), search.count_matches(corpus, "the"),
        near.search_near(corpus, "the", "and", 3),
        boolean.search_all(corpus, ["the", "and"], unique_key=True),
        boolean.search_any(corpus, ["the", "and"], unique_key=True),
        query(corpus, all=["the"], none=["dog"], near=[("the", "and", 2)], unique_key=True).hits,
        query_many(corpus, {"a": dict(all=["the"]), "b": dict(any=["and", "dog"])}, unique_key=True),
    ]
    for df in frames:
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text
        assert text.count("FileScan") == 1


def test_counts_leave_out_page_offsets(corpus):
    scan = [line for line in plan(search.count_matches(corpus, "the")).splitlines() if "FileScan" in line][0]
    assert "page_offsets" not in scan.split("ReadSchema")[1]


def test_filters_reach_the_scan(corpus):
    scan = plan(query(corpus, all=["the"], dataset=2, min_pages=1, unique_key=True).hits)
    assert "PartitionFilters: [isnotnull(dataset" in scan and "GreaterThanOrEqual(pages,1)" in scan
    assert "StringContains(text,The)" in plan(search.search(corpus, "The", case_sensitive=True))
    assert "StringContains" not in plan(search.search(corpus, "The"))


def test_page_is_top_k_and_keeps_texts_in_place(corpus):
    found = query(corpus, all=["the"], unique_key=True)
    assert "TakeOrderedAndProject" in plan(ranking.page_hits(found.hits, 1, 20))
    text = plan(found.page)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Exchange hash" not in text


def test_page_reads_the_row_groups_of_its_documents(spark, tmp_path):
    rows = [document(1, f"{n:05d}.pdf", f"the cat and {n} " * (9 if n == 777 else 5)) for n in range(2000)]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 50)
    try:
        index.write_index(spark.createDataFrame(rows, CORPUS), str(tmp_path / "index"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    found = query(index.read_index(spark, str(tmp_path / "index")), all=["cat"], unique_key=True, per_page=1)
    assert [r.filename for r in found.page.collect()] == ["00777.pdf"]
    assert scanned(found.page) <= 51  # one file of fifty rows, and the row of the page


def test_contexts_are_limited_before_the_shuffle(corpus):
    hits = search.search(corpus, "the").withColumn("part", F.lit(0))
    assert "WindowGroupLimit" in plan(first_contexts(hits, ["filename"], 50))


def test_merging_combines_before_the_shuffle(corpus):
    text = plan(query(corpus, any=["the", "and"]).hits)
    assert "partial_sum" in text and "partial_min_by" in text
    assert "text" not in text.split("ReadSchema")[1]  # scores only, from the shared folder


def test_hot_keys_are_decided_by_broadcast(spark):
    left = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"))
    keys = spark.range(0, 20_000, 3).select(F.col("id").alias("k"))
    want = {r.id for r in left.join(keys, "k").collect()}
    assert {r.id for r in keep_by_key(left, keys, ["k"], ["id"]).collect()} == want
    assert {r.id for r in drop_by_key(left, keys, ["k"], ["id"]).collect()} == set(range(20_000)) - want
    no_key = left.withColumn("k", F.when(F.col("id") % 5 > 0, F.col("k")))
    want = {r.id for r in no_key.join(keys, "k").collect()}
    assert {r.id for r in keep_by_key(no_key, keys, ["k"], ["id"]).collect()} == want
    text = plan(keep_by_key(left, keys, ["k"], ["id"]))
    assert "TakeOrderedAndProject(limit=1000" in text and "BroadcastExchange" in text


class Settings:
    """A session as ``shared_dir`` sees it."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {
            "applicationId": f"app-{master}", "master": master, "getCheckpointDir": lambda self: None})()


def test_shared_folder(spark):
    folder = session.shared_dir(spark)
    assert folder.startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    table = session.shared_table(spark.range(5))
    assert table.count() == 5 and os.listdir(folder)
    assert session.shared_dir(Settings("hdfs://x/", "yarn")) == "hdfs://x/foliolens-app-yarn"
    for master in ("yarn", "local[2]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(Settings(None, master))
