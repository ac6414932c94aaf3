"""Splittable JSON arrays, pages by seeking, and the fixed-size filter of names."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foliolens.operators import links, ranking
from foliolens.plans.name_filter import may_be_in
from foliolens.schema import CORPUS
from foliolens.sources import index
from foliolens.sources.json_array import array_objects, read_json_array
from tests.rules import document


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


ODD = ['}', '{', '"', '\\', '\\"}{', 'a"}, {"b', '[]', ']', '', 'é\n}', '\\\\"', '{"x": [}']


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_equals_json_lines(spark, tmp_path, small_splits, indent):
    pick = random.Random(7)
    rows = [document(n % 3 + 1, f"{n}.pdf", "".join(pick.choice(ODD + ["word "]) for _ in range(pick.randrange(40)))) for n in range(150)]
    rows.append(document(1, "long.pdf", "{}" * 3000))
    objects = [dict(zip(CORPUS.fieldNames(), r)) for r in rows]
    objects = [o | {"nested": [{"a": [1, {"b": "}"}]}, []]} for o in objects]
    for i in range(2):
        (tmp_path / "array").mkdir(exist_ok=True)
        (tmp_path / "array" / f"{i}.json").write_text(json.dumps(objects[i::2], indent=indent, ensure_ascii=i == 0), encoding="utf-8")
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, objects)))
    lines = index.read_index(spark, str(tmp_path / "lines.json"), "json")
    array = index.read_index(spark, str(tmp_path / "array"), "json_array")
    assert array.columns == lines.columns and sorted(map(str, array.collect())) == sorted(map(str, lines.collect()))
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "array")).rdd.getNumPartitions() > 20  # more tasks than files


def test_json_array_of_odd_elements(spark, tmp_path, small_splits):
    for name, text in {"empty": "[]", "blank": " [ ] \n", "mixed": '[1, "}", null, {"a": 1}, [2], {"a": 2} , {"a": {}}]', "nothing": ""}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted(json.dumps(json.loads(r.text)) for r in array_objects(spark, str(tmp_path)).collect()) == ['{"a": 1}', '{"a": 2}', '{"a": {}}']
    assert read_json_array(spark, str(tmp_path / "empty.json"), CORPUS).count() == 0


@pytest.mark.parametrize("sort", ["relevance", "filename", "dataset"])
def test_pages_by_seeking_are_pages_by_rank(spark, sort):
    pick = random.Random(3)
    rows = [(pick.choice([None, 1, 2]), pick.choice([None, "a", "b", "c"]), f"/{n}" if n else None, 1, pick.choice([None, 1, 2, 3])) for n in range(97)]
    hits = spark.createDataFrame(rows, "dataset int, filename string, filepath string, pages int, match_count int")
    want = [r.filepath for r in ranking.sort_hits(hits, sort).collect()]
    got, last = [], None
    while page := ranking.page_after(hits, last, 10, sort).collect():
        got += [r.filepath for r in page]
        last = page[-1]
    assert got == want
    plan = ranking.page_after(hits, last, 10, sort)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=10" in plan and "Window" not in plan


def test_name_filter_never_misses(spark):
    keys = spark.range(3000).select((F.col("id") % 7).cast("int").alias("d"), F.concat(F.lit("f"), "id").alias("f"))
    keys = keys.unionByName(spark.createDataFrame([(None, "x"), (1, None)], "d int, f string"))
    other = spark.range(5000).select(F.lit(9).alias("d"), F.concat(F.lit("g"), "id").alias("f"))
    assert may_be_in(keys, keys, ["d", "f"], "m").filter("NOT m").count() == 0
    assert may_be_in(other, keys, ["d", "f"], "m").filter("m").count() < 10
    assert may_be_in(other, keys.limit(0), ["d", "f"], "m").filter("m").count() == 0


def test_newer_links(spark):
    found = spark.createDataFrame([(1, "u1", "a"), (1, "u1", "a"), (1, "u2", "b"), (2, "u1", "a")], "dataset int, url string, filename string")
    planned = spark.createDataFrame([(1, "u1"), (1, "u1"), (3, "u2")], "dataset int, url string")
    assert sorted(tuple(r) for r in links.newer_links(found, planned).collect()) == [(1, "u2", "b"), (2, "u1", "a")]
