"""Saved queries give the same hits whichever pass they take."""

import random

import pytest

from foliolens.plans import query as plans
from tests.rules import CORPUS, document

WORDS = ["alpha", "beta", "Gamma", "STRASSE", "straße", "delta", "gam", "x", "alphabet"]


@pytest.fixture(scope="module")
def corpus(spark):
    pick = random.Random(6)
    rows = [document(1 + n % 3, f"{n % 17}.pdf", " ".join(pick.choice(WORDS) for _ in range(pick.randrange(12)))) for n in range(160)]
    rows.append(document(2, "long.pdf", "a" * 70_000 + "gamma" + "b" * 70_000 + "delta"))
    return spark.createDataFrame(rows, CORPUS).cache()


QUERIES = {
    "one": dict(all=["alpha"]), "two": dict(all=["beta", "GAMMA"]), "not": dict(all=["gam"], none=["delta"]), "any": dict(any=["straße", "delta"]),
    "any_not": dict(any=["gamma", "beta"], none=["alphabet", "strasse"]), "short": dict(all=["x"]), "short_not": dict(all=["delta"], none=["x"]),
    "case": dict(all=["Gamma"], case_sensitive=True), "word": dict(all=["alpha", "gam"], whole_word=True), "near": dict(near=[("alpha", "beta", 3)]),
    "set": dict(all=["alpha"], dataset=2), "pages": dict(any=["alpha", "beta"], min_pages=2), "most": dict(all=["beta"], max_pages=1),
    "regex": dict(all=["g[ae]mma"], regex=True), "absent": dict(all=["nowhere", "alpha"]), "both": dict(all=["delta", "alpha", "beta"], none=["gamma"]),
    "same": dict(any=["alpha", "alphabet"]), "near_not": dict(all=["alpha"], none=["beta"], near=[("gamma", "delta", 2)]),
}


@pytest.mark.parametrize("unique_key", [True, False])
def test_both_passes_agree(corpus, monkeypatch, unique_key):
    found = []
    for few in (0, 10**6):
        monkeypatch.setattr(plans, "FEW_QUERIES", few)
        df = plans.query_many(corpus, QUERIES, unique_key=unique_key)
        found.append(sorted(map(str, df.select(sorted(df.columns)).collect())))
    assert found[0] == found[1] and len({r.split("query_name='")[1] for r in found[0]}) >= 8


def test_a_text_meets_only_the_queries_whose_trigrams_it_has(corpus):
    queries = {f"q{i}": dict(all=[f"term{i:04d}"]) for i in range(2000)} | {"hit": dict(all=["alphabet"])}
    df = plans.query_many(corpus, queries, unique_key=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert {r.query_name for r in df.collect()} == {"hit"} and "BroadcastHashJoin" in plan and "Python" not in plan


def test_too_many_queries_are_refused(spark):
    from foliolens.plans.percolate import MAX_QUERIES, Saved, probed

    with pytest.raises(ValueError, match="at most"):
        probed(spark, [Saved(str(i), ["a"], [], [], False, ["abc"]) for i in range(MAX_QUERIES + 1)])


def test_each_text_is_tested_once_for_a_query(spark, tmp_path):
    """Filters on the counts stay above the join, where the text is known, and do not repeat its tests."""
    from workload import searches, tables

    pick = random.Random(9)
    rows = [(n, " ".join(pick.choice(["bab", "tes", "license", "the", "nim", "sorted", "tan"]) for _ in range(40)), "en", f"src{n % 24}")
            for n in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = plans.query_many(tables.corpus(spark, str(tmp_path)), searches.saved_queries(300), unique_key=True)
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    tests = [line for line in plan if "text" in line and ("RLIKE" in line or "regexp_like" in line)]
    assert len(tests) == 1 and "Generate" in tests[0]


def test_a_text_without_a_trigram_is_not_tested_for_its_term(spark, corpus):
    from foliolens.plans import percolate

    rows = percolate.probed(spark, [plans._saved(n, plans._spec(q.get("all"), q.get("any"), q.get("none"), None), q, True)
                                    for n, q in {"a": dict(any=["alpha", "delta"], none=["beta"]), "b": dict(all=["gamma", "x"])}.items()])
    assert [r[0] for r in rows] == ["a"] and all(gram for clause in rows[0][1:4] for _, gram in clause)
    plan = percolate.scores(corpus, rows, alone=True)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    counts = [i for i, line in enumerate(plan) if "regexp_extract_all(text" in line]
    flags = [i for i, line in enumerate(plan) if "RLIKE" in line]
    assert len(counts) == len(flags) == 1 and flags[0] < counts[0] and all("array_contains" in plan[i] for i in counts + flags)
