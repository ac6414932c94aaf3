"""Postings narrow a corpus to the documents that may match, and lose none that does."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliolens.functions.trigrams import folded, required_literals
from foliolens.operators import boolean, near, search
from foliolens.plans.skipping import intervals
from foliolens.sources import signatures
from tests.rules import CORPUS, document, scanned

WORDS = ["alpha", "Straße", "STRASSE", "İstanbul", "istanbul", "ΟΔΟΣ", "οδος", "οδοσε", "naïve", "ſure", "sure", "K2", "x", "𝒳𝒴𝒵", "tail"]


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    pick = random.Random(2)
    rows = [document(1 + n % 3, f"{n:05d}.pdf", " ".join(pick.choice(WORDS) for _ in range(30)) + (" needle-in-hay" if n == 377 else ""))
            for n in range(1200)]
    rows += [document(3, "long.pdf", "a" * 70_000 + "Rare" + "b" * 65_535 + "Edge" + "c" * 9), document(3, "none.pdf", "")]
    folder = str(tmp_path_factory.mktemp("signed") / "index")
    spark.conf.set("parquet.block.size", 4096)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 50)
    try:
        signatures.write_indexed(spark.createDataFrame(rows, CORPUS), folder, partitions=4)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    return folder


@pytest.fixture(scope="module")
def corpus(spark, path):
    return signatures.read_indexed(spark, path).drop("doc_no")


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("term", WORDS + ["needle-in-hay", "raRe", "edGe", "strasse", "σο", "ab", "a" * 40, "absent term", "BEdgec"])
def test_search_over_narrowed_is_search_over_all(spark, path, corpus, term):
    got = signatures.narrowed(spark, path, all=[term])
    assert rows(search.count_matches(got, term)) == rows(search.count_matches(corpus, term))
    assert rows(search.count_matches(got, term, case_sensitive=True)) == rows(search.count_matches(corpus, term, case_sensitive=True))


def test_clauses_over_narrowed(spark, path, corpus):
    both = signatures.narrowed(spark, path, all=["needle", "alpha"])
    assert rows(near.count_near(both, "needle", "alpha", 50)) == rows(near.count_near(corpus, "needle", "alpha", 50))
    either = signatures.narrowed(spark, path, any=["needle-in", "rare"])
    assert rows(boolean.search_any(either, ["needle-in", "rare"], unique_key=True)) == \
        rows(boolean.search_any(corpus, ["needle-in", "rare"], unique_key=True))
    pattern = r"needle-\w+-(hay|straw)"
    assert rows(search.search_regex(signatures.narrowed_by_pattern(spark, path, pattern), pattern)) == rows(search.search_regex(corpus, pattern))


def test_a_rare_term_reads_little(spark, path, corpus):
    assert scanned(search.count_matches(corpus, "needle-in-hay")) == 1202
    assert scanned(search.count_matches(signatures.narrowed(spark, path, all=["needle-in-hay"]), "needle-in-hay")) <= 200


def test_folding_agrees_with_patterns(spark):
    """Whatever a case-insensitive pattern takes for the same letter folds alike."""
    pairs = set()
    for code in [*range(32, 0xD800), *range(0xE000, 0x11000), *range(0x1E900, 0x1E944), *range(0x10400, 0x10450)]:
        c = chr(code)
        for other in {c.lower(), c.upper(), c.title(), c.casefold(), c.lower().upper(), c.upper().lower(), "i", "s", "k", "σ"}:
            if len(other) == 1 and other != c:
                pairs.add((c, other))
    df = spark.createDataFrame(sorted(pairs), "a string, b string")
    same = F.expr(r"regexp_like(b, concat('(?iu)^\\Q', a, '\\E$'))")
    assert df.filter(same).count() > 2000
    assert df.filter(same & (folded(F.col("a")) != folded(F.col("b")))).collect() == []


def test_folding_is_letter_by_letter(spark):
    pick = random.Random(5)
    texts = [("".join(pick.choice("ΑΣσς sΣ.İiß") for _ in range(9)), pick.randrange(9)) for _ in range(300)]
    df = spark.createDataFrame([(t[:k], t[k:], t) for t, k in texts], "a string, b string, t string")
    assert df.filter(F.concat(folded(F.col("a")), folded(F.col("b"))) != folded(F.col("t"))).count() == 0


@pytest.mark.parametrize("pattern,want", [
    ("license", ["license"]), ("lic[ei]nse", ["lic", "nse"]), ("a|b", []), ("(a|b)cd", ["cd"]), ("colou?r", ["colo", "r"]), ("ab*c", ["a", "c"]),
    ("ab+c", ["ab", "c"]), ("ab{2,3}c", ["a", "c"]), (r"\Qa|b\Ec", ["a|bc"]), (r"1\.5\d", ["1.5"]), (r"\bword\b", ["word"]), ("^x.y$", ["x", "y"]),
    (r"(?x)a b", []), (r"(?i)ab", ["ab"]), (r"\x41bc d", [" d"]), (r"[a[bc]&&[^d]]e", ["e"]), (r"[]a]b", ["b"]), (r"[^]a]b", ["b"]), (r"\p{L}ab", ["ab"]), ("a(?=b)c", ["a", "c"]),
    (r"[\]]z", ["z"]), ("((a)b)c", ["c"]), ("x(y)?z", ["x", "z"])])
def test_required_literals(pattern, want):
    assert required_literals(pattern) == want


def test_required_literals_are_in_every_match():
    pick = random.Random(9)
    for _ in range(300):
        parts = [pick.choice(["ab", "c", "[de]", "(f|gh)", "x?", "y+", "z*", ".", r"\d", r"\."]) for _ in range(5)]
        pattern = "".join(parts)
        text = "".join(pick.choice("abcdefghxyz1.") for _ in range(3000))
        for match in re.finditer(pattern, text):
            assert all(one in match[0] for one in required_literals(pattern))


def test_intervals():
    assert intervals([5, 1, 2, 9], 2) == [(1, 5), (9, 9)] and intervals([3, 3]) == [(3, 3)] and intervals([]) == []
    assert intervals(list("abcdef"), 2) == [("a", "c"), ("d", "f")]


def test_neighbours_go_to_the_postings_as_lists(spark, tmp_path, monkeypatch):
    """Each trigram of each document is in one list, once, whatever goes through a task together; lists are grouped, not numbers."""
    texts = ["Abcabc", "", None, "ab", "xab𝒳𝒴𝒵c", "a" * 70_000 + "Rare" + "b" * 65_535 + "a" * 9, "cabca"] * 3
    numbers = [(1 << 33) * (i % 2) + (1 << 16) * (i % 3) + i for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(numbers, texts)), "doc_no long, text string").coalesce(1)
    want = {(text.upper()[i:i + 3], number) for number, text in zip(numbers, texts) if text for i in range(len(text) - 2)}
    for most in (1, 8, signatures.AT_ONCE):
        monkeypatch.setattr(signatures, "AT_ONCE", most)
        signatures.write_postings(docs, str(tmp_path / f"grams{most}"))
        lists = spark.read.schema(signatures.POSTINGS).parquet(str(tmp_path / f"grams{most}")).collect()
        got = [(r.gram, (r.segment << signatures.SEGMENT_BITS) + doc) for r in lists for doc in r.docs]
        assert sorted(got) == sorted(want) and all(r.docs == sorted(r.docs) for r in lists)
    batches = list(signatures._partial_lists([pa.RecordBatch.from_pydict({"doc_no": list(range(500)), "piece": ["abcdef"] * 500})]))
    assert sum(b.num_rows for b in batches) == 4
