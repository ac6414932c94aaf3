import random
import re

import pytest

from foliolens.operators import boolean, near, ranking, search
from foliolens.plans import merge
from foliolens.plans.query import query, query_many
from tests.rules import CORPUS, document, merged, near_hits, near_pairs, spans, term_hits, whole


def plain(df):
    return [((r.dataset, r.filename, r.filepath, r.pages), r.match_count,
             [tuple(c) for c in r.contexts]) for r in df.collect()]


def same(got, want, most=None):
    want = [(d, n, c[:most] if most else c) for d, n, c in want]
    assert sorted(got) == sorted(want)


def random_docs(seed, n=60, letters="aab \n\fé😀ab", longest=70, names=None):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))
        name = f"f{rng.randint(0, names)}.pdf" if names else f"f{i}.pdf"
        docs.append(document(rng.randint(1, 3), name, text, f"{i:03}/"))
    return docs


@pytest.mark.parametrize("term", ["a", "aa", "b a", " a", "É", "😀"])
def test_search_equals_the_rule(spark, term):
    docs = random_docs(1)
    corpus = spark.createDataFrame(docs, CORPUS)
    want = term_hits(docs, term, 7)
    same(plain(search.search(corpus, term, context_chars=7)), want)
    flat = [tuple(r) for r in search.search_matches(corpus, term, context_chars=7).collect()]
    assert sorted(flat) == sorted((*d, *c) for d, _, cs in want for c in cs)
    counts = {r.filepath: r.match_count for r in search.count_matches(corpus, term).collect()}
    assert counts == {d[2]: n for d, n, _ in want}


@pytest.mark.parametrize("term", ["it's", "a\\", r"\E", "${env:HOME}", "$1", 'say "x"', "\n", "--", "'; '"])
def test_any_text_can_be_a_term(spark, term):
    docs = [document(1, "a.pdf", f"before {term} after {term}"), document(1, "b.pdf", "nothing here")]
    corpus = spark.createDataFrame(docs, CORPUS)
    same(plain(search.search(corpus, term)), term_hits(docs, term))
    same(plain(near.search_near(corpus, "after", term, 0)), near_hits(docs, "after", term, 0))
    same(plain(query(corpus, all=[term], none=["no"], near=[(term, "after", 1)]).page),
         whole(docs, all=[term], none=["no"], near=[(term, "after", 1)]))


def test_snippets_and_pages_in_long_texts(spark):
    text = "x" * 1020 + "needle" + "é" * 2000 + "\f" + "😀" * 700 + "needle" + "y" * 299 + "\f" * 400 + "needle"
    docs = [document(1, "long.pdf", text), document(1, "short.pdf", "needle")]
    same(plain(search.search(spark.createDataFrame(docs, CORPUS), "NEEDLE")), term_hits(docs, "needle"))


def test_many_matches_in_one_document(spark):
    docs = [document(1, "a.pdf", "ab\f " * 20_000)]
    (_, n, ctx), = plain(search.search(spark.createDataFrame(docs, CORPUS), "b", context_chars=2))
    assert n == 20_000 and ctx[-1] == (79_997, "... ab\f ", "b", 20_000)


def test_case_whole_word_and_regex(spark):
    docs = [document(1, "a.pdf", "On on éon on_ on. On2 (on) ON"), document(1, "b.pdf", "none")]
    corpus = spark.createDataFrame(docs, CORPUS)

    def starts(df):
        return [c.position for r in df.collect() for c in r.contexts]

    text = docs[0][4]
    assert starts(search.search(corpus, "On", case_sensitive=True)) == [m.start() for m in re.finditer("On", text)]
    want = [m.start() for m in re.finditer(r"\bon\b", text, re.I)]
    assert starts(search.search(corpus, "on", whole_word=True)) == want
    assert starts(search.search_regex(corpus, r"on[_.]")) == [m.start() for m in re.finditer(r"on[_.]", text)]


def test_page_is_null_without_offsets(spark):
    row = document(1, "a.pdf", "x")[:5]
    corpus = spark.createDataFrame([row + (None,), row + ([],)], CORPUS)
    assert [c.page for r in search.search(corpus, "x").collect() for c in r.contexts] == [None, None]
    bare = corpus.drop("page_offsets")
    assert [c.page for r in search.search(bare, "x").collect() for c in r.contexts] == [None, None]


@pytest.mark.parametrize("term", ["on", "é", "a b", ".a", "b.", "😀", "_", "2"])
def test_whole_word_equals_the_rule(spark, term):
    docs = random_docs(12, letters="abén.o_2 😀\n")
    docs.append(document(1, "z.pdf", "on 2on on2 éon on_ on. .on on\n😀on a.a .a é"))
    corpus = spark.createDataFrame(docs, CORPUS)
    got = {r.filepath: [c.position for c in r.contexts]
           for r in search.search(corpus, term, whole_word=True).collect()}
    word = re.compile(rf"\b{re.escape(term)}\b", re.I)
    want = {d[2]: [m.start() for m in word.finditer(d[4])] for d in docs}
    assert got == {k: v for k, v in want.items() if v}


NEAR_CASES = [("a", "b", 0, 50), ("a", "a", 1, 5), ("aa", "a", 2, 50), ("b a", "a", 1, 50),
              (" a", "b ", 0, 50), ("é", "a", 2, 3), ("b", "a", 9, 50), ("a b", "b a", 3, 50)]


@pytest.mark.parametrize("one, two, n, cap", NEAR_CASES)
def test_near_equals_the_rule(spark, one, two, n, cap):
    docs = random_docs(2)
    corpus = spark.createDataFrame(docs, CORPUS)
    got = near.with_pairs(corpus, one, two, n, cap=cap).select("filepath", "pairs").collect()
    assert {r.filepath: [tuple(p) for p in r.pairs] for r in got} == {
        d[2]: near_pairs(d[4], one, two, n, cap) for d in docs}
    same(plain(near.search_near(corpus, one, two, n, context_chars=5, cap=cap)),
         near_hits(docs, one, two, n, 5, cap))


def test_near_over_long_texts(spark):
    rng = random.Random(9)
    docs = [document(1, f"{k}.pdf", " ".join(rng.choice(["one", "two", "x", "onetwo", "y\n"]) for _ in range(900)))
            for k in range(4)]
    corpus = spark.createDataFrame(docs, CORPUS)
    for n, cap in ((0, 10_000), (6, 10_000), (40, 50)):
        got = near.with_pairs(corpus, "one", "two", n, cap=cap).collect()
        for r in got:
            assert [tuple(p) for p in r.pairs] == near_pairs(r.text, "one", "two", n, cap)
        found = near.search_near_matches(corpus, "one", "two", n, context_chars=3, cap=cap).collect()
        for d in docs:
            want = near_pairs(d[4], "one", "two", n, cap)
            assert sorted(r.position for r in found if r.filepath == d[2]) == sorted(p[0] for p in want)
            assert {r.match_count for r in found if r.filepath == d[2]} <= {len(want)}


def test_pairs_are_counted_without_being_made(spark):
    """400 million pairs of one document: a list of them would not fit the session."""
    n = 20_000
    corpus = spark.createDataFrame([document(1, "wide.pdf", "one " * n + "two " * n)], CORPUS)
    assert [r.match_count for r in near.count_near(corpus, "one", "two", 10**6).collect()] == [n * n]
    assert [r.match_count for r in near.count_near(corpus, "one", "two", 10**6, cap=n + 1).collect()] == [2 * n]
    first = near.search_near(corpus, "one", "two", 10**6, context_chars=2, max_contexts=3).collect()[0]
    assert first.match_count == n * n and len(first.contexts) == 3


def by_path(doc):
    return doc[2]


def by_name(doc):
    return doc[1]


def test_and_or_not_unique(spark):
    docs = random_docs(3, letters="abcd ")
    corpus = spark.createDataFrame(docs, CORPUS)
    same(plain(boolean.search_all(corpus, ["a", "bc", "d"], unique_key=True)),
         whole(docs, all=["a", "bc", "d"], key=by_path))
    same(plain(boolean.search_any(corpus, ["ab", "cd"], unique_key=True)),
         whole(docs, any=["ab", "cd"], key=by_path))
    same(plain(boolean.exclude_terms(search.search(corpus, "a"), corpus, ["bc", "dd"])),
         whole(docs, all=["a"], none=["bc", "dd"], key=by_path))


@pytest.mark.parametrize("seed", [4, 5])
def test_and_or_not_near_by_name(spark, seed):
    docs = random_docs(seed, letters="abcde ", longest=12, names=15)
    corpus = spark.createDataFrame(docs, CORPUS)
    same(plain(boolean.search_all(corpus, ["a", "bc", "d"])), whole(docs, all=["a", "bc", "d"]))
    same(plain(boolean.search_any(corpus, ["ab", "cd"], max_contexts=2)), whole(docs, any=["ab", "cd"]), 2)
    same(plain(boolean.exclude_terms(search.search(corpus, "a"), corpus, ["bc", "dd"])),
         whole(docs, all=["a"], none=["bc", "dd"]))
    got = boolean.merge_near(search.search(corpus, "ab"), [near.search_near(corpus, "a", "d", 1),
                                                           near.search_near(corpus, "e", "c", 0)], max_contexts=3)
    same(plain(got), whole(docs, all=["ab"], near=[("a", "d", 1), ("e", "c", 0)]), 3)
    with pytest.raises(ValueError, match="max_contexts"):
        boolean.search_any(corpus, ["ab", "cd"])
    rows = boolean.search_any_rows(corpus, ["ab", "cd"])
    assert rows.count() == sum(n for _, n, _ in whole(docs, any=["ab", "cd"]))
    nameless = boolean.search_any_rows(spark.createDataFrame([(1, None, "p", 1, "ab ab", [0])], CORPUS), ["ab"])
    assert [r.match_count for r in nameless.collect()] == [2, 2]
    key = ["dataset", "filename"]
    same(plain(boolean.search_all(corpus, ["a", "bc"], key=key)),
         whole(docs, all=["a", "bc"], key=lambda d: d[:2]))


QUERIES = [
    dict(all=["a"]),
    dict(all=["a", "bc"]),
    dict(all=["a"], none=["dd", "bb"]),
    dict(all=["a", "c"], none=["bb"]),
    dict(any=["ab", "cd", "e"]),
    dict(any=["ab", "cd"], none=["ee"]),
    dict(near=[("a", "d", 1)]),
    dict(all=["ab"], near=[("a", "d", 1), ("e", "c", 0)]),
    dict(all=["a", "c"], none=["ee"], near=[("b", "d", 0)]),
    dict(any=["ab", "ce"], none=["dd"], near=[("b", "d", 0)]),
]


@pytest.mark.parametrize("clauses", QUERIES, ids=str)
@pytest.mark.parametrize("unique", [True, False])
def test_whole_query_equals_the_rule(spark, clauses, unique):
    docs = random_docs(6, n=50, letters="abcde  ", longest=20, names=None if unique else 20)
    corpus = spark.createDataFrame(docs, CORPUS)
    want = whole(docs, **clauses, key=by_path if unique else by_name, chars=4)
    result = query(corpus, **clauses, unique_key=unique, per_page=1000, context_chars=4, max_contexts=6)
    got = [((r.dataset, r.filename, r.filepath, r.pages), r.match_count) for r in result.hits.collect()]
    assert sorted(got) == sorted((d, n) for d, n, _ in want)
    same(plain(result.page), want, 6)
    ranked = [tuple(r) for r in result.page.orderBy("rank").select("match_count", "dataset", "filename").collect()]
    assert ranked == sorted(ranked, key=lambda r: (-r[0], r[1], r[2]))
    assert tuple(result.totals.first()) == (len(want), sum(n for _, n, _ in want))


def test_query_filters_order_and_pages(spark):
    docs = random_docs(7, n=40, letters="ab\f", longest=12)
    corpus = spark.createDataFrame(docs, CORPUS)
    want = [(d, n) for d, n, _ in term_hits(docs, "a") if d[0] == 2 and 1 <= d[3] <= 3]
    want.sort(key=lambda h: (h[0][1], h[0][0]))
    pages = [query(corpus, all=["a"], dataset=2, min_pages=1, max_pages=3, sort="filename", page=p, per_page=3)
             for p in (1, 2)]
    got = [(r.filename, r.rank) for q in pages for r in q.page.orderBy("rank").collect()]
    assert got == [(h[0][1], i % 3 + 1) for i, h in enumerate(want[:6])]
    assert query(corpus, all=["a"], max_pages=0).totals.first().total == 0


def test_switches_hold_for_whole_searches(spark):
    rows = [document(1, "a.pdf", "The cat sat. the cats"), document(1, "b.pdf", "the Cat, the dog"),
            document(2, "a.pdf", "THE concat of dogs")]
    corpus = spark.createDataFrame(rows, CORPUS)

    def hits(unique=True, **clauses):
        found = query(corpus, **clauses, key=["dataset", "filename"], unique_key=unique)
        assert sorted(r.match_count for r in found.page.collect()) == sorted(r.match_count for r in found.hits.collect())
        return sorted((r.dataset, r.filename, r.match_count) for r in found.hits.collect())

    for unique in (True, False):
        assert hits(unique, all=["the", "cat"], case_sensitive=True) == [(1, "a.pdf", 1)]
        assert hits(unique, all=["the", "cat"], whole_word=True) == [(1, "a.pdf", 2), (1, "b.pdf", 2)]
        assert hits(unique, any=["cats?"], none=["dog$"], regex=True) == [(1, "a.pdf", 2), (2, "a.pdf", 1)]
        assert hits(unique, near=[("the", "dog", 0)], case_sensitive=True) == [(1, "b.pdf", 1)]
    many = query_many(corpus, {"x": dict(all=["The"], case_sensitive=True), "y": dict(all=["dogs?"], regex=True)},
                      unique_key=True)
    assert sorted((r.query_name, r.filename) for r in many.collect()) == [("x", "a.pdf"), ("y", "a.pdf"), ("y", "b.pdf")]
    got = boolean.search_all(corpus, ["cat", "the"], key=["dataset", "filename"], case_sensitive=True)
    assert [r.filename for r in got.collect()] == ["a.pdf"]
    got = boolean.search_any(corpus, ["Cat", "dog"], unique_key=True, case_sensitive=True, whole_word=True)
    assert [(r.filename, r.match_count) for r in got.collect()] == [("b.pdf", 2)]
    with pytest.raises(Exception, match="empty string"):
        query(corpus, all=["(?=the)"], regex=True, unique_key=True).hits.collect()
    with pytest.raises(ValueError, match="whole_word"):
        query(corpus, all=["a"], regex=True, whole_word=True)


def test_ranks_of_all_hits_and_deep_pages(spark, monkeypatch):
    rows = [(i % 3, f"{i % 7}.pdf", f"/{i:03d}", 1, i % 5) for i in range(200)] + [(None, None, "/x", 1, 9)]
    hits = spark.createDataFrame(rows, "dataset int, filename string, filepath string, pages int, match_count int").repartition(5)
    for sort in ranking.ORDERS:
        want = [r.filepath for r in ranking.sort_hits(hits, sort).collect()]
        ranked = ranking.rank_hits(hits, sort, partitions=6)
        got = sorted((r["rank"], r.filepath) for r in ranked.collect())
        assert got == list(enumerate(want, 1))
    page = sorted((r["rank"], r.filepath) for r in ranking.ranked_page(ranked, 5, 20).collect())
    assert page == list(enumerate(want, 1))[80:100]
    want = {r.filepath for r in ranking.page_hits(hits, 4, 30).collect()}
    monkeypatch.setattr(ranking, "TOP_ROWS", 50)
    assert {r.filepath for r in ranking.page_hits(hits, 4, 30).collect()} == want
    assert ranking.page_hits(hits, 1 << 40, 20).collect() == []
    assert ranking.rank_hits(hits.filter("false")).collect() == []


def test_first_contexts_of_a_name_that_most_documents_share(spark):
    rows = [(1, "hot" if i % 10 else f"{i}", f"/{i:04d}", 0, [(i, "c", "m", 1)] * 2) for i in range(600)]
    parts = spark.createDataFrame(rows, "dataset int, filename string, filepath string, part int, "
                                        "contexts array<struct<position:int,context:string,match:string,page:int>>")
    got = {r.filename: [c.position for c in r.contexts] for r in merge.first_contexts(parts, ["filename"], 5).collect()}
    assert got["hot"] == [1, 1, 2, 2, 3] and got["590"] == [590, 590] and len(got) == 61


def test_query_many_equals_single_queries(spark):
    docs = random_docs(8, n=40, letters="abcde ", longest=20, names=12)
    corpus = spark.createDataFrame(docs, CORPUS)
    saved = {"x": dict(any=["ab", "c"], min_pages=1), "y": dict(all=["a", "d"], none=["e"], dataset=1),
             "z": dict(near=[("a", "b", 1)])}
    for unique in (True, False):
        got = query_many(corpus, saved, unique_key=unique)
        for name, clauses in saved.items():
            one = query(corpus, **clauses, unique_key=unique).hits
            columns = one.columns
            assert sorted(map(tuple, got.filter(f"query_name = '{name}'").select(columns).collect())) == \
                sorted(map(tuple, one.collect()))
    with pytest.raises(ValueError):
        query_many(corpus, {"x": dict(any=["a"], nonsense=1)})


def test_wrong_arguments(spark):
    corpus = spark.createDataFrame([document(1, "a.pdf", "x")], CORPUS)
    for bad in (dict(), dict(all=["a"], any=["b"]), dict(none=["a"]), dict(all=["a"], page=0),
                dict(all=["a"], per_page=10_001), dict(near=[("a", "b", -1)])):
        with pytest.raises(ValueError):
            query(corpus, **bad)
    with pytest.raises(ValueError):
        ranking.select_datasets(corpus, [0])
    with pytest.raises(ValueError):
        ranking.sort_hits(corpus, "size")


def test_cap_contexts_and_spans(spark):
    corpus = spark.createDataFrame([document(1, "a.pdf", "x x x x")], CORPUS)
    row = ranking.cap_contexts(search.search(corpus, "x"), 3).first()
    assert (len(row.contexts), row.more, row.match_count) == (3, 1, 4)
    got = [(r.start, r.end) for r in search.match_spans(corpus, "x").collect()]
    assert got == spans("x x x x", "x")


def test_merge_rule_is_by_key():
    a, b = ((1, "x", "/1", 1), 1, ["p"]), ((2, "x", "/2", 1), 2, ["q"])
    assert merged([a, b], by_name) == [((1, "x", "/1", 1), 3, ["p", "q"])]
