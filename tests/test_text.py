import random

import pytest
from pyspark.sql import functions as F

from foliolens.functions import text as fx, urls
from foliolens.functions.arrays import blocks, count_while, running_totals, search_steps
from foliolens.functions.content import content_kind, content_preview, has_magic
from foliolens.functions.content import content_kind
from foliolens.functions.patterns import regex_pattern, term_pattern
from foliolens.operators.spans import with_spans
from tests.rules import offsets

SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0      　"


def rows(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_word_count_and_strip_use_every_white_space(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab" + SPACES) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    got = rows(spark, texts).select("v", fx.word_count(F.col("v")), fx.strip(F.col("v")), fx.text_length(F.col("v")))
    for v, words, stripped, length in got.collect():
        assert (words, stripped, length) == (len(v.split()), v.strip(), len(v))


def test_page_offsets(spark):
    texts = ["a\fb\f", "", "\f\f", "no page break", "é😀\fx" * 400]
    got = rows(spark, texts).select("v", fx.page_offsets("v")).collect()
    assert [list(o) for _, o in got] == [offsets(v) for v, _ in got]
    assert list(got[0][1]) == [0, 2, 4]


def test_position_to_page(spark):
    df = spark.createDataFrame([([0, 2, 4], p) for p in range(6)] + [(None, 1), ([], 1), ([3], 1)],
                               "o array<int>, p int")
    got = [r[0] for r in df.select(fx.position_to_page(F.col("p"), F.col("o"))).collect()]
    assert got == [1, 1, 2, 2, 3, 3, None, None, 1]


def test_running_totals_and_counts_over_blocks(spark):
    rng = random.Random(5)
    lists = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 127, 128, 129, 300, 1000)]
    df = rows(spark, lists, "array<int>").select("v", F.expr(running_totals("v")).alias("t"))
    for v, t in df.collect():
        assert list(t) == [sum(v[:i + 1]) for i in range(len(v))]
    for probe in (-1, 0, 1, 5, 500, 2000, 10 ** 6):
        count = count_while(search_steps("t"), lambda i: f"get(t, {i}) <= {probe}")
        for t, n in df.select("t", F.expr(count)).collect():
            assert n == sum(x <= probe for x in t)
    cut = df.select("v", F.expr(blocks("v", 100))).collect()
    assert [[len(b) for b in parts] for v, parts in cut] == [
        [100] * (len(v) // 100) + [len(v) % 100] * (len(v) % 100 > 0) for v, _ in cut]


def test_preview(spark):
    got = rows(spark, ["a" * 500, "a" * 501]).select(
        fx.text_preview(F.col("v")), fx.text_preview(F.col("v"), always_dots=True)).collect()
    assert [len(x) for r in got for x in r] == [500, 503, 503, 503]


def test_parse_info_and_lenient_pages(spark):
    raw = "Title: x\nno entry\nPages:  12 \nAuthor: a: b\nTitle: later\nEmpty:\n"
    info = rows(spark, [raw]).select(fx.parse_info(F.col("v"))).first()[0]
    assert info == {"Title": "later", "Pages": "12", "Author": "a: b", "Empty": ""}
    got = rows(spark, ["12", "abc", None, " 7 ", ""]).select(fx.lenient_int(F.col("v"))).collect()
    assert [r[0] for r in got] == [12, 0, 0, 7, 0]


def test_content(spark):
    df = rows(spark, [b"%PDF-1.4 x", b"<html>", b"", None, b"\n<!DOCTYPE HTML>", b"\xff\x00"], "binary")
    got = df.select(has_magic(F.col("v")), content_kind(F.col("v")), content_preview(F.col("v"), 3)).collect()
    assert [r[0] for r in got] == [True, False, False, False, False, False]
    assert [r[1] for r in got] == ["pdf", "html", "empty", "empty", "html", "other"]
    assert got[0][2] == "%PD"


def test_urls(spark):
    base = "https://www.h.org/sets/data-set-1-files?page=2"
    links = ["a.pdf", "/a.pdf?x=1", "//h/a.pdf", "https://h/a%20b.pdf", "A.PDF", "?page=3", "#top"]
    got = rows(spark, links).select(urls.resolve_url(F.col("v"), F.lit(base))).collect()
    assert [r[0] for r in got] == [
        "https://www.h.org/sets/a.pdf", "https://www.h.org/a.pdf?x=1", "https://h/a.pdf",
        "https://h/a%20b.pdf", "https://www.h.org/sets/A.PDF",
        "https://www.h.org/sets/data-set-1-files?page=3", base + "#top"]
    names = rows(spark, ["https://h/x/a%20b%28c%29%41.pdf?y=/z"]).select(
        urls.decode_filename(urls.url_filename(F.col("v")))).first()[0]
    assert names == "a b(c)%41.pdf"


@pytest.mark.parametrize("path, allowed", [
    ("/a.PDF?x=.exe", True), ("/a.exe", False), ("/folder/", True), ("/.hidden", True), ("/a.tar.js", True),
    ("/a.", False), ("/d.exe/file", True), ("", True)])
def test_allowed_ext(spark, path, allowed):
    assert rows(spark, [path]).select(urls.allowed_ext(F.col("v"))).first()[0] is allowed


def test_page_number_and_listing_url(spark):
    got = rows(spark, ["/x?page=12", "/x?a=1&page=3", "/x?homepage=4", "/x"]).select(urls.page_number(F.col("v")))
    assert [r[0] for r in got.collect()] == [12, 3, None, None]
    got = rows(spark, [0, 2], "int").select(urls.listing_url(F.lit("b"), F.col("v"))).collect()
    assert [r[0] for r in got] == ["b", "b?page=2"]


@pytest.mark.parametrize("term", ["a.b", "(x)", r"\E", r"x\Ey\Q", "$1", "it's", "a\\"])
def test_terms_are_literal(spark, term):
    df = rows(spark, [f"one {term} two", "a-b (y) E Q 1"])
    got = df.select(F.regexp_extract_all("v", F.lit(term_pattern(term)), F.lit(0))).collect()
    assert [list(r[0]) for r in got] == [[term], []]


def test_empty_patterns_are_refused(spark):
    for build in (regex_pattern, term_pattern):
        with pytest.raises(ValueError):
            build("")
    texts = rows(spark, ["the cat the dog the"])
    for pattern in ("x*", r"\b", "(?=the)"):
        with pytest.raises(Exception, match="matched the empty string"):
            with_spans(texts, regex_pattern(pattern), text="v").collect()


def test_anchor_targets(spark):
    html = ("<a href='x.pdf'>1</a><a class=k href=y.pdf>2</a><a data-href=\"z.pdf\" href=\"w.pdf\">3</a><A HREF = \"v.pdf\">4</A>"
            "<a title='href=t.pdf' rel href=\"u.pdf?a=1&amp;b=2\">5</a><area href=\"no.pdf\"><a name=\"n.pdf\">6</a>")
    got = rows(spark, [html, None]).select(urls.hrefs("v")).collect()
    assert list(got[0][0]) == ["x.pdf", "y.pdf", "w.pdf", "v.pdf", "u.pdf?a=1&b=2"] and got[1][0] is None


def test_html_behind_blanks(spark):
    df = rows(spark, [" " * 500 + "<!DOCTYPE html><p>", " " * 500, "x <html>"])
    assert [r[0] for r in df.select(content_kind(F.col("v").cast("binary"))).collect()] == ["html", "other", "other"]


def test_join_pages(spark):
    df = spark.createDataFrame([([(2, "b "), (1, " a"), (3, None)],)], "p array<struct<page_number int, text string>>")
    joined = fx.join_pages(F.col("p"))
    text, length = df.select(joined["full_text"], joined["text_length"]).first()
    assert (text, length) == ("a\n\nb", len(" a\n\nb \n\n\n\n"))
