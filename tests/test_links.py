from pyspark.sql import functions as F

from foliolens.functions import html as markup
from foliolens.operators import links

HTML = """<html><nav aria-label="Pagination"><a class="x" href="/s?page=1">2</a> <a href="/s?page=4">5</a></nav>
<a href="/f/a.pdf">A</a><a title="t" href="b.pdf?x=1">B</a><A HREF="https://o/c.PDF">C</A><a href="/f/a.pdf">again</a>
<a href="/about">about</a> <a href="/s?page=9"><b>Last</b> page</a></html>"""


def listing(spark, pages):
    return spark.createDataFrame([(d, n, "https://h/d/list", html) for d, n, html in pages],
                                 "dataset int, page_num int, base_url string, html string")


def test_links(spark):
    pages = listing(spark, [(1, 0, HTML), (1, 3, HTML), (1, 12, HTML)])
    found = links.extract_links(pages)
    one = sorted(r.url for r in found.filter("page_num = 0").collect())
    assert one == ["https://h/d/b.pdf?x=1", "https://h/f/a.pdf", "https://h/f/a.pdf"]
    loose = links.extract_links(pages, ignore_case=True).filter("page_num = 0").collect()
    assert {r.filename for r in loose} == {"a.pdf", "b.pdf", "c.PDF"}
    batches = links.distinct_links(found).groupBy("batch").count().collect()
    assert {r.batch: r["count"] for r in batches} == {0: 2, 1: 2}

    have = spark.createDataFrame([(1, "b.pdf"), (2, "a.pdf")], "dataset int, filename string")
    plan = links.plan_fetch(found, have)
    assert {r.batch: (r.links, r.existing) for r in plan.collect()} == {0: (2, 1), 1: (2, 1)}
    assert tuple(links.plan_fetch_totals(plan).first()) == (1, 4, 2)
    assert [r.url for r in links.pending_links(found, have).collect()] == ["https://h/f/a.pdf"]


def test_fallback_patterns(spark):
    pages = listing(spark, [(1, 0, '<i href="x.pdf">'), (2, 0, "see https://o/y.pdf or"), (3, 0, "at /sites/z.pdf now"),
                            (4, 0, "none")])
    got = {r.dataset: r.href for r in links.extract_links_fallback(pages).collect()}
    assert got == {1: "x.pdf", 2: "https://o/y.pdf", 3: "/sites/z.pdf"}


def test_last_page(spark):
    no_last = HTML.replace("Last", "Next")
    pages = listing(spark, [(1, 0, HTML), (2, 0, no_last), (3, 0, "<nav></nav>"),
                            (4, 0, no_last.replace("Next", "Last").replace("page=9", "p=9"))])
    got = {r.dataset: r.last_page for r in links.last_page(links.pagination_links(pages), pages).collect()}
    assert got == {1: 9, 2: 4, 3: 0, 4: 4}  # set 3 has no pagination links at all
    urls = links.listing_urls(spark.createDataFrame([(3, 1)], "dataset int, last_page int"), F.lit("u"))
    assert sorted(r.url for r in urls.collect()) == ["u", "u?page=1"]


def test_hot_file_name_and_outcomes(spark):
    many = spark.range(3000).select(
        F.lit(1).alias("dataset"), F.lit(0).alias("page_num"), F.concat(F.lit("https://h/"), "id").alias("url"),
        F.when(F.col("id") % 3 > 0, "same.pdf").otherwise(F.concat("id", F.lit(".pdf"))).alias("filename"))
    have = many.filter("filename <> 'same.pdf'").select("dataset", "filename").limit(600)
    assert links.pending_links(many, have).count() == 2400
    assert tuple(links.name_clashes(many).first()) == (1, "same.pdf", 2000)
    outcomes = spark.createDataFrame([(1, "failed"), (1, "downloaded"), (2, "skipped")], "dataset int, status string")
    got = {r.dataset: tuple(r)[1:4] for r in links.fetch_summary(outcomes).collect()}
    assert got == {1: (1, 0, 1), 2: (0, 1, 0), None: (1, 1, 1)}
    outcomes = spark.createDataFrame([(None, "failed")], "dataset int, status string")
    assert sorted(tuple(r)[1:] for r in links.fetch_summary(outcomes).collect()) == [(0, 0, 1, False), (0, 0, 1, True)]


MARKUP = [
    # page, href values of the anchors, (label, in bar) of all anchors
    ("<a href='1.pdf'>one</a>", ["1.pdf"], [("one", False)]),
    ("<!-- <a href='1'>x</a> --><a href=2>two</A><!-- <a href=3>", ["2"], [("two", False)]),
    ("<script>if (a<b) '<a href=1>'</script ><SCRIPT src='x>y'></SCRIPT><a href='2'>2</a>", ["2"], [("2", False)]),
    ("<style>a{}</style><styles><a href=1>1</a></styles>", ["1"], [("1", False)]),
    ("<a title='a>b' data-href=\"9\" rel href = \"1&amp;2\" >x<b>y</b>&lt;</a>", ["1&2"], [("xy&lt;", False)]),
    ("<a href=1 href=2>a<a href=\"\">b</a>c", ["1", ""], [("a", False), ("b", False)]),
    ("<a>none</a><abbr href=1>no</abbr><a/href=3>3</a>", ["3"], [("none", False), ("3", False)]),
    ("a < b <a href=1>1 < 2</a>", ["1"], [("1 < 2", False)]),
    ("<a href=1", [], []),
    ("<nav aria-label=Pagination><nav><a href=1>1</a></nav><a href=2>2</a></nav><a href=3>3</a>", ["1", "2", "3"],
     [("1", True), ("2", True), ("3", False)]),
    ("<nav><a href=1>1</a><nav ARIA-LABEL='Pagination'><a href=2>2</a></nav><a href=3>3</a></nav>", ["1", "2", "3"],
     [("1", False), ("2", True), ("3", False)]),
    ("<nav aria-label='Pagination'><a href=1>open", ["1"], [("open", True)]),
    ("<nav data-x=\"aria-label='Pagination'\"><a href=1>1</a></nav>", ["1"], [("1", False)]),
    ("<a " + "x=1 " * 5000 + "href=1>" + "t" * 100_000 + "</a>", ["1"], [("t" * 100_000, False)]),
    ("<" * 20_000 + "'" * 20_000, [], []), ("", [], []),
]


def test_markup(spark):
    pages = spark.createDataFrame([(i, html) for i, (html, _, _) in enumerate(MARKUP)], "i int, html string")
    got = {r.i: list(r.h) for r in pages.selectExpr("i", f"{markup.hrefs('html')} AS h").collect()}
    assert got == {i: hrefs for i, (_, hrefs, _) in enumerate(MARKUP)}
    rows = pages.selectExpr("i", f"{markup.tokens('html')} AS t", "html").selectExpr("*", f"{markup.bounds('t', 'a')} AS a", f"{markup.bounds('t', 'nav')} AS n")
    rows = rows.selectExpr("i", "html", "t", f"{markup.anchors('t', 'a')} AS a", f"{markup.regions('t', 'n', 'aria-label', 'Pagination')} AS r")
    for r in rows.collect():
        inside = [(a.label, any(x.start < a.at < x.end for x in r.r)) for a in r.a]
        assert inside == MARKUP[r.i][2]
        assert "".join(r.t) == r.html  # nothing is left out


def test_bar_without_last_and_last_without_number(spark):
    bar = "<nav aria-label='Pagination'><a href='?page=3'>3</a><a href=\"?page=7\">7</a></nav>"
    pages = listing(spark, [(1, 0, "<a data-href=\"?page=99\" href=\"?page=3\">Last</a>"), (2, 0, bar), (3, 0, "<a>Last</a>" + bar),
                            (4, 0, "<!-- <a href='?page=9'>Last</a> -->"), (5, 0, bar + "<a href='?page=5'>l<b>as</b>t</a>"),
                            (6, 0, "<a href='x'>Last</a>" + bar.replace(">7<", ">Last<"))])
    got = {r.dataset: r.last_page for r in links.last_page(links.pagination_links(pages), pages).collect()}
    assert got == {1: 3, 2: 7, 3: 7, 4: 0, 5: 5, 6: 7}
