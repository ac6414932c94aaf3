"""Link queries: what listing pages point to, and what remains to be fetched."""

from pyspark.sql import functions as F

from foliolens.functions import urls
from foliolens.operators import links
from workload import tables as t
from workload.registry import query

# anchors of the test pages have no .pdf links; /th takes its place
LINK = "/th"
_HREFS = """list_filter(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1), lambda h: contains(h, '/th'))"""
_HOST = "regexp_extract(base_url, '^([a-z]+://[^/?#]*)', 1)"

_LINKS = f"""{t.LISTING}, found AS (SELECT dataset, page_num, {_HOST} AS host, unnest({_HREFS}) AS href FROM listing),
  links AS (SELECT dataset, page_num, href, host || href AS url,
    string_split(string_split(href, '?')[1], '/')[-1] AS filename FROM found)"""


def _links(spark, sf):
    return links.extract_links(t.listing_pages(spark, sf), LINK)


@query("extract_links", f"WITH {_LINKS} SELECT * FROM links")
def _(spark, sf):
    return _links(spark, sf)


@query("extract_links_ignore_case", f"WITH {_LINKS.replace('contains(h,', 'contains(lower(h),')} SELECT * FROM links")
def _(spark, sf):
    return links.extract_links(t.listing_pages(spark, sf), LINK, ignore_case=True)


@query("extract_links_fallback", f"""WITH {t.LISTING}, tried AS (SELECT dataset, page_num, {_HOST} AS host,
    regexp_extract_all(html, 'href="([^"]*ing)"', 1) AS a, regexp_extract_all(html, 'href="([^"]*tion)"', 1) AS b
  FROM listing), found AS (SELECT dataset, page_num, host,
    unnest(CASE WHEN len(a) > 0 THEN a ELSE b END) AS href FROM tried)
  SELECT dataset, page_num, href, host || href AS url, string_split(href, '/')[-1] AS filename FROM found""")
def _(spark, sf):
    return links.extract_links_fallback(
        t.listing_pages(spark, sf), ['href="([^"]*ing)"', 'href="([^"]*tion)"'])


@query("distinct_links", f"""WITH {_LINKS} SELECT DISTINCT dataset, CAST(page_num // 10 AS INTEGER) AS batch,
    url, filename FROM links""")
def _(spark, sf):
    return links.distinct_links(_links(spark, sf))


_PLAN = f"""{_LINKS}, {t.HAVE}, d AS (SELECT DISTINCT dataset, page_num // 10 AS batch, url, filename FROM links),
  planned AS (SELECT dataset, CAST(batch AS INTEGER) AS batch, count(*) AS links, count(*) FILTER (WHERE
    (dataset, filename) IN (SELECT (dataset, filename) FROM have)) AS existing FROM d GROUP BY dataset, batch)"""


@query("plan_fetch", f"WITH {_PLAN} SELECT * FROM planned")
def _(spark, sf):
    return links.plan_fetch(_links(spark, sf), t.have_names(spark, sf))


@query("plan_fetch_totals", f"""WITH {_PLAN} SELECT dataset, CAST(sum(links) AS BIGINT) AS links,
    CAST(sum(existing) AS BIGINT) AS existing FROM planned GROUP BY dataset""")
def _(spark, sf):
    return links.plan_fetch_totals(links.plan_fetch(_links(spark, sf), t.have_names(spark, sf)))


@query("pending_links", f"""WITH {_LINKS}, {t.HAVE} SELECT DISTINCT dataset, url, filename FROM links
  WHERE (dataset, filename) NOT IN (SELECT (dataset, filename) FROM have)""")
def _(spark, sf):
    return links.pending_links(_links(spark, sf), t.have_names(spark, sf))


@query("name_clashes", f"""WITH {_LINKS} SELECT dataset, filename, count(DISTINCT url) AS urls FROM links
  GROUP BY dataset, filename HAVING count(DISTINCT url) > 1""")
def _(spark, sf):
    return links.name_clashes(_links(spark, sf))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in links.STATUSES)


@query("fetch_summary", f"WITH {t.OUTCOMES} SELECT dataset, {_COUNTS}, grouping(dataset) = 1 AS is_total FROM outcomes GROUP BY ROLLUP (dataset)")
def _(spark, sf):
    return links.fetch_summary(t.outcomes(spark, sf))


def _pagination(spark, sf):
    """The page URLs as pagination links; one page in seven carries the "Last" link."""
    pages = t.web_pages(spark, sf, "url")
    return pages.select(
        (F.col("page_id") % 40).cast("int").alias("dataset"), F.col("page_id").alias("page_num"),
        F.lit(0).alias("pos"), F.col("url").alias("href"), (F.col("page_id") % 7 == 0).alias("is_last"),
        (F.col("page_id") % 7 > 0).alias("in_bar"))


_LAST = """p AS (SELECT CAST(page_id % 40 AS INTEGER) AS dataset, page_id, page_id % 7 = 0 AS is_last,
    TRY_CAST(regexp_extract(url, '[?&]page=(\\d+)', 1) AS INTEGER) AS n FROM pages),
  last_pages AS (SELECT dataset, coalesce(arg_min_null(n, page_id) FILTER (WHERE is_last),
    max(n) FILTER (WHERE NOT is_last), 0) AS last_page FROM p GROUP BY dataset)"""


@query("last_page", f"WITH {_LAST} SELECT * FROM last_pages")
def _(spark, sf):
    return links.last_page(_pagination(spark, sf))


@query("pagination_links", f"""WITH {t.LISTING}, a AS (SELECT dataset, page_num,
    regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h,
    regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2) AS l FROM listing),
  e AS (SELECT dataset, page_num, unnest(range(0, len(h))) AS pos, unnest(h) AS href, unnest(l) AS label FROM a)
  SELECT dataset, page_num, CAST(pos AS INTEGER) AS pos, href, true AS is_last, false AS in_bar FROM e
  WHERE contains(lower(regexp_replace(label, '<[^>]*>', '', 'g')), 'last')""")
def _(spark, sf):
    return links.pagination_links(t.listing_pages(spark, sf))


_LABELLED = f"""{t.LISTING}, a AS (SELECT dataset, page_num,
    regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h,
    regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2) AS l FROM listing),
  e AS (SELECT dataset, page_num, unnest(range(0, len(h))) AS pos, unnest(h) AS href, unnest(l) AS label FROM a)"""


@query("last_page_of_listing", f"""WITH {_LABELLED}, p AS (SELECT dataset, arg_min_null(
    TRY_CAST(regexp_extract(href, '[?&]page=(\\d+)', 1) AS INTEGER), (page_num, pos)) AS n FROM e
    WHERE contains(lower(regexp_replace(label, '<[^>]*>', '', 'g')), 'last') GROUP BY dataset)
  SELECT dataset, coalesce(max(n), 0) AS last_page FROM listing LEFT JOIN p USING (dataset) GROUP BY dataset""")
def _(spark, sf):
    pages = t.listing_pages(spark, sf)
    return links.last_page(links.pagination_links(pages), pages)


def _marked_up(spark, sf):
    """The listing pages with their own anchors disarmed and a bar of one of five kinds."""
    page = F.col("page_num") * 12 + F.col("dataset") - 1
    n = page.cast("string")
    bars = [
        # no "Last": the highest number of the bar counts, not those of comments, scripts or other attributes
        F.concat(F.lit("<NAV class=x aria-label='Pagination'><ul><li><a data-href=\"?page=9999\" href='?page="), n, F.lit(
            "'>next</a></li><!-- <a href=\"?page=8888\">Last</a> --></ul></NAV><script>'<a href=\"?page=7777\">Last</a>'</script>")),
        # "Last" in a nested element, attributes in any order, no quotes
        F.concat(F.lit('<a title="a > b" class=\'p\' href=/l?x=1&amp;page='), n, F.lit('><span>LAST</span> »</a><a href="?page=9999">Last</a>')),
        # a "Last" without a number: the bar tells, nested bars included
        F.concat(F.lit('<a>Last</a><nav aria-label="Pagination"><nav></nav><a href="?page='), n, F.lit('">2</a></nav><a href="?page=9999">3</a>')),
        F.lit("<nav aria-label='Other'><a href='?page=9999'>4</a></nav>"),
        F.concat(F.lit('<a href="x.pdf?page='), n, F.lit("\" >doc</a><a href = 'y.PDF'>doc</a><!-- <a href='z.pdf'> --><a hrefs='w.pdf'>no</a>")),
    ]
    bar = F.coalesce(*[F.when(page % 5 == i, b) for i, b in enumerate(bars)])
    return t.listing_pages(spark, sf).withColumn("html", F.concat(F.regexp_replace("html", "(?i)<a", "<i"), bar))


_BARS = "SELECT CAST(page_id % 12 + 1 AS INTEGER) AS dataset, CAST(page_id // 12 AS INTEGER) AS page_num, page_id, page_id % 5 AS kind FROM pages"


@query("pagination_markup", f"""WITH b AS ({_BARS}),
  k(kind, pos, href, is_last, in_bar) AS (VALUES (0, 0, '?page=#', false, true), (1, 0, '/l?x=1&page=#', true, false),
    (1, 1, '?page=9999', true, false), (2, 0, NULL, true, false), (2, 1, '?page=#', false, true))
  SELECT dataset, page_num, pos, replace(href, '#', CAST(page_id AS VARCHAR)) AS href, is_last, in_bar FROM b JOIN k USING (kind)""")
def _(spark, sf):
    return links.pagination_links(_marked_up(spark, sf))


@query("last_page_of_bar", f"""WITH b AS ({_BARS}) SELECT dataset, CAST(coalesce(
    CASE arg_min(kind, page_num) FILTER (WHERE kind IN (1, 2)) WHEN 1 THEN min(page_id) FILTER (WHERE kind = 1) END,
    max(page_id) FILTER (WHERE kind IN (0, 2)), 0) AS INTEGER) AS last_page FROM b GROUP BY dataset""")
def _(spark, sf):
    pages = _marked_up(spark, sf)
    return links.last_page(links.pagination_links(pages), pages)


@query("extract_links_markup", f"""WITH {t.LISTING}, b AS ({_BARS}),
  k(tail, ignored) AS (VALUES ('x.pdf?page=#', false), ('y.PDF', true))
  SELECT dataset, page_num, replace(tail, '#', CAST(page_id AS VARCHAR)) AS href,
    split_part(tail, '?', 1) AS filename FROM b, k WHERE kind = 4""")
def _(spark, sf):
    return links.extract_links(_marked_up(spark, sf), ignore_case=True).drop("url")


@query("extract_links_patterns", f"""WITH {t.LISTING}, b AS ({_BARS}), k(kind, href) AS (VALUES (0, '/f/a#.pdf?x=1'),
    (1, 'https://o.org/d/b#.pdf'), (2, '/sites/c#.pdf'))
  SELECT dataset, page_num, replace(href, '#', CAST(page_id AS VARCHAR)) AS href,
    split_part(split_part(replace(href, '#', CAST(page_id AS VARCHAR)), '?', 1), '/', -1) AS filename FROM b JOIN k USING (kind)""")
def _(spark, sf):
    page = F.col("page_num") * 12 + F.col("dataset") - 1
    texts = ['<i href="/f/a#.pdf?x=1">a</i> https://o.org/z.pdf', "see https://o.org/d/b#.pdf or /sites/z.pdf", "at /sites/c#.pdf.", "none", "no.pdf here"]
    html = F.coalesce(*[F.when(page % 5 == i, F.replace(F.lit(text), F.lit("#"), page.cast("string"))) for i, text in enumerate(texts)])
    listing = t.listing_pages(spark, sf).withColumn("html", F.concat(F.regexp_replace("html", "href=", "h="), html))
    return links.extract_links_fallback(listing).drop("url")


@query("newer_links", f"""WITH {_LINKS}, d AS (SELECT DISTINCT dataset, url, filename FROM links)
  SELECT * FROM d WHERE (dataset, url) NOT IN (SELECT (dataset, url) FROM links WHERE page_num < 10)""")
def _(spark, sf):
    found = _links(spark, sf)
    return links.newer_links(found, found.filter("page_num < 10").select("dataset", "url"))


@query("listing_urls", f"""WITH {_LAST} SELECT dataset, 'https://h/data-set-' || dataset || '-files' AS base_url,
    CAST(unnest(range(0, last_page + 1)) AS INTEGER) AS page_num,
    'https://h/data-set-' || dataset || '-files' || CASE WHEN unnest(range(0, last_page + 1)) > 0
      THEN '?page=' || unnest(range(0, last_page + 1)) ELSE '' END AS url FROM last_pages""")
def _(spark, sf):
    base = urls.dataset_url(F.col("dataset"), "https://h")
    return links.listing_urls(links.last_page(_pagination(spark, sf)), base)


@query("resolve_url", """WITH c AS (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS base, url FROM pages),
  b AS (SELECT page_id, base, regexp_extract(base, '^([a-z]+:)//', 1) AS scheme,
    regexp_extract(base, '^([a-z]+://[^/]*)', 1) AS host, regexp_extract(base, '^(.*/)', 1) AS folder FROM c)
  SELECT page_id, unnest(['a.pdf', '/a.pdf?x=1', '//h/a.pdf', 'https://h/b.pdf']) AS link,
    unnest([folder || 'a.pdf', host || '/a.pdf?x=1', scheme || '//h/a.pdf', 'https://h/b.pdf']) AS url FROM b""")
def _(spark, sf):
    cases = F.array(*[F.lit(x) for x in ("a.pdf", "/a.pdf?x=1", "//h/a.pdf", "https://h/b.pdf")])
    rows = t.web_pages(spark, sf, "url").select("page_id", F.col("url").alias("base"), F.explode(cases).alias("link"))
    return rows.select("page_id", "link", urls.resolve_url(F.col("link"), F.col("base")).alias("url"))


@query("url_filename", """SELECT page_id, string_split(string_split(url, '?')[1], '/')[-1] AS filename FROM pages""")
def _(spark, sf):
    return t.web_pages(spark, sf, "url").select("page_id", urls.url_filename(F.col("url")).alias("filename"))


@query("decode_filename", """SELECT doc_id, replace(text, chr(10), ' ') || '(+%41)' AS filename
  FROM documents""")
def _(spark, sf):
    coded = F.concat("text", F.lit("(+%41)"))
    for char, code in ((" ", "%20"), ("\n", "%20"), ("(", "%28"), (")", "%29")):
        coded = F.replace(coded, F.lit(char), F.lit(code))
    return t.documents(spark, sf, "doc_id", "text").select("doc_id", urls.decode_filename(coded).alias("filename"))


@query("allowed_ext", """WITH u AS (SELECT page_id, url,
    lower(regexp_extract(string_split(string_split(url, '?')[1], '/')[-1], '[^.].*?(\\.[^.]*)$', 1)) AS ext FROM pages)
  SELECT page_id, ext = '' OR ext IN ('.html', '.json', '.pdf', '.css', '.js', '.png', '.jpg', '.ico') AS allowed FROM u""")
def _(spark, sf):
    return t.web_pages(spark, sf, "url").select("page_id", urls.allowed_ext(F.col("url")).alias("allowed"))
