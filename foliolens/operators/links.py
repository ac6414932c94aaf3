"""Link inventories from listing pages, and what remains to be fetched."""

from pyspark.sql import Column, DataFrame, functions as F

from foliolens.functions.arrays import pin
from foliolens.functions.html import anchors, bounds, regions, tokens
from foliolens.functions.urls import (
    decode_filename, hrefs, links_by_patterns, listing_url, page_number, resolve_url, url_filename,
)
from foliolens.plans.name_filter import may_be_in
from foliolens.plans.skew import drop_by_key
from foliolens.session import shared_table

BATCH_SIZE = 10
_URL_BLOCK = 10_000
STATUSES = ["downloaded", "skipped", "failed"]

# How the pagination of a listing page is marked up.
_BAR = ("nav", "aria-label", "Pagination")
_LAST_TEXT = "last"


def extract_links(listing: DataFrame, contains: str = ".pdf", ignore_case: bool = False) -> DataFrame:
    """One row per link of every listing page (dataset, page_num, base_url, html)."""
    return _as_links(listing, hrefs("html", contains, ignore_case))


def extract_links_fallback(listing: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Links of the first pattern that finds any on a page."""
    found = links_by_patterns(F.col("html"), patterns) if patterns else links_by_patterns(F.col("html"))
    return _as_links(listing, found)


def _as_links(listing: DataFrame, found: Column) -> DataFrame:
    rows = listing.select("dataset", "page_num", "base_url", F.explode(found).alias("href"))
    rows = rows.withColumn("url", resolve_url(F.col("href"), F.col("base_url")))
    return rows.select("dataset", "page_num", "href", "url", url_filename(F.col("url")).alias("filename"))


def decoded(links: DataFrame) -> DataFrame:
    return links.withColumn("filename", decode_filename(F.col("filename")))


def with_batch(links: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    return links.withColumn("batch", F.floor(F.col("page_num") / batch_size).cast("int"))


def distinct_links(links: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Links without repeats inside a batch of listing pages."""
    return with_batch(links, batch_size).select("dataset", "batch", "url", "filename").distinct()


def valid_names(files: DataFrame, ok: Column) -> DataFrame:
    return files.filter(ok).select("dataset", "filename").distinct()


def plan_fetch(links: DataFrame, have: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Per batch: distinct links, and how many are there already.

    ``have`` = ``valid_names``. Links are counted per file name before the join, so a name
    that very many links share is one row in it.
    """
    per_name = distinct_links(links, batch_size).groupBy("dataset", "batch", "filename").agg(
        F.count("*").alias("n"))
    known = have.withColumn("_have", F.lit(True))
    joined = per_name.join(known, ["dataset", "filename"], "left")
    return joined.groupBy("dataset", "batch").agg(
        F.sum("n").alias("links"),
        F.sum(F.when(F.col("_have"), F.col("n")).otherwise(0)).alias("existing"))


def plan_fetch_totals(planned: DataFrame) -> DataFrame:
    """Per data set; a link listed in two batches counts twice."""
    return planned.groupBy("dataset").agg(
        F.sum("links").alias("links"), F.sum("existing").alias("existing"))


def pending_links(links: DataFrame, have: DataFrame) -> DataFrame:
    """Distinct links whose file is not there with valid content.

    A filter of fixed size over the names that are there lets most links pass without a look at the
    names; only those it cannot tell go through the anti join.
    """
    key = ["dataset", "filename"]
    todo = shared_table(may_be_in(links.select("dataset", "url", "filename").distinct(), have, key, "_maybe"))
    unsure = todo.filter("_maybe").drop("_maybe")
    return todo.filter("NOT _maybe").drop("_maybe").unionByName(drop_by_key(unsure, have, key, ["dataset", "url"]))


def newer_links(links: DataFrame, planned: DataFrame) -> DataFrame:
    """Distinct links that an earlier plan (dataset, url) does not hold: what a next run has to look at."""
    key = ["dataset", "url"]
    todo = shared_table(may_be_in(links.select("dataset", "url", "filename").distinct(), planned, key, "_maybe"))
    unsure = todo.filter("_maybe").drop("_maybe")
    known = planned.select(*key).distinct()
    return todo.filter("NOT _maybe").drop("_maybe").unionByName(drop_by_key(unsure, known, key, key))


def name_clashes(links: DataFrame) -> DataFrame:
    """File names that several links of a data set share, and so would overwrite each other."""
    distinct = links.select("dataset", "filename", "url").distinct()
    return (distinct.groupBy("dataset", "filename").agg(F.count("*").alias("urls"))
            .filter("urls > 1"))


def fetch_summary(outcomes: DataFrame, totals: bool = True) -> DataFrame:
    """Outcomes counted by status per data set. The grand total has a null data set and is marked in
    ``is_total``, which tells it from outcomes without a data set."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    if not totals:
        return outcomes.groupBy("dataset").agg(*counts)
    return outcomes.rollup("dataset").agg(*counts, (F.grouping("dataset") == 1).alias("is_total"))


def pagination_links(listing: DataFrame) -> DataFrame:
    """Links that can tell the last page: those labelled "Last", and those of the pagination bar.

    (dataset, page_num, pos, href, is_last, in_bar); ``pos`` counts the anchors of a page.
    """
    name, label, value = _BAR
    rows = pin(listing.select("dataset", "page_num", "html"), {"_t": tokens("html")}, drop=("html",))
    rows = pin(rows, {"_a": bounds("_t", "a"), "_n": bounds("_t", name)})
    rows = pin(rows, {"_a": anchors("_t", "_a"), "_r": regions("_t", "_n", label, value)}, drop=("_a", "_n", "_t"))
    rows = rows.select("dataset", "page_num", "_r", F.posexplode("_a").alias("pos", "a"))
    is_last = F.lower("a.label").contains(_LAST_TEXT)
    rows = rows.select("dataset", "page_num", "pos", F.col("a.href").alias("href"), is_last.alias("is_last"),
                       F.expr("exists(_r, r -> a.at > r.start AND a.at < r.end)").alias("in_bar"))
    return rows.filter("is_last OR in_bar")


def last_page(pagination: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Per data set: the number on the first "Last" link, else the highest number of the bar, else 0.

    ``pagination`` has the columns of ``pagination_links``. Data sets of ``listing`` that
    have no pagination links get 0.
    """
    if listing is not None:
        sets = listing.select("dataset").distinct()
        found = last_page(pagination).withColumnRenamed("dataset", "_set")
        return (sets.join(found, sets["dataset"].eqNullSafe(found["_set"]), "left")
                .select("dataset", F.coalesce("last_page", F.lit(0)).alias("last_page")))
    number = page_number(F.col("href"))
    first_last = F.when(F.col("is_last"), F.struct("page_num", "pos"))
    return pagination.groupBy("dataset").agg(F.coalesce(
        F.min_by(number, first_last), F.max(F.when(F.col("in_bar"), number)), F.lit(0)).alias("last_page"))


def listing_urls(last_pages: DataFrame, base: Column) -> DataFrame:
    """URLs of the listing pages 0..last of every data set."""
    # In blocks, so that no row holds the numbers of all pages of a data set.
    blocks = last_pages.withColumn("base_url", base).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.floor(F.col("last_page") / _URL_BLOCK).cast("int"))))
    return blocks.select(
        "dataset", "base_url", F.explode(F.expr(
            f"sequence(block * {_URL_BLOCK}, least(last_page, block * {_URL_BLOCK} + {_URL_BLOCK - 1}))")).alias("page_num")
    ).withColumn("url", listing_url(F.col("base_url"), F.col("page_num")))
