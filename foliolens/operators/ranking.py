"""Filters, orders, pages and totals over hits."""

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from foliolens.session import shared_table

MAX_PER_PAGE = 10_000
# Pages that end above this rank are a top-k in one task; deeper ones come from ranks of all hits.
TOP_ROWS = 1_000_000
_ROW_BITS = 33

# Each order ends in columns that make it total, so pages never overlap.
ORDERS = {
    "relevance": ["-match_count", "dataset", "filename", "filepath"],
    "filename": ["filename", "dataset", "filepath"],
    "dataset": ["dataset", "filename", "filepath"],
}


def bounds(dataset: int | None = None, min_pages: int = 0, max_pages: int | None = None) -> Column:
    """Condition on data set and page count; None means no bound, 0 is a real bound."""
    ok = F.lit(True)
    if dataset is not None:
        ok = ok & (F.col("dataset") == dataset)
    if min_pages > 0:
        ok = ok & (F.col("pages") >= min_pages)
    if max_pages is not None:
        ok = ok & (F.col("pages") <= max_pages)
    return ok


def filter_hits(df: DataFrame, dataset: int | None = None, min_pages: int = 0,
                max_pages: int | None = None) -> DataFrame:
    return df.filter(bounds(dataset, min_pages, max_pages))


def select_datasets(df: DataFrame, ids: list[int], n: int = 12) -> DataFrame:
    wrong = [i for i in ids if not 1 <= i <= n]
    if wrong:
        raise ValueError(f"data sets must be 1..{n}, got {wrong}")
    return df.filter(F.col("dataset").isin(list(ids)))


def order_columns(sort: str) -> list:
    if sort not in ORDERS:
        raise ValueError(f"sort must be one of {sorted(ORDERS)}, got {sort!r}")
    return [F.desc(name[1:]) if name.startswith("-") else F.asc(name) for name in ORDERS[sort]]


def sort_hits(hits: DataFrame, sort: str = "relevance") -> DataFrame:
    return hits.orderBy(*order_columns(sort))


def check_page(page: int, per_page: int) -> None:
    if page < 1 or not 1 <= per_page <= MAX_PER_PAGE:
        raise ValueError(f"page must be at least 1 and per_page 1..{MAX_PER_PAGE}")


def page_hits(hits: DataFrame, page: int = 1, per_page: int = 20, sort: str = "relevance") -> DataFrame:
    """One page, the same rows at any depth.

    Order, offset and limit together run as a top-k, whose size is the end of the page; beyond
    ``TOP_ROWS`` the hits are ranked instead. For many pages keep ``rank_hits`` and take them
    with ``ranked_page``.
    """
    check_page(page, per_page)
    if page * per_page > TOP_ROWS:
        return ranked_page(rank_hits(hits, sort), page, per_page).drop("rank")
    return sort_hits(hits, sort).offset((page - 1) * per_page).limit(per_page)


def page_after(hits: DataFrame, last: Row | None, per_page: int = 20, sort: str = "relevance") -> DataFrame:
    """The page that follows the hit ``last`` (None: the first page), at any depth for the price of the first.

    Only hits behind ``last`` in the order are looked at, as a top-k of one page; none before it is ranked.
    """
    check_page(1, per_page)
    if last is not None:
        hits = hits.filter(_behind(last, ORDERS[sort] if sort in ORDERS else order_columns(sort)))
    return sort_hits(hits, sort).limit(per_page)


def _behind(last: Row, names: list[str]) -> Column:
    """Rows that the order puts after ``last``: null comes first where it ascends and last where it descends."""
    after, equal = F.lit(False), F.lit(True)
    for name in names:
        column, value = F.col(name.lstrip("-")), last[name.lstrip("-")]
        if name[0] == "-":
            beyond = F.lit(False) if value is None else (column < value) | column.isNull()
        else:
            beyond = column.isNotNull() if value is None else column > value
        after = after | (equal & F.coalesce(beyond, F.lit(False)))
        equal = equal & column.eqNullSafe(F.lit(value))
    return after


def rank_hits(hits: DataFrame, sort: str = "relevance", partitions: int | None = None) -> DataFrame:
    """All hits with their ``rank`` from 1, without a window over all of them.

    Hits are split into ranges of the order and sorted inside each; the rank is the place inside
    the range plus the rows of the ranges before. Only one row per range meets in one task. Hits
    are written first, because finding the ranges reads them once more, and placed hits too, so
    that all steps see the same ranges.
    """
    order = order_columns(sort)
    spark = hits.sparkSession
    ranges = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = shared_table(hits).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the id holds the number of the partition above these bits and the row inside it below
    placed = shared_table(ordered.withColumn("_id", F.monotonically_increasing_id())).withColumn(
        "_range", F.shiftright("_id", _ROW_BITS))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").agg(F.count("*").alias("n")).select(
        "_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    rank = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return placed.join(F.broadcast(starts), "_range").select(*hits.columns, rank.alias("rank"))


def ranked_page(ranked: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    """One page of ``rank_hits``, with the ranks over all hits."""
    check_page(page, per_page)
    return ranked.filter(F.col("rank").between((page - 1) * per_page + 1, page * per_page))


def rank_page(page: DataFrame, sort: str = "relevance") -> DataFrame:
    """Number the rows of one page 1..n (a page is small, so one task is enough)."""
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order_columns(sort))))


def hit_totals(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("total"),
                    F.coalesce(F.sum("match_count"), F.lit(0)).alias("total_matches"))


def cap_contexts(hits: DataFrame, k: int = 50) -> DataFrame:
    """At most ``k`` contexts per hit, and how many were left out."""
    return (hits.withColumn("more", F.greatest(F.size("contexts") - k, F.lit(0)))
            .withColumn("contexts", F.slice("contexts", 1, k)))
