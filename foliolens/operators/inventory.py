"""Roll-ups, statistics and validity of the stored files."""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliolens.functions.arrays import count_while, search_steps
from foliolens.functions.content import PDF_MAGIC, content_kind, content_preview, has_magic
from foliolens.session import shared_table

NUM_DATASETS = 12
_BUCKETS = 1024
_ACCURACY = 100_000
_QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _sum_mb() -> Column:
    """Sum of rounded megabytes, exact and the same in any order."""
    total = F.sum(F.col("size_mb").cast("decimal(18,2)")).cast("double")
    return F.coalesce(total, F.lit(0.0)).alias("total_size_mb")


def dataset_rollup(files: DataFrame) -> DataFrame:
    """Per data set: files (error records included), pages and megabytes."""
    return files.groupBy("dataset").agg(
        F.count("*").alias("file_count"),
        F.sum(F.coalesce("pages", F.lit(0))).alias("total_pages"),
        _sum_mb(),
    )


def corpus_totals(files: DataFrame) -> DataFrame:
    """Files (error records left out), pages and megabytes of everything."""
    return files.filter("error IS NULL").agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum("pages"), F.lit(0)).alias("total_pages"),
        _sum_mb(),
    )


def extraction_summary(files: DataFrame, n: int = NUM_DATASETS, totals: bool = True) -> DataFrame:
    """Every data set 1..n and any other there is, zeros for empty ones; the totals row has a
    null data set."""
    spark = files.sparkSession
    ids = spark.range(1, n + 1).select(F.col("id").cast("int").alias("dataset"))
    ids = ids.unionByName(files.select("dataset").filter("dataset IS NOT NULL")).distinct()
    each = ids.join(dataset_rollup(files), "dataset", "left").select(
        "dataset",
        F.coalesce("file_count", F.lit(0)).alias("file_count"),
        F.coalesce("total_pages", F.lit(0)).alias("total_pages"),
        F.coalesce("total_size_mb", F.lit(0.0)).alias("total_size_mb"),
    )
    if not totals:
        return each
    total = corpus_totals(files).select(
        F.lit(None).cast("int").alias("dataset"), F.col("total_files").alias("file_count"),
        "total_pages", "total_size_mb")
    return each.unionByName(total)


def corpus_stats(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count("*").alias("total_docs"),
                      F.coalesce(F.sum("pages"), F.lit(0)).alias("total_pages"))


def describe_corpus(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles (interpolated) and max of numeric columns, exactly.

    The values are counted first, so repeated ones travel once, and the counts are kept. Approximate quantiles
    of the distinct values cut each column into at most 1,024 ranges; one pass gives every range its count and
    moments about its own lower end, which add up to those of the column without loss of digits. The counts
    say which ranges hold the wanted ranks, and only the values of those are ranked one by one. The driver sees the
    ranges' sums, never values.
    """
    spark = df.sparkSession
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns
    ])).alias("x")).select("x.*").filter("v IS NOT NULL")
    counted = shared_table(long.groupBy("column", "v").agg(F.count("*").alias("n")))
    basic = counted.groupBy("column").agg(
        F.min("v").alias("low"), F.max("v").alias("high"),
        F.percentile_approx("v", [i / _BUCKETS for i in range(1, _BUCKETS)], _ACCURACY).alias("bounds")).collect()
    edges = spark.createDataFrame([(r["column"], r["low"], sorted(set(r["bounds"]))) for r in basic], "column string, low double, bounds array<double>")
    bucket = F.expr(count_while("steps", lambda i: f"get(bounds, {i}) <= v"))
    placed = counted.join(F.broadcast(edges.withColumn("steps", F.expr(search_steps("bounds")))), "column").select(
        "column", "v", "n", bucket.alias("bucket"), "low", "bounds")
    placed = placed.withColumn("d", F.col("v") - F.coalesce(F.get("bounds", F.col("bucket") - 1), "low"))
    ranges: dict[str, list] = {r["column"]: [] for r in basic}
    sums = placed.groupBy("column", "bucket").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("d")).alias("first"), F.sum(F.col("n") * F.col("d") * F.col("d")).alias("second"))
    for r in sums.collect():
        ranges[r["column"]].append(r)
    summaries, wanted = [], []
    for r in basic:
        bounds = [r["low"], *sorted(set(r["bounds"]))]
        last = sum(part["n"] for part in ranges[r["column"]]) - 1
        ranks = {math.floor(q * last) + k for q in _QUARTILES.values() for k in (0, 1)}
        count, mean, spread = 0, 0.0, 0.0
        for part in sorted(ranges[r["column"]], key=lambda p: p["bucket"]):
            n, centre = part["n"], bounds[part["bucket"]]
            own, around = centre + part["first"] / n, part["second"] - part["first"] ** 2 / n
            wanted += [(r["column"], part["bucket"], count, rank) for rank in ranks if count <= rank < count + n]
            gap, before = own - mean, count
            count += n
            mean += gap * n / count
            spread += around + gap * gap * before * n / count
        std = math.sqrt(max(spread, 0.0) / (count - 1)) if count > 1 else None
        summaries.append((r["column"], count, mean, std, r["low"], r["high"]))
    # at most six ranks for each column
    at_rank = spark.createDataFrame(wanted, "column string, bucket int, before long, rank long")
    w = Window.partitionBy("column", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    needed = F.broadcast(at_rank.select("column", "bucket", "before").distinct())
    ranked = placed.select("column", "bucket", "v", "n").join(needed, ["column", "bucket"]).withColumn("upto", F.col("before") + F.sum("n").over(w))
    found = ranked.drop("before").join(F.broadcast(at_rank.drop("before")), ["column", "bucket"]).filter("rank < upto AND rank >= upto - n")
    values = {(r["column"], r["rank"]): r["v"] for r in found.select("column", "rank", "v").collect()}
    rows = []
    for column, count, mean, std, low, high in summaries:
        quartiles = []
        for q in _QUARTILES.values():
            at = q * (count - 1)
            one, share = math.floor(at), at - math.floor(at)
            quartiles.append(values[column, one] * (1 - share) + (values[column, one + 1] * share if share else 0.0))
        rows.append((column, count, mean, std, low, *quartiles, high))
    return spark.createDataFrame(rows, "column string, count long, mean double, std double, min double, "
                                 + ", ".join(f"{name} double" for name in _QUARTILES) + ", max double")


def page_tables(doc_pages: DataFrame) -> DataFrame:
    """Per page: how many tables, and whether any."""
    n = F.coalesce(F.size("tables"), F.lit(0))
    return doc_pages.withColumn("table_count", n).withColumn("has_tables", n > 0)


def document_tables(doc_pages: DataFrame) -> DataFrame:
    # two documents may have one name; where rows carry the path, that tells them apart
    path = ["filepath"] if "filepath" in doc_pages.columns else []
    return page_tables(doc_pages).groupBy("dataset", "filename", *path).agg(
        F.sum("table_count").alias("table_count"),
        F.count_if("has_tables").alias("pages_with_tables"))


def valid(magic: bytes = PDF_MAGIC, content: str = "content") -> Column:
    return has_magic(F.col(content), magic)


def validity_counts(files: DataFrame, magic: bytes = PDF_MAGIC) -> DataFrame:
    return files.groupBy("dataset").agg(
        F.count_if(valid(magic)).alias("valid"), F.count_if(~valid(magic)).alias("invalid"))


def quarantine(files: DataFrame, magic: bytes = PDF_MAGIC) -> tuple[DataFrame, DataFrame]:
    """(valid rows, other rows); nothing is deleted."""
    return files.filter(valid(magic)), files.filter(~valid(magic))


def sniff_content(files: DataFrame, magic: bytes = PDF_MAGIC, n: int = 200) -> DataFrame:
    """Kind of content and its first bytes, for finding error pages saved as files."""
    keep = [c for c in files.columns if c != "content"]
    return files.select(*keep, content_kind(F.col("content"), magic).alias("kind"),
                        content_preview(F.col("content"), n).alias("preview"))
