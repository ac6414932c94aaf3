"""Raw files in numbered data-set folders, and records made from extracted text."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliolens.functions.patterns import escape_literal
from foliolens.functions.text import (
    join_pages, lenient_int, page_offsets, parse_info, split_pages, text_length, word_count,
)
from foliolens.schema import FILES

NUM_DATASETS = 12


def scan_files(spark: SparkSession, root: str, glob: str = "*.pdf") -> DataFrame:
    """Files below ``root`` that match a glob, with the number of their data set.

    ``content`` is read only where a later step asks for it.
    """
    files = (spark.read.format("binaryFile")
             .option("pathGlobFilter", glob)
             .option("recursiveFileLookup", True)
             .load(root))
    number = F.nullif(F.regexp_extract("path", r"data-set-(\d+)/[^/]*\z", 1), F.lit(""))
    return files.withColumn("dataset", number.try_cast("int")).filter("dataset IS NOT NULL")


def with_empty_datasets(df: DataFrame, n: int = NUM_DATASETS) -> DataFrame:
    """Every data set 1..n; one without rows gives one row of nulls."""
    ids = df.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("dataset"))
    missing = ids.join(df.select("dataset").distinct(), "dataset", "left_anti")
    return df.unionByName(missing, allowMissingColumns=True)


def size_mb(size_bytes: Column) -> Column:
    """Megabytes to two places, halves to the even digit."""
    return F.bround(size_bytes / F.lit(1048576.0), 2)


def file_stats(files: DataFrame, root: str) -> DataFrame:
    """Name, path below ``root`` with a leading slash, size and time of each file."""
    prefix = escape_literal(root.removeprefix("file://").rstrip("/"))
    below = F.regexp_replace("path", f"^(?:[a-z0-9]+:(?://)?)?{prefix}/", "/")
    return files.select(
        "dataset",
        F.substring_index("path", "/", -1).alias("filename"),
        below.alias("filepath"),
        F.col("length").alias("size_bytes"),
        size_mb(F.col("length")).alias("size_mb"),
        F.col("modificationTime").alias("modified_date"),
    )


def file_records(stats: DataFrame, texts: DataFrame) -> DataFrame:
    """``records`` of statistics and texts that are kept apart.

    ``texts`` has (dataset, filename or filepath, full_text, raw, error). The path is what tells
    files apart, so give it where names repeat; this form shuffles the texts.
    """
    on = ["dataset", "filepath" if "filepath" in texts.columns else "filename"]
    texts = texts.select(*on, "full_text", "raw", "error")
    return records(stats.join(texts, on, "left"))


def records(rows: DataFrame) -> DataFrame:
    """Full records of rows that hold the statistics of a file, its extracted ``full_text``, the
    ``raw`` info lines and ``error``: no join, no shuffle.

    A file without extracted text counts as one with empty text, as when the extraction tool
    fails. A record with an error keeps its name and path only.
    """
    info = F.col("info")

    def named(key: str) -> Column:
        return F.coalesce(F.element_at(info, key), F.lit(""))

    ok = F.col("error").isNull()
    rows = (rows.withColumn("info", parse_info(F.coalesce("raw", F.lit(""))))
            .withColumn("full_text", F.coalesce("full_text", F.lit(""))))
    values = {
        "pages": lenient_int(named("Pages")),
        "title": named("Title"),
        "author": named("Author"),
        "subject": named("Subject"),
        "creator": named("Creator"),
        "producer": named("Producer"),
        "creation_date": named("CreationDate"),
        "text_length": text_length(F.col("full_text")),
        "word_count": word_count(F.col("full_text")),
        "full_text": F.col("full_text"),
        "size_bytes": F.col("size_bytes"),
        "size_mb": F.col("size_mb"),
        "modified_date": F.col("modified_date"),
    }
    return rows.select(*[
        (F.when(ok, values[f.name]) if f.name in values else F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in FILES.fields
    ])


def ok_files(files: DataFrame) -> DataFrame:
    return files.filter("error IS NULL")


def build_index(files: DataFrame, sep: str = "\f") -> DataFrame:
    """Flat search index: one row per file with text and page offsets; error rows left out."""
    return ok_files(files).filter("full_text IS NOT NULL").select(
        "dataset", "filename", "filepath",
        F.coalesce("pages", F.lit(0)).alias("pages"),
        F.col("full_text").alias("text"),
        page_offsets("full_text", sep).alias("page_offsets"),
    )


def page_rows(corpus: DataFrame, sep: str = "\f", text: str = "text") -> DataFrame:
    """One row per page of each document."""
    return (corpus.select("dataset", "filename", "filepath",
                          F.posexplode(split_pages(F.col(text), sep)).alias("i", "text"))
            .withColumn("page_number", F.col("i") + 1).drop("i"))


def join_page_rows(doc_pages: DataFrame) -> DataFrame:
    """Page rows back to documents; a document is the largest group here."""
    # two documents may have one name; where rows carry the path, that tells them apart
    key = ["dataset", "filename", *(["filepath"] if "filepath" in doc_pages.columns else [])]
    pages = doc_pages.groupBy(*key).agg(
        F.collect_list(F.struct("page_number", "text")).alias("page_list"))
    joined = join_pages(F.col("page_list"))
    return pages.select(*key, F.size("page_list").alias("page_count"),
                        joined["full_text"].alias("full_text"),
                        joined["text_length"].alias("text_length"))
