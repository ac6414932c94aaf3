"""Reading and writing the search index, the archive and the exports."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from foliolens.functions.text import PREVIEW_CHARS, text_preview
from foliolens.functions.urls import dataset_name, dataset_url
from foliolens.operators.inventory import corpus_totals, extraction_summary
from foliolens.schema import ARCHIVE, CORPUS, FILES
from foliolens.sources.files import NUM_DATASETS, build_index, ok_files
from foliolens.sources.json_array import read_json_array

# The columns of the exports.
EXPORT_CSV = ["filename", "dataset", "pages", "match_count"]
EXPORT_JSON = EXPORT_CSV + ["filepath"]
PART_BYTES = 64 * 1024 * 1024


def _with_preview(datasets: T.StructType) -> T.StructType:
    record = T.StructType([*datasets["files"].dataType.elementType.fields, T.StructField("text_preview", T.StringType())])
    return T.StructType([T.StructField(f.name, T.ArrayType(record) if f.name == "files" else f.dataType) for f in datasets.fields])


NESTED = _with_preview(ARCHIVE["datasets"].dataType.elementType)


def read_index(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The flat index: Parquet, JSON lines ('json') or one JSON array ('json_array')."""
    if fmt == "json_array":
        return read_json_array(spark, path, CORPUS)
    reader = spark.read.schema(CORPUS)
    return reader.parquet(path) if fmt == "parquet" else reader.json(path)


def ordered(index: DataFrame, partitions: int | None = None) -> DataFrame:
    """In order of data set, file name and path over all partitions, a large data set in many of them."""
    order = ["dataset", "filename", "filepath"]
    ranged = index.repartitionByRange(partitions, *order) if partitions else index.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def write_index(index: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                partitions: int | None = None) -> None:
    """Partitioned by data set and in order of file name.

    The range partitioning splits a large data set over many tasks; the order gives narrow
    statistics per row group, by which looking up the documents of a page skips most of the index.
    The session's number of shuffle partitions holds unless ``partitions`` says otherwise.
    """
    ordered(index, partitions).write.mode(mode).partitionBy("dataset").format(fmt).save(path)


def summary_rows(files: DataFrame, n: int = PREVIEW_CHARS, always_dots: bool = False) -> DataFrame:
    """File records with a preview in place of the text."""
    return files.select(*[c for c in files.columns if c != "full_text"],
                        text_preview(F.col("full_text"), n, always_dots).alias("text_preview"))


def write_summary(files: DataFrame, path: str, source: str = "", tool: str = "", description: str = "",
                  n: int = NUM_DATASETS, mode: str = "errorifexists") -> None:
    """The archive with previews in place of texts: ``metadata``, and ``datasets`` with their roll-ups."""
    _write_nested(files, nest_archive(summary_rows(files), source, n, text="text_preview"), path, source, tool, description, n, mode)


def write_json_array(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON array for each partition of ``rows``, an element to a line; ``read_json_array`` reads it split."""
    def lines(batches):
        last = None
        for batch in batches:
            out = ["["] if last is None and batch.num_rows else []
            for row in batch.column(0).to_pylist():
                out += [last + ","] if last is not None else []
                last = row
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([] if last is None else [last, "]"], pa.string())], ["value"])

    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInArrow(lines, "value string").write.mode(mode).text(path)


def file_list(files: DataFrame) -> DataFrame:
    return ok_files(files).select(
        "dataset", "filename",
        F.coalesce("pages", F.lit(0)).alias("pages"),
        F.coalesce("size_mb", F.lit(0.0)).alias("size_mb"),
        F.coalesce("word_count", F.lit(0)).alias("word_count"),
    )


def write_file_list(files: DataFrame, path: str, mode: str = "errorifexists") -> None:
    file_list(files).write.mode(mode).json(path)


def export_csv(hits: DataFrame, path: str, header: bool = True, quote_all: bool = False,
               mode: str = "errorifexists") -> None:
    columns = EXPORT_CSV if header else ["filename", "dataset", "match_count"]
    (hits.select(*columns).write.mode(mode)
     .option("header", header).option("quoteAll", quote_all).csv(path))


def export_json(hits: DataFrame, path: str, mode: str = "errorifexists") -> None:
    hits.select(*EXPORT_JSON).write.mode(mode).json(path)


def archive_datasets(files: DataFrame, source: str = "", n: int = NUM_DATASETS) -> DataFrame:
    """One row per data set 1..n with name, URL and roll-up."""
    return extraction_summary(files, n, totals=False).select(
        F.col("dataset").alias("dataset_number"),
        dataset_name(F.col("dataset")).alias("dataset_name"),
        dataset_url(F.col("dataset"), source).alias("dataset_url"),
        "file_count", "total_pages", "total_size_mb",
    )


def nest_archive(files: DataFrame, source: str = "", n: int = NUM_DATASETS,
                 part_bytes: int = PART_BYTES, text: str = "full_text") -> DataFrame:
    """Data-set rows with their file records nested inside.

    One nested row cannot hold a data set of any size, so a data set is cut into as many
    numbered parts as its bytes ask for, by a hash of the path. Small data sets are one row.
    Files are in name order inside a part; ``parts`` and the roll-up are repeated on each.
    """
    names = dict.fromkeys([f.name for f in FILES.fields if f.name != "dataset"] + [text])
    record = [name for name in names if name in files.columns]
    # text_length, where there is one, spares reading the texts twice
    size = F.col("text_length") * 2 if "text_length" in files.columns else F.octet_length(text)
    bytes_in = F.coalesce(size, F.lit(0)).cast("bigint") + 1024
    sizes = files.groupBy("dataset").agg(
        F.ceil(F.sum(bytes_in) / part_bytes).cast("int").alias("parts"))
    placed = files.join(F.broadcast(_checked(sizes, n)), "dataset").withColumn(
        "part", F.pmod(F.xxhash64("filepath", "filename"), F.col("parts")).cast("int"))
    # the name comes first in the record, so array_sort orders by it
    nested = placed.groupBy("dataset", "part", "parts").agg(
        F.array_sort(F.collect_list(F.struct(*record))).alias("files"))
    heads = archive_datasets(files, source, n)
    full = F.broadcast(heads).join(nested.withColumnRenamed("dataset", "dataset_number"), "dataset_number")
    no_files = F.array().cast(full.schema["files"].dataType)
    empty = (heads.filter("file_count = 0")
             .select("*", F.lit(0).alias("part"), F.lit(1).alias("parts"), no_files.alias("files")))
    return full.unionByName(empty)


def _checked(per_dataset: DataFrame, n: int) -> DataFrame:
    """An archive has data sets 1..n, which bounds the rows to n; any other is an error."""
    wrong = F.raise_error(F.concat(F.lit(f"the archive has data sets 1..{n}, not "), F.coalesce(F.col("dataset").cast("string"), F.lit("null"))))
    return per_dataset.withColumn("dataset", F.when(F.col("dataset").between(1, n), F.col("dataset")).otherwise(wrong.cast("int")))


def write_archive(files: DataFrame, path: str, source: str = "", tool: str = "", description: str = "",
                  n: int = NUM_DATASETS, mode: str = "errorifexists") -> None:
    """The archive as JSON lines: ``metadata`` (one row) and ``datasets`` (nested rows)."""
    _write_nested(files, nest_archive(files, source, n), path, source, tool, description, n, mode)


def _write_nested(files: DataFrame, nested: DataFrame, path: str, source: str, tool: str, description: str, n: int, mode: str) -> None:
    meta = corpus_totals(files).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("extraction_date"),
        F.lit(n).alias("total_datasets"), F.lit(source).alias("source"),
        F.lit(tool).alias("extraction_tool"), F.lit(description).alias("description"),
        "total_files", "total_pages", "total_size_mb")
    meta.coalesce(1).write.mode(mode).json(f"{path}/metadata")
    nested.write.mode(mode).json(f"{path}/datasets")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Nested data-set rows of ``write_archive`` or, with previews for texts, of ``write_summary``."""
    return spark.read.schema(NESTED).json(f"{path}/datasets")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARCHIVE["metadata"].dataType).json(f"{path}/metadata")


def read_archive_document(spark: SparkSession, path: str) -> DataFrame:
    """Nested data-set rows of an archive kept as a single JSON document."""
    doc = spark.read.schema(ARCHIVE).option("multiLine", True).json(path)
    return doc.select(F.inline("datasets"))


def flatten_archive(datasets: DataFrame, sep: str = "\f") -> DataFrame:
    """Index rows of nested data-set rows; records with an error or without text are left out."""
    return build_index(archive_files(datasets), sep)


def archive_files(datasets: DataFrame) -> DataFrame:
    """Flat file records of nested data-set rows, with ``text_preview`` where a summary was read."""
    return datasets.select(F.col("dataset_number").alias("dataset"), F.inline("files"))
