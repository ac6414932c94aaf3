"""Explicit schemas of the tables this package reads and writes."""

from pyspark.sql import types as T

DOC_COLUMNS = ["dataset", "filename", "filepath", "pages"]

CORPUS = T.StructType([
    T.StructField("dataset", T.IntegerType()),
    T.StructField("filename", T.StringType()),
    T.StructField("filepath", T.StringType()),
    T.StructField("pages", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("page_offsets", T.ArrayType(T.IntegerType())),
])

_FILE_FIELDS = [
    T.StructField("filename", T.StringType()),
    T.StructField("filepath", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("size_mb", T.DoubleType()),
    T.StructField("modified_date", T.TimestampType()),
    T.StructField("pages", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("creator", T.StringType()),
    T.StructField("producer", T.StringType()),
    T.StructField("creation_date", T.StringType()),
    T.StructField("full_text", T.StringType()),
    T.StructField("text_length", T.IntegerType()),
    T.StructField("word_count", T.IntegerType()),
    T.StructField("error", T.StringType()),
]

FILES = T.StructType([T.StructField("dataset", T.IntegerType())] + _FILE_FIELDS)

ARCHIVE_METADATA = T.StructType([
    T.StructField("extraction_date", T.StringType()),
    T.StructField("total_datasets", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("extraction_tool", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("total_files", T.LongType()),
    T.StructField("total_pages", T.LongType()),
    T.StructField("total_size_mb", T.DoubleType()),
])

ARCHIVE_DATASET = T.StructType([
    T.StructField("dataset_number", T.IntegerType()),
    T.StructField("dataset_name", T.StringType()),
    T.StructField("dataset_url", T.StringType()),
    T.StructField("files", T.ArrayType(T.StructType(_FILE_FIELDS))),
    T.StructField("file_count", T.LongType()),
    T.StructField("total_pages", T.LongType()),
    T.StructField("total_size_mb", T.DoubleType()),
])

ARCHIVE = T.StructType([
    T.StructField("metadata", ARCHIVE_METADATA),
    T.StructField("datasets", T.ArrayType(ARCHIVE_DATASET)),
])

DOC_PAGES = T.StructType([
    T.StructField("dataset", T.IntegerType()),
    T.StructField("filename", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))),
])
