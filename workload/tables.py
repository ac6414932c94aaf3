"""Search tables made from the test tables, and the same as SQL.

documents become a corpus in 12 data sets, with a line as a page; pages become listing
pages; events become fetch outcomes.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliolens.functions.text import page_offsets, split_pages, text_length, word_count
from foliolens.session import shared_dir
from foliolens.sources import signatures
from foliolens.sources.files import size_mb

SEP = "\n"
MAGIC = b"<!DOC"


def spread(df: DataFrame, key: str) -> DataFrame:
    """The test tables are single files of one row group, which is one task whatever the cores.
    This is about those files, not a part of any operator; a real corpus has many splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(3 * cores, key)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spread(docs.select(*columns) if columns else docs, "doc_id")


def _dataset() -> Column:
    return (F.substring("source", 4, 10).cast("int") % 12 + 1).cast("int")


def _corpus(spark: SparkSession, sf_dir: str, filename: Column, folder: Column) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    docs = docs.withColumn("dataset", _dataset()).withColumn("filename", filename)
    return docs.select(
        "dataset", "filename",
        F.concat(F.lit("/data-set-"), F.col("dataset").cast("string"), folder, F.col("filename")).alias("filepath"),
        F.size(split_pages(F.col("text"), SEP)).alias("pages"),
        "text",
        page_offsets("text", SEP).alias("page_offsets"),
        "lang",
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under its own file name."""
    name = F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt"))
    return _corpus(spark, sf_dir, name, F.lit("/"))


def corpus_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with 97 file names, so that many documents of all data sets share one."""
    name = F.concat(F.lit("doc-"), (F.col("doc_id") % 97).cast("string"), F.lit(".txt"))
    folder = F.concat(F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit("/"))
    return _corpus(spark, sf_dir, name, folder)


def signed(spark: SparkSession, sf_dir: str) -> str:
    """Where the corpus lies as an index with trigram postings, written once in a session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _SIGNED:
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        signatures.write_indexed(corpus(spark, sf_dir), path)
        _SIGNED[at] = path
    return _SIGNED[at]


_SIGNED: dict[tuple[str, str], str] = {}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File records; one in fifty is an error record."""
    failed = F.substring("filename", 5, 12).cast("bigint") % 50 == 7
    docs = corpus(spark, sf_dir).withColumn("error", F.when(failed, "no text"))

    def ok(value: Column) -> Column:
        return F.when(F.col("error").isNull(), value)

    size = F.octet_length("text").cast("bigint")
    return docs.select(
        "dataset", "filename", "filepath",
        ok(size).alias("size_bytes"),
        ok(size_mb(size)).alias("size_mb"),
        ok(F.col("pages")).alias("pages"),
        ok(F.col("text")).alias("full_text"),
        ok(text_length(F.col("text"))).alias("text_length"),
        ok(word_count(F.col("text"))).alias("word_count"),
        "error",
    )


def web_pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", *columns), "page_id")


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_pages(spark, sf_dir, "url", "html").select(
        (F.col("page_id") % 12 + 1).cast("int").alias("dataset"),
        F.floor(F.col("page_id") / 12).cast("int").alias("page_num"),
        F.col("url").alias("base_url"), "html")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents: the web pages, and every text as one that is not valid."""
    html = web_pages(spark, sf_dir, "html").select(
        (F.col("page_id") % 12 + 1).cast("int").alias("dataset"),
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("filename"),
        F.col("html").cast("binary").alias("content"))
    text = documents(spark, sf_dir, "doc_id", "text", "source").select(
        _dataset().alias("dataset"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("filename"),
        F.col("text").cast("binary").alias("content"))
    return html.unionByName(text)


def have_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names taken as already fetched: every ASCII word of the documents, in the data set of each."""
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return docs.select(_dataset().alias("dataset"), F.explode(F.array_distinct(words)).alias("filename")).distinct()


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("user_id") % 12 + 1).cast("int").alias("dataset"),
        F.when(kind == "error", "failed").when(kind == "view", "skipped").otherwise("downloaded").alias("status"))


# --- the same as SQL ---------------------------------------------------------------------

_DATASET = "CAST(CAST(substr(source, 4) AS INTEGER) % 12 + 1 AS INTEGER)"


def _corpus_sql(filename: str, folder: str) -> str:
    return f"""SELECT dataset, filename, '/data-set-' || dataset || {folder} || filename AS filepath,
        CAST(len(string_split(text, chr(10))) AS INTEGER) AS pages, text, lang
      FROM (SELECT *, {_DATASET} AS dataset, {filename} AS filename FROM documents)"""


CORPUS = "corpus AS (" + _corpus_sql(
    "'doc-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.txt'", "'/'") + ")"

BY_NAME = "corpus AS (" + _corpus_sql(
    "'doc-' || (doc_id % 97) || '.txt'", "'/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '/'") + ")"

OFFSETS = """list_transform(range(0, len(string_split(text, chr(10)))), lambda i: CAST(coalesce(list_sum(
      list_transform(list_slice(string_split(text, chr(10)), 1, i), lambda p: length(p) + 1)), 0) AS INTEGER))"""

WORDS = "len(list_filter(string_split_regex({}, '\\s+'), lambda w: w <> ''))"

FILES = CORPUS + f""",
  files AS (SELECT dataset, filename, filepath,
      CASE WHEN error IS NULL THEN size_bytes END AS size_bytes,
      CASE WHEN error IS NULL THEN round_even(size_bytes / 1048576.0, 2) END AS size_mb,
      CASE WHEN error IS NULL THEN pages END AS pages,
      CASE WHEN error IS NULL THEN text END AS full_text,
      CASE WHEN error IS NULL THEN CAST(length(text) AS INTEGER) END AS text_length,
      CASE WHEN error IS NULL THEN CAST({WORDS.format('text')} AS INTEGER) END AS word_count,
      error
    FROM (SELECT *, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes,
        CASE WHEN CAST(substr(filename, 5, 12) AS BIGINT) % 50 = 7 THEN 'no text' END AS error FROM corpus))"""

LISTING = """listing AS (SELECT CAST(page_id % 12 + 1 AS INTEGER) AS dataset,
      CAST(page_id // 12 AS INTEGER) AS page_num, url AS base_url, html FROM pages)"""

STORED = f"""stored AS (
    SELECT CAST(page_id % 12 + 1 AS INTEGER) AS dataset, 'page-' || page_id AS filename, html AS body FROM pages
    UNION ALL SELECT {_DATASET}, 'doc-' || doc_id, text FROM documents)"""

HAVE = f"""have AS (SELECT DISTINCT {_DATASET} AS dataset,
    unnest(regexp_extract_all(lower(text), '[a-z]+')) AS filename FROM documents)"""

OUTCOMES = """outcomes AS (SELECT CAST(user_id % 12 + 1 AS INTEGER) AS dataset,
      CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'downloaded' END AS status
    FROM events)"""


def spans(term: str, name: str, where: str = "true", source: str = "corpus", flags: str = "(?i)",
          regex: str | None = None) -> str:
    """Common table ``name``: every match as (document columns, text, i, s, e, m)."""
    pat = flags + (regex if regex is not None else _quote(term))
    pat = pat.replace("'", "''")
    return f"""{name}_p AS (SELECT *, string_split_regex(text, '{pat}') AS p,
        regexp_extract_all(text, '{pat}') AS found
      FROM {source} WHERE regexp_matches(text, '{pat}') AND {where}),
    {name}_i AS (SELECT filepath, unnest(range(1, len(found) + 1)) AS i, len(found) AS n,
        unnest(list_transform(list_slice(p, 1, len(found)), lambda x: length(x))) AS gap,
        unnest(found) AS m FROM {name}_p),
    {name}_e AS (SELECT *, sum(gap + length(m)) OVER (PARTITION BY filepath ORDER BY i) AS e FROM {name}_i),
    {name} AS (SELECT dataset, filename, filepath, pages, text, i, m, CAST(e - length(m) AS INTEGER) AS s,
        CAST(e AS INTEGER) AS e, CAST(n AS INTEGER) AS match_count
      FROM {name}_e JOIN corpus USING (filepath))"""


def _quote(term: str) -> str:
    return "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in term)


def context(s: str = "s", e: str = "e", m: str = "m", chars: int = 300) -> str:
    """Select list of one context: position, context, match, page."""
    return f"""CAST({s} AS INTEGER) AS position,
      CASE WHEN {s} > {chars} THEN '...' ELSE '' END
        || substr(text, greatest({s} - {chars}, 0) + 1,
                  least({e} + {chars}, length(text)) - greatest({s} - {chars}, 0))
        || CASE WHEN {e} + {chars} < length(text) THEN '...' ELSE '' END AS context,
      {m} AS match,
      CAST(1 + length(substr(text, 1, {s})) - length(replace(substr(text, 1, {s}), chr(10), '')) AS INTEGER) AS page"""


def pairs(one: str, two: str, n: int, name: str) -> str:
    """Common table ``name``: all pairs (document columns, text, i, j, s, e)."""

    def edges(src: str) -> str:
        # words that begin before the start, and before the end less one that runs on past it
        return f"""SELECT x.*, coalesce(a.i, 0) AS ws, coalesce(b.i, 0)
          - CASE WHEN regexp_matches(substr(text, x.e, 2), '^\\S\\S$') THEN 1 ELSE 0 END AS we
        FROM {src} x
          ASOF LEFT JOIN {name}_w_e a ON x.filepath = a.filepath AND x.s > a.e - length(a.m)
          ASOF LEFT JOIN {name}_w_e b ON x.filepath = b.filepath AND x.e > b.e - length(b.m)"""

    both = f"filepath IN (SELECT filepath FROM {name}_a) AND filepath IN (SELECT filepath FROM {name}_b)"
    return f"""{spans(one, name + '_a')}, {spans(two, name + '_b')},
    {spans('', name + '_w', both, regex='\\S+')},
    {name}_1 AS ({edges(name + '_a')}), {name}_2 AS ({edges(name + '_b')}),
    {name} AS (SELECT a.dataset, a.filename, a.filepath, a.pages, a.text, a.i AS i, b.i AS j,
        least(a.s, b.s) AS s, greatest(a.e, b.e) AS e
      FROM {name}_1 a JOIN {name}_2 b ON a.filepath = b.filepath
      WHERE (a.e < b.s AND b.ws - a.we <= {n}) OR (b.e < a.s AND a.ws - b.we <= {n}))"""
