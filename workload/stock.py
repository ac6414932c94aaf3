"""Inventory queries: text functions, records, roll-ups, validity, index and exports."""

import uuid

from pyspark.sql import functions as F

from foliolens.functions import text as fx
from foliolens.functions.content import has_magic
from foliolens.operators import inventory
from foliolens.operators.search import count_matches, filenames
from foliolens.session import shared_dir
from foliolens.sources import files as sources, index
from workload import tables as t
from workload.registry import query


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query("text_preview", f"""WITH {t.CORPUS} SELECT filename,
  CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS text_preview FROM corpus""")
def _(spark, sf):
    return t.corpus(spark, sf).select("filename", fx.text_preview(F.col("text")).alias("text_preview"))


@query("text_stats", f"""WITH {t.CORPUS} SELECT filename, CAST(length(text) AS INTEGER) AS text_length,
  CAST({t.WORDS.format('text')} AS INTEGER) AS word_count FROM corpus""")
def _(spark, sf):
    return t.corpus(spark, sf).select(
        "filename", fx.text_length(F.col("text")).alias("text_length"),
        fx.word_count(F.col("text")).alias("word_count"))


@query("page_offsets", f"""WITH {t.CORPUS} SELECT filename, CAST(unnest(range(1, len(o) + 1)) AS INTEGER) AS page_number,
    unnest(o) AS page_offset FROM (SELECT filename, {t.OFFSETS} AS o FROM corpus)""")
def _(spark, sf):
    pages = t.corpus(spark, sf).select("filename", F.posexplode("page_offsets").alias("i", "page_offset"))
    return pages.select("filename", (F.col("i") + 1).alias("page_number"), "page_offset")


@query("position_to_page", f"""WITH {t.CORPUS} SELECT filename, position, CAST(1 + length(substr(text, 1, position))
    - length(replace(substr(text, 1, position), chr(10), '')) AS INTEGER) AS page
  FROM (SELECT filename, text, CAST(unnest([0, length(text) // 3, length(text) // 2, length(text)]) AS INTEGER)
    AS position FROM corpus)""")
def _(spark, sf):
    n = F.char_length("text")
    places = F.array(F.lit(0), F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int"), n)
    docs = t.corpus(spark, sf).select("filename", "page_offsets", F.explode(places).alias("position"))
    return docs.select("filename", "position",
                       fx.position_to_page(F.col("position"), F.col("page_offsets")).alias("page"))


@query("page_rows", f"""WITH {t.CORPUS} SELECT dataset, filename, filepath,
    CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS page_number, unnest(p) AS text
  FROM (SELECT *, string_split(text, chr(10)) AS p FROM corpus)""")
def _(spark, sf):
    return sources.page_rows(t.corpus(spark, sf), t.SEP)


@query("join_pages", f"""WITH {t.CORPUS}, j AS (SELECT dataset, filename, filepath, pages,
    array_to_string(list_transform(string_split(text, chr(10)), lambda p: p || chr(10) || chr(10)), '') AS joined FROM corpus)
  SELECT dataset, filename, filepath, pages AS page_count, regexp_replace(joined, '^\\s+|\\s+$', '', 'g') AS full_text,
    CAST(length(joined) AS INTEGER) AS text_length FROM j""")
def _(spark, sf):
    return sources.join_page_rows(sources.page_rows(t.corpus(spark, sf), t.SEP))


@query("parse_info", """SELECT doc_id, unnest(['Title', 'Pages', 'Author']) AS key,
    unnest([source, CAST(n_chars AS VARCHAR), 'a: ' || lang]) AS value,
    unnest([0, n_chars, 0]) AS number FROM documents""")
def _(spark, sf):
    raw = F.concat(F.lit("Title: "), "source", F.lit("\nPages: "), F.col("n_chars").cast("string"),
                   F.lit("\nno entry\nAuthor: x\nAuthor: a: "), "lang")
    docs = t.documents(spark, sf, "doc_id", "source", "n_chars", "lang")
    info = docs.select("doc_id", F.explode(fx.parse_info(raw)).alias("key", "value"))
    return info.withColumn("number", fx.lenient_int(F.col("value")).cast("bigint"))


@query("build_index", f"""WITH {t.FILES} SELECT dataset, filename, filepath, pages, text,
    CAST(len(o) AS INTEGER) AS page_count, o[len(o)] AS last_offset
  FROM (SELECT dataset, filename, filepath, pages, full_text AS text,
    {t.OFFSETS.replace('text', 'full_text')} AS o FROM files WHERE error IS NULL)""")
def _(spark, sf):
    built = sources.build_index(t.files(spark, sf), t.SEP)
    return built.select("dataset", "filename", "filepath", "pages", "text",
                        F.size("page_offsets").alias("page_count"),
                        F.element_at("page_offsets", -1).alias("last_offset"))


@query("read_index", f"""WITH {t.FILES} SELECT dataset, count(*) AS docs, CAST(sum(pages) AS BIGINT) AS pages,
    CAST(sum(length(full_text)) AS BIGINT) AS chars FROM files WHERE error IS NULL GROUP BY dataset""")
def _(spark, sf):
    path = _folder(spark)
    index.write_index(sources.build_index(t.files(spark, sf), t.SEP), path)
    return index.read_index(spark, path).groupBy("dataset").agg(
        F.count("*").alias("docs"), F.sum("pages").alias("pages"),
        F.sum(F.char_length("text").cast("bigint")).alias("chars"))


_INDEX = f"""WITH {t.FILES} SELECT dataset, filename, filepath, pages, full_text AS text,
    {t.OFFSETS.replace('text', 'full_text')} AS page_offsets FROM files WHERE error IS NULL"""


@query("read_index_array", _INDEX.replace("AS page_offsets", "AS o").replace("WITH ", "WITH b AS (WITH ", 1)
       + ") SELECT dataset, filename, filepath, pages, text, CAST(list_sum(o) AS BIGINT) AS offsets FROM b")
def _(spark, sf):
    path = _folder(spark)
    index.write_json_array(sources.build_index(t.files(spark, sf), t.SEP), path)
    return _with_offset_sum(index.read_index(spark, path, "json_array"))


@query("read_index_json", _INDEX.replace("AS page_offsets", "AS o").replace("WITH ", "WITH b AS (WITH ", 1)
       + ") SELECT dataset, filename, filepath, pages, text, CAST(list_sum(o) AS BIGINT) AS offsets FROM b")
def _(spark, sf):
    path = _folder(spark)
    index.write_index(sources.build_index(t.files(spark, sf), t.SEP), path, "json")
    return _with_offset_sum(index.read_index(spark, path, "json"))


def _with_offset_sum(found):
    total = F.aggregate("page_offsets", F.lit(0).cast("bigint"), lambda a, b: a + b)
    return found.withColumn("offsets", total).select("dataset", "filename", "filepath", "pages", "text", "offsets")


@query("summary_nested", f"""WITH {t.FILES}, r AS (SELECT dataset, count(*) AS file_count,
    CAST(sum(coalesce(pages, 0)) AS BIGINT) AS total_pages,
    round_even(sum(coalesce(size_mb, 0)), 2) AS total_size_mb FROM files GROUP BY dataset),
  m AS (SELECT count(*) FILTER (WHERE error IS NULL) AS total_files, CAST(sum(coalesce(pages, 0)) AS BIGINT) AS all_pages FROM files)
  SELECT dataset AS dataset_number, file_count, total_pages, total_size_mb, filename, pages, text_length, error,
    CASE WHEN length(full_text) > 500 THEN substr(full_text, 1, 500) || '...' ELSE full_text END AS text_preview,
    total_files, all_pages, 'tool' AS extraction_tool FROM files JOIN r USING (dataset), m""")
def _(spark, sf):
    path = _folder(spark)
    index.write_summary(t.files(spark, sf), path, "http://h", "tool", "previews")
    rows = index.read_archive(spark, path).select("dataset_number", "file_count", "total_pages", "total_size_mb", F.inline("files"))
    meta = index.read_metadata(spark, path).select("total_files", F.col("total_pages").alias("all_pages"), "extraction_tool")
    rows = rows.select("dataset_number", "file_count", "total_pages", "total_size_mb", "filename", "pages", "text_length", "error", "text_preview")
    return rows.join(F.broadcast(meta))  # one row of metadata


@query("archive_nested", f"""WITH {t.FILES}, r AS (SELECT dataset, count(*) AS file_count,
    CAST(sum(coalesce(pages, 0)) AS BIGINT) AS total_pages,
    round_even(sum(coalesce(size_mb, 0)), 2) AS total_size_mb FROM files GROUP BY dataset)
  SELECT dataset AS dataset_number, 'data-set-' || dataset AS dataset_name,
    'http://h/data-set-' || dataset || '-files' AS dataset_url, file_count, total_pages, total_size_mb,
    filename, pages, text_length, error FROM files JOIN r USING (dataset)""")
def _(spark, sf):
    # small parts, so that a data set really is cut
    nested = index.nest_archive(t.files(spark, sf), "http://h", part_bytes=200_000)
    head = ["dataset_number", "dataset_name", "dataset_url", "file_count", "total_pages", "total_size_mb"]
    return nested.select(*head, F.inline("files")).select(*head, "filename", "pages", "text_length", "error")


@query("flatten_archive", f"""WITH {t.FILES} SELECT dataset, filename, filepath, pages, full_text AS text
  FROM files WHERE error IS NULL""")
def _(spark, sf):
    path = _folder(spark)
    index.write_archive(t.files(spark, sf), path)
    flat = index.flatten_archive(index.read_archive(spark, path), t.SEP)
    return flat.select("dataset", "filename", "filepath", "pages", "text")


@query("scan_files", f"""WITH {t.CORPUS} SELECT CAST(d AS INTEGER) AS dataset,
    CAST(coalesce(sum(octet_length(encode(text)) + 1), 0) AS BIGINT) AS size_bytes
  FROM range(1, 15) r(d) LEFT JOIN corpus ON dataset = d GROUP BY d""")
def _(spark, sf):
    path = _folder(spark)
    folder = F.concat(F.lit("data-set-"), F.col("dataset").cast("string"))
    t.corpus(spark, sf).select("text", folder.alias("set")).write.partitionBy("set").text(path)
    stats = sources.file_stats(sources.scan_files(spark, path, "*.txt"), path)
    return sources.with_empty_datasets(stats, 14).groupBy("dataset").agg(
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))


@query("file_stats", f"""WITH {t.CORPUS}, s AS (SELECT dataset, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size_bytes
    FROM corpus GROUP BY dataset)
  SELECT dataset, size_bytes, round_even(size_bytes / 1048576.0, 2) AS size_mb, true AS named, true AS placed, true AS dated FROM s""")
def _(spark, sf):
    path = _folder(spark)
    folder = F.concat(F.lit("data-set-"), F.col("dataset").cast("string"))
    # one file for each data set; what it is called is up to the writer
    t.corpus(spark, sf).select("text", folder.alias("set")).repartition("set").write.partitionBy("set").text(path)
    stats = sources.file_stats(sources.scan_files(spark, path, "*.txt"), path)
    return stats.select(
        "dataset", "size_bytes", "size_mb", F.col("filename").rlike(r"^part-[^/]*\.txt$").alias("named"),
        (F.col("filepath") == F.concat(F.lit("/set=data-set-"), F.col("dataset").cast("string"), F.lit("/"), "filename")).alias("placed"),
        F.col("modified_date").between(F.current_timestamp() - F.expr("INTERVAL 1 DAY"), F.current_timestamp() + F.expr("INTERVAL 1 DAY")).alias("dated"))


@query("file_records", f"""WITH {t.CORPUS} SELECT dataset, filename, filepath,
    CASE WHEN ok THEN size_bytes END AS size_bytes, CASE WHEN ok THEN CASE WHEN lang = 'en' THEN pages ELSE 0 END END AS pages,
    CASE WHEN ok THEN 'T ' || lang END AS title, CASE WHEN ok THEN '' END AS author,
    CASE WHEN ok THEN CAST(length(text) AS INTEGER) END AS text_length,
    CASE WHEN ok THEN CAST({t.WORDS.format('text')} AS INTEGER) END AS word_count,
    CASE WHEN NOT ok THEN 'no text' END AS error
  FROM (SELECT *, lang <> 'de' AS ok, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM corpus)""")
def _(spark, sf):
    docs = t.corpus(spark, sf)
    size = F.octet_length("text").cast("bigint")
    pages = F.when(F.col("lang") == "en", F.col("pages").cast("string")).otherwise("unknown")
    rows = docs.select("dataset", "filename", "filepath", size.alias("size_bytes"),
                       sources.size_mb(size).alias("size_mb"), F.lit(None).cast("timestamp").alias("modified_date"),
                       F.col("text").alias("full_text"),
                       F.concat(F.lit("Title:  T "), "lang", F.lit("\nPages: "), pages).alias("raw"),
                       F.when(F.col("lang") == "de", "no text").alias("error"))
    return sources.records(rows).select("dataset", "filename", "filepath", "size_bytes", "pages", "title", "author",
                                        "text_length", "word_count", "error")


@query("file_list", f"""WITH {t.FILES} SELECT dataset, filename, pages, size_mb, word_count
  FROM files WHERE error IS NULL""")
def _(spark, sf):
    return index.file_list(t.files(spark, sf))


@query("summary_rows", f"""WITH {t.FILES} SELECT dataset, filename, filepath, size_bytes, size_mb, pages,
    text_length, word_count, error, substr(full_text, 1, 500) || '...' AS text_preview FROM files""")
def _(spark, sf):
    return index.summary_rows(t.files(spark, sf), always_dots=True)


_EXPORT = f"""WITH {t.CORPUS} SELECT filename, dataset, pages,
    CAST(len(regexp_extract_all(text, '(?i)the')) AS INTEGER) AS match_count{{}}
  FROM corpus WHERE regexp_matches(text, '(?i)the')"""


@query("export_hits", _EXPORT.format(""))
def _(spark, sf):
    path = _folder(spark)
    index.export_csv(count_matches(t.corpus(spark, sf), "the"), path)
    return spark.read.schema("filename string, dataset int, pages int, match_count int").csv(path, header=True)


@query("export_hits_json", _EXPORT.format(", filepath"))
def _(spark, sf):
    path = _folder(spark)
    index.export_json(count_matches(t.corpus(spark, sf), "the"), path)
    return spark.read.schema(
        "filename string, dataset int, pages int, match_count int, filepath string").json(path)


@query("filenames_in_dataset", f"WITH {t.CORPUS} SELECT filename FROM corpus WHERE dataset = 1")
def _(spark, sf):
    return filenames(t.corpus(spark, sf), 1)


@query("filenames_all", f"WITH {t.CORPUS} SELECT filename FROM corpus")
def _(spark, sf):
    return filenames(t.corpus(spark, sf))


_ROLLUP = """SELECT dataset, count(*) AS file_count, CAST(sum(coalesce(pages, 0)) AS BIGINT) AS total_pages,
    round_even(sum(coalesce(size_mb, 0)), 2) AS total_size_mb FROM files GROUP BY dataset"""
_TOTALS = """SELECT count(*) AS total_files, CAST(coalesce(sum(pages), 0) AS BIGINT) AS total_pages,
    round_even(coalesce(sum(size_mb), 0), 2) AS total_size_mb FROM files WHERE error IS NULL"""


@query("dataset_rollup", f"WITH {t.FILES} {_ROLLUP}")
def _(spark, sf):
    return inventory.dataset_rollup(t.files(spark, sf))


@query("corpus_totals", f"WITH {t.FILES} {_TOTALS}")
def _(spark, sf):
    return inventory.corpus_totals(t.files(spark, sf))


@query("extraction_summary", f"""WITH {t.FILES}, r AS ({_ROLLUP}), s AS ({_TOTALS})
  SELECT CAST(d AS INTEGER) AS dataset, coalesce(file_count, 0) AS file_count,
    coalesce(total_pages, 0) AS total_pages, coalesce(total_size_mb, 0) AS total_size_mb
  FROM range(1, 15) x(d) LEFT JOIN r ON dataset = d
  UNION ALL SELECT NULL, total_files, total_pages, total_size_mb FROM s""")
def _(spark, sf):
    return inventory.extraction_summary(t.files(spark, sf), 14)


@query("corpus_stats", f"""WITH {t.CORPUS} SELECT count(*) AS total_docs,
    CAST(sum(pages) AS BIGINT) AS total_pages FROM corpus""")
def _(spark, sf):
    return inventory.corpus_stats(t.corpus(spark, sf))


def _describe(column: str) -> str:
    stats = ", ".join(f"round(quantile_cont(CAST({column} AS DOUBLE), {q}), 4) AS {p}"
                      for p, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))
    return f"""SELECT '{column}' AS "column", count({column}) AS "count", round(avg({column}), 4) AS mean,
      round(stddev_samp({column}), 4) AS std, CAST(min({column}) AS DOUBLE) AS "min", {stats},
      CAST(max({column}) AS DOUBLE) AS "max" FROM files"""


@query("describe_corpus", f"WITH {t.FILES} " + " UNION ALL ".join(
    _describe(c) for c in ("dataset", "pages", "text_length", "size_mb")))
def _(spark, sf):
    stats = inventory.describe_corpus(t.files(spark, sf), ["dataset", "pages", "text_length", "size_mb"])
    for c in ("mean", "std", "p25", "p50", "p75"):
        stats = stats.withColumn(c, F.round(c, 4))
    return stats


@query("page_tables", f"""WITH {t.CORPUS}, p AS (SELECT dataset, filename,
    CAST(unnest(range(1, len(q) + 1)) AS INTEGER) AS page_number,
    unnest(list_transform(q, lambda x: length(x) - length(replace(x, ',', '')))) AS n
  FROM (SELECT *, string_split(text, chr(10)) AS q FROM corpus))
  SELECT dataset, filename, page_number, CAST(n AS INTEGER) AS table_count, n > 0 AS has_tables FROM p""")
def _(spark, sf):
    # a comma stands for a table
    pages = sources.page_rows(t.corpus(spark, sf), t.SEP)
    commas = F.regexp_extract_all("text", F.lit(","), F.lit(0))
    tables = F.transform(commas, lambda c: F.array(F.array(c)))
    return inventory.page_tables(pages.withColumn("tables", tables)).select(
        "dataset", "filename", "page_number", "table_count", "has_tables")


@query("document_tables", f"""WITH {t.CORPUS}, p AS (SELECT dataset, filename, filepath,
    unnest(list_transform(string_split(text, chr(10)), lambda x: length(x) - length(replace(x, ',', '')))) AS n FROM corpus)
  SELECT dataset, filename, filepath, CAST(sum(n) AS BIGINT) AS table_count, count(*) FILTER (WHERE n > 0) AS pages_with_tables
  FROM p GROUP BY ALL""")
def _(spark, sf):
    pages = sources.page_rows(t.corpus(spark, sf), t.SEP)
    commas = F.regexp_extract_all("text", F.lit(","), F.lit(0))
    return inventory.document_tables(pages.withColumn("tables", F.transform(commas, lambda c: F.array(F.array(c)))))


_VALID = "starts_with(body, '<!DOC')"


@query("valid_content", f"WITH {t.STORED} SELECT dataset, filename, {_VALID} AS valid FROM stored")
def _(spark, sf):
    return t.stored(spark, sf).select("dataset", "filename", has_magic(F.col("content"), t.MAGIC).alias("valid"))


@query("validity_counts", f"""WITH {t.STORED} SELECT dataset, count(*) FILTER (WHERE {_VALID}) AS valid,
    count(*) FILTER (WHERE NOT {_VALID}) AS invalid FROM stored GROUP BY dataset""")
def _(spark, sf):
    return inventory.validity_counts(t.stored(spark, sf), t.MAGIC)


@query("quarantine", f"""WITH {t.STORED} SELECT dataset, filename,
    CASE WHEN {_VALID} THEN 'valid' ELSE 'quarantined' END AS state FROM stored""")
def _(spark, sf):
    good, bad = inventory.quarantine(t.stored(spark, sf), t.MAGIC)
    columns = ["dataset", "filename"]
    return good.select(*columns, F.lit("valid").alias("state")).unionByName(
        bad.select(*columns, F.lit("quarantined").alias("state")))


@query("sniff_content", f"""WITH {t.STORED} SELECT dataset, filename,
    CASE WHEN starts_with(lower(regexp_replace(body, '^\\s+', '')), '<!doctype html') OR starts_with(lower(regexp_replace(body, '^\\s+', '')), '<html')
      THEN 'html' ELSE 'other' END AS kind FROM stored""")
def _(spark, sf):
    return inventory.sniff_content(t.stored(spark, sf)).select("dataset", "filename", "kind")


@query("sniff_preview", f"""WITH {t.STORED}, h AS (SELECT dataset, filename, hex(encode(body)) AS h FROM stored)
  SELECT dataset, filename, array_to_string(list_transform(range(0, least(200, length(h) // 2)), lambda i: chr(CAST(
    16 * (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1 AS INTEGER))), '')
    AS preview FROM h""")
def _(spark, sf):
    return inventory.sniff_content(t.stored(spark, sf)).select("dataset", "filename", "preview")


@query("export_hits_quoted", f"""WITH {t.CORPUS} SELECT '"' || filename || '","' || dataset || '","' ||
    len(regexp_extract_all(text, '(?i)the')) || '"' AS line FROM corpus WHERE regexp_matches(text, '(?i)the')""")
def _(spark, sf):
    path = _folder(spark)
    index.export_csv(count_matches(t.corpus(spark, sf), "the"), path, header=False, quote_all=True)
    return spark.read.text(path).select(F.col("value").alias("line"))
