"""Hits of several clauses brought together under one document key."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliolens.operators.spans import context_sql, with_snippet_parts
from foliolens.plans.marks import with_marks
from foliolens.schema import DOC_COLUMNS

DOC_ORDER = ["dataset", "filename", "filepath"]
_SALTS = 256


def merge_counts(parts: DataFrame, key: list[str]) -> DataFrame:
    """One hit per key: counts summed, other columns from the first part, then first document.

    ``parts`` has the document columns, ``match_count`` and ``part`` (clause number). All
    aggregates combine before the shuffle, so a key with very many rows is no burden.
    """
    doc = F.struct(*DOC_COLUMNS)
    merged = parts.groupBy(*[F.col(k).alias(f"_key_{k}") for k in key]).agg(
        F.min_by(doc, F.struct("part", *DOC_ORDER)).alias("doc"),
        F.sum("match_count").alias("match_count"),
    )
    return merged.select("doc.*", "match_count")


def join_on_key(heads: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``heads`` (one row per key) with ``rows`` of the same key; null keys meet too."""
    named = rows.select(*[F.col(k).alias(f"_key_{k}") for k in key], *[c for c in rows.columns if c not in key])
    on = reduce(Column.__and__, [heads[k].eqNullSafe(named[f"_key_{k}"]) for k in key])
    return heads.join(named, on).drop(*[f"_key_{k}" for k in key])


def first_rows(rows: DataFrame, key: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows per key, numbered in ``rn``.

    Rows are ranked in salted shares of a key first, and each window limit drops rows before its
    shuffle: whatever share of all rows a key has, a task of the second step gets at most ``most``
    rows of each share.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(_SALTS)).cast("int")

    def ranked(some: DataFrame, by: list[str]) -> DataFrame:
        rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return some.withColumn("rn", rn).filter(F.col("rn") <= most)

    shares = ranked(rows.withColumn("_salt", salt), [*key, "_salt"]).drop("rn", "_salt")
    return ranked(shares, key)


def first_contexts(parts: DataFrame, key: list[str], most: int) -> DataFrame:
    """The first ``most`` contexts per key, in order of part, document and position.

    ``parts`` has the document columns, ``part`` and ``contexts``; ``most`` bounds the list
    that is collected.
    """
    rows = parts.select(*key, "part", *[c for c in DOC_ORDER if c not in key],
                        F.posexplode(F.slice("contexts", 1, most)).alias("i", "c"))
    kept = first_rows(rows, key, ["part", *DOC_ORDER, "i"], most)
    lists = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rn", "c"))).alias("l"))
    return lists.select(*key, F.transform("l", lambda x: x["c"]).alias("contexts"))


def first_contexts_at(docs: DataFrame, places: DataFrame, key: list[str], most: int, context_chars: int) -> DataFrame:
    """``first_contexts`` of spans: places are ranked without their snippets, which are cut in the rows of
    the few documents that hold them. What is then gathered per key is at most ``most`` contexts.

    ``places`` has the key, ``DOC_ORDER``, ``part``, ``i`` and ``s`` (start, end, match).
    """
    kept = first_rows(places, key, ["part", *DOC_ORDER, "i"], most)
    wanted = kept.groupBy("dataset", "filepath").agg(F.collect_list(F.struct("rn", "s")).alias("_wanted"))
    found = with_snippet_parts(with_marks(docs, wanted, ["dataset", "filepath"]))
    cut = f"transform(_wanted, w -> named_struct('rn', w.rn, 'c', {context_sql('w.s.start', 'w.s.end', 'w.s.match', context_chars)}))"
    rows = found.select(*key, F.explode(F.expr(cut)).alias("l"))
    lists = rows.groupBy(*key).agg(F.array_sort(F.collect_list("l")).alias("l"))
    return lists.select(*key, F.transform("l", lambda x: x["c"]).alias("contexts"))
