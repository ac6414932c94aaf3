"""Matching rows against a set of keys when one key may hold a large share of the rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

HOT_KEYS = 1000


def flag_by_key(left: DataFrame, keys: DataFrame, key: list[str], row_id: list[str],
                out: str, counts: DataFrame | None = None) -> DataFrame:
    """Add boolean ``out``: is the row's key among ``keys`` (which must be distinct)?

    The ``HOT_KEYS`` most frequent keys of ``left`` are decided by a broadcast join: their
    number is fixed, so the broadcast does not grow with the data. Every other key holds
    at most 1/HOT_KEYS of the rows and goes through an ordinary shuffle join, in which the
    rows of hot keys, and those without a key, are spread over all partitions by a salt
    instead of meeting in one.

    ``counts`` (key columns and ``n``) saves counting the keys of ``left`` when known.
    """
    if counts is None:
        counts = left.groupBy(*key).agg(F.count("*").alias("n"))
    present = keys.select(*key, F.lit(True).alias("_present"))
    hottest = counts.orderBy(F.desc("n"), *key).limit(HOT_KEYS)
    hot = hottest.join(present, key, "left").select(
        *key, F.coalesce("_present", F.lit(False)).alias("_hot"))
    open_key = reduce(Column.__and__, [F.col(k).isNotNull() for k in key], F.col("_hot").isNull())
    rows = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(open_key, 0).otherwise(1 + F.pmod(F.xxhash64(*row_id), F.lit(1 << 20))))
    cold = present.withColumn("_salt", F.lit(0).cast("bigint")).withColumnRenamed("_present", "_cold")
    joined = rows.join(cold, key + ["_salt"], "left")
    return joined.withColumn(out, F.coalesce("_hot", "_cold", F.lit(False))).select(*left.columns, out)


def keep_by_key(left: DataFrame, keys: DataFrame, key: list[str], row_id: list[str],
                counts: DataFrame | None = None) -> DataFrame:
    """Semi join by ``flag_by_key``."""
    return flag_by_key(left, keys, key, row_id, "_keep", counts).filter("_keep").drop("_keep")


def drop_by_key(left: DataFrame, keys: DataFrame, key: list[str], row_id: list[str],
                counts: DataFrame | None = None) -> DataFrame:
    """Anti join by ``flag_by_key``."""
    return flag_by_key(left, keys, key, row_id, "_drop", counts).filter("NOT _drop").drop("_drop")
