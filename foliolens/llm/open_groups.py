"""Groups of rows that share a key and that links have not connected: dealt to tasks in shares and compared as a whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_part(batches, column: str, of_group, names: list[str]):
    """Pairs (a, b) that ``of_group`` finds in each (key, part) of rows sorted by them. It gets n, component and
    the values of ``column`` (lists as arrays), and returns places in the group."""
    def done(table, cut):
        row, n, component = (table.column(c).to_numpy() for c in ("row", "n", "component"))
        values = table.column(column)
        values = values.to_numpy() if pa.types.is_list(values.type) else values.to_pylist()
        for i, j in zip(cut[:-1], cut[1:]):
            if j - i > 1:
                a, b = of_group(n[i:j], component[i:j], values[i:j])
                if len(a):
                    a, b = row[i:j][a], row[i:j][b]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names)

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        if not len(table):
            continue
        key, part = (table.column(c).to_numpy() for c in ("key", "part"))
        cut = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1]
        held = table.slice(cut[-1])
        yield from done(table, cut)
    if held is not None:
        yield from done(held, [0, len(held)])


def in_open_groups(named: DataFrame, chunk: int) -> DataFrame:
    """(key, part, row, component) of the groups that hold several components. One of more
    than ``chunk`` rows is cut into shares, and each pair of shares is a part."""
    size = (named.groupBy("key").agg(F.count("*").alias("rows"), F.min("component").alias("low"), F.max("component").alias("high"))
            .where("low < high").select("key", F.ceil(F.col("rows") / F.lit(chunk / 2)).cast("int").alias("shares")))
    dealt = (named.join(size, "key").withColumn("mine", F.pmod(F.xxhash64("row"), "shares").cast("int"))
             .withColumn("part", F.explode(F.when(F.col("shares") <= 2, F.array(F.lit(0))).otherwise(F.transform(
                 F.sequence(F.lit(0), F.col("shares") - 1),
                 lambda other: F.least(other, F.col("mine")) * F.col("shares") + F.greatest(other, F.col("mine")))))))
    return dealt.select("key", "part", "row", "component")
