"""Narrow marks brought to the documents, so that texts and snippets stay in their rows.

What a clause decides for a key (a merged count, the wanted positions) is a narrow row. ``with_marks``
joins such rows to the documents by broadcasts of a checked size; more marks than one broadcast may
hold are dealt over passes by ranges of a key column, which the sorted index answers from
disjoint row groups. No text and no snippet crosses a shuffle either way.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from foliolens.plans.skipping import intervals, within
from foliolens.session import shared_table

MAX_MARKS = 500_000  # of some 100 bytes each
FEW_MARKS = 10_000


def same_key(left: list[Column], right: list[Column]) -> Column:
    """Null keys meet too."""
    return reduce(Column.__and__, [a.eqNullSafe(b) for a, b in zip(left, right)])


def with_marks(docs: DataFrame, marks: DataFrame, key: list[str], most: int = MAX_MARKS) -> DataFrame:
    """Documents whose ``key`` has a mark, with the mark's other columns.

    ``marks`` has one row per key and no other column of ``docs``. Of few marks the values of the
    last key column (the file name or path) also go to the scan.
    """
    marks = shared_table(marks.select(*[F.col(k).alias(f"_mark_{k}") for k in key], *[c for c in marks.columns if c not in key]))
    ranged = f"_mark_{key[-1]}"
    passes = -(-marks.count() // most)
    if passes <= 1:
        return _joined(docs, marks, key)
    cuts = marks.select(ranged).repartitionByRange(passes * 2, ranged).groupBy(F.spark_partition_id()).agg(F.max(ranged).alias("high"))
    highs = sorted(r["high"] for r in cuts.collect() if r["high"] is not None)
    parts, low = [], None
    for high in [*highs[:-1], None]:
        def inside(name: str, low=low, high=high) -> Column:
            tests = [F.col(name) > low] if low is not None else []
            tests += [F.col(name) <= high] if high is not None else []
            test = reduce(Column.__and__, tests, F.lit(True))
            return test if low is not None else test | F.col(name).isNull()  # null comes before every range
        parts.append(_joined(docs.filter(inside(key[-1])), marks.filter(inside(ranged)), key))
        low = high
    return reduce(DataFrame.unionByName, parts)


def _joined(docs: DataFrame, marks: DataFrame, key: list[str]) -> DataFrame:
    few = [r[0] for r in marks.select(f"_mark_{key[-1]}").limit(FEW_MARKS + 1).collect()]
    if len(few) <= FEW_MARKS and None not in few:
        docs = docs.filter(within(key[-1], intervals(few)))
    on = same_key([docs[k] for k in key], [marks[f"_mark_{k}"] for k in key])
    return docs.join(F.broadcast(marks), on).drop(*[f"_mark_{k}" for k in key])
