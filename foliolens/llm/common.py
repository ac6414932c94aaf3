"""Small helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_ROWS = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` (or ``setCheckpointDir``) names.

    All executors see it. It is an error to have none: a folder of one machine would be
    missing on the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    return named.rstrip("/")


_SCRATCH: list[list[str]] = []


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and a
    lost executor costs no recomputation. Inside ``scratch`` the table goes at its end, unless ``keep``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/foliolens-llm-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes in this block are removed when it ends: what is still needed
    then has to be written with ``keep``."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in small pieces, so that Python objects of few texts exist at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_texts(df: DataFrame, columns: list[str], make: Callable, schema: str) -> DataFrame:
    """``make`` turns an iterator of small record batches of ``columns`` into record batches."""
    def run(batches):
        yield from make(slices(batches))
    return df.select(*columns).mapInArrow(run, schema)


def bounded_ids(labelled: DataFrame, id_col: str, bound: int, seed: str) -> DataFrame:
    """At most ``bound`` distinct ids, the ones with the smallest keyed hash: a sample that
    does not depend on the order or number of partitions."""
    ids = labelled.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    return ids.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(bound)


def text_or_empty(text_col: str) -> "F.Column":
    return F.coalesce(F.col(text_col), F.lit(""))
