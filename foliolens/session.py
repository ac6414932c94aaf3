"""Session settings and the shared folder for intermediate tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(builder: SparkSession.Builder, shuffle_partitions: int | None = None) -> SparkSession.Builder:
    """Apply ``SETTINGS``. ``shuffle_partitions`` is the number adaptive execution starts
    from before it joins small partitions; on a large cluster give a few per core."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below the one that ``spark.checkpoint.dir`` (or
    ``setCheckpointDir``) names. Without one there is no place that all executors see: an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    return f"{named.rstrip('/')}/foliolens-{spark.sparkContext.applicationId}"


def shared_table(df: DataFrame) -> DataFrame:
    """Write a narrow intermediate result once and read it back.

    Several later steps can then read it without scanning the texts again, and a
    lost executor costs no recomputation.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
