"""Collects the queries and their SQL."""

import functools
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def with_shared_folder(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, for a session that may name no shared folder: on one machine a temporary one is
    named, as tests and the bench would; a cluster has to name its own."""
    @functools.wraps(build)
    def run(spark, sf_dir):
        sc = spark.sparkContext
        on_one_machine = sc.master == "local" or sc.master.startswith("local[")
        if on_one_machine and not spark.conf.get("spark.checkpoint.dir", None) and not sc.getCheckpointDir():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="foliolens-"))
        return build(spark, sf_dir)

    return run
