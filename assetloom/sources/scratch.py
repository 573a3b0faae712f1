"""A place for intermediate files that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Only on a single machine may that be unset: a temporary folder is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-loom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "stored") -> DataFrame:
    """Written once and read back, which ends the lineage."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def no_inferred_filters(spark: SparkSession):
    """For actions on tables of a hundred computed columns, where deriving filters from all of them takes longer than the job.

    Queries that other threads of the session plan meanwhile do without such filters too; their results are the same."""
    name = "spark.sql.constraintPropagation.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, was)
