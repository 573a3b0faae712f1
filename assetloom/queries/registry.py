"""Registration of queries and shared bindings of tables to operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as signals of whole samples."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 32767).cast("int")).alias("samples"))


#: The same signals as SQL.
SIG = "sig AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 32767)::INT) AS samples FROM embeddings)"
#: One row per frame.
LONG = f"{SIG}, long AS (SELECT vec_id, unnest(range(len(samples))) AS i, unnest(samples) AS s FROM sig)"
#: Nine levels from order priorities, and the like.
LEVEL_OF_KEY = "['none','low','medium','high','extreme'][(vec_id % 5)::INT + 1]"


def level_of(key: str):
    return F.element_at(F.array(*[F.lit(x) for x in ("none", "low", "medium", "high", "extreme")]), (F.col(key) % 5 + 1).cast("int"))
