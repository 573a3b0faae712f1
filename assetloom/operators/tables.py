"""Keep-first de-duplication, emitted orders, set operations and name lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from assetloom.operators.inherit import dimension, row_bytes
from assetloom.sources.scratch import stored

#: Rows and bytes of one group that a single task orders; a larger group is split over range partitions.
TASK_ROWS, TASK_BYTES = 500_000, 128 << 20


def spread(df: DataFrame, by: Sequence[str], rows: int = 50_000) -> DataFrame:
    """Rows dealt out by a key of theirs over tasks of about ``rows`` (and as many as a shuffle has), for rows that are about to
    become much wider: a small file may hold more of them than a task can sort."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    return df.repartition(tasks, *by)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order; NULL and blank keys are alike.

    ``row_number() = 1`` lets Spark drop later rows of a key before the shuffle, so a frequent key is no hot spot."""
    k = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]
    w = Window.partitionBy(*k).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def keep_last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def sort_table(df: DataFrame, keys: Sequence[str], descending: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """Byte order of the keys, blank first; ties in the order of ``tie``."""
    k = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]
    return df.orderBy(*[c.desc() if descending else c.asc() for c in k], *tie)


def positions(df: DataFrame, keys: Sequence[str], tie: Sequence[str] = (), descending: bool = False, within: Sequence[str] = ()) -> DataFrame:
    """The place (from 1) of each row in the order of ``sort_table``, globally or within groups of any size."""
    k = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]
    order = [*[c.desc() if descending else c.asc() for c in k], *tie]
    return running(df, within, order, F.lit(1), "position", inclusive=True)


def _split(df: DataFrame, by: Sequence[str], task_rows: int | None) -> tuple[DataFrame, bool]:
    """The rows, stored, and whether one of their groups is too large for a task (measured)."""
    df = stored(df, "groups")
    most = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(row_bytes(df)).alias("bytes")).agg(F.max("n"), F.max("bytes")).first()
    return df, (most[0] or 0) > (TASK_ROWS if task_rows is None else task_rows) or (most[1] or 0) > TASK_BYTES


def _ranged(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    """Rows range-partitioned by group and order, with their partition in ``__part``, written to shared storage.

    Range bounds are sampled anew whenever they are computed, so the partition numbers have to be kept."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def running(df: DataFrame, by: Sequence[str], order: Sequence, value: Column | str | dict[str, Column], name: str = "", inclusive: bool = False, task_rows: int | None = None) -> DataFrame:
    """Adds the running sum of ``value`` (whole numbers) before each row of its group, or up to it; of several values at
    once, given by the names of their sums.

    A group is one window if no group has more rows or bytes than a task takes (``TASK_ROWS``, ``TASK_BYTES``). Else rows are range-partitioned by
    group and order, values are summed per partition and group (joined by broadcast if they are few), and only the sum
    within a partition is a window. Rows of equal order come in any order of each other."""
    values = value if isinstance(value, dict) else {name: F.col(value) if isinstance(value, str) else value}
    last, names = 0 if inclusive else -1, list(values)
    df, large = _split(df.withColumns({f"__v{i}": v for i, v in enumerate(values.values())}), by, task_rows)

    def sums(w: WindowSpec, base: str | None = None) -> dict[str, Column]:
        each = {n: F.coalesce(F.sum(f"__v{i}").over(w), F.lit(0)) for i, n in enumerate(names)}
        return {n: (c if base is None else F.col(f"{base}{i}") + c).cast("long") for i, (n, c) in enumerate(each.items())}

    drop = [f"__v{i}" for i in range(len(names))]
    if not large:
        return df.withColumns(sums(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last))).drop(*drop)
    r = _ranged(df, by, order)
    each = r.groupBy("__part", *by).agg(*[F.sum(f"__v{i}").alias(f"__sum{i}") for i in range(len(names))])
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("__part", *by, *[F.coalesce(F.sum(f"__sum{i}").over(before), F.lit(0)).alias(f"__base{i}") for i in range(len(names))])
    inside = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    j = _with(r, base, by)
    return j.withColumns(sums(inside, "__base")).drop("__part", *[f"__base{i}" for i in range(len(names))], *drop)


def _with(rows: DataFrame, parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with what is known of their partition and group; groups may be null."""
    keys = ["__part", *by]
    parts = parts.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    on = [rows[k].eqNullSafe(parts[f"__of_{k}"]) for k in keys]
    return rows.join(dimension(parts), on, "left").drop(*[f"__of_{k}" for k in keys])


def previous(df: DataFrame, by: Sequence[str], order: Sequence, value: Column | str, name: str, task_rows: int | None = None) -> DataFrame:
    """Adds ``value`` of the row before in the group (NULL for its first), in groups of any size, split as by ``running``:
    the first row of a partition takes it from the last row of the group's partition before."""
    value = F.col(value) if isinstance(value, str) else value
    df, large = _split(df.withColumn("__v", value), by, task_rows)
    if not large:
        return df.withColumn(name, F.lag("__v").over(Window.partitionBy(*by).orderBy(*order))).drop("__v")
    r = _ranged(df, by, order)
    inside = Window.partitionBy("__part", *by).orderBy(*order)
    ends = r.withColumn("__n", F.row_number().over(inside)).groupBy("__part", *by).agg(F.max_by("__v", "__n").alias("__end"))
    before = Window.partitionBy(*by).orderBy("__part")
    carried = ends.select("__part", *by, F.lag("__end").over(before).alias("__carried"))
    j = _with(r, carried, by).withColumn("__n", F.row_number().over(inside))
    return j.withColumn(name, F.when(F.col("__n") == 1, F.col("__carried")).otherwise(F.lag("__v").over(inside))).drop("__part", "__carried", "__v", "__n")


def ranks(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """The place (from 0) of each row within its group, of any size."""
    return running(df, by, order, F.lit(1), name)


def distinct_names(*names: tuple[DataFrame, Column], skipped: Sequence[str] = ("default",)) -> DataFrame:
    """The distinct trimmed names of several columns, without blanks and the skipped ones (in any case)."""
    every = reduce(lambda a, b: a.unionByName(b), [df.select(F.trim(c).alias("Name")) for df, c in names])
    return every.filter((F.col("Name") != "") & ~F.lower("Name").isin(list(skipped))).distinct()


def split_storage(storage: str) -> Column:
    return F.when(F.col(storage) == "STREAMED", "streamed").otherwise("loaded")
