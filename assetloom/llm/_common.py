"""Shared plumbing: table access, durable intermediates, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder path below ``spark.checkpoint.dir``, which every executor can reach.

    Only on a single machine (a local master) may that setting be absent: a temporary folder is set then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-loom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here and a lost executor costs no rework."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``: for the states of a loop that a later one has replaced."""
    spark, path = df.sparkSession, df.stored_at
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def positional(df: DataFrame, *cols: str) -> tuple[DataFrame, list[str]]:
    """``df`` with columns c0, c1, ... and the new names of ``cols``, so that no name of a user's column can clash.

    The original names come back with ``toDF(*df.columns)``.
    """
    names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(names))]), [f"c{names.index(c)}" for c in cols]


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the given columns, under new names. They are found by exact name, so others may differ from them in case only."""
    safe, names = positional(df, *cols.values())
    return safe.select(*[F.col(c).alias(new) for new, c in zip(cols, names, strict=True)])


def led(df: DataFrame, key: Sequence[str], order: Sequence[str], what: str = "led") -> DataFrame:
    """Every row with the first row of its key: ``lead_x`` for each x in ``order``, and ``chunk``.

    Rows are range-partitioned and sorted by key and order, so a key in a third of all rows spreads over as many tasks
    as its rows need; each task hands the first row of a key on to the next rows. The first and the last key of every
    task (one row) tell a task whose first key began in an earlier one what leads it; they are broadcast. ``chunk``
    numbers runs of at most 1,024 rows of one key. Keys must not be null; equal rows share a lead. Order: nulls first.
    """
    spark, names = df.sparkSession, df.columns
    kind = {f.name: f.dataType for f in df.schema.fields}
    leads = [f"lead_{c}" for c in order]

    def mark(batches):
        part, carry, base = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = {c: b.column(names.index(c)) for c in [*key, *order]}
            if carry is not None:  # stands for the last row before: its key, and the order of what leads it
                cols = {c: pa.concat_arrays([carry[c], x]) for c, x in cols.items()}
            n, skip = len(cols[key[0]]), int(carry is not None)
            new = np.ones(n, bool)
            new[1:] = False
            for c in key:
                new[1:] |= np.asarray(pc.not_equal(cols[c][1:], cols[c][:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            pos = np.arange(n) - first + np.where(first == 0, base, 0)
            lead = {c: cols[c].take(pa.array(first)) for c in order}
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(lead[c][skip:] for c in order), pa.array(np.full(n - skip, part, np.int32)), pa.array((part << 32) + pos[skip:] // 1024)],
                [*names, *leads, "part", "chunk"],
            )
            carry, base = {c: (lead[c] if c in lead else cols[c])[n - 1 :] for c in cols}, int(pos[-1])

    fields = [*df.schema.fields, *[T.StructField(a, kind[c]) for a, c in zip(leads, order, strict=True)], T.StructField("part", T.IntegerType()), T.StructField("chunk", T.LongType())]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(parts, *key, *order).sortWithinPartitions(*key, *order).mapInArrow(mark, T.StructType(fields))
    out = stored(out, what)
    # where a task's first key began in an earlier one, the first of those knows what leads it: one row a task
    k = F.struct(*key)
    ends = out.groupBy("part").agg(F.min(k).alias("lo"), F.max(k).alias("hi"), F.max_by(F.struct(*leads), k).alias("lead"))
    began = ends.groupBy(F.col("hi").alias("key")).agg(F.min("part").alias("from"), F.min_by("lead", "part").alias("true"))
    mend = ends.join(F.broadcast(began), F.col("lo") == F.col("key")).filter("from < part").select(F.col("part").alias("of"), F.col("key").alias("led_key"), "true")
    mend = stored(mend.coalesce(1), "mend")
    out = out.join(F.broadcast(mend), (F.col("part") == F.col("of")) & (k == F.col("led_key")), "left")
    known = F.col("of").isNotNull()
    return out.select(*names, *[F.when(known, F.col("true")[a]).otherwise(F.col(a)).alias(a) for a in leads], "chunk")


def numbered(df: DataFrame, order: Sequence[str] = (), name: str = "at", what: str = "numbered") -> DataFrame:
    """Every row with its number from 0 (``name``) in the order of the given columns, or in any fixed order without them.

    Rows are range-partitioned and sorted, numbered within their partition and written to the shared folder; the first
    number of each partition comes from the counts of those before it (one row a partition, broadcast)."""
    spark, names = df.sparkSession, df.columns

    def mark(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows))], [*names, "part_", "pos_"])
            at += b.num_rows

    fields = [*df.schema.fields, T.StructField("part_", T.IntegerType()), T.StructField("pos_", T.LongType())]
    if order:
        df = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    out = stored(df.mapInArrow(mark, T.StructType(fields)), what)
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    start = out.groupBy("part_").agg(F.count("*").alias("n_")).select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    return out.join(F.broadcast(start), "part_").select(*names, (F.col("base_") + F.col("pos_")).alias(name))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list by alternating large and small stars.

    Returns ``(id, component)`` for every vertex of an edge; the component is its smallest id. Every round is two
    aggregations of minima, which combine before the shuffle, so a vertex of any degree is no hot spot; the join back
    is on the vertex and can be split where it is skewed.
    """
    cur = stored(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges"
    )

    def mark(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    was = mark(cur)
    while was[0]:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        was_cur, cur = cur, stored(small, "edges")
        now = mark(cur)
        dropped(was_cur)
        if now == was:
            break
        was = now
    tops = cur.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops)
