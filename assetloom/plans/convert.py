"""Conversion of what a build adds: sources resampled, gated and cut in depth by the level of their entry."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions import scalars as S
from assetloom.operators import signal
from assetloom.sources import ranges
from assetloom.sources.scratch import stored

#: What an entry of a manifest has from its conversion. ``converted_in`` names the run whose folder holds the rows.
CONVERTED = {"size": "long", "frame_count": "long", "channel_count": "int", "frame_rate_index": "int", "converted_checksum": "string", "converted_in": "string"}


def conditioned(wanted: DataFrame, to: int = 48000, chunk_frames: int = 4096, range_bytes: int = 64 << 20) -> DataFrame:
    """(path, level, chunk_no, channel_count, frame_rate, samples) of the wanted (path, level): each file is read once for all
    of its levels, in ranges; those that have the rate are a map, the others are kept and resampled by messages. Levels are those of ``S.LEVEL_RANK``; what a level does to a row of samples is ``condition_chunks``.

    A pair that is wanted twice is made once. A null path or a file that is no signal raises an error; a signal without frames has
    one row without samples."""
    listed = stored(wanted.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("level")), ",").alias("levels")), "wanted")
    found = ranges.signal_heads(listed, "levels")
    as_is = (F.col("frame_rate") == to) | (F.col("frame_count") == 0)

    def each(which: Column) -> DataFrame:
        rows = ranges.rows_of(found.filter(which), chunk_frames, range_bytes, carried="levels")
        rows = rows.withColumn("level", F.explode(F.split("levels", ","))).withColumn("one", F.struct(F.col("asset").alias("path"), "level"))
        return rows.drop("asset", "levels")

    columns = ["one.path", "level", "chunk_no", "channel_count", F.lit(to).alias("frame_rate"), F.col("samples").cast("array<smallint>").alias("samples")]
    done = signal.gated_chunks(each(as_is)).select(*columns)
    if found.filter(~as_is).isEmpty():
        return done
    # resampling meets the rows several times
    other = stored(each(~as_is), "source-rows")
    return done.unionByName(signal.condition_chunks(other, to=to, chunk_frames=chunk_frames, asset="one").select(*columns))


def digests(rows: DataFrame, run: int = 4096) -> DataFrame:
    """(path, level, size, frame_count, channel_count, frame_rate_index, converted_checksum) of ``conditioned`` rows.

    The checksum is an MD5 in three levels (rows of samples, runs of rows, runs), so that a signal of any length is the
    work of many tasks and none holds more than a run of row digests; it depends on the length of rows, which a build keeps."""
    rate = F.array(*[F.lit(x) for x in S.RATES])
    row = rows.select(
        "path", "level", F.floor(F.col("chunk_no") / run).alias("__run"), "chunk_no", "channel_count", "frame_rate",
        F.size("samples").cast("long").alias("__n"), F.md5(F.array_join(F.col("samples").cast("array<string>"), ",")).alias("__d"),
    )

    def joined(at: str) -> Column:
        return F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "__d"))), lambda x: x["__d"]), "")).alias("__d")

    facts = [F.max("channel_count").alias("channel_count"), F.max("frame_rate").alias("frame_rate"), F.sum("__n").alias("__n")]
    runs = row.groupBy("path", "level", "__run").agg(joined("chunk_no"), *facts)
    all_ = runs.groupBy("path", "level").agg(joined("__run"), *facts)
    return all_.select(
        "path", "level", (F.col("__n") * 2).alias("size"), F.floor(F.col("__n") / F.col("channel_count")).cast("long").alias("frame_count"), "channel_count",
        (F.array_position(rate, F.col("frame_rate")) - 1).cast("int").alias("frame_rate_index"), F.upper("__d").alias("converted_checksum"),
    )


def into(root: str, **options) -> Callable[[DataFrame], DataFrame]:
    """A converter for ``jobs.build``: takes (path, level) to these and ``CONVERTED``. The rows of a run are written below
    ``root`` in a folder of their own, before the manifest that names it."""

    def convert(wanted: DataFrame) -> DataFrame:
        name = f"run-{uuid.uuid4().hex}"
        rows = conditioned(wanted, **options)
        rows.write.parquet(f"{root}/{name}")
        made = digests(wanted.sparkSession.read.schema(rows.schema).parquet(f"{root}/{name}"))
        return stored(made.withColumn("converted_in", F.lit(name)), "converted")

    return convert
