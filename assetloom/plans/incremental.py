"""Builds that do again only what changed: fingerprints of every input beside compiled rows, checksums and manifest.

The state of a build is one published snapshot (see ``snapshots``): ``marks`` has a row for every input file with its
fingerprint (size and time of change, from a listing) and the run that compiled or hashed it; ``rows``, ``bad`` and
``hashes`` lie outside of the snapshot, in a folder for each run, and are never written again, so a run writes what it
compiled and no more. A run that fails before it publishes leaves the state as it was.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.functions import scalars as S
from assetloom.operators import inherit
from assetloom.plans import jobs
from assetloom.sources import ranges, snapshots
from assetloom.sources.scratch import no_inferred_filters, stored

MARKS = "kind string, file string, mark string, run string"
_REQUEST = ["zone", "platform", "language"]


@dataclass
class Inputs:
    """``tables``, ``assets`` and ``shared`` are listings (path, length, modificationTime): of source tables, of asset files
    (also tree, rel_path, parent, ext) and of what every row depends on (templates, zone configs, platforms, locales).
    ``read`` takes source tables to their rows (as ``jobs.Context.sources``), ``hashed`` asset files (rows of ``assets``) to
    (path, source_checksum) and, if the manifest is to have them, ``jobs.FEATURES``; ``zones``, ``templates``, ``platforms`` and ``locales`` are as in ``jobs.Context``, from functions, as a
    run without changes doesn't read them."""

    tables: DataFrame
    assets: DataFrame
    shared: DataFrame
    read: Callable[[list[str]], DataFrame]
    hashed: Callable[[DataFrame], DataFrame]
    zones: Callable[[], DataFrame]
    templates: Callable[[], DataFrame]
    platforms: Callable[[], DataFrame]
    locales: Callable[[], DataFrame]


@dataclass
class Done:
    """``manifest`` as it is now; ``changes`` (kind, file, change) of the inputs, empty if nothing had to be done; what was
    compiled and hashed in this run; ``build`` of this run, or None."""

    manifest: DataFrame
    changes: DataFrame
    compiled: list[str]
    hashed: int
    build: jobs.Build | None


def mark(kind: str, listing: DataFrame) -> DataFrame:
    """(kind, file, mark) of a listing: what tells one state of a file from another without reading it."""
    return listing.select(F.lit(kind).alias("kind"), F.col("path").alias("file"), F.concat_ws(":", "length", F.unix_micros("modificationTime")).alias("mark"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """(kind, file, change): add, change or remove."""
    a, b = now.select("kind", "file", F.col("mark").alias("__now")), before.select("kind", "file", F.col("mark").alias("__was"))
    status = F.when(F.col("__was").isNull(), "add").when(F.col("__now").isNull(), "remove").when(F.col("__now") != F.col("__was"), "change")
    return a.join(b, ["kind", "file"], "full_outer").select("kind", "file", status.alias("change")).filter("change is not null")


def _kept(spark: SparkSession, root: str, what: str, marks: DataFrame, kind: str, file: str) -> DataFrame | None:
    """What earlier runs stored for the files that still count, by file and run: a run's folder is read if a mark names it."""
    keep = marks.filter(F.col("kind") == kind).select(F.col("file").alias("__of"), F.col("run").alias("__run"))
    runs = [r[0] for r in keep.select("__run").distinct().collect() if r[0] and snapshots.exists(spark, f"{root}/{what}/{r[0]}")]
    if not runs:
        return None
    found = [spark.read.parquet(f"{root}/{what}/{r}").withColumn("__by", F.lit(r)) for r in sorted(runs)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    keep = inherit.dimension(keep)
    return out.join(keep, (out[file] == keep["__of"]) & (out["__by"] == keep["__run"]), "left_semi").drop("__by")


def build(requests: DataFrame, inputs: Inputs, root: str, **options) -> Done:
    """``jobs.build`` with what is known below ``root``.

    Nothing changed (no input file and no request): the published manifest, after a comparison of listings; no table, no
    content and no compiled row is read. Else only rows of added and changed source tables are compiled (all, if a shared
    input changed) and only added and changed assets hashed; keep-first, resolution and the diff, which compare rows with
    one another, run over the compiled rows. Paths of changed tables go to the driver, which hands them to the reader."""
    spark = requests.sparkSession
    asked = requests.select(*_REQUEST).distinct().select(F.lit("request").alias("kind"), F.to_json(F.struct(*_REQUEST)).alias("file"), F.lit("").alias("mark"))
    now = mark("table", inputs.tables).unionByName(mark("asset", inputs.assets)).unionByName(mark("shared", inputs.shared)).unionByName(asked)
    name = snapshots.current(spark, root)
    at = f"{root}/{name}"
    before = spark.read.schema(MARKS).parquet(f"{at}/marks") if name else spark.createDataFrame([], MARKS)
    changes = stored(changed(now, before), "changes")
    if name and changes.isEmpty():
        return Done(spark.read.parquet(f"{at}/manifest"), changes, [], 0, None)

    run, path = snapshots.fresh(root)
    every = not changes.filter("kind = 'shared'").isEmpty()
    stale = now.filter("kind = 'table'").select("file") if every else changes.filter("kind = 'table' and change <> 'remove'").select("file")
    stale = sorted(r[0] for r in stale.collect())
    # what stays has the run that made it, what changed this one
    kept = now.join(before.select("kind", "file", F.col("mark").alias("__was"), F.col("run").alias("__run")), ["kind", "file"], "left")
    same = (F.col("mark") == F.col("__was")) & ~((F.col("kind") == "table") & F.lit(every))
    marks = stored(kept.select("kind", "file", "mark", F.when(same, F.col("__run")).otherwise(run).alias("run")), "marks")
    if stale:
        checked = jobs.checked_rows(inputs.read(stale), inputs.zones(), inputs.templates())
        with no_inferred_filters(spark):
            checked.write.parquet(f"{root}/rows/{run}")
            jobs.bad_rows(spark.read.schema(checked.schema).parquet(f"{root}/rows/{run}")).write.parquet(f"{root}/bad/{run}")
    fresh = inputs.assets.join(changes.filter("kind = 'asset' and change <> 'remove'").select(F.col("file").alias("path")), "path", "left_semi")
    hashed = fresh.count()
    if hashed:
        inputs.hashed(fresh).write.parquet(f"{root}/hashes/{run}")

    rows, bad, hashes = (_kept(spark, root, what, marks, kind, file) for what, kind, file in (("rows", "table", "__file"), ("bad", "table", "__file"), ("hashes", "asset", "path")))
    if rows is None:  # no source table at all
        rows, bad = jobs.compile_rows(inputs.read([]), inputs.zones(), inputs.templates())
    rows = jobs.accepted_rows(rows)
    with no_inferred_filters(spark):
        aliases = jobs.first_stored_rows(rows)
    hashes = spark.createDataFrame([], "path string, source_checksum string") if hashes is None else hashes
    assets = inputs.assets.join(hashes, "path").withColumn("size", F.col("length"))
    previous = spark.read.parquet(f"{at}/manifest") if name else spark.createDataFrame([], "zone string, platform string, language string, storage_class string, name string, name_hash long, size long, source_checksum string")
    context = jobs.Context(sources=rows, zones=inputs.zones(), templates=inputs.templates(), files=assets, platforms=inputs.platforms(), locales=inputs.locales(), previous=previous)
    done = jobs.build(requests, context, compiled=(aliases, bad.drop("__file")), **options)
    done.manifest.write.parquet(f"{path}/manifest")
    marks.write.parquet(f"{path}/marks")
    snapshots.publish(spark, root, run)
    return Done(spark.read.parquet(f"{path}/manifest"), changes, stale, hashed, done)


def compact(spark: SparkSession, root: str) -> None:
    """Compiled rows and checksums of all runs in one run's folders, without what no mark names any longer; a new snapshot
    names it. For now and then: each run adds a folder, whose superseded rows are skipped but stay on disk."""
    name = snapshots.current(spark, root)
    if name is None:
        return
    run, path = snapshots.fresh(root)
    marks = spark.read.schema(MARKS).parquet(f"{root}/{name}/marks")
    for what, kind, file in (("rows", "table", "__file"), ("bad", "table", "__file"), ("hashes", "asset", "path")):
        kept = _kept(spark, root, what, marks, kind, file)
        if kept is not None:
            kept.write.parquet(f"{root}/{what}/{run}")
    marks.withColumn("run", F.lit(run)).write.parquet(f"{path}/marks")
    spark.read.parquet(f"{root}/{name}/manifest").write.parquet(f"{path}/manifest")
    snapshots.publish(spark, root, run)
    snapshots.clear(spark, [f"{root}/{what}" for what in ("rows", "bad", "hashes")], keep=run)


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of the files below a folder; their content isn't read. Files of no bytes
    are no assets: Spark's file index skips them, so a row that names one is reported as unresolved."""
    return spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(root).select("path", "length", "modificationTime")


def hashed_files(assets: DataFrame, recipes: bool = False) -> DataFrame:
    """(path, source_checksum) of the listed files, which tasks read in blocks for it; with ``recipes`` also ``jobs.RECIPES``,
    so that entries have the checksum of content and recipe, from the same read."""
    made = ranges.file_hashes(assets, recipes)
    return made.select("path", F.col("md5").alias("source_checksum"), *([jobs.RECIPES] if recipes else []))


def measured_files(assets: DataFrame, **options) -> DataFrame:
    """``hashed_files`` with the features of the signals, made once for every state of a file. Samples are read in ranges
    and once; the checksum, which only one task can make, is a read of its own."""
    rate = F.array(*[F.lit(x) for x in S.RATES])
    made = jobs.features_of_files(stored(assets.select("path"), "listed"), store=stored, **options)
    return made.withColumn("frame_rate_index", (F.array_position(rate, F.col("frame_rate")) - 1).cast("int")).withColumnRenamed("md5", "source_checksum").drop("frame_rate")
