"""Writers of side tables, lists, totals, geometry and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions import scalars as S
from assetloom.functions.spec import ColumnSpec
from assetloom.sources import snapshots


def _cells(df: DataFrame, spec: Sequence[ColumnSpec], blank: Sequence[str]) -> list[Column]:
    def cell(c: ColumnSpec):
        if c.name in blank or c.name not in df.columns:
            return F.lit("")
        v = F.col(c.name)
        if c.kind == "boolean":
            return S.fmt_bool(v)
        if c.kind in ("int", "float"):
            return S.fmt_num(v)
        return F.coalesce(v.cast("string"), F.lit(""))

    return [cell(c).alias(c.name) for c in spec if c.written]


def formatted(df: DataFrame, spec: Sequence[ColumnSpec], blank: Sequence[str] = ()) -> DataFrame:
    """The written columns as text in declared order; NULL is blank, and so are the columns in ``blank``."""
    return df.select(*_cells(df, spec, blank))


def write_table(df: DataFrame, spec: Sequence[ColumnSpec], path: str, blank: Sequence[str] = ()) -> None:
    """A CSV table with header (also when empty), necessary quoting only, blanks for NULL, CRLF line ends.

    ``df`` is written in its own order (see ``sort_table``)."""
    out = formatted(df, spec, blank)
    out.write.mode("overwrite").options(header=True, emptyValue="", nullValue="", escape='"', lineSep="\r\n").csv(path)


def name_list(df: DataFrame, name: str = "Name") -> DataFrame:
    return df.select(F.col(name).alias("Name")).filter("Name is not null and Name <> ''").distinct().orderBy("Name")


def write_names(df: DataFrame, path: str, name: str = "Name", header: bool = True, order: str | None = None) -> None:
    """One name a line. With a header: sorted and distinct; without: every row, in order of ``order``.

    Sorted in ranges: the part files in the order of their names are the list, a short one is a single file. The header
    is the first line of the first."""
    if header:
        rows = df.sparkSession.createDataFrame([("Name", 0)], "value string, i int").unionByName(
            name_list(df, name).select(F.col("Name").alias("value"), F.lit(1).alias("i"))
        )
        rows.orderBy("i", "value").select("value").write.mode("overwrite").text(path)
    else:
        df.orderBy(order or name).select(F.col(name).alias("value")).write.mode("overwrite").text(path)


def write_tables(df: DataFrame, spec: Sequence[ColumnSpec], path: str, groups: DataFrame, keys: Sequence[str], descending: bool = False, blank: Sequence[str] = ()) -> None:
    """``write_table`` for many groups at once, each in a folder of its own below ``path``, blank keys first.

    ``groups`` has one row for each table to write, also where it has no rows: every table has its header once, as the
    first line. Rows are range-partitioned by group and keys, so a large group has several part files, which are the
    table in the order of their names."""
    by = groups.columns
    text = {"escape": '"', "emptyValue": "", "nullValue": ""}
    sort = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__k{i}") for i, c in enumerate(keys)]
    cells = F.struct(*_cells(df, spec, blank))
    rows = df.select(*[F.col(c).alias(f"__{c}") for c in by], F.lit(1).alias("__i"), *sort, F.to_csv(cells, text).alias("value"))
    head = F.to_csv(F.struct(*[F.lit(c.name).alias(c.name) for c in spec if c.written]), text)
    heads = groups.select(*[F.col(c).alias(f"__{c}") for c in by], F.lit(0).alias("__i"), *[F.lit("").alias(f"__k{i}") for i in range(len(keys))], head.alias("value"))
    order = [F.col(f"__k{i}").desc() if descending else F.col(f"__k{i}").asc() for i in range(len(keys))]
    _in_folders(rows.unionByName(heads), path, by, ["__i", *order], "\r\n")


def write_lists(df: DataFrame, path: str, by: Sequence[str], value: str, order: Sequence[str]) -> None:
    """One text a line in the given order, for many groups at once, laid out as by ``write_tables``."""
    _in_folders(df.select(*[F.col(c).alias(f"__{c}") for c in by], *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.col(value).cast("string").alias("value")), path, by, [f"__o{i}" for i in range(len(order))], "\n")


def _in_folders(df: DataFrame, path: str, by: Sequence[str], order: Sequence, end: str) -> None:
    rows = _in_ranges(df, [*[f"__{c}" for c in by], *order])
    rows.select(*[F.col(f"__{c}").alias(f"by_{c}") for c in by], "value").write.mode("overwrite").option("lineSep", end).partitionBy(*[f"by_{c}" for c in by]).text(path)


def _in_ranges(df: DataFrame, order: Sequence) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def write_scalar(df: DataFrame, path: str) -> None:
    """The only value of a one-row frame as text."""
    df.select(F.col(df.columns[0]).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def geometry_json(planes: DataFrame, volumes: DataFrame, triggers: DataFrame, by: str = "file") -> DataFrame:
    """(file, value): Nodes (always empty), Planes, Volumes and Triggers of each file in their order.

    What is collected is one file's geometry: ``by`` has to name files, whose text is read by one task as well."""
    p = planes.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("plane_index", "plane"))).alias("p"))
    v = volumes.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("id", "plane_index", "plane_count"))).alias("v"))
    t = triggers.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("id", "priority", "room"))).alias("t"))
    j = t.join(v, by, "left").join(p, by, "left")
    return j.select(
        by,
        F.to_json(
            F.struct(
                F.array().cast("array<string>").alias("Nodes"),
                F.transform("p", lambda x: F.struct(x["plane"].alias("Plane"))).alias("Planes"),
                F.transform("v", lambda x: F.struct(x["id"].alias("Id"), x["plane_index"].alias("PlaneIndex"), x["plane_count"].alias("PlaneCount"))).alias("Volumes"),
                F.transform("t", lambda x: F.struct(x["id"].alias("Id"), x["priority"].alias("Priority"), x["room"].alias("Room"))).alias("Triggers"),
            )
        ).alias("value"),
    )


def write_geometry(planes: DataFrame, volumes: DataFrame, triggers: DataFrame, path: str) -> None:
    geometry_json(planes, volumes, triggers).select("value").write.mode("overwrite").text(path)


def deploy(manifest: DataFrame, paths: Sequence[str], by: Sequence[str] | None = None) -> None:
    """The same manifest to every location, also when nothing changed, each published as a snapshot (see ``snapshots``): a
    run that fails leaves a location with the manifest it had. The first write is read back for the others. ``by``
    defaults to those of zone, platform, language and storage_class that the manifest has."""
    by = [c for c in ("zone", "platform", "language", "storage_class") if c in manifest.columns] if by is None else by
    first, *others = paths
    snapshots.write(manifest, first, by)
    spark = manifest.sparkSession
    again = spark.read.schema(manifest.schema).parquet(snapshots.folder(spark, first))
    for p in others:
        snapshots.write(again, p, by)
