"""Layered defaults, template inheritance and dimension lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A dimension is broadcast up to so many rows and bytes (measured first); a larger one is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def dimension(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if it is small; measuring stops just beyond the bound of rows."""
    most = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(row_bytes(df)).alias("bytes")).first()
    return F.broadcast(df) if most["n"] <= rows and (most["bytes"] or 0) <= size else df


def row_bytes(df: DataFrame) -> Column:
    """What a row is taken to have: 16 bytes for each column and the bytes of its text, arrays and the like."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c in (F.col(f"`{f.name}`") if f.dataType.simpleString() in ("string", "binary") else F.to_json(F.struct(f"`{f.name}`")) for f in df.schema.fields if _wide(f.dataType.simpleString()))]
    return sum(wide, F.lit(16 * len(df.columns))).cast("long")


def _wide(kind: str) -> bool:
    return kind in ("string", "binary") or kind.startswith(("array", "struct", "map"))


def _key(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def _text(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.simpleString() == "string"


def inherit(df: DataFrame, templates: DataFrame, on: str, key: str, cols: Sequence[str], unknown: str | None = None) -> DataFrame:
    """``cols`` filled where blank from the template that ``on`` names (any case); one level, in one projection.

    A blank reference has no template. Templates are expected once per key (see ``read_templates``). With ``unknown`` a column of
    that name says which rows ``missing_refs`` would give, from the same join."""
    t = templates.filter(F.coalesce(F.trim(key), F.lit("")) != "").select(_key(key).alias("__t"), *[F.col(c).alias(f"__t_{c}") for c in cols])
    j = df.withColumn("__k", F.when(F.trim(on) != "", _key(on))).join(dimension(t), F.col("__k") == F.col("__t"), "left")

    def filled(c: str) -> Column:
        own = F.when(F.trim(c) != "", F.col(c)) if _text(df, c) else F.col(c)
        return F.coalesce(own, F.col(f"__t_{c}"), F.col(c)).alias(c)

    cols = set(cols)
    lost = [(F.col("__k").isNotNull() & F.col("__t").isNull()).alias(unknown)] if unknown else []
    return j.select(*[filled(c) if c in cols else F.col(c) for c in df.columns], *lost)


def layered(*layers: Column | str) -> Column:
    """The first layer that is given: row, source, template, zone."""
    return F.coalesce(*layers)


def missing_refs(df: DataFrame, dim: DataFrame, on: str, key: str) -> DataFrame:
    """Rows with a reference that is not blank and that the dimension lacks."""
    d = dim.select(_key(key).alias("__d")).distinct()
    asked = df.filter(F.coalesce(F.trim(on), F.lit("")) != "").withColumn("__k", _key(on))
    return asked.join(dimension(d), F.col("__k") == F.col("__d"), "left_anti").drop("__k")


def lookup(df: DataFrame, dim: DataFrame, on: str, key: str, keep_duplicates: bool = True, exact: bool = False) -> DataFrame:
    """The dimension's row for every reference, blank ones skipped: one row per reference, or per distinct key."""
    asked = df.filter(F.coalesce(F.trim(on), F.lit("")) != "").select((F.col(on) if exact else _key(on)).alias("__k"))
    if not keep_duplicates:
        asked = asked.distinct()
    d = dim.withColumn("__d", F.col(key) if exact else _key(key))
    return asked.join(dimension(d), F.col("__k") == F.col("__d")).drop("__k", "__d")


def first_of(dim: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """A dimension with its first row for each exact key."""
    w = Window.partitionBy(key).orderBy(*order)
    return dim.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
