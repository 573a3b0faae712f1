"""Tables from CSV files whose headers differ and whose rows may be ragged."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetloom.functions import scalars as S
from assetloom.functions.spec import DOMAINS, LEVELS, ColumnSpec
from assetloom.sources import ranges

ORDER = ["__file", "__row"]


def typed(c: Column, spec: ColumnSpec) -> Column:
    """The typed value of a text cell; blank text is NULL."""
    if spec.kind == "boolean":
        return S.parse_bool(c)
    if spec.kind in ("int", "float"):
        return S.parse_num(c, spec.kind)
    if spec.kind == "level":
        return S.parse_level(c)
    if spec.kind in DOMAINS:
        return S.parse_enum(c, DOMAINS[spec.kind])
    return S.blank_to_null(c)


def ill_typed(c: Column, spec: ColumnSpec) -> Column:
    if spec.kind == "boolean":
        return S.bad_bool(c)
    if spec.kind in ("int", "float"):
        return S.bad_num(c)
    if spec.kind == "level":
        return S.bad_level(F.coalesce(c, F.lit("")))
    if spec.kind in DOMAINS:
        return S.bad_enum(c, DOMAINS[spec.kind])
    return F.lit(False)


def _headers(spark: SparkSession, paths: Sequence[str], skip_comments: bool) -> dict[str, list[str]]:
    """Paths by header line, of which tasks read no more than that line. Table sources are listed in a config, so their number
    is small. On a store that only Spark's readers know all lines are scanned for the first ones."""
    if not paths:
        return {}
    files = spark.read.format("binaryFile").load(list(paths)).select("path")
    if all(ranges.known(p) for p in paths):
        first = ranges.first_lines(files, r"#| *$" if skip_comments else None).withColumnRenamed("line", "header")
    else:
        lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
        if skip_comments:
            lines = lines.filter(~F.col("value").rlike(r"^#") & (F.trim("value") != ""))
        lines = lines.withColumn("i", F.monotonically_increasing_id())
        first = lines.groupBy("path").agg(F.min_by("value", F.struct("at", "i")).alias("header"))
    out: dict[str, list[str]] = {}
    for r in first.orderBy("path").collect():
        out.setdefault(r["header"].strip("\r"), []).append(r["path"])
    return out


def _raw(spark: SparkSession, paths: Sequence[str], header: str, **options) -> DataFrame:
    names = next(iter(spark.createDataFrame([(header,)], "h string").select(F.from_csv("h", F.lit(_ddl(header)), {"escape": '"'})).collect()))[0]
    names = [(n or "").strip() for n in names]
    # a schema of positions: names may repeat or differ in case only
    raw = spark.read.options(header=True, escape='"', multiLine=True, enforceSchema=True, **options).schema(
        ", ".join(f"c{i} string" for i in range(len(names)))
    ).csv(list(paths))
    raw = raw.select(*[F.trim(F.regexp_replace(f"c{i}", r"^\s+|\s+$", "")).alias(f"c{i}") for i in range(len(names))], F.col("_metadata.file_path").alias("__file"))
    return raw.withColumn("__row", F.monotonically_increasing_id()).withColumn("__names", F.lit("\t".join(names)))


def _ddl(header: str) -> str:
    return ", ".join(f"h{i} string" for i in range(header.count(",") + 1))


def _named(raw: DataFrame, spec: Sequence[ColumnSpec], names: list[str]) -> DataFrame:
    """The declared columns by exact name; unknown headers are ignored and absent ones are NULL."""
    at = {n: i for i, n in reversed(list(enumerate(names)))}
    cols = [(F.col(f"c{at[c.name]}") if c.name in at else F.lit(None).cast("string")).alias(c.name) for c in spec]
    return raw.select(*cols, *ORDER)


def _load(spark, paths, spec, relaxed: bool) -> DataFrame:
    parts = []
    for header, files in sorted(_headers(spark, paths, relaxed).items()):
        options = {"comment": "#"} if relaxed else {}
        raw = _raw(spark, files, header, mode="PERMISSIVE" if relaxed else "FAILFAST", **options)
        names = header_names(header)
        if relaxed:
            raw = drop_marked(raw, "c0")
        parts.append(_named(raw, spec, names))
    if not parts:
        return spark.createDataFrame([], ", ".join(f"`{c.name}` string" for c in spec) + ", __file string, __row long")
    return reduce(lambda a, b: a.unionByName(b), parts)


def header_names(header: str) -> list[str]:
    import csv

    return [n.strip() for n in next(csv.reader([header]))]


def drop_marked(df: DataFrame, first: str) -> DataFrame:
    """Without rows whose first cell is empty or begins with a comment sign or a quote."""
    c = F.trim(F.col(first))
    return df.filter(c.isNotNull() & (c != "") & ~c.rlike('^[#"]'))


def violations_of_types(text: DataFrame, spec: Sequence[ColumnSpec]) -> DataFrame:
    """(file, row, rule, detail) for every cell that its column's kind refuses."""
    bad = F.filter(
        F.array(
            *[
                F.struct(F.coalesce(ill_typed(F.col(c.name), c), F.lit(False)).alias("bad"), F.lit(f"type of {c.name}").alias("rule"), F.col(c.name).alias("detail"))
                for c in spec
            ]
        ),
        lambda x: x["bad"],
    )
    return text.select(F.col("__file").alias("file"), F.col("__row").alias("row"), F.explode(bad).alias("v")).select("file", "row", "v.rule", "v.detail")


def _typed(text: DataFrame, spec: Sequence[ColumnSpec]) -> DataFrame:
    return text.select(*[typed(F.col(c.name), c).alias(c.name) for c in spec], *ORDER)


def read_table_text(spark: SparkSession, paths: Sequence[str], spec: Sequence[ColumnSpec], relaxed: bool = False) -> DataFrame:
    """Cells as text, one read for every distinct header, united by name."""
    return _load(spark, paths, spec, relaxed)


def read_table(spark: SparkSession, paths: Sequence[str], spec: Sequence[ColumnSpec]) -> DataFrame:
    """Strict scan: a malformed line fails the load, and so does a cell that its column's kind refuses."""
    text = _load(spark, paths, spec, relaxed=False)
    bad = violations_of_types(text, spec).limit(5).collect()
    if bad:
        raise ValueError(f"rows that can't be read: {[(r['file'], r['rule'], r['detail']) for r in bad]}")
    return _typed(text, spec)


def read_table_relaxed(spark: SparkSession, paths: Sequence[str], spec: Sequence[ColumnSpec]) -> DataFrame:
    """Relaxed scan: cells trimmed, comments and rows without a first cell dropped, short rows padded."""
    return _typed(_load(spark, paths, spec, relaxed=True), spec)


def with_provenance(df: DataFrame, file: Column | str = "__file", row: Column | str = "__row", prefix: str = "RowSource") -> DataFrame:
    """File, stem and line filled where blank; the line counts a file's surviving rows, from 2."""
    f = F.col(file) if isinstance(file, str) else file
    line = F.row_number().over(Window.partitionBy(f).orderBy(row)) + 1
    have = set(df.columns)
    new = {}
    for name, value in ((f"{prefix}FileName", f), (f"{prefix}ShortName", S.file_stem(f)), (f"{prefix}LineNumber", line)):
        new[name] = F.coalesce(F.col(name), value) if name in have else value
    return df.withColumns(new)


def glob_of(ext: str) -> str:
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def list_paths(spark: SparkSession, root: str, pattern: str, recursive: bool) -> list[str]:
    """Sorted files below a folder; a missing folder has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    files = spark.read.format("binaryFile").options(recursiveFileLookup=recursive, pathGlobFilter=pattern).load(root).select("path")
    return sorted(r["path"] for r in files.collect())


def read_tree(spark: SparkSession, root: str, ext: str, spec: Sequence[ColumnSpec]) -> DataFrame:
    """All tables below a folder with the extension in any case; a missing folder gives no rows."""
    return _typed(_load(spark, list_paths(spark, root, glob_of(ext), True), spec, relaxed=True), spec)


def read_templates(spark: SparkSession, root: str, spec: Sequence[ColumnSpec], key: str = "Name") -> DataFrame:
    """Templates of one folder by lower-case name; of equal names the one of the later file (then row) stays."""
    rows = _typed(_load(spark, list_paths(spark, root, "*.csv", False), spec, relaxed=True), spec)
    return keep_last(rows.withColumn("template_key", F.lower(key)), ["template_key"], ORDER)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def load_sources(config: DataFrame, readers: dict[str, Callable[[list[str]], DataFrame]], kind: str = "Type", file: str = "Filename", level: str = "Level") -> dict[str, DataFrame]:
    """One frame per source type of a zone config (a small table), each row with the file's default level."""
    rows = config.select(kind, file, level).collect()
    out = {}
    for k in sorted({r[kind] for r in rows} & readers.keys()):
        mine = [r for r in rows if r[kind] == k]
        parts = []
        for lv in sorted({r[level] or "" for r in mine}):
            files = [r[file] for r in mine if (r[level] or "") == lv]
            parts.append(readers[k](files).withColumn("SourceLevel", F.lit(lv or None).cast("string")))
        out[k] = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out


def union_sources(*tagged: tuple[str, DataFrame]) -> DataFrame:
    """All rows of several sources with the name of their source; columns that one lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source_tag", F.lit(t)) for t, df in tagged])


def pair_by_filename(left: DataFrame, right: DataFrame, on: str = "file_name") -> DataFrame:
    """The right-hand files that have a partner of the same name on the left."""
    return right.join(left.select(on).distinct(), on, "left_semi")


LEVEL_ORDER = {name: i for i, name in enumerate(LEVELS)}
