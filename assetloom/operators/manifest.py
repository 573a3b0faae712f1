"""Content-addressed manifests: diff, offsets, checks and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.operators.tables import keep_first, previous, ranks, running


def diff_manifest(desired: DataFrame, previous: DataFrame, key: str = "name", checksum: str = "source_checksum") -> DataFrame:
    """(key, status): add, change (to be removed and added), remove or keep, from one full outer join."""
    d = desired.select(F.col(key), F.col(checksum).alias("__d"), F.lit(True).alias("__in"))
    p = previous.select(F.col(key), F.col(checksum).alias("__p"), F.lit(True).alias("__was"))
    status = F.when(F.col("__was").isNull(), "add").when(F.col("__in").isNull(), "remove").when(F.col("__d").eqNullSafe(F.col("__p")), "keep").otherwise("change")
    return d.join(p, key, "full_outer").select(key, status.alias("status"))


def compared(desired: DataFrame, previous: DataFrame, key: str = "name", checksum: str = "source_checksum") -> DataFrame:
    """(key, status, new, old): ``diff_manifest`` with the row of either side (NULL where it has none), from the same join, so
    that what is kept and added needs no other."""
    d = desired.select(key, F.struct(*[c for c in desired.columns if c != key]).alias("new"))
    p = previous.select(key, F.struct(*[c for c in previous.columns if c != key]).alias("old"))
    # sorted by a number, which tells almost all keys apart; texts that begin alike are compared whole else
    d, p = (x.withColumn("__h", F.xxhash64(key)) for x in (d, p))
    same = F.col(f"new.{checksum}").eqNullSafe(F.col(f"old.{checksum}"))
    status = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").when(same, "keep").otherwise("change")
    return d.join(p, ["__h", key], "full_outer").select(key, status.alias("status"), "new", "old")


def diff_summary(diff: DataFrame) -> DataFrame:
    """Numbers of entries to add and to remove; a change counts as both."""
    s = F.col("status")
    return diff.agg(F.count_if(s.isin("add", "change")).alias("n_add"), F.count_if(s.isin("remove", "change")).alias("n_remove"))


def apply_diff(previous: DataFrame, diff: DataFrame, new_rows: DataFrame, key: str = "name") -> DataFrame:
    """Kept rows of the previous manifest and the new rows of what is added or changed."""
    kept = previous.join(diff.filter("status = 'keep'").select(key), key, "left_semi")
    added = new_rows.join(diff.filter("status in ('add', 'change')").select(key), key, "left_semi")
    return kept.unionByName(added, allowMissingColumns=True)


def orphans(previous: DataFrame, desired: DataFrame, key: str) -> DataFrame:
    return previous.join(desired.select(key).distinct(), key, "left_anti")


def unchanged(desired: DataFrame, previous: DataFrame, key: str, checksum: str) -> DataFrame:
    return desired.select(key, checksum).intersect(previous.select(key, checksum))


def absent_removals(removals: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Keys to be removed that the manifest doesn't have: each is an error."""
    return removals.join(manifest.select(key), key, "left_anti")


def first_wins(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """For each key the row of the first frame that has it."""
    return _ranked(frames, key, 1)


def last_wins(frames: Sequence[DataFrame], key: str) -> DataFrame:
    return _ranked(frames, key, -1)


def _ranked(frames: Sequence[DataFrame], key: str, sign: int) -> DataFrame:
    parts = [df.withColumn("__rank", F.lit(sign * i)) for i, df in enumerate(frames)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return keep_first(out, [key], ["__rank"]).drop("__rank")


def packed_offsets(m: DataFrame, by: Sequence[str], order: Sequence[str], size: str = "size", base: int = 2048, task_rows: int | None = None, place: str | None = None) -> DataFrame:
    """Gap-free offsets: ``base`` plus the sizes of the entries before, per group of any size (see ``running``), and with
    ``place`` a column of that name with the number of entries before."""
    if place:
        m = running(m, by, order, {"offset": F.col(size), place: F.lit(1)}, task_rows=task_rows)
    else:
        m = running(m, by, order, size, "offset", task_rows=task_rows)
    return m.withColumn("offset", F.col("offset") + F.lit(base).cast("long"))


def retained_first(m: DataFrame, diff: DataFrame, key: str = "name") -> DataFrame:
    """Adds ``placement``: kept entries (0) come before additions (1), as offsets are packed."""
    return m.join(diff.select(key, F.when(F.col("status") == "keep", 0).otherwise(1).alias("placement")), key)


def check_monotonic(m: DataFrame, by: Sequence[str], order: Sequence[str], offset: str = "offset") -> DataFrame:
    """Entries whose offset lies before that of the entry before."""
    return previous(m, by, order, offset, "previous_offset").filter(F.col(offset) < F.col("previous_offset"))


def gaps(m: DataFrame, by: Sequence[str], offset: str = "offset", size: str = "size", base: int = 2048) -> DataFrame:
    """Adds the bytes between each entry and the end of the one before (or the base)."""
    m = previous(m, by, [offset], F.col(offset) + F.col(size), "gap")
    return m.withColumn("gap", F.col(offset) - F.coalesce("gap", F.lit(base)))


def free_space(m: DataFrame, by: Sequence[str], **options) -> DataFrame:
    return gaps(m, by, **options).groupBy(*by).agg(F.sum("gap").cast("long").alias("free_space"))


def manifest_totals(m: DataFrame, by: Sequence[str] = (), size: str = "size") -> DataFrame:
    return m.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_bytes"))


def storage_counts(m: DataFrame, by: Sequence[str], storage: str) -> DataFrame:
    """Numbers of loaded and streamed assets per group."""
    s = F.col(storage) == "STREAMED"
    return m.groupBy(*by).agg(F.count_if(~F.coalesce(s, F.lit(False))).alias("n_loaded"), F.count_if(s).alias("n_streamed"))


def duplicate_keys(df: DataFrame, key: str, origin: str, fold: bool = True) -> DataFrame:
    """Keys that occur more than once (in any case, if ``fold``), with their number, first and last origin."""
    k = F.lower(key) if fold else F.col(key)
    g = df.groupBy(k.alias("key")).agg(F.count("*").alias("n"), F.min(origin).alias("first_origin"), F.max(origin).alias("last_origin"))
    return g.filter("n > 1")


def content_checksum(m: DataFrame, by: Sequence[str], order: str, checksum: str) -> DataFrame:
    """MD5 over the ordered checksums of a group, in two levels: runs of 4096 ordered rows, then their digests.

    No task gathers more than a run of a group."""
    ranked = ranks(m, by, [order], "__i")

    def digest(df: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("i"), F.col(value).alias("v")))), lambda x: x["v"])
        return df.groupBy(*keys).agg(F.md5(F.array_join(ordered, "")).alias("checksum"))

    runs = digest(ranked.withColumn("__run", F.floor(F.col("__i") / 4096)), [*by, "__run"], "__i", checksum)
    return digest(runs, by, "__run", "checksum")


def budget(m: DataFrame, by: Sequence[str], limit: str, size: str = "size", level: str = "level_rank", pct: int = 85, top: int = 4) -> DataFrame:
    """Groups at ``pct`` percent of their limit or more that could still be compressed further."""
    g = m.groupBy(*by).agg(F.sum(size).cast("long").alias("bytes"), F.max(level).alias("max_level"), F.max(limit).alias("limit_bytes"))
    g = g.withColumn("percent", F.floor(F.col("bytes") * 100 / F.col("limit_bytes")).cast("long"))
    return g.filter((F.col("percent") >= pct) & (F.col("max_level") < top))


def manifest_problems(m: DataFrame, version: int = 0, by: Sequence[str] | None = None) -> DataFrame:
    """(rule, detail) of what makes a manifest unusable: another version, offsets out of order or overlapping, names twice.

    ``by`` defaults to those of zone, platform, language and storage_class that the manifest has."""
    by = [c for c in ("zone", "platform", "language", "storage_class") if c in m.columns] if by is None else by
    wrong = m.filter(F.lit(version != 0) & ~F.col("version").eqNullSafe(F.lit(version))).select(F.lit("version").alias("rule"), F.col("name").alias("detail"))
    order = check_monotonic(m, by, ["order"]).select(F.lit("offset order").alias("rule"), F.col("name").alias("detail"))
    twice = m.groupBy(*by, "name").count().filter("count > 1").select(F.lit("name twice").alias("rule"), F.col("name").alias("detail"))
    return wrong.unionByName(order).unionByName(twice)


def reconcile(header: DataFrame, m: DataFrame, by: Sequence[str], size: str = "size", offset: str = "offset") -> DataFrame:
    """Headers (n_entries, total_bytes, file_bytes) that the entries contradict: (by, rule)."""
    g = m.groupBy(*by).agg(F.count("*").alias("__n"), F.sum(size).alias("__bytes"), F.max(F.col(offset) + F.col(size)).alias("__end"))
    j = header.join(g, list(by), "left")
    rules = F.filter(
        F.array(
            F.when(~F.col("n_entries").eqNullSafe(F.coalesce("__n", F.lit(0))), "entry count"),
            F.when(~F.col("total_bytes").eqNullSafe(F.coalesce("__bytes", F.lit(0))), "total bytes"),
            F.when(F.col("__end") > F.col("file_bytes"), "offset range"),
        ),
        lambda x: x.isNotNull(),
    )
    return j.select(*by, F.explode(rules).alias("rule"))
