"""Feature refresh, ambient volumes and the incremental zone build, for many zones and languages at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions import scalars as S
from assetloom.functions import spec as P
from assetloom.operators import geometry, inherit, manifest, resolve, signal, tables, validate
from assetloom.plans.convert import CONVERTED
from assetloom.sources import files as src
from assetloom.sources import ranges, sinks
from assetloom.sources.scratch import no_inferred_filters, stored


def refresh_features(files: DataFrame, previous: DataFrame, read=None, store=None, **options) -> DataFrame:
    """Features of all listed files (path, mtime): kept from ``previous`` (path, mtime in seconds, ...) where fresh, made
    anew otherwise; files that are gone have none. Contents are read of stale files only.

    ``read`` takes the stale files to (path, md5, content). Without it the tasks open the files themselves, in ranges
    (``ranges.signal_rows``): files of any size, and no path on the driver. A file without frames has a shape of zeros."""
    joined = files.select("path", "mtime").join(previous.select("path", F.col("mtime").alias("__at")), "path", "left")
    stale = joined.filter(S.is_stale("mtime", "__at")).select("path", "mtime")
    kept = previous.join(files.select("path"), "path", "left_semi").join(stale.select("path"), "path", "left_anti")
    if read is None:
        stale = stored(stale, "stale")
        new = features_of_files(stale, store=store, **options)
    else:
        new = features_of(read(stale), store=store, **options)
    new = new.join(stale.select("path", F.unix_timestamp("mtime").alias("mtime")), "path")
    return kept.unionByName(new.select(*previous.columns))


def features_of(content: DataFrame, store=None, chunk_frames: int = 4096, **options) -> DataFrame:
    """(path, md5, frame_rate, channel_count, frame_count, envelope columns) of files (path, md5, content)."""
    return features_of_rows(src.wav_to_chunks(content, chunk_frames), content.select("path", "md5"), store=store, chunk_frames=chunk_frames, **options)


def features_of_files(listed: DataFrame, store=None, chunk_frames: int = 4096, **options) -> DataFrame:
    """``features_of`` of listed files (path), which tasks read in ranges."""
    rows, hashes = ranges.signal_rows(listed, chunk_frames), ranges.file_hashes(listed).select("path", "md5")
    return features_of_rows(rows, hashes, store=store, chunk_frames=chunk_frames, **options)


def features_of_rows(rows: DataFrame, hashes: DataFrame, store=None, bucket: int = signal.BUCKET, **options) -> DataFrame:
    """``features_of`` of signals in rows and the checksums (path, md5) of their files."""
    summary = signal.summaries(rows, bucket)
    summary = store(summary) if store else summary
    meta = summary.groupBy("asset").agg(F.first("frame_rate").alias("frame_rate"), F.first("channel_count").alias("channel_count"), F.sum("frames").alias("frame_count"))
    shape = signal.envelope_of(summary, bucket, store=store, **options)
    each = hashes.select("path", "md5").join(meta.withColumnRenamed("asset", "path"), "path").join(shape.withColumnRenamed("asset", "path"), "path")
    return each.select(
        "path", "md5", "frame_rate", "channel_count", "frame_count",
        *[S.quantise_level(F.col("level")[i]).alias(f"envelope_loudness{i}") for i in range(4)],
        *[S.quantise_time(F.col("time")[i]).alias(f"envelope_time{i}") for i in (1, 2)],
    )


def ambient_volumes(faces: DataFrame, class_name: str = "trigger_multiple", target: str = "ambient_package") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(planes, volumes, triggers, problems) of map faces (see ``read_map_faces``), each by file.

    A trigger is an entity of the class with the target name; its first brush is the volume."""
    kept = faces.filter((F.col("class_name") == class_name) & (F.col("target_name") == target))
    triggers = geometry.dense_ids(kept.select("file", "entity_no", "room", "priority").distinct(), "file", "entity_no")
    first = kept.filter("brush_no is null or brush_no = 0").join(triggers.select("file", "entity_no", "id"), ["file", "entity_no"])
    pl = first.withColumn("plane", F.when(F.col("p0").isNotNull(), S.plane("p0", "p1", "p2"))).withColumn("volume", F.struct("file", "id"))
    pl = pl.select("file", "id", "volume", "face_no", "plane")
    volumes = geometry.index_planes(pl.groupBy("file", "id").agg(F.count("plane").alias("plane_count")), "file", "id")
    problems = geometry.hull_problems(pl).select("volume.*", "rule")
    planes = pl.filter("plane is not null").join(volumes.select("file", "id", "plane_index"), ["file", "id"])
    planes = planes.select("file", "id", (F.col("plane_index") + F.col("face_no")).alias("plane_index"), "plane")
    return planes, volumes, triggers.select("file", "id", "priority", "room"), problems


@dataclass
class Context:
    """Inputs of a build, each for all zones: sources (zone, source_level, then alias columns, __file, __row), zones
    (zone, zone_level), templates, files (tree, path, rel_path, parent, ext, source_checksum), platforms, locales and
    the previous manifest."""

    sources: DataFrame
    zones: DataFrame
    templates: DataFrame
    files: DataFrame
    platforms: DataFrame
    locales: DataFrame
    previous: DataFrame


@dataclass
class Build:
    aliases: DataFrame
    violations: DataFrame
    assets: DataFrame
    conflicts: DataFrame
    unresolved: DataFrame
    diff: DataFrame
    manifest: DataFrame


#: Checksums of a file's content with the recipe of each level (``S.recipe_checksums``). Where the files have them, an entry's
#: checksum is that of its level; without (or where it is null, or the level is none of the five) it is ``S.recipe_of``.
RECIPES = "recipe_checksums"
#: What the manifest keeps of a file's content, where the files come with it (see ``incremental.measured_files``).
FEATURES = ["frame_rate_index", "channel_count", "frame_count", *[f"envelope_loudness{i}" for i in range(4)], "envelope_time1", "envelope_time2"]
TEMPLATE_COLUMNS = [c.name for c in P.ALIAS if c.inherited]


def checked_rows(sources: DataFrame, zones: DataFrame, templates: DataFrame) -> DataFrame:
    """All rows before any is compared with another: levels layered, templates and defaults applied, paths normalised, with
    ``alias_key``, what is wrong with them (``__bad``: key, rule, detail) and whether they are accepted (``__ok``), in one pass:
    ``accepted_rows`` and ``bad_rows`` of what is stored of it don't compile anything again."""
    a = tables.spread(sources, ["__file", "__row"]).withColumn("CompressionLevel", inherit.layered("CompressionLevel", "source_level"))
    a = inherit.inherit(a, templates, "Template", "Name", [c for c in TEMPLATE_COLUMNS if c in a.columns], unknown="__unknown")
    none = F.array().cast("array<struct<key: string, rule: string, detail: string>>")
    unknown = F.array(F.struct(F.col("Name").alias("key"), F.lit("unknown template").alias("rule"), F.col("Template").alias("detail")))
    a = a.withColumn("__bad", F.when(F.col("__unknown"), unknown).otherwise(none)).drop("__unknown")
    # a row of no known zone is dropped, but its reference is told of
    a = a.join(inherit.dimension(zones.withColumn("__known", F.lit(True))), "zone", "left").withColumn("CompressionLevel", inherit.layered("CompressionLevel", "zone_level", F.lit("none"))).drop("zone_level")
    a = S.apply_fixups(S.apply_defaults(a, P.ALIAS))
    a = a.withColumns({c: S.norm_path(c) for c in P.SPECS})
    a = S.clear(a)
    # details are made of broken rules only
    rules = validate.alias_rules()
    breaks = F.coalesce(F.col("__known") & validate.breaks(rules), F.lit(False))
    broken = F.transform(validate.broken(rules), lambda x: F.struct(F.col("Name").alias("key"), x["rule"].alias("rule"), x["detail"].alias("detail")))
    bad = F.when(breaks, F.concat("__bad", broken)).otherwise(F.col("__bad"))
    a = a.withColumns({"__bad": bad, "__ok": F.col("__known").isNotNull() & ~breaks, "alias_key": alias_key(["zone", *P.DEDUP_KEYS])})
    return a.drop("__known")


def accepted_rows(checked: DataFrame) -> DataFrame:
    """The rows of ``checked_rows`` that break no rule; rows that were stored before they had a verdict were accepted."""
    return checked.filter(F.coalesce("__ok", F.lit(True))).drop("__ok", "__bad") if "__ok" in checked.columns else checked


def bad_rows(checked: DataFrame) -> DataFrame:
    """(zone, key, rule, detail, __file) of what is wrong with the rows of ``checked_rows``."""
    return checked.select("zone", "__file", F.explode("__bad").alias("b")).select("zone", "b.key", "b.rule", "b.detail", "__file")


def compile_rows(sources: DataFrame, zones: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of ``checked_rows``. Violations name the file of their row."""
    a = checked_rows(sources, zones, templates)
    return accepted_rows(a), bad_rows(a)


def first_rows(rows: DataFrame) -> DataFrame:
    """Of rows that are alike (by ``alias_key``, a digest of the zone and the keys) the first by file and place."""
    return tables.keep_first(_keyed(rows), ["alias_key"], ["__file", "__row"])


def first_stored_rows(rows: DataFrame) -> DataFrame:
    """``first_rows`` of rows that can be read again: keys are counted, and only rows whose key occurs more than once are
    compared, so wide rows without a double aren't moved."""
    rows = _keyed(rows)
    twice = stored(rows.groupBy("alias_key").count().filter("count > 1").select("alias_key"), "twice")
    if twice.isEmpty():
        return rows
    twice = inherit.dimension(twice)
    again = tables.keep_first(rows.join(twice, "alias_key", "left_semi"), ["alias_key"], ["__file", "__row"])
    return rows.join(twice, "alias_key", "left_anti").unionByName(again)


def _keyed(rows: DataFrame) -> DataFrame:
    made = alias_key(["zone", *P.DEDUP_KEYS])
    return rows.withColumn("alias_key", F.coalesce("alias_key", made) if "alias_key" in rows.columns else made)


def compile_aliases(sources: DataFrame, zones: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, violations): ``compile_rows`` and keep-first."""
    a, bad = compile_rows(sources, zones, templates)
    return first_rows(a), bad.drop("__file")


def alias_key(columns: Sequence[str]) -> Column:
    """The identity of a row: a digest over the columns with their names, so values of neighbouring columns can't be
    exchanged; NULL and blank are alike, as in ``keep_first``."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])), 256)


def build(requests: DataFrame, ctx: Context, roots: tuple[str, str] = ("", ""), base: int = 2048, version: int = 1, compiled: tuple[DataFrame, DataFrame] | None = None, convert=None) -> Build:
    """Zones built for requested (zone, platform, language) rows; all requests are one job with these as columns.

    Files are taken from the tree of the locale (its SearchName). The diff against the previous manifest comes before
    any content is read, so only what is added or changed has to be converted. Entries have their place in the order of
    offsets (``order``), the ``version`` of the manifest, and those of ``FEATURES`` that the files have. ``compiled`` are aliases and violations that were compiled
    before, as ``incremental`` keeps them.

    ``convert`` (see ``convert.into``; files need a path then) takes the distinct (path, level) of what is added or changed to the
    size, frames and checksum of its converted form, which replace those of the source; one conversion serves all zones,
    platforms and languages. An entry of the previous manifest that was never converted counts as changed."""
    if compiled:
        aliases, bad = compiled
    else:
        aliases, bad = compile_aliases(ctx.sources, ctx.zones, ctx.templates)
        # read several times below: the wide expressions are evaluated once
        with no_inferred_filters(requests.sparkSession):
            aliases = stored(aliases, "aliases")
    if "alias_key" not in aliases.columns:
        aliases = aliases.withColumn("alias_key", alias_key(["zone", *P.DEDUP_KEYS]))
    platform = ctx.platforms.select(F.col("Platform").alias("__platform"), F.col("CompressionScale").alias("platform_scale"))
    locale = ctx.locales.select(F.col("Name").alias("language"), "SearchName", "IsShared", F.col("CompressionScale").alias("locale_scale"))
    req = requests.join(inherit.dimension(platform), requests["platform"] == platform["__platform"]).drop("__platform").join(inherit.dimension(locale), "language")
    rows = aliases.drop("Platform", "Language").join(inherit.dimension(req), "zone")
    rows = rows.filter(validate.for_platform("PlatformMask", F.col("platform")) & ~validate.all_blank(*P.SPECS))
    rows = rows.withColumn("row_key", F.struct("alias_key", "platform", "language"))
    scaled = rows.withColumn("scaled", S.scale_level(S.scale_level("Compression", "platform_scale"), "locale_scale"))
    info = ["zone", "platform", "language", "Name", "Storage", "CompressionLevel", "SearchName", "IsShared", "__file", "__row", "scaled"]
    specs = resolve.unpivot_specs(scaled, "row_key", {"main": "FileSpec", "sustain": "FileSpecSustain", "release": "FileSpecRelease"}, carried=info)
    specs = specs.withColumn("tree", F.when(F.col("IsShared"), "").otherwise(F.lower("SearchName")))
    lost = resolve.unresolved(specs, ctx.files, shared="IsShared").select("zone", "platform", "language", "Name", "slot", "spec")
    # what an entry takes from its file comes along, so files are met once
    extra = [c for c in FEATURES if c in ctx.files.columns]
    recipes = [RECIPES] if RECIPES in ctx.files.columns else []
    path = ["path"] if convert else []
    content = ["source_checksum", "size", *extra, *recipes, *path]
    found = resolve.resolve_specs(specs, ctx.files, tree="tree", carried=content)
    found = resolve.with_targets(found, list(roots), "SearchName", "Storage", "looping", "scaled", "platform")
    found = found.withColumns({"storage_class": tables.split_storage("Storage"), "origin": F.col("Name"), "order": F.struct("__file", "__row", "slot", "source")})
    by = ["zone", "platform", "language", "storage_class"]
    found = found.withColumn("claim", F.struct(*by, "target"))
    # settings that clash keep no asset: the build can't tell which is meant
    with no_inferred_filters(requests.sparkSession):
        found = stored(found, "found")
    settings = ["source", "looping", "Storage", "CompressionLevel"]
    conflicts = resolve.target_conflicts(found, "claim", settings, "origin", "order")
    claims = resolve.unclashed(found, "claim", settings, "order").withColumn("target_key", F.to_json("claim"))
    first = resolve.first_resolved(found, "row_key", "slot")
    wide = first.groupBy("row_key").pivot("slot", ["main", "sustain", "release"]).agg(F.first("source").alias("source"), F.first("target").alias("target"))
    names = {f"{slot}_{kind}": f"File{kind.capitalize()}{tail}" for slot, tail in (("main", ""), ("sustain", "Sustain"), ("release", "Release")) for kind in ("source", "target")}
    emitted = rows.drop(*P.GENERATED).join(wide.withColumnsRenamed(names), "row_key", "left").withColumnsRenamed({"platform": "Platform", "language": "Language"})

    bound = S.recipe_of("source_checksum", "CompressionLevel")
    if recipes:
        bound = F.coalesce(S.checksum_at(RECIPES, "CompressionLevel"), bound)
    # the columns of a claim that an entry needs
    named = resolve.unclashed(found.select("claim", "order", *settings, *content), "claim", settings, "order")
    desired = named.select("claim.*", "source", "CompressionLevel", *content).select(
        *by, F.col("target").alias("name"), S.name_hash("target").alias("name_hash"), "size", bound.alias("source_checksum"), "source", "CompressionLevel", *extra, *path
    )
    key = "entry"
    desired, previous = (d.withColumn(key, F.struct(*by, "name")) for d in (desired, ctx.previous))
    if convert:
        made = F.col("converted_checksum") if "converted_checksum" in previous.columns else F.lit(None)
        previous = previous.withColumn("source_checksum", F.when(made.isNotNull(), F.col("source_checksum")))
    entry = ["name", "name_hash", "size", "source_checksum"]
    was = previous.select(key, *by, *entry, *[c for c in dict.fromkeys([*extra, *(CONVERTED if convert else [])]) if c in previous.columns and c not in entry])
    keep = F.col("status") == "keep"
    if convert:
        both = stored(manifest.compared(desired, was, key), "compared")
        diff = both.select(key, "status")
        made = _converted(both.filter("status in ('add', 'change')").select(key, "new.*"), convert)
        extra = [*extra, *[c for c in CONVERTED if c not in ("size", *extra)]]
        kept = both.filter(keep).select(key, "old.*", F.lit(0).alias("placement"))
        merged = kept.unionByName(made.select(key, *by, *entry, *extra, F.lit(1).alias("placement")), allowMissingColumns=True)
    else:
        diff = manifest.diff_manifest(desired, previous, key)
        both = manifest.compared(desired.select(key, *by, *entry, *extra), was, key).filter("status <> 'remove'")
        merged = both.select(
            key, *[F.when(keep, F.col(f"old.{c}") if c in was.columns else F.lit(None)).otherwise(F.col(f"new.{c}")).alias(c) for c in [*by, *entry, *extra]],
            F.when(keep, 0).otherwise(1).alias("placement"),
        )
    packed = manifest.packed_offsets(merged, by, ["placement", "name"], base=base, place="order")
    return Build(emitted, bad, claims, conflicts, lost, diff, packed.drop(key, "placement").withColumn("version", F.lit(version)))


def _converted(todo: DataFrame, convert) -> DataFrame:
    """The desired entries that are added or changed, with what their conversion gives in place of what the source has."""
    todo = todo.withColumn("level", F.lower(F.coalesce("CompressionLevel", F.lit("none"))))
    if todo.isEmpty():  # no run without work
        return todo.withColumns({c: F.lit(None).cast(kind) for c, kind in CONVERTED.items()})
    made = convert(todo.select("path", "level").distinct()).select("path", "level", *CONVERTED)
    return todo.drop(*CONVERTED).join(inherit.dimension(made), ["path", "level"])


@dataclass
class Side:
    """What a build writes besides aliases, each by zone: ambients, reverbs and script ids with the columns of their
    specs, ducks and music with the file names (column file) that the zone's config lists."""

    ambients: DataFrame | None = None
    reverbs: DataFrame | None = None
    script_ids: DataFrame | None = None
    ducks: DataFrame | None = None
    music: DataFrame | None = None


def write_outputs(b: Build, requests: DataFrame, locales: DataFrame, side: Side, path: str) -> None:
    """The side files of all requested zones, platforms and languages, in folders by kind, zone, platform and language
    below ``path``.

    Aliases always; reverbs (by falling name), ambients, script ids and the lists of duck and music names for shared
    locales only; of the loaded assets their number, their bytes and their names in order of the offset."""
    each = ["zone", "platform", "language"]
    asked = requests.select(*each).distinct()
    shared = asked.join(inherit.dimension(locales.filter("IsShared").select(F.col("Name").alias("language"))), "language", "left_semi").select(*each)
    sinks.write_tables(b.aliases, P.ALIAS, f"{path}/alias", asked, P.SORT_KEYS)
    for kind, rows, spec, keys, falling in (
        ("reverb", side.reverbs, P.REVERB, ["Name"], True),
        ("ambient", side.ambients, P.AMBIENT, ["Name"], False),
        ("scriptid", side.script_ids, P.SCRIPT_ID, ["ScriptId", "AliasName"], False),
    ):
        if rows is not None:
            blank = [c.name for c in spec if c.name.startswith("RowSource")] if kind == "ambient" else []
            sinks.write_tables(rows.join(inherit.dimension(shared), "zone"), spec, f"{path}/{kind}", shared, keys, falling, blank)

    def names(rows: DataFrame | None, c: Column, skipped: Sequence[str] = ()) -> list[DataFrame]:
        """Names of a zone, and of one platform where the rows have it."""
        if rows is None:
            return []
        platform = F.col("Platform") if "Platform" in rows.columns else F.lit(None).cast("string")
        return [rows.select("zone", platform.alias("only"), F.trim(c).alias("Name")).filter((F.col("Name") != "") & ~F.lower("Name").isin(list(skipped)))]

    ducks = [*names(b.aliases, F.col("Duck"), ["default"]), *names(side.ambients, F.col("Duck"), ["default"]), *names(side.ducks, S.file_stem("file"))]
    # a header for each list, also for one without names
    for kind, parts in (("ducklist", ducks), ("musiclist", names(side.music, S.file_stem("file")))):
        if parts:
            found = reduce(lambda x, y: x.unionByName(y), parts).distinct().join(inherit.dimension(shared), "zone")
            found = found.filter("only is null or only = platform").select(*each, "Name").distinct()
            head = shared.select(*each, F.lit("Name").alias("Name"), F.lit(0).alias("i"))
            sinks.write_lists(found.withColumn("i", F.lit(1)).unionByName(head), f"{path}/{kind}", each, "Name", ["i", "Name"])
    loaded = b.manifest.filter("storage_class = 'loaded'")
    totals = manifest.manifest_totals(loaded, each)
    totals = asked.join(totals, each, "left").na.fill(0)
    sinks.write_lists(totals, f"{path}/memory", each, "total_bytes", ["total_bytes"])
    sinks.write_lists(totals, f"{path}/assetcount", each, "n", ["n"])
    sinks.write_lists(loaded, f"{path}/assets", each, "name", ["offset"])
