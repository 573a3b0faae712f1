"""Conversion of what a build adds: each source once, levels apart, kept entries untouched."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from assetloom.functions import scalars as S
from assetloom.functions.spec import ALIAS
from assetloom.operators import signal
from assetloom.plans import convert, jobs
from assetloom.sources import files

LEVELS = list(S.LEVEL_RANK)


def wav(samples, channels=1, rate=48000):
    raw = struct.pack(f"<{len(samples)}h", *samples)
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, 16)
    return b"RIFF" + struct.pack("<I", 4) + head + b"data" + struct.pack("<I", len(raw)) + raw


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for k, (n, ch, rate) in enumerate([(5_000, 1, 48000), (3_000, 2, 44100), (0, 1, 22050), (2_000, 1, 96000), (700, 2, 48000)]):
        (root / f"{k}.wav").write_bytes(wav([(i * 7919 * (k + 1)) % 4001 - 2000 if i // 600 % 2 else i % 90 for i in range(n * ch)], ch, rate))
    return root


def test_rows_equal_the_whole_signal(spark, folder):
    paths = files.list_files(spark, str(folder)).select("path")
    wanted = paths.crossJoin(spark.createDataFrame([(k,) for k in LEVELS], "level string"))
    rows = convert.conditioned(wanted.union(wanted), chunk_frames=512, range_bytes=2048)
    got = {}
    for r in rows.orderBy("path", "level", "chunk_no").collect():
        got.setdefault((r.path, r.level), []).append(r.samples)
        assert r.frame_rate == 48000
    whole = []
    for p in sorted(folder.iterdir()):
        ch, rate, frames = files.parse_wav(p.read_bytes())
        whole += [(f"file:{p}", ch, rate, level, frames.ravel().tolist()) for level in LEVELS]
    frame = spark.createDataFrame(whole, "path string, channel_count int, frame_rate int, level string, samples array<int>")
    want = {(r.path, r.level): r.samples for r in signal.condition(frame).collect()}
    assert len(got) == len(want) == 25 and {k: sum(v, []) for k, v in got.items()} == want

    def md5(parts):
        return hashlib.md5("".join(parts).encode()).hexdigest()

    for r in convert.digests(rows, run=3).collect():
        parts = [md5([",".join(map(str, x))]) for x in got[r.path, r.level]]
        runs = [md5(parts[i : i + 3]) for i in range(0, len(parts), 3)]
        assert r.converted_checksum == md5(runs).upper() and r.size == 2 * len(want[r.path, r.level])
        assert r.frame_count == r.size // 2 // r.channel_count and S.RATES[r.frame_rate_index] == 48000


def test_builds_convert_what_is_added_or_changed(spark, folder, tmp_path):
    listed = files.list_files(spark, str(folder)).select("path", "size", "stem")
    rel = F.concat(F.lit("s"), F.col("stem"), F.lit("\\"), "stem", F.lit(".wav"))
    zone = F.when(F.col("stem").cast("int") % 2 == 0, "east").otherwise("west")
    asked = []

    def build(previous, changed=(), levels="low", version=1):
        into = convert.into(str(tmp_path / "out"), chunk_frames=512)

        def counted(wanted):
            asked[:] = sorted((r.path.rsplit("/", 1)[1], r.level) for r in wanted.collect())
            return into(wanted)

        asked.clear()
        rows = listed.select(zone.alias("zone"), F.lit(levels).alias("source_level"), F.concat(F.lit("a"), "stem").alias("Name"), rel.alias("FileSpec"), F.lit("pc").alias("PlatformMask"), F.lit("f").alias("__file"), F.col("stem").cast("long").alias("__row"))
        ctx = jobs.Context(
            sources=S.complete(rows, ALIAS),
            zones=spark.createDataFrame([("east", None), ("west", None)], "zone string, zone_level string"),
            templates=S.complete(spark.createDataFrame([("t",)], "Name string"), ALIAS),
            files=listed.select(F.lit("").alias("tree"), rel.alias("rel_path"), F.concat(F.lit("s"), "stem").alias("parent"), F.lit("wav").alias("ext"), F.concat(F.lit("c"), "stem", F.when(F.col("stem").isin(*changed), "!").otherwise("") if changed else F.lit("")).alias("source_checksum"), "size", "path"),
            platforms=spark.createDataFrame([("pc", 0.5)], "Platform string, CompressionScale float"),
            locales=spark.createDataFrame([("all", "all", True, 1.0), ("german", "German", True, 0.5)], "Name string, SearchName string, IsShared boolean, CompressionScale float"),
            previous=previous,
        )
        requests = spark.createDataFrame([(z, "pc", lang) for z in ("east", "west") for lang in ("all", "german")], "zone string, platform string, language string")
        m = jobs.build(requests, ctx, convert=counted, version=version).manifest
        m.write.parquet(str(tmp_path / f"m{version}"))
        m = spark.read.parquet(str(tmp_path / f"m{version}"))
        return m, {(r.language, r.name): r.asDict() for r in m.collect()}

    m1, first = build(spark.createDataFrame([], files.MANIFEST))
    assert asked == [(f"{k}.wav", "low") for k in range(5)] and len(first) == 10
    assert all(r["converted_checksum"] and r["size"] == 2 * r["frame_count"] * r["channel_count"] for r in first.values())
    made = next(r for r in first.values() if "\\1." in r["name"])
    assert made["frame_count"] == 3_000 * 48000 // 44100 and made["channel_count"] == 2
    assert spark.read.parquet(str(tmp_path / "out" / made["converted_in"])).select("path").distinct().count() == 5
    m2, same = build(m1, version=2)
    assert asked == [] and all(same[k]["converted_in"] == r["converted_in"] and same[k]["offset"] == r["offset"] for k, r in first.items())
    _, some = build(m2, changed=("3",), version=3)
    assert asked == [("3.wav", "low")]
    assert {k for k, r in some.items() if r["converted_in"] != first[k]["converted_in"]} == {k for k in some if "\\3." in k[1]}
    # entries that were never converted count as changed
    _, all_ = build(m2.withColumn("converted_checksum", F.when(~F.col("name").contains("\\0."), F.col("converted_checksum"))), version=4)
    assert asked == [("0.wav", "low")] and all(r["converted_checksum"] == first[k]["converted_checksum"] for k, r in all_.items())


def test_nothing_wanted_and_no_signal(spark, tmp_path):
    none = spark.createDataFrame([], "path string, level string")
    assert convert.into(str(tmp_path / "out"))(none).count() == 0
    (tmp_path / "x.wav").write_bytes(b"none")
    with pytest.raises(ValueError, match="x.wav"):
        convert.conditioned(spark.createDataFrame([(str(tmp_path / "x.wav"), "low")], "path string, level string"))
