"""Files read in ranges by the tasks that open them."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from assetloom.functions import scalars as S
from assetloom.plans import jobs
from assetloom.sources import files, ranges
from assetloom.sources.scratch import stored


def wav(samples, channels=1, rate=48000, claimed=None, before=b""):
    raw = struct.pack(f"<{len(samples)}h", *samples)
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, 16) + before
    return b"RIFF" + struct.pack("<I", 4) + head + b"data" + struct.pack("<I", len(raw) if claimed is None else claimed) + raw


def listed(spark, paths):
    return spark.createDataFrame([(str(p),) for p in paths], "path string")


def test_ranges_equal_whole_files(spark, tmp_path):
    sets = {
        "long.wav": wav([(i * 37) % 65536 - 32768 for i in range(10_001)]),
        "two channels.wav": wav(list(range(4_002)), channels=2, rate=44100, before=b"LIST" + struct.pack("<I", 3) + b"abc\0"),
        "none.wav": wav([]),
        "claims more%20.wav": wav([5] * 100, claimed=6_000),
        "half a frame.wav": wav([1, 2, 3], channels=2),
        "tail.wav": wav([7] * 512) + b"junk",
    }
    for name, data in sets.items():
        (tmp_path / name).write_bytes(data)
    whole = files.wav_to_chunks(files.read_assets(spark, str(tmp_path)), 512)
    split = ranges.signal_rows(files.list_files(spark, str(tmp_path)), chunk_frames=512, range_bytes=2048)
    assert split.rdd.getNumPartitions() >= 10
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))


def test_what_is_no_signal(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"")
    (tmp_path / "b.wav").write_bytes(b"RIFF\0\0\0\0WAVEdata\4\0\0\0abcd")
    (tmp_path / "c.wav").write_bytes(wav([1])[:30])
    (tmp_path / "d.wav").write_bytes(wav([1]))
    paths = listed(spark, [tmp_path / n for n in ("a.wav", "b.wav", "c.wav", "d.wav", "d.wav", "gone.wav")]).union(spark.createDataFrame([(None,)], "path string"))
    got = {r.path and r.path.rsplit("/", 1)[1]: r.problem for r in ranges.heads(paths).collect()}
    assert set(got) == {"a.wav", "b.wav", "c.wav", "d.wav", "gone.wav", None} and ranges.heads(paths).count() == 6
    assert got["d.wav"] is None and got["b.wav"] == "data before format" and all(got[k] for k in got if k != "d.wav")
    with pytest.raises(ValueError, match="a.wav"):
        ranges.signal_rows(paths)
    assert ranges.signal_rows(paths.filter("path like '%d.wav'")).count() == 1
    assert ranges.signal_rows(paths.filter("false")).count() == 0 and ranges.file_hashes(paths.filter("false"), recipes=True).count() == 0


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    frames = 750_000_000  # 3 GB of two channels, all but the last frames a hole of the file
    big = tmp_path / "big.wav"
    with open(big, "wb") as f:
        f.write(wav([], channels=2, claimed=4 * frames))
        f.truncate(44 + 4 * frames)
        f.seek(44 + 4 * (frames - 2))
        f.write(struct.pack("<4h", 1, -2, 3, -4))
    found = stored(ranges.heads(listed(spark, [big])), "heads")
    assert found.first().frame_count == frames
    asked = ranges.ranges(found)
    assert asked.count() == 3 * 10**9 // (64 << 20) + 1 and asked.agg(F.sum("rows")).first()[0] == -(-frames // 4096)
    last = ranges.read_ranges(asked.filter(F.col("first_row") + F.col("rows") >= -(-frames // 4096)), 1).orderBy(F.desc("chunk_no")).first()
    assert last.chunk_no == frames // 4096 and last.samples[-4:] == [1, -2, 3, -4] and len(last.samples) == 2 * (frames % 4096)


def test_hashes_in_blocks(spark, tmp_path, monkeypatch):
    data = {"x": b"", "y": b"abc" * 5_000_000, "z": b"q"}
    for name, d in data.items():
        (tmp_path / name).write_bytes(d)
    for r in ranges.file_hashes(listed(spark, [tmp_path / n for n in data]), recipes=True).collect():
        d = data[r.path.rsplit("/", 1)[1]]
        assert r.size == len(d) and r.md5 == hashlib.md5(d).hexdigest().upper()
        for level in S.LEVEL_RANK:
            assert r.recipe_checksums[level] == hashlib.md5(d + S.recipe(level)).hexdigest().upper()


def test_features_of_ranges_equal_those_of_contents(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"{k}.wav").write_bytes(wav([((i * (k + 3) * 911) % 30_000) >> (i // 400) for i in range(1_500 * k)], rate=44100))
    files_ = files.list_files(spark, str(tmp_path)).select("path", "mtime")
    kinds = "path string, mtime long, md5 string, frame_rate int, channel_count int, frame_count long, " + ", ".join(f"{c} int" for c in [*[f"envelope_loudness{i}" for i in range(4)], "envelope_time1", "envelope_time2"])
    none = spark.createDataFrame([], kinds)
    whole = jobs.refresh_features(files_, none, read=lambda s: files.read_assets(spark, str(tmp_path)), store=stored, bucket=16, chunk_frames=512)
    split = jobs.refresh_features(files_, none, store=stored, bucket=16, chunk_frames=512)
    assert sorted(map(str, whole.collect())) == sorted(map(str, split.collect())) and split.count() == 4
    # what is fresh stays and isn't opened
    was = split.withColumn("md5", F.lit("old"))
    assert {r.md5 for r in jobs.refresh_features(files_, stored(was, "was"), store=stored).collect()} == {"old"}


def test_paths_of_stores():
    assert ranges._URI.match("file:/a b/c").groups() == ("file", None, "a b/c")
    assert ranges._URI.match("file:///a b/c").groups() == ("file", "", "/a b/c")
    assert ranges._URI.match("hdfs://host:8020/x/y.wav").groups() == ("hdfs", "host:8020", "/x/y.wav")
    assert ranges._URI.match("s3a://bucket/x y.wav").groups() == ("s3a", "bucket", "/x y.wav")
    assert ranges._URI.match("/plain/x.wav") is None


def test_first_lines_are_all_that_is_read(spark, tmp_path):
    sets = {
        "a": b"Name,X\r\n1,2\r\n", "b": b"# c\n\n   \n#\nName\n", "c": b"#only\n", "d": b"", "e": "Näme\rrest".encode(), "f": b"one line", "g": b"\nsecond",
        "h": b"H\n" + b"\xff" * 10,
    }
    for name, data in sets.items():
        (tmp_path / name).write_bytes(data)
    paths = listed(spark, [tmp_path / n for n in sets])

    def got(skip):
        return {r.path.rsplit("/", 1)[1]: r.line for r in ranges.first_lines(paths, skip).collect()}

    assert got(None) == {"a": "Name,X", "b": "# c", "c": "#only", "e": "Näme", "f": "one line", "g": "", "h": "H"}
    assert got(r"#| *$") == {"a": "Name,X", "b": "Name", "e": "Näme", "f": "one line", "g": "second", "h": "H"}


def test_tables_whose_names_have_spaces(spark, tmp_path):
    from assetloom.functions.spec import ColumnSpec
    from assetloom.sources import tables

    (tmp_path / "a b.csv").write_text('# made by hand\nName,X\nn1,1\n#off,2\n"line\nend",3\n')
    (tmp_path / "c.csv").write_text("X,Other,Name\n5,o,n2\n")
    found = tables.read_tree(spark, str(tmp_path), "csv", [ColumnSpec("Name"), ColumnSpec("X", "int")])
    assert sorted((r.Name, r.X) for r in found.collect()) == [("line\nend", 3), ("n1", 1), ("n2", 5)]
    assert tables.read_tree(spark, str(tmp_path / "none"), "csv", [ColumnSpec("Name")]).count() == 0


def test_many_small_files_are_few_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"{i}.wav").write_bytes(wav([i] * 3))
    rows = ranges.signal_rows(files.list_files(spark, str(tmp_path)), chunk_frames=512, range_bytes=1024)
    assert rows.rdd.getNumPartitions() <= 16
    assert sorted(r.samples for r in rows.collect()) == sorted([i] * 3 for i in range(200))


def test_tasks_write_signals_a_file_each(spark, tmp_path):
    many = [(f"{tmp_path}/{k % 2}/{k}.wav", [k, -1, 32767, -32768] * k) for k in range(5)]
    frame = spark.createDataFrame(many, "path string, samples array<int>")
    want = {p: bytes(r[0]) + b"\n" for p, r in zip((p for p, _ in many), frame.select(files.wav_bytes("samples")).collect(), strict=True)}
    for _ in range(2):  # a task that is run again replaces its files
        got = ranges.write_signals(frame, after=b"\n").collect()
        assert {r.path: r.size for r in got} == {p: len(x) for p, x in want.items()}
        assert {str(p): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()} == want


def test_written_signals_share_folders(spark):
    """A folder a file would be a task of the listing each."""
    from assetloom.queries.sources import take_files

    root, made = take_files(spark, "/root/testdata/sf0.001")
    listed = files.list_files(spark, root)
    assert made.count() > 1 and listed.select("parent").distinct().count() == 1
    key = F.regexp_extract("path", "[^/]*$", 0)
    assert sorted(map(tuple, listed.select(key, "size").collect())) == sorted(map(tuple, made.select(key, "size").collect()))
