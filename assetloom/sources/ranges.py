"""Signals and checksums of files of any size, opened by the tasks themselves: no path goes to the driver and no file is
ever whole in memory.

A pass over the heads walks the chunks of each file once (``heads``); frames are then read in ranges of bytes, cut between
rows, so that one file is the work of many tasks (``signal_rows``). Checksums are made from blocks (``file_hashes``).
Files are opened by pyarrow, which knows local files, HDFS and the usual object stores; for a store that only Spark's own
readers know there are ``files.read_assets`` and ``files.wav_to_chunks``, up to 2 GB a file."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.functions import scalars as S
from assetloom.sources import files as src
from assetloom.sources.scratch import stored

HEADS = "path string, size long, channel_count int, frame_rate int, data_at long, frame_count long, problem string"
#: Bytes that a task holds of a file at a time.
BLOCK = 4 << 20
_URI = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]+):/(?:/([^/]*))?(/?.*)$")
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
#: Bytes that are the work of a task, and those that a range counts as at least, since a file has to be opened for it.
TASK, OPENING = 64 << 20, 256 << 10
#: What ``opened`` can open.
KNOWN = {"file", "hdfs", "s3", "s3a", "s3n", "gs", "abfs", "abfss"}


@lru_cache(64)
def _store(scheme: str, authority: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{authority}/")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path is None:
        raise ValueError("no path")
    m = _URI.match(path)
    if m is None or m[1] == "file":
        return fs.LocalFileSystem(), path if m is None else "/" + m[3].lstrip("/")
    store, base = _store(m[1], m[2] or "")
    return store, f"{base.rstrip('/')}/{m[3].lstrip('/')}"


def opened(path: str):
    """A file for reading at any place, by its path as Spark lists it (names aren't percent-encoded)."""
    store, at = _place(path)
    return store.open_input_file(at)


def written(path: str, data: bytes) -> None:
    """A whole file, in folders that are made for it. It has its name from a rename on, so a task that fails leaves none cut
    short, and one that is run again replaces it."""
    store, at = _place(path)
    folder = at.rsplit("/", 1)[0]
    store.create_dir(folder, recursive=True)
    hidden = f"{folder}/_{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as f:
        f.write(data)
    try:
        store.move(hidden, at)
    except OSError:  # a store whose rename doesn't replace
        store.delete_file(at)
        store.move(hidden, at)


def write_signals(signals: DataFrame, channels: int = 1, rate: int = 48000, after: bytes = b"") -> DataFrame:
    """(path, size) of signals (path, samples) that the tasks write, each as a 16-bit PCM file with ``after`` behind its data.

    For very many small files: Spark's own writers set up and commit a writer for each."""
    kind = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16) + b"data"

    def run(batches):
        for b in batches:
            paths, sizes = b.column(0).to_pylist(), []
            for path, samples in zip(paths, b.column(1), strict=True):
                if samples.values is None or samples.values.null_count:
                    raise ValueError(f"samples missing: {path}")
                raw = samples.values.to_numpy().astype("<i2").tobytes()
                data = b"RIFF" + struct.pack("<I", len(raw) + 36) + kind + struct.pack("<I", len(raw)) + raw + after
                written(path, data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "size"])

    return stored(signals.select("path", "samples").mapInArrow(run, "path string, size long"), "written")


def known(path: str) -> bool:
    """Whether tasks can open a file of this scheme themselves."""
    m = _URI.match(path)
    return m is None or m[1] in KNOWN


def first_lines(listed: DataFrame, skip: str | None = None, tasks: int | None = None) -> DataFrame:
    """(path, line) of the listed files: the first line, or the first one that the pattern ``skip`` doesn't match from its start,
    read no further than that. A file without such a line has no row. Lines end as in Spark's text reader."""

    def run(batches):
        for b in batches:
            paths, lines = [], []
            for path in b.column(0).to_pylist():
                with opened(path) as f, io.TextIOWrapper(f, "utf-8", "replace") as text:
                    line = next((x.rstrip("\n") for x in text if skip is None or not re.match(skip, x.rstrip("\n"))), None)
                if line is not None:
                    paths.append(path)
                    lines.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lines, pa.string())], ["path", "line"])

    return _spread(listed, tasks).mapInArrow(run, "path string, line string")


def _spread(frame: DataFrame, tasks: int | None) -> DataFrame:
    """Each path once, over a number of tasks that adaptive execution doesn't merge: small rows that stand for much work."""
    return frame.select("path").repartition(tasks or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").distinct()


def heads(listed: DataFrame, tasks: int | None = None) -> DataFrame:
    """(path, size, channel_count, frame_rate, data_at, frame_count, problem) of the listed files (path), of which the heads of
    their chunks are read.

    ``problem`` says why a file is no signal, or that it can't be opened; the other columns but the path are NULL then. A null
    path is a problem, a path that is listed twice has one row. Frames that the head claims and the file lacks count: they
    are read as zeros."""

    def head(path):
        try:
            with opened(path) as f:
                size = f.size()
                channels, rate, at, claimed = src.find_data(lambda at, n: f.read_at(n, at) if at < size else b"", size)
        except (ValueError, OSError) as why:
            return None, None, None, None, None, str(why) or type(why).__name__
        return size, channels, rate, at, claimed // (2 * channels), None

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        names = ["path", "size", "channel_count", "frame_rate", "data_at", "frame_count", "problem"]
        for b in batches:
            rows = [(p, *head(p)) for p in b.column(0).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return _spread(listed, tasks).mapInArrow(run, HEADS)


def ranges(found: DataFrame, chunk_frames: int = 4096, range_bytes: int = 64 << 20, carried: str | None = None) -> DataFrame:
    """(path, channel_count, frame_rate, data_at, frame_count, first_row, rows) of ``heads``: the rows of a signal in ranges of
    about ``range_bytes``, from the heads alone. A signal without frames has one range of one row."""
    rows = F.greatest(F.lit(1), F.ceil(F.col("frame_count") / chunk_frames)).cast("long")
    per = F.greatest(F.lit(1), F.floor(F.lit(range_bytes) / (F.col("channel_count") * (2 * chunk_frames)))).cast("long")
    each = found.filter("problem is null").withColumns({"__rows": rows, "__per": per})
    each = each.withColumn("first_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__rows") - 1, F.col("__per"))))
    return each.select("path", "channel_count", "frame_rate", "data_at", "frame_count", "first_row", F.least("__per", F.col("__rows") - F.col("first_row")).alias("rows"), *([carried] if carried else []))


def read_ranges(asked: DataFrame, tasks: int, chunk_frames: int = 4096, carried: str | None = None) -> DataFrame:
    """The rows (as ``files.CHUNKS``) of the asked ``ranges``, a bounded block in memory at a time. ``chunk_frames`` is that of
    the ranges; a text column named by ``carried`` stays beside the rows."""

    def run(batches):
        path = f = None
        try:
            for b in batches:
                for r in b.to_pylist():
                    if r["path"] != path:
                        if f is not None:
                            f.close()
                        path, f = r["path"], opened(r["path"])
                    for block in _blocks(f, r, chunk_frames):
                        yield block.append_column(carried, pa.array([r[carried]] * block.num_rows, pa.string())) if carried else block
        finally:
            if f is not None:
                f.close()

    return asked.repartition(tasks).mapInArrow(run, src.CHUNKS + (f", `{carried}` string" if carried else ""))


def _blocks(f, r, chunk_frames):
    ch, size = r["channel_count"], f.size()
    step = max(1, BLOCK // (2 * ch * chunk_frames))
    end = r["first_row"] + r["rows"]
    for row in range(r["first_row"], end, step):
        k = min(step, end - row)
        n = max(0, min(r["frame_count"] - row * chunk_frames, k * chunk_frames))
        at = r["data_at"] + row * chunk_frames * 2 * ch
        raw = f.read_at(n * 2 * ch, at) if n and at < size else b""
        flat = np.zeros(n * ch, "<i2")
        flat.view(np.uint8)[: len(raw)] = np.frombuffer(raw, np.uint8)
        cuts = np.minimum(np.arange(k + 1) * chunk_frames, n) * ch
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r["path"]] * k),
                pa.array(np.arange(row, row + k)),
                pa.array([ch] * k, pa.int32()),
                pa.array([r["frame_rate"]] * k, pa.int32()),
                pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat)),
            ],
            ["asset", "chunk_no", "channel_count", "frame_rate", "samples"],
        )


def signal_heads(listed: DataFrame, carried: str | None = None) -> DataFrame:
    """The ``heads`` of the listed files, read once and kept. Files that are no signals raise an error that names the first
    few; to go on without them, take their ``heads`` first. A text column of the list that ``carried`` names (one value a
    path) stays beside each path."""
    found = stored(heads(listed), "heads")
    bad = found.filter("problem is not null").select("path", "problem").orderBy("path").limit(5).collect()
    if bad:
        raise ValueError(f"files that can't be read: {[tuple(r) for r in bad]}")
    return found.join(listed.select("path", carried), "path") if carried else found


def rows_of(found: DataFrame, chunk_frames: int = 4096, range_bytes: int = 64 << 20, most_tasks: int = 20_000, carried: str | None = None) -> DataFrame:
    """The signals of ``signal_heads`` as rows; tasks are as many as the bytes need (``TASK``, or ``range_bytes`` if that is more),
    and four times those of a shuffle if there are ranges for so many: beyond that a task takes many ranges of small files.
    What is carried stands beside each row, so nothing has to be joined to samples."""
    asked = ranges(found, chunk_frames, range_bytes, carried)
    each = F.greatest(F.col("rows") * F.col("channel_count") * (2 * chunk_frames), F.lit(OPENING))
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    tasks = max(4 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // max(TASK, range_bytes)))
    return read_ranges(asked, max(1, min(tasks, n, most_tasks)), chunk_frames, carried)


def signal_rows(listed: DataFrame, chunk_frames: int = 4096, range_bytes: int = 64 << 20, most_tasks: int = 20_000) -> DataFrame:
    """The signals of the listed files (path) as rows of ``chunk_frames`` frames, as ``files.wav_to_chunks`` has them, of files
    of any size: ``rows_of`` their ``signal_heads``."""
    return rows_of(signal_heads(listed), chunk_frames, range_bytes, most_tasks)


def file_hashes(listed: DataFrame, recipes: bool = False, tasks: int | None = None) -> DataFrame:
    """(path, size, md5) of the listed files (path), and with ``recipes`` also ``recipe_checksums`` (see ``S.recipe_checksums``),
    from one read in blocks. A path that is listed twice has one row; a null path or a file that can't be opened fails the job."""
    tails = {k: S.recipe(k) for k in S.LEVEL_RANK} if recipes else {}
    kind = pa.struct([(k, pa.string()) for k in tails])

    def digests(path):
        h, size = hashlib.md5(usedforsecurity=False), 0
        with opened(path) as f:
            while block := f.read(BLOCK):
                h.update(block)
                size += len(block)
        each = {}
        for level, tail in tails.items():
            one = h.copy()
            one.update(tail)
            each[level] = one.hexdigest().upper()
        return path, size, h.hexdigest().upper(), each

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                path, size, md5, each = digests(path)
                cols = [pa.array([path]), pa.array([size], pa.int64()), pa.array([md5])]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array([each], kind)] if recipes else []), ["path", "size", "md5"] + (["recipe_checksums"] if recipes else []))

    schema = "path string, size long, md5 string"
    if recipes:
        schema += ", recipe_checksums struct<" + ", ".join(f"{k}: string" for k in tails) + ">"
    return _spread(listed, tasks).mapInArrow(run, schema)
