"""File listings, binary assets, signals in chunks, stream headers, manifests and map text."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.sources import snapshots

SUPPORTED = ["wav", "flac", "ogg"]
CHUNKS = "asset string, chunk_no long, channel_count int, frame_rate int, samples array<smallint>"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel_path, parent, stem, ext, size, mtime) of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    base = spark._jvm.org.apache.hadoop.fs.Path(root).makeQualified(
        spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jvm.org.apache.hadoop.fs.Path("/")
    ).toString().rstrip("/")
    rel = F.substring("path", len(base) + 2, 1 << 20)
    return split_path(files.withColumn("rel_path", rel), "rel_path").withColumnsRenamed({"length": "size", "modificationTime": "mtime"})


def split_path(df: DataFrame, path: str) -> DataFrame:
    """parent, stem and ext of a path with forward slashes."""
    return df.withColumns(
        {
            "parent": F.regexp_extract(path, r"^(.*)/[^/]*$", 1),
            "stem": F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1),
            "ext": F.regexp_extract(path, r"\.([^./]*)$", 1),
        }
    )


def supported(ext: Column | str) -> Column:
    return (F.col(ext) if isinstance(ext, str) else ext).isin(SUPPORTED)


def read_assets(spark: SparkSession, paths) -> DataFrame:
    """(path, size, md5, content) of files."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.col("length").alias("size"), F.upper(F.md5("content")).alias("md5"), "content")


def find_data(read, length: int) -> tuple[int, int, int, int]:
    """(channels, rate, place, bytes) of the samples of a 16-bit PCM file of ``length`` bytes, whose chunks are walked with
    ``read(place, n)``. The bytes are what the data chunk claims, in whole frames; the file may hold fewer."""
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, fmt = 12, None
    while at + 8 <= length:
        head = read(at, 8)
        name, size = head[:4], int.from_bytes(head[4:8], "little")
        if name == b"fmt ":
            body = read(at + 8, 16)
            if len(body) < 16:
                raise ValueError("format cut short")
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body)
            if kind not in (1, 65534) or bits != 16 or not 1 <= channels <= 2:
                raise ValueError(f"unsupported format {kind}, {bits} bits, {channels} channels")
            fmt = channels, rate
        elif name == b"data":
            if fmt is None:
                raise ValueError("data before format")
            return *fmt, at + 8, size // (2 * fmt[0]) * 2 * fmt[0]
        at += 8 + size + size % 2
    raise ValueError("no data")


def parse_wav(data: bytes) -> tuple[int, int, np.ndarray]:
    """(channels, rate, frames x channels) of a 16-bit PCM file; a data chunk that claims too much is padded with zeros."""
    channels, rate, at, size = find_data(lambda at, n: data[at : at + n], len(data))
    raw = data[at : at + size]
    raw += b"\0" * (size - len(raw))
    return channels, rate, np.frombuffer(raw, "<i2").reshape(-1, channels)


def wav_to_chunks(files: DataFrame, chunk_frames: int = 4096, name: str = "path", content: str = "content") -> DataFrame:
    """Signals as rows of ``chunk_frames`` frames (interleaved samples), a multiple of 512 so that neither gates nor
    buckets straddle rows; a file without frames is one empty row. A file is parsed where it is read, one at a time."""

    def run(batches):
        for b in batches:
            for asset, data in zip(b.column(0), b.column(1), strict=True):
                channels, rate, frames = parse_wav(data.as_py())
                for no, at in enumerate(range(0, max(len(frames), 1), chunk_frames)):
                    part = np.ascontiguousarray(frames[at : at + chunk_frames]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([asset.as_py()]),
                            pa.array([no], pa.int64()),
                            pa.array([channels], pa.int32()),
                            pa.array([rate], pa.int32()),
                            pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part)),
                        ],
                        ["asset", "chunk_no", "channel_count", "frame_rate", "samples"],
                    )

    return files.select(F.col(name).cast("string"), F.col(content)).mapInArrow(run, CHUNKS)


def wav_bytes(samples: Column, channels: int = 1, rate: int = 48000) -> Column:
    """A 16-bit PCM file of an array of samples, from built-in expressions."""

    def little(c: Column, n: int) -> Column:
        h = F.lpad(F.hex(c), 2 * n, "0")
        return F.concat(*[F.substring(h, 2 * (n - 1 - i) + 1, 2) for i in range(n)])

    size = F.size(samples) * 2
    body = F.array_join(F.transform(samples, lambda x: little(F.pmod(x.cast("int"), F.lit(65536)), 2)), "")
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16) + b"data"
    return F.unhex(F.concat(F.lit(b"RIFF".hex()), little(size + 36, 4), F.lit(head.hex()), little(size, 4), body))


def flac_streaminfo(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds frame_rate, channel_count, bits and total_samples from the stream header (bytes 8 to 41) of a file."""
    h = F.hex(F.substring(content, 1, 42))

    def number(first: int, n: int) -> Column:
        return F.conv(F.substring(h, 2 * first + 1, 2 * n), 16, 10).cast("long")

    word = number(18, 4)  # 20 bits of rate, 3 of channels, 5 of bits, 4 of the total
    ok = F.startswith(h, F.lit(b"fLaC".hex().upper())) & (F.length(h) == 84)
    return files.withColumns(
        {
            "frame_rate": F.when(ok, F.shiftright(word, 12).cast("int")),
            "channel_count": F.when(ok, (F.shiftright(word, 9).bitwiseAND(7) + 1).cast("int")),
            "bits": F.when(ok, (F.shiftright(word, 4).bitwiseAND(31) + 1).cast("int")),
            "total_samples": F.when(ok, word.bitwiseAND(15) * F.lit(1 << 32) + number(22, 4)),
        }
    )


MANIFEST = (
    "name string, name_hash long, size long, frame_count long, `order` long, `offset` long, frame_rate_index int, channel_count int, looping int, "
    "format int, envelope_loudness0 int, envelope_loudness1 int, envelope_loudness2 int, envelope_loudness3 int, envelope_time1 int, "
    "envelope_time2 int, source_checksum string, converted_checksum string, version int, zone string, platform string, language string, storage_class string"
)


def read_manifest(spark: SparkSession, path: str, version: int = 0) -> DataFrame:
    """The previous manifest, or none of it where it is missing or fails a check (see ``manifest_problems``). Of a location
    that was published the current snapshot is read.

    A version of 0 accepts any. Nothing is deleted; one aggregation decides."""
    from assetloom.operators.manifest import manifest_problems

    if not snapshots.exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    path = snapshots.folder(spark, path)
    m = spark.read.schema(MANIFEST).option("mergeSchema", False).parquet(path)
    return m.limit(0) if manifest_problems(m, version).limit(1).collect() else m


# --- map text ------------------------------------------------------------------------------------------------------

FACES = "file string, entity_no int, class_name string, target_name string, room string, priority int, brush_no int, face_no int, p0 array<double>, p1 array<double>, p2 array<double>"
_FACE = re.compile(r"^\s*\(([^()]*)\)\s*\(([^()]*)\)\s*\(([^()]*)\)")
_PAIR = re.compile(r'^\s*("([^"]*)"|[^\s"{}()]+)\s*("(.*)"|.*?)\s*$')
SKIPPED = ("animations", "mesh", "curve")


def parse_map(text: str):
    """(entity number, key-values, [[(p0, p1, p2), ...] per brush]) of each entity.

    Braces nest: entities at depth one, brushes below. A block named in SKIPPED is passed over, and so is what a brush
    holds besides faces."""
    depth, no, fields, brushes, faces, skip = 0, -1, {}, [], None, None
    named = ""
    for line in text.splitlines():
        s = line.split("//")[0].strip() if not line.strip().startswith('"') else line.strip()
        if not s:
            continue
        if s == "{":
            depth += 1
            if skip is None and named in SKIPPED:
                skip = depth
            if depth == 1:
                no, fields, brushes = no + 1, {}, []
            elif depth == 2 and skip is None:
                faces = []
            named = ""
        elif s == "}":
            if depth == skip:
                skip = None
            elif depth == 2 and skip is None and faces is not None:
                brushes.append(faces)
                faces = None
            elif depth == 1:
                yield no, fields, brushes
            depth -= 1
            named = ""
        elif skip is None:
            named = s.split()[0].strip('"')
            if depth == 1 and (m := _PAIR.match(s)):
                fields[(m[1] if m[2] is None else m[2]).strip()] = m[3] if m[4] is None else m[4]
            elif depth == 2 and faces is not None and (m := _FACE.match(s)):
                faces.append([[float(x) for x in g.split()] for g in m.groups()])


def read_map_faces(spark: SparkSession, paths) -> DataFrame:
    """One row per face of each brush (one row without a brush for entities that have none); files in parallel."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def run(batches):
        for b in batches:
            for file, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for no, kv, brushes in parse_map(value):
                    p = kv.get("script_ambientpriority", "").strip()
                    head = (file, no, kv.get("classname", ""), kv.get("targetname", ""), kv.get("script_ambientroom", ""), int(p) if re.fullmatch(r"[+-]?\d{1,9}", p) else 0)
                    if not brushes:
                        rows.append((*head, None, None, None, None, None))
                    for i, faces in enumerate(brushes):
                        rows += [(*head, i, j, *f) for j, f in enumerate(faces)] or [(*head, i, None, None, None, None)]
                if rows:
                    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * 3]
                    names = ["file", "entity_no", "class_name", "target_name", "room", "priority", "brush_no", "face_no", "p0", "p1", "p2"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return text.mapInArrow(run, FACES)
