"""Scalar functions on columns. All are built-in expressions, so they stay within generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions.spec import GENERATED, ColumnSpec

ColumnOrName = Column | str
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INT_MIN, INT_MAX = -2147483648, 2147483647


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(c: ColumnOrName) -> Column:
    return F.translate(_c(c), _UPPER, _LOWER)


def blank_to_null(c: ColumnOrName) -> Column:
    return F.when(F.trim(_c(c)) != "", _c(c))


def _mapped(c: Column, table: dict, default: Column) -> Column:
    first, *rest = table.items()
    out = F.when(c == F.lit(first[0]), F.lit(first[1]))
    for k, v in rest:
        out = out.when(c == F.lit(k), F.lit(v))
    return out.otherwise(default)


# --- parsing -------------------------------------------------------------------------------------------------------

def parse_bool(c: ColumnOrName, blank: bool | None = None) -> Column:
    """true/yes/1 and false/no/0, any case; a blank gives ``blank``; anything else is NULL (see ``bad_bool``)."""
    v = F.lower(F.trim(_c(c)))
    out = F.when(v.isin("true", "yes", "1"), True).when(v.isin("false", "no", "0"), False)
    return out if blank is None else out.when(F.coalesce(v, F.lit("")) == "", blank)


def bad_bool(c: ColumnOrName) -> Column:
    return (F.trim(_c(c)) != "") & parse_bool(c).isNull()


def _double(c: Column) -> Column:
    """A number, or one of the names of infinity and not-a-number; NULL for anything else, also '1d' and '1f'."""
    low = F.lower(c)
    return (
        F.when(c.rlike(NUMBER), c.try_cast("double"))
        .when(low.isin("inf", "+inf", "infinity", "+infinity"), float("inf"))
        .when(low.isin("-inf", "-infinity"), float("-inf"))
        .when(low.isin("nan", "+nan", "-nan"), float("nan"))
    )


def parse_num(c: ColumnOrName, kind: str = "int") -> Column:
    """Lenient number: blank is NULL; an exact integer, else a double truncated toward zero, saturating, NaN to 0."""
    v = F.trim(_c(c))
    d = _double(v)
    if kind in ("float", "double"):
        return d.cast(kind)
    # greatest and least pass over NULL
    clamped = F.when(F.isnan(d), 0.0).when(d.isNotNull(), F.greatest(F.least(d, F.lit(float(INT_MAX))), F.lit(float(INT_MIN))))
    return F.coalesce(F.when(v.rlike("^[+-]?[0-9]+$"), v.try_cast("int")), clamped.cast("int"))


def bad_num(c: ColumnOrName) -> Column:
    return (F.trim(_c(c)) != "") & _double(F.trim(_c(c))).isNull()


def parse_enum(c: ColumnOrName, domain: list[str]) -> Column:
    """The value in upper case if it belongs to the domain; blank and unknown values are NULL (see ``bad_enum``)."""
    v = F.upper(F.trim(_c(c)))
    return F.when(v.isin(domain), v)


def bad_enum(c: ColumnOrName, domain: list[str]) -> Column:
    return (F.trim(_c(c)) != "") & ~F.upper(F.trim(_c(c))).isin(domain)


# The five levels with rank, bit mask, gate threshold and the 13 bytes that identify the recipe.
LEVEL_RANK = {"none": 0, "low": 1, "medium": 2, "high": 3, "extreme": 4}
LEVEL_MASK = {"none": ~0, "low": ~0x3, "medium": ~0xF, "high": ~0x3F, "extreme": ~0xFF}
LEVEL_GATE = {"none": None, "low": 128, "medium": 256, "high": 256, "extreme": 1024}
GATE_WINDOW = 128


def recipe(level: str, window: int = GATE_WINDOW) -> bytes:
    """Mask and gate of a level as bytes: mask, window, whether there is a gate, threshold; little-endian."""
    gate = LEVEL_GATE[level]
    return b"".join(
        [(LEVEL_MASK[level] & 0xFFFF).to_bytes(2, "little"), window.to_bytes(8, "little"), bytes([gate is not None]), (gate or 0).to_bytes(2, "little")]
    )


def parse_level(c: ColumnOrName) -> Column:
    """'', default and yes inherit (NULL); no is none; else one of the five names; unknown values are NULL (``bad_level``)."""
    v = F.lower(F.trim(_c(c)))
    return F.when(v == "no", "none").when(v.isin(*LEVEL_RANK), v)


def bad_level(c: ColumnOrName) -> Column:
    return ~F.lower(F.trim(_c(c))).isin("", "default", "yes", "no", *LEVEL_RANK)


def level_rank(c: ColumnOrName) -> Column:
    return _mapped(_c(c), LEVEL_RANK, F.lit(None).cast("int"))


def blank_as(c: ColumnOrName, value: str) -> Column:
    return F.when(F.coalesce(F.trim(_c(c)), F.lit("")) == "", F.lit(value)).otherwise(_c(c))


# --- paths and identities ------------------------------------------------------------------------------------------

def norm_path(c: ColumnOrName) -> Column:
    """Trimmed, backslashes, ASCII lower case, separators collapsed and none in front."""
    v = F.translate(ascii_lower(F.trim(_c(c))), "/", "\\")
    return F.regexp_replace(F.regexp_replace(v, r"\\+", r"\\"), r"^\\+", "")


def name_hash(c: ColumnOrName) -> Column:
    """32-bit hash of the ASCII-lowered code points: h = c + h * 65599, from 5381, modulo 2**32; 0 becomes 1."""
    v = ascii_lower(_c(c))
    # an empty text has no characters, though split gives one empty string
    chars = F.filter(F.split(v, ""), lambda x: x != "")
    h = F.aggregate(chars, F.lit(5381).cast("long"), lambda a, x: (a * F.lit(65599).cast("long") + F.ascii(x)) % F.lit(1 << 32))
    return F.when(h == 0, F.lit(1).cast("long")).otherwise(h)


def content_md5(c: ColumnOrName) -> Column:
    return F.upper(F.md5(_c(c)))


def recipe_md5(c: ColumnOrName, level: ColumnOrName) -> Column:
    """MD5 of the content followed by the bytes of the recipe of its level."""
    tag = _mapped(_c(level), {k: recipe(k).hex() for k in LEVEL_RANK}, F.lit(None).cast("string"))
    return F.upper(F.md5(F.concat(_c(c).cast("binary"), F.unhex(tag))))


def recipe_checksums(c: ColumnOrName) -> Column:
    """``recipe_md5`` of a content for every level, as a struct with a field a level: all come from one read of the file."""
    return F.struct(*[recipe_md5(c, F.lit(k)).alias(k) for k in LEVEL_RANK])


def checksum_at(checksums: ColumnOrName, level: ColumnOrName) -> Column:
    """The field of ``recipe_checksums`` that a level names (in any case), else null."""
    return F.coalesce(*[F.when(F.lower(_c(level)) == k, _c(checksums)[k]) for k in LEVEL_RANK])


def recipe_of(checksum: ColumnOrName, level: ColumnOrName) -> Column:
    """A content checksum bound to the recipe of a level, without reading the content again: the MD5 of the checksum's
    text and the recipe. It is another identity than ``recipe_md5`` of the content itself; a manifest keeps to one of them."""
    tag = _mapped(_c(level), {k: recipe(k).hex().upper() for k in LEVEL_RANK}, F.lit(""))
    return F.upper(F.md5(F.concat(_c(checksum), F.lit("+"), tag)))


def asset_id(h: ColumnOrName, md5: ColumnOrName) -> Column:
    return F.concat_ws(" ", _c(h).cast("string"), F.upper(_c(md5)))


def scale_level(v: ColumnOrName, scale: ColumnOrName) -> Column:
    """floor(v * floor(100 * scale) / 100) in 32-bit floats."""
    part = F.floor((F.lit(100).cast("float") * _c(scale).cast("float")).cast("float")).cast("float")
    return F.floor(((_c(v).cast("float") * part).cast("float") / F.lit(100).cast("float")).cast("float")).cast("int")


def _without_prefix(s: Column, prefix: Column) -> Column:
    hit = (F.length(prefix) > 0) & F.startswith(ascii_lower(s), ascii_lower(prefix))
    return F.when(hit, F.substring(s, F.length(prefix) + 1, F.length(s))).otherwise(s)


def strip_roots(c: ColumnOrName, roots: list[str], language: ColumnOrName) -> Column:
    """The path without the given roots (in order), leading separators and a leading language segment; any case."""
    s = F.translate(_c(c), "\\", "/")
    for root in roots:
        s = _without_prefix(s, F.lit(root.replace("\\", "/")))
    s = F.regexp_replace(s, r"^/+", "")
    s = _without_prefix(s, F.concat(_c(language), F.lit("/")))
    return F.regexp_replace(s, r"^/+", "")


def target_name(path: ColumnOrName, storage: ColumnOrName, looping: ColumnOrName, level: ColumnOrName, platform: ColumnOrName) -> Column:
    """Relative path without extension, then ``.{L|S|P}{L|N}{level}.{platform}.snd``; NULL without an extension."""
    p = F.translate(_c(path), "/", "\\")
    base = F.regexp_extract(p, r"(?s)^(.*)\.([^.\\]*)$", 1)
    s = _mapped(_c(storage), {"LOADED": "L", "STREAMED": "S", "PRIMED": "P"}, F.lit(None).cast("string"))
    loop = _mapped(_c(looping), {"LOOPING": "L", "NONLOOPING": "N"}, F.lit(None).cast("string"))
    out = F.concat(base, F.lit("."), s, loop, _c(level).cast("string"), F.lit("."), _c(platform), F.lit(".snd"))
    return F.when(p.rlike(r"(?s)^.*\.[^.\\]*$"), out)


def file_stem(c: ColumnOrName) -> Column:
    """Last path segment without its extension; a leading dot is part of the stem."""
    name = F.regexp_extract(_c(c), r"([^/\\]*)[/\\]*$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


# --- units and signal scalars --------------------------------------------------------------------------------------

FLOOR_LINEAR, FLOOR_DB = 1e-4, -80.0


def db_to_linear(c: ColumnOrName) -> Column:
    return F.pow(F.lit(10.0), _c(c) / 20.0)


def linear_to_db(c: ColumnOrName) -> Column:
    return F.when(_c(c) < FLOOR_LINEAR, F.lit(FLOOR_DB)).otherwise(20.0 * F.log10(_c(c)))


def linear_to_spl(c: ColumnOrName) -> Column:
    return F.when(_c(c) < FLOOR_LINEAR, F.lit(0.0)).otherwise(20.0 * F.log10(_c(c)) + 100.0)


# The frame rates of the manifest's index.
RATES = [8000, 12000, 16000, 24000, 32000, 44100, 48000, 96000, 192000]


def rate_index(c: ColumnOrName) -> Column:
    return _mapped(_c(c), {r: i for i, r in enumerate(RATES)}, F.lit(255))


def index_rate(c: ColumnOrName) -> Column:
    return _mapped(_c(c), dict(enumerate(RATES)), F.lit(0))


def fmt_bool(c: ColumnOrName) -> Column:
    return F.when(_c(c), "True").when(~_c(c), "False").otherwise("")


def fmt_num(c: ColumnOrName) -> Column:
    """Shortest form without exponent and without a trailing '.0'; NULL is blank."""
    s = _c(c).cast("string")
    plain = F.when(F.contains(s, F.lit("E")), F.regexp_replace(_c(c).cast("decimal(38,12)").cast("string"), "0+$", "")).otherwise(s)
    return F.coalesce(F.regexp_replace(plain, r"\.0?$", ""), F.lit(""))


def level_mask(level: ColumnOrName) -> Column:
    return _mapped(_c(level), LEVEL_MASK, F.lit(None).cast("int"))


def gate_threshold(level: ColumnOrName) -> Column:
    return _mapped(_c(level), {k: v for k, v in LEVEL_GATE.items() if v is not None}, F.lit(None).cast("int"))


def truncate_bits(samples: ColumnOrName, level: ColumnOrName) -> Column:
    mask = level_mask(level)
    return F.transform(_c(samples), lambda x: x.cast("int").bitwiseAND(mask))


def resampled_frames(n: ColumnOrName, rate: ColumnOrName, to: int = 48000) -> Column:
    return F.floor(_c(n).cast("long") * F.lit(to).cast("long") / _c(rate)).cast("long")


def quantise_level(c: ColumnOrName) -> Column:
    """A loudness as an unsigned byte: truncated, saturating."""
    return F.when(_c(c).isNotNull(), F.greatest(F.least(_c(c), F.lit(255.0)), F.lit(0.0))).cast("int")


def quantise_time(c: ColumnOrName) -> Column:
    return F.when(_c(c).isNotNull(), F.greatest(F.least(_c(c) * 65535.0, F.lit(65535.0)), F.lit(0.0))).cast("int")


# --- geometry ------------------------------------------------------------------------------------------------------

def _cross(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _xyz(c: ColumnOrName) -> list[Column]:
    return [_c(c)[i] for i in range(3)]


def cross(a: ColumnOrName, b: ColumnOrName) -> list[Column]:
    return _cross(_xyz(a), _xyz(b))


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Of the first three components."""
    return _dot(_xyz(a), _xyz(b))


def plane(p0: ColumnOrName, p1: ColumnOrName, p2: ColumnOrName) -> Column:
    """[nx, ny, nz, d] of the plane through three points (arrays); the normal follows (p1-p0) x (p2-p0)."""
    a, b, c = _xyz(p0), _xyz(p1), _xyz(p2)
    n = _cross([y - x for x, y in zip(a, b, strict=True)], [y - x for x, y in zip(a, c, strict=True)])
    size = F.sqrt(_dot(n, n))
    n = [F.when(size == 0, x).otherwise(x / F.when(size == 0, 1.0).otherwise(size)) for x in n]
    return F.array(*n, -_dot(n, a))


def plane_dist(pl: ColumnOrName, point: ColumnOrName) -> Column:
    return _dot(_xyz(pl), _xyz(point)) + _c(pl)[3]


def intersect3(a: ColumnOrName, b: ColumnOrName, c: ColumnOrName) -> Column:
    """The common point of three planes, NULL where the determinant is below 1e-6."""
    n = [_xyz(p) for p in (a, b, c)]
    d = [_c(p)[3] for p in (a, b, c)]
    det = _dot(_cross(n[0], n[1]), n[2])
    parts = [(_cross(n[1], n[2]), d[0]), (_cross(n[2], n[0]), d[1]), (_cross(n[0], n[1]), d[2])]
    safe = F.when(F.abs(det) < 1e-6, 1.0).otherwise(det)
    point = F.array(*[reduce(lambda x, y: x + y, [v[i] * -w for v, w in parts]) / safe for i in range(3)])
    return F.when(F.abs(det) >= 1e-6, point)


# --- freshness and defaults ----------------------------------------------------------------------------------------

def is_stale(mtime: ColumnOrName, stored: ColumnOrName, tolerance: int = 1) -> Column:
    """Whether a file must be read again: unknown, or newer than stored by more than the tolerance in seconds."""
    return _c(stored).isNull() | (F.unix_timestamp(_c(mtime)) > _c(stored) + tolerance)


def typed_default(c: ColumnSpec) -> Column:
    return F.lit(c.default).cast(KIND_TYPES.get(c.kind, "string"))


KIND_TYPES = {"int": "int", "float": "float", "boolean": "boolean"}


def complete(df: DataFrame, spec: list[ColumnSpec]) -> DataFrame:
    """``df`` with every column of the spec; those it lacks are NULL."""
    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(KIND_TYPES.get(c.kind, "string")).alias(c.name) for c in spec if c.name not in have])


def apply_defaults(df: DataFrame, spec: list[ColumnSpec]) -> DataFrame:
    """All defaults in one projection; columns outside the spec stay."""
    by = {c.name: c for c in spec if c.default is not None}
    return df.select(*[F.coalesce(F.col(f"`{n}`"), typed_default(by[n])).alias(n) if n in by else F.col(f"`{n}`") for n in df.columns])


def apply_fixups(df: DataFrame) -> DataFrame:
    """DistMaxWet follows DistMaxDry where it is not given; nothing panned to the low-frequency channel has reverb."""
    return df.withColumns(
        {
            "DistMaxWet": F.coalesce("DistMaxWet", "DistMaxDry"),
            "ReverbSend": F.when(F.col("Pan") == "lfe", F.lit(0)).otherwise(F.col("ReverbSend")),
        }
    )


def clear(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = GENERATED if cols is None else cols
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in cols})
