"""Convex volumes bounded by planes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.functions import scalars as S
from assetloom.operators.tables import ranks, running

EPS = -0.01


def plane_triples(planes: DataFrame, volume: str = "volume", no: str = "face_no", pl: str = "plane") -> DataFrame:
    """All triples i < j < k of the planes of one volume: (volume, i, j, k, a, b, c).

    Equi-joins on the volume; a volume's faces are few, and its triples are what the check is about."""
    one = planes.select(volume, F.col(no).alias("i"), F.col(pl).alias("a"))
    two = planes.select(volume, F.col(no).alias("j"), F.col(pl).alias("b"))
    three = planes.select(volume, F.col(no).alias("k"), F.col(pl).alias("c"))
    return one.join(two, volume).filter("i < j").join(three, volume).filter("j < k")


def hull_points(planes: DataFrame, volume: str = "volume", no: str = "face_no", pl: str = "plane") -> DataFrame:
    """The points in which three planes of a volume meet: (volume, i, j, k, point)."""
    t = plane_triples(planes, volume, no, pl).withColumn("point", S.intersect3("a", "b", "c"))
    return t.filter("point is not null").select(volume, "i", "j", "k", "point")


def lines(planes: DataFrame, volume: str = "volume", no: str = "face_no", pl: str = "plane") -> DataFrame:
    """The lines in which two planes i < j of a volume meet: (volume, i, j, origin, direction). Parallel planes have none.

    The direction is the product of the normals; the origin is the point of the line nearest to the volume's origin."""
    one = planes.select(volume, F.col(no).alias("i"), F.col(pl).alias("a"))
    two = planes.select(volume, F.col(no).alias("j"), F.col(pl).alias("b"))
    n = S.cross("a", "b")
    pairs = one.join(two, volume).filter("i < j").select(volume, "i", "j", "a", "b", F.array(*n).alias("direction"))
    square = S.dot("direction", "direction")
    # (d_a * b - d_b * a) x direction / |direction|^2, for planes n . p + d = 0
    mixed = F.array(*[F.col("a")[3] * F.col("b")[k] - F.col("b")[3] * F.col("a")[k] for k in range(3)])
    pairs = pairs.withColumn("__m", mixed).filter(square >= 1e-12)
    at = [x / square for x in S.cross("direction", "__m")]
    return pairs.select(volume, "i", "j", F.array(*at).alias("origin"), "direction")


def edges(planes: DataFrame, volume: str = "volume", no: str = "face_no", pl: str = "plane", eps: float = EPS, salt: int = 16) -> DataFrame:
    """The part of every line that lies on the inner side of all planes of its volume: (volume, i, j, origin, direction, lo, hi).

    Along a line the distance to a plane is linear, so each plane bounds its places from below or above, or (parallel)
    lets all or none of them stand: one maximum and one minimum a line. Lines of a volume are dealt over ``salt`` groups
    that each meet its planes, so a volume of many faces is no single task. Lines without a place left are not returned."""
    line = lines(planes, volume, no, pl).withColumn("__g", F.pmod(F.xxhash64("i", "j"), F.lit(salt)).cast("int"))
    cut = planes.select(volume, F.col(pl).alias("__pl"), F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("__g"))
    slope, height = S.dot("__pl", "direction"), S.plane_dist("__pl", "origin")
    flat = F.abs(slope) < 1e-12
    bound = (F.lit(eps) - height) / F.when(flat, 1.0).otherwise(slope)
    met = line.join(cut, [volume, "__g"]).select(volume, "i", "j", F.when(~flat & (slope > 0), bound).alias("lo"), F.when(~flat & (slope < 0), bound).alias("hi"), (flat & (height < eps)).alias("out"))
    span = met.groupBy(volume, "i", "j").agg(F.coalesce(F.max("lo"), F.lit(float("-inf"))).alias("lo"), F.coalesce(F.min("hi"), F.lit(float("inf"))).alias("hi"), F.max("out").alias("out"))
    return line.drop("__g").join(span.filter("not out and lo <= hi").drop("out"), [volume, "i", "j"])


def inside_points(planes: DataFrame, volume: str = "volume", no: str = "face_no", pl: str = "plane", eps: float = EPS) -> DataFrame:
    """The points of ``hull_points`` on the inner side of every plane of their volume (normals point inward): (volume, i,
    j, k, point).

    A point lies on the line of its first two planes; it stays if its place there is within the line's span. Only lines
    with a span meet third planes, and no triple meets a plane."""
    line = edges(planes, volume, no, pl, eps).withColumnsRenamed({"origin": "__o", "direction": "__d"})
    third = planes.select(volume, F.col(no).alias("k"), F.col(pl).alias("__c"))
    det = S.dot("__c", "__d")
    met = line.join(third, volume).filter(F.col("k") > F.col("j")).filter(F.abs(det) >= 1e-6)
    met = met.withColumn("__t", -S.plane_dist("__c", "__o") / det).filter("__t >= lo and __t <= hi")
    return met.select(volume, "i", "j", "k", F.array(*[F.col("__o")[x] + F.col("__t") * F.col("__d")[x] for x in range(3)]).alias("point"))


def valid_volumes(planes: DataFrame, volume: str = "volume", no: str = "face_no", pl: str = "plane", eps: float = EPS) -> DataFrame:
    """Volumes of which at least one point survives."""
    kept = inside_points(planes, volume, no, pl, eps)
    return planes.select(volume).distinct().join(kept.select(volume).distinct(), volume, "left_semi")


def hull_problems(planes: DataFrame, volume: str = "volume", no: str = "face_no", pl: str = "plane") -> DataFrame:
    """(volume, rule) of volumes with fewer than three planes, or whose planes bound nothing."""
    n = planes.groupBy(volume).agg(F.count(pl).alias("n"))
    few = n.filter("n < 3").select(volume, F.lit("fewer than three planes").alias("rule"))
    empty = n.filter("n >= 3").join(valid_volumes(planes.filter(F.col(pl).isNotNull()), volume, no, pl), volume, "left_anti")
    return few.unionByName(empty.select(volume, F.lit("bounds nothing").alias("rule")))


def index_planes(counts: DataFrame, file: str, id_: str, n: str = "plane_count") -> DataFrame:
    """plane_index: planes of the volumes before, within a file."""
    return running(counts, [file], [id_], n, "plane_index")


def dense_ids(df: DataFrame, file: str, order: str) -> DataFrame:
    """Ids from 0 in declaration order within a file."""
    return ranks(df, [file], [order], "id").withColumn("id", F.col("id").cast("int"))
