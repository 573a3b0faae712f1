"""Scalar functions on literal values."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assetloom.functions import scalars as S
from assetloom.functions import spec as P


def values(spark, expr, data, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], f"i int, x {kind}")
    return [r.v for r in df.select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


def test_numbers(spark):
    data = ["", None, " 7 ", "-99.95", "1e5", "3e10", "-3e10", "nan", "inf", "1d", "x", "+5", ".5"]
    assert values(spark, S.parse_num, data) == [None, None, 7, -99, 100000, 2147483647, -2147483648, 0, 2147483647, None, None, 5, 0]
    assert values(spark, S.bad_num, data) == [False, None, False, False, False, False, False, False, False, True, True, False, False]


def test_bools_levels_and_domains(spark):
    data = ["TRUE", "yes", "1", "False", "no", "0", "", None, "x"]
    assert values(spark, S.parse_bool, data) == [True, True, True, False, False, False, None, None, None]
    assert values(spark, lambda c: S.parse_bool(c, blank=False), data)[6:] == [False, False, None]
    assert values(spark, S.parse_level, ["", "default", "yes", "no", "HIGH", "what"]) == [None, None, None, "none", "high", None]
    assert values(spark, S.bad_level, ["", "default", "no", "HIGH", "what"]) == [False, False, False, False, True]
    assert values(spark, lambda c: S.parse_enum(c, P.DOMAINS["storage"]), ["loaded", "x", ""]) == ["LOADED", None, None]


def test_hash_and_recipe(spark):
    assert values(spark, S.name_hash, ["abc", "ABC", ""]) == [669497117, 669497117, 5381]
    r = S.recipe("high")
    assert len(r) == 13 and r[2:10] == (128).to_bytes(8, "little") and r[10] == 1 and S.recipe("none")[10] == 0
    got = values(spark, lambda c: S.recipe_md5(c, F.lit("low")), ["data"])
    assert got == [hashlib.md5(b"data" + S.recipe("low")).hexdigest().upper()]


def test_printing(spark):
    assert values(spark, S.fmt_num, [1.0, 0.25, 1e7, 5.1, 0.000015, -13.0, None], "double") == ["1", "0.25", "10000000", "5.1", "0.000015", "-13", ""]
    assert values(spark, S.fmt_bool, [True, False, None], "boolean") == ["True", "False", ""]


def test_paths(spark):
    assert values(spark, S.norm_path, ["/A//b\\\\C.wav ", "x", ""]) == ["a\\b\\c.wav", "x", ""]
    t = lambda c: S.target_name(c, F.lit("STREAMED"), F.lit("LOOPING"), F.lit(50), F.lit("pc"))
    assert values(spark, t, ["a/b.wav", "a.b/c", "a"]) == ["a\\b.SL50.pc.snd", None, None]
    strip = lambda c: S.strip_roots(c, ["D:/Loc", "d:/shared"], F.lit("English"))
    assert values(spark, strip, ["d:\\loc\\english\\x.wav", "D:/Shared//y.wav", "z.wav"]) == ["x.wav", "y.wav", "z.wav"]
    assert values(spark, S.file_stem, ["a/b.c.wav", "noext", "d\\e.duk", ".x"]) == ["b.c", "noext", "e", ".x"]
    assert values(spark, lambda c: S.scale_level(c, F.lit(0.29).cast("float")), [80], "int") == [23]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aB/\\ .", max_size=12), min_size=1, max_size=8))
def test_norm_path_is_idempotent(spark, data):
    once = values(spark, S.norm_path, data)
    assert values(spark, S.norm_path, once) == once or any(x != x.strip() for x in once)


def test_planes(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0])], "a array<double>, b array<double>, c array<double>")
    r = df.select(S.plane("a", "b", "c").alias("p"), S.plane("a", "a", "a").alias("z")).withColumn("d", S.plane_dist("p", F.array(F.lit(5.0), F.lit(5.0), F.lit(2.0)))).first()
    assert list(r.p[:3]) == [0.0, 0.0, 1.0] and abs(r.p[3]) == 0 and r.d == 2.0 and list(map(abs, r.z)) == [0, 0, 0, 0]


def test_defaults_and_fixups(spark):
    df = S.complete(spark.createDataFrame([("x", 5, "lfe"), ("y", None, None)], "Name string, DistMaxDry int, Pan string"), P.ALIAS)
    rows = {r.Name: r for r in S.apply_fixups(S.apply_defaults(df, P.ALIAS)).collect()}
    assert rows["x"].DistMaxWet == 5 and rows["x"].ReverbSend == 0 and rows["y"].DistMaxWet == 10000 and rows["y"].VolMin == 92
    assert rows["y"].Pauseable is True and rows["y"].LimitType == "PRIORITY" and rows["y"].PriorityThresholdMax == 0.75
    assert len(P.ALIAS) == 103 and sum(c.written for c in P.ALIAS) == 102


@pytest.mark.parametrize("level,mask", [("none", -1), ("low", -4), ("high", -64)])
def test_truncation_floors_negatives(spark, level, mask):
    df = spark.createDataFrame([([-5, 5, 300],)], "s array<int>")
    assert df.select(S.truncate_bits("s", F.lit(level)).alias("t")).first().t == [x & mask for x in (-5, 5, 300)]
