"""Checksums of content and recipe in manifests, against hashlib."""

import hashlib
from dataclasses import replace

from pyspark.sql import functions as F

from assetloom.functions import scalars as S
from assetloom.plans import incremental, jobs


def md5(data: bytes) -> str:
    return hashlib.md5(data).hexdigest().upper()


def test_checksums_of_all_levels_from_one_read(spark, tmp_path):
    data = {"a.wav": b"a", "empty.wav": b"", "b.wav": b"\x00\xff\xfe" * 5, "c.wav": "é".encode()}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    rows = incremental.hashed_files(incremental.listing(spark, str(tmp_path)), recipes=True).collect()
    assert {r.path.rsplit("/", 1)[1] for r in rows} == {"a.wav", "b.wav", "c.wav"}  # an empty file holds no asset
    for r in rows:
        content = data[r.path.rsplit("/", 1)[1]]
        assert r.source_checksum == md5(content)
        assert r[jobs.RECIPES].asDict() == {k: md5(content + S.recipe(k)) for k in S.LEVEL_RANK}
    none = incremental.hashed_files(incremental.listing(spark, str(tmp_path)).filter("false"), recipes=True)
    assert none.count() == 0 and none.columns == ["path", "source_checksum", jobs.RECIPES]


def test_checksum_of_a_level(spark):
    levels = ["LOW", "none", "odd", "", None]
    df = spark.createDataFrame([(x,) for x in levels], "level string").withColumn("c", S.recipe_checksums(F.lit("x")))
    got = {r.level: r.at for r in df.select("level", S.checksum_at("c", "level").alias("at")).collect()}
    assert got == {"LOW": md5(b"x" + S.recipe("low")), "none": md5(b"x" + S.recipe("none")), "odd": None, "": None, None: None}
    empty = df.select(S.checksum_at(F.lit(None).cast(df.schema["c"].dataType), F.lit("low")).alias("at")).first()
    assert empty.at is None


def test_built_manifest_has_them(spark):
    from assetloom.queries.signals import _written_inputs

    requests, inputs, root = _written_inputs(spark, "/root/testdata/sf0.001")
    plain = inputs()
    made = lambda assets: plain.hashed(assets).withColumn(jobs.RECIPES, S.recipe_checksums("source_checksum"))
    done = incremental.build(requests, replace(plain, hashed=made), f"{root}/recipes")
    known = {md5(r[0].encode() + S.recipe(k)) for r in plain.hashed(plain.assets).select("source_checksum").collect() for k in S.LEVEL_RANK}
    got = [r[0] for r in done.manifest.select("source_checksum").collect()]
    assert got and set(got) <= known
