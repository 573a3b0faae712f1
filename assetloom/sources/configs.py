"""Nested configuration files in relaxed JSON: comments, bare names, single quotes and trailing commas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JSON5 = {"allowComments": "true", "allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "mode": "PERMISSIVE"}
# The shapes of the configs.
ZONE = (
    "Name string, Parent string, IsStandalone boolean, IsShipped boolean, NoStreamBank boolean, OptimizePoint boolean, MapFile string, "
    "Sources array<struct<Type:string,Name:string,Filename:string,Specs:array<string>,DefaultAudioCompression:string>>, Ducks array<string>, "
    "MusicFiles array<string>, DefaultAudioCompression string"
)
DUCK = (
    "Name string, DefaultAllOn boolean, FadeIn float, FadeInCurve string, FadeOut float, FadeOutCurve string, Distance int, Length float, "
    "StartDelay float, UpdateWhilePaused boolean, TrackAmplitude boolean, DuckAlias string, DuckAliasLpf int, DuckAliasAttenuation int, "
    "DisableInSplitScreen boolean, Values array<struct<Name:string,DuckGroup:string,UseDefaultValue:boolean,Lpf:int,Attenuation:int>>"
)
_ASSET = (
    "struct<SourceWaveName:string,TargetWaveName:string,AliasName:string,Volume:string,BPM:int,AssetType:int,Looping:boolean,LoopNumber:int,"
    "LoopStartOffset:bigint,CompleteLoop:boolean,RemoveAfterPlay:boolean,PlayAsFirstRandom:boolean,`Order`:int,Channels:int,CompleteOnStop:boolean,"
    "StartSync:boolean,StartSyncBeats:int,StartDelayBeats:int,StartFadeBeats:int,StopSync:boolean,StopSyncBeats:int,StopDelayBeats:int,"
    "StopFadeBeats:int,StartOffsetFrames:int,Meter:int,Template:string,ParentStateName:string>"
)
MUSIC = (
    f"Name string, StateArray array<struct<Name:string,IntroAsset:{_ASSET},ExitAsset:{_ASSET},LoopAssets:array<{_ASSET}>,LoopIndex:int,"
    "IsRandom:boolean,IsSequential:boolean,SkipPreviousExit:boolean,`Order`:int>>, StateNames array<string>, LoopIndex int, FileName string"
)
_TEXT = r"""("(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+')"""
#: Comments, then trailing commas, which make Spark give up the field; strings are matched first, so what is in them stays.
_COMMENT = _TEXT + r"|//[^\r\n]*+|/\*(?s:.*?)\*/"
_TRAILING = _TEXT + r"|,(?=\s*[}\]])"


def from_json5(text: Column, schema: str) -> Column:
    return F.from_json(F.regexp_replace(F.regexp_replace(text, _COMMENT, "$1"), _TRAILING, "$1"), schema, JSON5)


def _read(spark: SparkSession, paths, schema: str) -> DataFrame:
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return text.select("file", from_json5(F.col("value"), schema).alias("v")).select("file", "v.*")


def own_parent_cleared(parent: Column, name: Column) -> Column:
    return F.when(parent == name, "").otherwise(parent)


def read_config(spark: SparkSession, paths) -> DataFrame:
    """Zone configs; a zone that names itself as parent has none. A file that can't be parsed has NULL columns."""
    return _read(spark, paths, ZONE).withColumn("Parent", own_parent_cleared(F.col("Parent"), F.col("Name")))


def read_ducks(spark: SparkSession, paths) -> DataFrame:
    """Ducks, one row per value (one with NULLs if it has none); DefaultAllOn is true where it is absent."""
    d = _read(spark, paths, DUCK).withColumn("DefaultAllOn", F.coalesce("DefaultAllOn", F.lit(True)))
    flat = d.withColumn("value", F.explode_outer("Values")).drop("Values")
    return flat.select(*[c for c in flat.columns if c != "value"], *[F.col(f"value.{c}").alias(f"Value{c}") for c in ("Name", "DuckGroup", "UseDefaultValue", "Lpf", "Attenuation")])


def read_music(spark: SparkSession, paths) -> DataFrame:
    """Music sets, one row per asset: set, place and name of the state, the asset's role and place, and its fields."""
    s = _read(spark, paths, MUSIC).select("file", F.col("Name").alias("Set"), F.posexplode("StateArray").alias("StateNo", "state"))
    role = F.concat(
        F.array(F.struct(F.lit("intro").alias("Role"), F.col("state.IntroAsset").alias("asset"))),
        F.coalesce(F.transform("state.LoopAssets", lambda a: F.struct(F.lit("loop").alias("Role"), a.alias("asset"))), F.array()),
        F.array(F.struct(F.lit("exit").alias("Role"), F.col("state.ExitAsset").alias("asset"))),
    )
    flat = s.select("file", "Set", "StateNo", F.col("state.Name").alias("State"), F.posexplode(F.filter(role, lambda x: x["asset"].isNotNull())).alias("AssetNo", "x"))
    return flat.select("file", "Set", "StateNo", "State", "AssetNo", "x.Role", "x.asset.*")
