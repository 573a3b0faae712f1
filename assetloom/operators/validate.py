"""Rules whose violations are rows; strict mode raises on the first of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.functions.scalars import RATES
from assetloom.functions.spec import ORDERED_PAIRS


@dataclass
class Rule:
    name: str
    bad: Column
    detail: Column


def violations(df: DataFrame, rules: Sequence[Rule], key: str) -> DataFrame:
    """(key, rule, detail), one row for each rule that a row breaks; all rules in one pass. A NULL verdict passes."""
    bad = df.select(F.col(key).alias("key"), F.explode(broken(rules)).alias("v"))
    return bad.select("key", "v.rule", "v.detail")


def broken(rules: Sequence[Rule]) -> Column:
    """The rules that a row breaks, as an array of structs with rule and detail."""
    found = F.array(
        *[F.struct(F.coalesce(r.bad, F.lit(False)).alias("bad"), F.lit(r.name).alias("rule"), r.detail.cast("string").alias("detail")) for r in rules]
    )
    return F.filter(found, lambda x: x["bad"])


def strict(df: DataFrame, rules: Sequence[Rule], key: str, shown: int = 10) -> DataFrame:
    """``df``, or an error that names the first violations by key and rule."""
    bad = violations(df, rules, key).orderBy("key", "rule").limit(shown).collect()
    if bad:
        raise ValueError("; ".join(f"{r['key']}: {r['rule']} ({r['detail']})" for r in bad))
    return df


def accepted(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that break no rule."""
    return df.filter(~breaks(rules))


def breaks(rules: Sequence[Rule]) -> Column:
    """Whether a row breaks any rule."""
    return reduce(lambda a, b: a | b, [F.coalesce(r.bad, F.lit(False)) for r in rules])


def for_platform(mask: str, name: Column | str) -> Column:
    """A blank mask is for all platforms, else one of its words is the platform's name in any case."""
    name = F.col(name) if isinstance(name, str) else name
    m = F.coalesce(F.trim(mask), F.lit(""))
    return (m == "") | F.exists(F.split(m, r"\s+"), lambda x: F.lower(x) == F.lower(name))


def all_blank(*cols: str) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.trim(c), F.lit("")) == "" for c in cols])


def no_space(col: str) -> Rule:
    return Rule(f"{col} has a space", F.instr(col, " ") > 0, F.col(col))


def ordered(low: str, high: str) -> Rule:
    return Rule(f"{low} above {high}", F.col(low) > F.col(high), F.concat_ws(" > ", F.col(low).cast("string"), F.col(high).cast("string")))


def spatial_priority(pan: str = "PanType", limits: Sequence[str] = ("LimitType", "EntityLimitType"), low: str = "PriorityMin", high: str = "PriorityMax") -> Rule:
    """A sound placed in space and limited by priority needs a range of priorities."""
    limited = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) == "PRIORITY", F.lit(False)) for c in limits])
    return Rule("no range of priorities", F.col(pan).isin("3d", "2.5d") & limited & F.col(low).eqNullSafe(F.col(high)), F.col(low))


def required(col: str) -> Rule:
    return Rule(f"{col} missing", F.col(col).isNull(), F.lit(None).cast("string"))


def alias_rules() -> list[Rule]:
    return [*map(no_space, ("Name", "FileSpec", "Subtitle")), *[ordered(a, b) for a, b in ORDERED_PAIRS], spatial_priority()]


def signal_rules(kind: str = "format", bits: str = "bits", rate: str = "frame_rate", channels: str = "channel_count", platform: str = "platform") -> list[Rule]:
    """What the signal jobs accept: 16-bit PCM, one of nine rates, one or two channels, platform pc."""
    return [
        Rule("format", ~F.col(kind).isin(1, 65534), F.col(kind)),
        Rule("bits", F.col(bits) != 16, F.col(bits)),
        Rule("frame rate", ~F.col(rate).isin(RATES), F.col(rate)),
        Rule("channels", ~F.col(channels).between(1, 2), F.col(channels)),
        Rule("platform", F.lower(platform) != "pc", F.col(platform)),
    ]


def listed_name_with_space(name: str, from_directory: str) -> Rule:
    return Rule("listed file has a space", F.col(from_directory) & (F.instr(name, " ") > 0), F.col(name))
