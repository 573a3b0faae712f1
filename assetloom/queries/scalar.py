"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom.functions import scalars as S
from assetloom.functions.spec import ALIAS, DOMAINS, ColumnSpec
from assetloom.queries.registry import LEVEL_OF_KEY, SIG, Registry, level_of, signals, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_STATUS = "CASE o_orderstatus WHEN 'F' THEN ' Yes' WHEN 'O' THEN 'FALSE' ELSE '' END"


@query(f"""SELECT o_orderkey, CASE lower(trim({_STATUS})) WHEN 'yes' THEN true WHEN 'false' THEN false END AS flag,
    CASE lower(trim({_STATUS})) WHEN 'yes' THEN true ELSE false END AS strict_flag FROM orders""")
def f1_parse_bool(spark, sf):
    o = table(spark, sf, "orders").withColumn("t", F.expr(_STATUS))
    return o.select("o_orderkey", S.parse_bool("t").alias("flag"), S.parse_bool("t", blank=False).alias("strict_flag"))


_NUM = "CASE l_linenumber % 5 WHEN 0 THEN '' WHEN 1 THEN cast(cast(l_quantity as int) as varchar(20)) WHEN 2 THEN '-' || cast(cast(floor(l_extendedprice) as bigint) as varchar(20)) || '.75' WHEN 3 THEN '3e10' ELSE ' x1' END"


@query(f"""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 1 THEN l_quantity::INT WHEN 2 THEN -floor(l_extendedprice)::INT WHEN 3 THEN 2147483647 END AS n,
    CASE l_linenumber % 5 WHEN 4 THEN true ELSE false END AS bad FROM lineitem""")
def f2_parse_num(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("t", F.expr(_NUM))
    return li.select("l_orderkey", "l_linenumber", S.parse_num("t").alias("n"), S.bad_num("t").alias("bad"))


@query("""SELECT event_id, CASE WHEN upper(event_type) IN ('CLICK','VIEW') THEN upper(event_type) END AS kind, upper(event_type) NOT IN ('CLICK','VIEW') AS unknown FROM events""")
def f3_parse_enum(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", S.parse_enum("event_type", ["CLICK", "VIEW"]).alias("kind"), S.bad_enum("event_type", ["CLICK", "VIEW"]).alias("unknown"))


_PRIO = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Default' WHEN '2' THEN 'no' WHEN '3' THEN ' HIGH' WHEN '4' THEN 'huge' ELSE 'low' END"


@query("""SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN 'none' WHEN '3' THEN 'high' WHEN '1' THEN NULL WHEN '4' THEN NULL ELSE 'low' END AS level,
    CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN 0 WHEN '3' THEN 3 WHEN '1' THEN NULL WHEN '4' THEN NULL ELSE 1 END AS level_rank, substr(o_orderpriority, 1, 1) = '4' AS bad FROM orders""")
def f4_parse_level(spark, sf):
    o = table(spark, sf, "orders").withColumn("t", F.expr(_PRIO))
    return o.select("o_orderkey", S.parse_level("t").alias("level"), S.level_rank(S.parse_level("t")).alias("level_rank"), S.bad_level("t").alias("bad"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'default' ELSE p_name END AS name FROM part")
def f5_blank_as(spark, sf):
    p = table(spark, sf, "part").withColumn("t", F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.col("p_name")))
    return p.select("p_partkey", S.blank_as("t", "default").alias("name"))


@query(r"""SELECT page_id, ltrim(regexp_replace(replace(translate(trim(url), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '/', '\'), '\\+', '\\', 'g'), '\') AS path FROM pages""")
def f6_norm_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.norm_path("url").alias("path"))


def _hash(c):
    return f"""(SELECT CASE WHEN h = 0 THEN 1 ELSE h END FROM (SELECT list_reduce(list_prepend(5381::BIGINT, list_transform(range(length({c})), lambda i: ascii(substr(
        translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), i::INT + 1, 1))::BIGINT)), lambda a, x: (a * 65599 + x) % 4294967296) AS h))"""


@query(f"SELECT p_partkey, {_hash('p_name')} AS h FROM part")
def f7_name_hash(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.name_hash("p_name").alias("h"))


@query("SELECT doc_id, upper(md5(text)) AS md5 FROM documents")
def f8_content_md5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.content_md5("text").alias("md5"))


_TAGS = ", ".join(f"'{k}': '{S.recipe(k).hex()}'" for k in S.LEVEL_RANK)


@query("SELECT doc_id, upper(md5(text || ':' || n_chars)) AS checksum FROM documents")
def f9_recipe_text(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", S.content_md5(F.concat_ws(":", "text", F.col("n_chars").cast("string"))).alias("checksum"))


@query(f"""SELECT doc_id, upper(md5(encode(text) || unhex(map_extract_value(MAP {{{_TAGS}}}, ['none','low','medium','high','extreme'][(doc_id % 5)::INT + 1])))) AS checksum FROM documents""")
def f9_recipe_md5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.recipe_md5("text", level_of("doc_id")).alias("checksum"))


@query("SELECT doc_id, (n_chars || ' ' || upper(md5(text))) AS id FROM documents")
def f10_asset_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.asset_id("n_chars", F.md5("text")).alias("id"))


@query("""SELECT l_orderkey, l_linenumber, floor(((l_quantity::FLOAT * floor((100::FLOAT * (1 - l_tax)::FLOAT)::FLOAT)::FLOAT)::FLOAT / 100::FLOAT)::FLOAT)::INT AS scaled FROM lineitem""")
def f11_scale_level(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.scale_level("l_quantity", 1 - F.col("l_tax")).alias("scaled"))


_SPEC = "'shared/' || o_orderkey || '/' || o_orderpriority || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '.wav' END"


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN replace('shared/' || o_orderkey || '/' || o_orderpriority, '/', '\\') || '.'
    || CASE o_orderkey % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'S' ELSE 'P' END || CASE WHEN o_orderkey % 2 = 0 THEN 'L' ELSE 'N' END || (o_custkey % 101) || '.pc.snd' END AS target FROM orders""")
def f12_target_name(spark, sf):
    o = table(spark, sf, "orders").withColumn("spec", F.expr(_SPEC))
    storage = F.when(F.col("o_orderkey") % 3 == 0, "LOADED").when(F.col("o_orderkey") % 3 == 1, "STREAMED").otherwise("PRIMED")
    looping = F.when(F.col("o_orderkey") % 2 == 0, "LOOPING").otherwise("NONLOOPING")
    return o.select("o_orderkey", S.target_name("spec", storage, looping, F.col("o_custkey") % 101, F.lit("pc")).alias("target"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^(?i)https://m\\.', ''), '^(?i)http://', ''), '^/+', ''), '^(?i)' || split_part(split_part(url, '//', 2), '/', 1) || '/', ''), '^/+', '') AS rel FROM pages""")
def f13_strip_roots(spark, sf):
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    return table(spark, sf, "pages").select("page_id", S.strip_roots("url", ["HTTPS://m.", "http://"], host).alias("rel"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(n, '^.+\.[^.]*$') THEN regexp_extract(n, '^(.+)\.[^.]*$', 1) ELSE n END AS stem
    FROM (SELECT page_id, regexp_extract(url, '([^/\\]*)[/\\]*$', 1) AS n FROM pages)""")
def f14_file_stem(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.file_stem("url").alias("stem"))


@query("SELECT event_id, round(pow(10, value / 20000), 6) AS linear FROM events")
def f15_db_to_linear(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(S.db_to_linear(F.col("value") / 1000), 6).alias("linear"))


_PEAK = f"WITH {SIG}, p AS (SELECT vec_id, list_max(list_transform(samples, lambda x: abs(x))) / 32768.0 * (vec_id % 2) AS v FROM sig)"


def _peaks(spark, sf):
    s = signals(spark, sf)
    return s.select("vec_id", (F.array_max(F.transform("samples", F.abs)) / 32768.0 * (F.col("vec_id") % 2)).alias("v"))


@query(f"{_PEAK} SELECT vec_id, CASE WHEN v < 1e-4 THEN -80.0 ELSE round(20 * log10(v), 6) END AS db FROM p")
def f16_linear_to_db(spark, sf):
    return _peaks(spark, sf).select("vec_id", F.round(S.linear_to_db("v"), 6).alias("db"))


@query(f"{_PEAK} SELECT vec_id, CASE WHEN v < 1e-4 THEN 0.0 ELSE round(20 * log10(v) + 100, 6) END AS spl FROM p")
def f17_linear_to_spl(spark, sf):
    return _peaks(spark, sf).select("vec_id", F.round(S.linear_to_spl("v"), 6).alias("spl"))


@query("""SELECT p_partkey, CASE WHEN p_size % 10 = 9 THEN 255 ELSE p_size % 10 END AS idx, CASE WHEN p_size % 10 = 9 THEN 0 ELSE [8000,12000,16000,24000,32000,44100,48000,96000,192000][p_size % 10 + 1] END AS rate FROM part""")
def f18_rates(spark, sf):
    p = table(spark, sf, "part").withColumn("i", F.col("p_size") % 10)
    p = p.withColumn("r", F.element_at(F.array(*[F.lit(x) for x in [*S.RATES, 11025]]), F.col("i") + 1))
    return p.select("p_partkey", S.rate_index("r").alias("idx"), S.index_rate("i").alias("rate"))


@query("SELECT doc_id, CASE toxic WHEN 1 THEN 'True' WHEN 0 THEN 'False' ELSE '' END AS flag FROM labels")
def f19_fmt_bool(spark, sf):
    return table(spark, sf, "labels").select("doc_id", S.fmt_bool(F.col("toxic") == 1).alias("flag"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN (round(s_acctbal) * 10000)::BIGINT::VARCHAR WHEN s_suppkey % 4 = 1 THEN ''
    ELSE rtrim(rtrim(round(s_acctbal, 2)::DECIMAL(20,2)::VARCHAR, '0'), '.') END AS t FROM supplier""")
def f20_fmt_num(spark, sf):
    s = table(spark, sf, "supplier")
    v = F.when(F.col("s_suppkey") % 4 == 0, F.round("s_acctbal") * 10000).when(F.col("s_suppkey") % 4 > 1, F.round("s_acctbal", 2))
    return s.select("s_suppkey", S.fmt_num(v).alias("t"))


_MASK = "CASE {} WHEN 'none' THEN -1 WHEN 'low' THEN -4 WHEN 'medium' THEN -16 WHEN 'high' THEN -64 ELSE -256 END"


@query(f"""WITH {SIG}, m AS (SELECT *, {_MASK.format(LEVEL_OF_KEY)} AS m FROM sig)
    SELECT vec_id, i, s & m AS s FROM (SELECT vec_id, unnest(range(len(samples))) AS i, unnest(samples) AS s, m FROM m)""")
def f21_truncate_bits(spark, sf):
    s = signals(spark, sf).withColumn("level", level_of("vec_id"))
    return s.select("vec_id", F.posexplode(S.truncate_bits("samples", "level")).alias("i", "s")).withColumn("i", F.col("i").cast("long"))


@query(f"SELECT vec_id, CASE {LEVEL_OF_KEY} WHEN 'low' THEN 128 WHEN 'medium' THEN 256 WHEN 'high' THEN 256 WHEN 'extreme' THEN 1024 END AS gate FROM embeddings")
def f22_gate_threshold(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", S.gate_threshold(level_of("vec_id")).alias("gate"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey * 48000) // 44100 AS frames FROM lineitem")
def f23_resampled_frames(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.resampled_frames("l_partkey", F.lit(44100)).alias("frames"))


@query("""SELECT event_id, greatest(least(trunc(value), 255), 0)::INT AS level, greatest(least(trunc(65535 * (value / 500)), 65535), 0)::INT AS time FROM events""")
def f24_quantise(spark, sf):
    return table(spark, sf, "events").select("event_id", S.quantise_level("value").alias("level"), S.quantise_time(F.col("value") / 500).alias("time"))


def points(spark, sf):
    """Three points of each vector, in whole numbers so that both engines round alike."""
    e = table(spark, sf, "embeddings").withColumn("q", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("double")))
    return e.select("vec_id", "q", *[F.slice("q", 3 * i + 1, 3).alias(f"p{i}") for i in range(3)])


#: The plane as SQL: cross product, length, normal and distance.
PLANE = """q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 100)) AS q FROM embeddings),
c AS (SELECT vec_id, q, q[1] AS x0, q[2] AS y0, q[3] AS z0, q[4]-q[1] AS ax, q[5]-q[2] AS ay, q[6]-q[3] AS az, q[7]-q[1] AS bx, q[8]-q[2] AS byy, q[9]-q[3] AS bz FROM q),
n AS (SELECT *, ay*bz-az*byy AS nx, az*bx-ax*bz AS ny, ax*byy-ay*bx AS nz FROM c),
pl AS (SELECT *, CASE WHEN nx=0 AND ny=0 AND nz=0 THEN 1 ELSE sqrt(nx*nx+ny*ny+nz*nz) END AS len FROM n),
plane AS (SELECT vec_id, q, nx/len AS a, ny/len AS b, nz/len AS c, -((nx/len)*x0+(ny/len)*y0+(nz/len)*z0) AS d FROM pl)"""


@query(f"WITH {PLANE} SELECT vec_id, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(d, 6) AS d FROM plane")
def f27_plane(spark, sf):
    p = points(spark, sf).withColumn("pl", S.plane("p0", "p1", "p2"))
    return p.select("vec_id", *[F.round(F.col("pl")[i], 6).alias(n) for i, n in enumerate("abcd")])


@query(f"WITH {PLANE} SELECT vec_id, round(a*q[10]+b*q[11]+c*q[12]+d, 5) AS dist FROM plane")
def f28_plane_dist(spark, sf):
    p = points(spark, sf).withColumn("pl", S.plane("p0", "p1", "p2"))
    return p.select("vec_id", F.round(S.plane_dist("pl", F.slice("q", 10, 3)), 5).alias("dist"))


@query("""WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 100)) AS q FROM embeddings),
    d AS (SELECT *, (q[2]*q[7]-q[3]*q[6])*q[9]+(q[3]*q[5]-q[1]*q[7])*q[10]+(q[1]*q[6]-q[2]*q[5])*q[11] AS det FROM q)
    SELECT vec_id, CASE WHEN abs(det) >= 1e-6 THEN round((-q[4]*(q[6]*q[11]-q[7]*q[10]) - q[8]*(q[10]*q[3]-q[11]*q[2]) - q[12]*(q[2]*q[7]-q[3]*q[6]))/det, 4) END AS x FROM d""")
def f29_intersect3(spark, sf):
    p = points(spark, sf).withColumn("at", S.intersect3(F.slice("q", 1, 4), F.slice("q", 5, 4), F.slice("q", 9, 4)))
    return p.select("vec_id", F.round(F.col("at")[0], 4).alias("x"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN true ELSE epoch(date_trunc('second', ts))::BIGINT > epoch(date_trunc('second', ts))::BIGINT + (event_id % 5)::BIGINT - 3 + 1 END AS stale FROM events""")
def f30_is_stale(spark, sf):
    e = table(spark, sf, "events")
    stored = F.when(F.col("event_id") % 4 != 0, F.unix_timestamp("ts") + F.col("event_id") % 5 - 3)
    return e.select("event_id", S.is_stale("ts", stored).alias("stale"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 92 ELSE c_nationkey END AS "VolMin", CASE WHEN c_custkey % 2 = 0 THEN 10000 ELSE 7 END AS "DistMaxDry",
    CASE WHEN c_custkey % 5 = 0 THEN 'lfe' ELSE 'default' END AS "Pan", CASE WHEN c_custkey % 2 = 0 THEN 10000 ELSE 7 END AS "DistMaxWet", CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 4 END AS "ReverbSend" FROM customer""")
def f31_apply_defaults(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("VolMin"),
        F.when(F.col("c_custkey") % 2 != 0, F.lit(7)).alias("DistMaxDry"),
        F.when(F.col("c_custkey") % 5 == 0, "lfe").alias("Pan"),
        F.lit(None).cast("int").alias("DistMaxWet"),
        F.lit(4).alias("ReverbSend"),
    )
    return S.apply_fixups(S.apply_defaults(c, ALIAS))


@query("SELECT o_orderkey, NULL::VARCHAR AS o_orderpriority, NULL::BIGINT AS o_custkey FROM orders")
def f32_clear(spark, sf):
    return S.clear(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_custkey"), ["o_orderpriority", "o_custkey"])


KINDS = {c.name: c for c in ALIAS}
assert set(DOMAINS) <= {c.kind for c in ALIAS} and isinstance(ALIAS[0], ColumnSpec)
