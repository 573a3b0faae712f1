"""Queries of rules, joins, aggregates over tables and manifests, orders and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom.functions import scalars as S
from assetloom.operators import inherit as J
from assetloom.operators import manifest as M
from assetloom.operators import resolve as R
from assetloom.operators import tables as T
from assetloom.operators import validate as V
from assetloom.plans import hashtree as H
from assetloom.queries.registry import Registry, table
from assetloom.sources import files
from assetloom.sources.scratch import scratch

query = Registry()
QUERIES, SQL = query.queries, query.sql


# --- rules ---------------------------------------------------------------------------------------------------------

_MASK = "CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_name || '  ' || upper(p_type) END"


@query(f"SELECT p_partkey FROM part WHERE trim({_MASK}) = '' OR list_contains(list_transform(regexp_split_to_array(trim({_MASK}), '\\s+'), lambda x: lower(x)), 'ring')")
def p1_for_platform(spark, sf):
    p = table(spark, sf, "part").withColumn("mask", F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.concat_ws("  ", "p_name", F.upper("p_type"))))
    return p.filter(V.for_platform("mask", F.lit("RING"))).select("p_partkey")


@query(r"SELECT page_id, regexp_extract(url || CASE page_id % 3 WHEN 0 THEN '.wav' WHEN 1 THEN '.WAV' ELSE '' END, '\.([^./]*)$', 1) IN ('wav','flac','ogg') AS ok FROM pages")
def p2_supported(spark, sf):
    tail = F.when(F.col("page_id") % 3 == 0, ".wav").when(F.col("page_id") % 3 == 1, ".WAV").otherwise("")
    return files.split_path(table(spark, sf, "pages").withColumn("p", F.concat("url", tail)), "p").select("page_id", files.supported("ext").alias("ok"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0 OR o_custkey % 2 <> 0")
def p3_some_spec(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, "a").alias("x"), F.when(F.col("o_custkey") % 2 == 0, " ").otherwise("b").alias("y"), F.lit("").alias("z"))
    return o.filter(~V.all_blank("x", "y", "z")).select("o_orderkey")


@query("SELECT p_partkey AS key, 'p_name has a space' AS rule, p_name AS detail FROM part WHERE instr(p_name, ' ') > 0 UNION ALL SELECT p_partkey, 'p_type has a space', p_type FROM part WHERE instr(p_type, ' ') > 0")
def p4_no_space(spark, sf):
    return V.violations(table(spark, sf, "part"), [V.no_space("p_name"), V.no_space("p_type")], "p_partkey")


@query("""SELECT l_orderkey AS key, 'l_tax above l_discount' AS rule FROM lineitem WHERE l_tax > l_discount
    UNION ALL SELECT l_orderkey, 'l_linenumber above l_quantity' FROM lineitem WHERE l_linenumber > l_quantity""")
def p5_ordered_pairs(spark, sf):
    return V.violations(table(spark, sf, "lineitem"), [V.ordered("l_tax", "l_discount"), V.ordered("l_linenumber", "l_quantity")], "l_orderkey").select("key", "rule")


@query("""SELECT l_orderkey AS key, 'no range of priorities' AS rule, l_quantity::INT::VARCHAR AS detail FROM lineitem
    WHERE l_returnflag IN ('A','N') AND (l_linestatus = 'F' OR l_returnflag = 'N') AND l_quantity = l_partkey % 50""")
def p6_spatial_priority(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_returnflag") == "A", "3d").when(F.col("l_returnflag") == "N", "2.5d").otherwise("2d").alias("PanType"),
        F.when(F.col("l_linestatus") == "F", "PRIORITY").alias("LimitType"),
        F.when(F.col("l_returnflag") == "N", "PRIORITY").otherwise("OLDEST").alias("EntityLimitType"),
        F.col("l_quantity").cast("int").alias("PriorityMin"),
        (F.col("l_partkey") % 50).cast("int").alias("PriorityMax"),
    )
    return V.violations(li, [V.spatial_priority()], "l_orderkey")


@query("SELECT c_custkey AS key, 'Storage missing' AS rule FROM customer WHERE c_nationkey % 5 = 0 UNION ALL SELECT c_custkey, 'Looping missing' FROM customer WHERE c_acctbal < 0")
def p7_required(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 5 != 0, "x").alias("Storage"), F.when(F.col("c_acctbal") >= 0, "y").alias("Looping"))
    return V.violations(c, [V.required("Storage"), V.required("Looping")], "c_custkey").select("key", "rule")


@query("""WITH m AS (SELECT l_orderkey AS key, CASE WHEN l_linenumber = 7 THEN 3 ELSE 1 END AS f, CASE WHEN l_quantity > 40 THEN 24 ELSE 16 END AS b, CASE WHEN l_partkey % 3 = 0 THEN 11025 ELSE 48000 END AS r, l_linenumber AS c, CASE WHEN l_returnflag = 'A' THEN 'pc' ELSE 'x' END AS p FROM lineitem)
    SELECT key, 'format' AS rule FROM m WHERE f = 3 UNION ALL SELECT key, 'bits' FROM m WHERE b <> 16 UNION ALL SELECT key, 'frame rate' FROM m WHERE r = 11025
    UNION ALL SELECT key, 'channels' FROM m WHERE c > 2 OR c < 1 UNION ALL SELECT key, 'platform' FROM m WHERE p <> 'pc'""")
def p8_signal_rules(spark, sf):
    m = table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_linenumber") == 7, 3).otherwise(1).alias("format"),
        F.when(F.col("l_quantity") > 40, 24).otherwise(16).alias("bits"),
        F.when(F.col("l_partkey") % 3 == 0, 11025).otherwise(48000).alias("frame_rate"),
        F.col("l_linenumber").alias("channel_count"),
        F.when(F.col("l_returnflag") == "A", "PC").otherwise("x").alias("platform"),
    )
    return V.violations(m, V.signal_rules(), "l_orderkey").select("key", "rule")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND user_id % 7 = 0")
def p9_trigger_filter(spark, sf):
    return table(spark, sf, "events").filter((F.col("event_type") == "click") & (F.col("user_id") % 7 == 0)).select("event_id")


@query("SELECT p_partkey AS key, 'listed file has a space' AS rule, p_name AS detail FROM part WHERE p_size % 2 = 0 AND instr(p_name, ' ') > 0")
def p10_listed_space(spark, sf):
    p = table(spark, sf, "part").withColumn("dir", F.col("p_size") % 2 == 0)
    return V.violations(p, [V.listed_name_with_space("p_name", "dir")], "p_partkey")


@query("""WITH g AS (SELECT lang, count(*) AS n, sum(n_chars) AS b FROM documents GROUP BY lang)
    SELECT lang, 'entry count' AS rule FROM g WHERE n % 2 = 0 UNION ALL SELECT lang, 'total bytes' FROM g WHERE lang IN ('de', 'fr') UNION ALL SELECT lang, 'offset range' FROM g WHERE lang = 'en'""")
def p12_reconcile(spark, sf):
    m = M.packed_offsets(table(spark, sf, "documents").select("lang", "doc_id", F.col("n_chars").alias("size")), ["lang"], ["doc_id"])
    h = m.groupBy("lang").agg(
        (F.count("*") + F.when(F.count("*") % 2 == 0, 1).otherwise(0)).alias("n_entries"),
        (F.sum("size") + F.when(F.col("lang").isin("de", "fr"), 1).otherwise(0)).cast("long").alias("total_bytes"),
        (F.sum("size") + F.when(F.col("lang") == "en", 0).otherwise(2048)).cast("long").alias("file_bytes"),
    )
    return M.reconcile(h, m, ["lang"])


# --- joins ---------------------------------------------------------------------------------------------------------

@query("""SELECT c.c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END, ' '), CASE WHEN c_custkey % 5 <> 0 THEN n_name END, ' ') AS segment,
    coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, CASE WHEN c_custkey % 5 <> 0 THEN n_regionkey END) AS bal FROM customer c LEFT JOIN nation ON n_nationkey = c_nationkey""")
def j1_inherit(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("Name"), F.col("n_name").alias("segment"), F.col("n_regionkey").cast("double").alias("bal"))
    c = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit(" n"), "c_nationkey")).otherwise("").alias("Template"),
        F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("bal"),
    )
    return J.inherit(c, n, "Template", "Name", ["segment", "bal"]).drop("Template")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0 AND c_nationkey >= 20")
def j1_missing_refs(spark, sf):
    n = table(spark, sf, "nation").filter("n_nationkey < 20").select(F.concat(F.lit("N"), "n_nationkey").alias("Name"))
    c = table(spark, sf, "customer").withColumn("Template", F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("n"), "c_nationkey")))
    return J.missing_refs(c, n, "Template", "Name").select("c_custkey")


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_quantity > 40 THEN l_returnflag END, CASE WHEN p_size > 25 THEN p_brand END, CASE WHEN s_acctbal > 5000 THEN n_name END, r_name) AS layer
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def j2_layered(spark, sf):
    li, p, s, n, r = (table(spark, sf, t) for t in ("lineitem", "part", "supplier", "nation", "region"))
    j = li.join(p, li["l_partkey"] == p["p_partkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).join(J.dimension(n), s["s_nationkey"] == n["n_nationkey"]).join(J.dimension(r), n["n_regionkey"] == r["r_regionkey"])
    layers = [F.when(F.col("l_quantity") > 40, F.col("l_returnflag")), F.when(F.col("p_size") > 25, F.col("p_brand")), F.when(F.col("s_acctbal") > 5000, F.col("n_name")), F.col("r_name")]
    return j.select("l_orderkey", "l_linenumber", J.layered(*layers).alias("layer"))


@query("SELECT c_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 4 <> 0")
def j3_reference_rows(spark, sf):
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit(" REV"), "o_custkey", F.lit(" "))).otherwise("").alias("Reverb"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("rev"), "c_custkey").alias("key"), "c_custkey", "c_name")
    return J.lookup(o, c, "Reverb", "key").drop("key")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def j4_dimension(spark, sf):
    n = J.first_of(table(spark, sf, "nation").unionByName(table(spark, sf, "nation").withColumn("n_name", F.lit("zz"))), "n_nationkey", ["n_name"])
    c = table(spark, sf, "customer")
    return c.join(J.dimension(n), c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", "n_name")


_FILES = """f AS (SELECT p_partkey, p_brand || '/' || p_type || '/' || p_size || '/' || p_partkey || CASE WHEN p_size % 5 = 0 THEN '.txt' ELSE '.wav' END AS rel, p_brand || '/' || p_type || '/' || p_size AS parent, p_size % 5 <> 0 AS ok FROM part),
s AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN p_brand || '/' || p_type || '/' || p_size || '/' || l_partkey || '.wav' ELSE 'Brand#' || (l_partkey % 30) || '/ECONOMY/' || (l_suppkey % 50) END AS spec FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _specs(spark, sf):
    p = table(spark, sf, "part")
    folder = F.concat_ws("/", "p_brand", "p_type", "p_size")
    f = p.select(
        F.concat_ws("/", folder, F.concat(F.col("p_partkey"), F.when(F.col("p_size") % 5 == 0, ".txt").otherwise(".wav"))).alias("rel_path"),
        folder.alias("parent"),
        F.when(F.col("p_size") % 5 == 0, "txt").otherwise("wav").alias("ext"),
    )
    li = table(spark, sf, "lineitem")
    s = li.join(p, li["l_partkey"] == p["p_partkey"]).select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") % 2 == 0, F.concat_ws("/", folder, F.concat("l_partkey", F.lit(".wav")))).otherwise(F.concat(F.lit("Brand#"), F.col("l_partkey") % 30, F.lit("/ECONOMY/"), F.col("l_suppkey") % 50)).alias("spec"),
    )
    return s, f


@query(f"WITH {_FILES} SELECT l_orderkey, l_linenumber, rel AS source FROM s JOIN f ON ok AND spec = rel UNION ALL SELECT l_orderkey, l_linenumber, rel FROM s JOIN f ON ok AND spec = parent")
def j5_resolve_specs(spark, sf):
    s, f = _specs(spark, sf)
    return R.resolve_specs(s, f, grouped=True).select("l_orderkey", "l_linenumber", "source")


@query(f"WITH {_FILES} SELECT l_orderkey, l_linenumber FROM s WHERE spec NOT IN (SELECT rel FROM f WHERE ok) AND spec NOT IN (SELECT parent FROM f WHERE ok)")
def j5_unresolved(spark, sf):
    s, f = _specs(spark, sf)
    return R.unresolved(s, f).select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey AS row_key, 'main' AS slot, l_returnflag AS spec, l_linestatus AS looping FROM lineitem UNION ALL SELECT l_orderkey, 'sustain', l_shipdate::DATE::VARCHAR, 'LOOPING' FROM lineitem WHERE l_linenumber % 2 = 0""")
def j6_unpivot_specs(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("sus", F.when(F.col("l_linenumber") % 2 == 0, F.to_date("l_shipdate").cast("string"))).withColumn("rel", F.lit(" "))
    return R.unpivot_specs(li, "l_orderkey", {"main": "l_returnflag", "sustain": "sus", "release": "rel"}, "l_linestatus")


_DIFF = """d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5(text || 'x') ELSE md5(text) END AS c FROM documents WHERE doc_id % 5 <> 0),
p AS (SELECT doc_id, md5(text) AS c FROM documents WHERE doc_id % 3 <> 0)"""


def _two(spark, sf):
    """Documents before and after: some are new, some gone, some changed."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "text")
    new = d.select("doc_id", "n_chars", F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text")).alias("c")).filter("doc_id % 5 <> 0")
    return new, d.select("doc_id", "n_chars", F.md5("text").alias("c")).filter("doc_id % 3 <> 0")


@query(f"WITH {_DIFF} SELECT coalesce(d.doc_id, p.doc_id) AS doc_id, CASE WHEN p.doc_id IS NULL THEN 'add' WHEN d.doc_id IS NULL THEN 'remove' WHEN d.c = p.c THEN 'keep' ELSE 'change' END AS status FROM d FULL JOIN p ON d.doc_id = p.doc_id")
def j7_diff_manifest(spark, sf):
    return M.diff_manifest(*_two(spark, sf), key="doc_id", checksum="c")


@query(f"WITH {_DIFF} SELECT count(*) FILTER (WHERE p.doc_id IS NULL OR (d.doc_id IS NOT NULL AND d.c <> p.c)) AS n_add, count(*) FILTER (WHERE d.doc_id IS NULL OR (p.doc_id IS NOT NULL AND d.c <> p.c)) AS n_remove FROM d FULL JOIN p ON d.doc_id = p.doc_id")
def j7_diff_summary(spark, sf):
    return M.diff_summary(M.diff_manifest(*_two(spark, sf), key="doc_id", checksum="c"))


@query(f"WITH {_DIFF} SELECT doc_id, c FROM d")
def j7_apply_diff(spark, sf):
    new, old = _two(spark, sf)
    return M.apply_diff(old, M.diff_manifest(new, old, "doc_id", "c"), new, "doc_id").select("doc_id", "c")


def _kept_tree(spark, sf):
    """The new table, and where the old one is kept with its tree."""
    new, old = _two(spark, sf)
    root = scratch(spark, "tree")
    H.commit(old, root, "doc_id", ["c"], depth=2)
    return new, root


@query(f"WITH {_DIFF} SELECT coalesce(d.doc_id, p.doc_id) AS doc_id, CASE WHEN p.doc_id IS NULL THEN 'add' WHEN d.doc_id IS NULL THEN 'remove' ELSE 'change' END AS status FROM d FULL JOIN p ON d.doc_id = p.doc_id WHERE d.c IS DISTINCT FROM p.c")
def j7_diff_tree(spark, sf):
    new, root = _kept_tree(spark, sf)
    return H.diff(new, root, "doc_id", ["c"]).rows


@query(f"WITH {_DIFF} SELECT doc_id, c FROM d")
def j7_commit_tree(spark, sf):
    new, root = _kept_tree(spark, sf)
    H.commit(new, root, "doc_id", ["c"])
    return H.read_entries(spark, root).select("doc_id", "c")


@query("SELECT doc_id, min(o) AS origin FROM (SELECT doc_id, 0 AS o FROM labels UNION ALL SELECT doc_id, 1 FROM documents) GROUP BY doc_id")
def j8_first_wins(spark, sf):
    a = table(spark, sf, "labels").select("doc_id", F.lit(0).alias("origin"))
    return M.first_wins([a, table(spark, sf, "documents").select("doc_id", F.lit(1).alias("origin"))], "doc_id")


@query("SELECT doc_id, max(o) AS origin FROM (SELECT doc_id, 0 AS o FROM documents UNION ALL SELECT doc_id, 1 FROM labels) GROUP BY doc_id")
def j9_last_wins(spark, sf):
    a = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("origin"))
    return M.last_wins([a, table(spark, sf, "labels").select("doc_id", F.lit(1).alias("origin"))], "doc_id")


@query("SELECT doc_id + 7 AS doc_id FROM labels WHERE doc_id + 7 NOT IN (SELECT doc_id FROM documents)")
def j12_absent_removals(spark, sf):
    return M.absent_removals(table(spark, sf, "labels").select((F.col("doc_id") + 7).alias("doc_id")), table(spark, sf, "documents"), "doc_id")


# --- aggregates ----------------------------------------------------------------------------------------------------

@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS total_bytes FROM documents GROUP BY lang")
def a1_total_bytes(spark, sf):
    return M.manifest_totals(table(spark, sf, "documents"), ["lang"], "n_chars")


@query("SELECT count(*) AS n FROM documents")
def a2_asset_count(spark, sf):
    return M.manifest_totals(table(spark, sf, "documents"), size="n_chars").select("n")


@query("SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag <> 'R') AS n_loaded, count(*) FILTER (WHERE l_returnflag = 'R') AS n_streamed FROM lineitem GROUP BY 1")
def a3_storage_counts(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("Storage", F.when(F.col("l_returnflag") == "R", "STREAMED").when(F.col("l_returnflag") == "A", "PRIMED"))
    return M.storage_counts(li, ["l_linestatus"], "Storage")


@query("SELECT lower(p_name) AS key, count(*) AS n, min(p_partkey) AS first_origin, max(p_partkey) AS last_origin FROM part GROUP BY 1 HAVING count(*) > 1")
def a4_duplicate_keys(spark, sf):
    return M.duplicate_keys(table(spark, sf, "part").withColumn("p_name", F.when(F.col("p_size") > 9, F.upper("p_name")).otherwise(F.col("p_name"))), "p_name", "p_partkey")


@query("SELECT md5(text) AS key, count(*) AS n, min(doc_id) AS first_origin, max(doc_id) AS last_origin FROM documents GROUP BY 1 HAVING count(*) > 1")
def a5_duplicate_names(spark, sf):
    return M.duplicate_keys(table(spark, sf, "documents").withColumn("h", F.md5("text")), "h", "doc_id", fold=False)


@query("""WITH a AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS o, struct_pack(a := l_returnflag, b := l_linestatus) AS s FROM lineitem),
    g AS (SELECT l_partkey, min(o) AS first_origin, arg_min(s, o) AS fs, count(DISTINCT s) AS n_settings FROM a GROUP BY 1 HAVING count(DISTINCT s) > 1)
    SELECT l_partkey, n_settings, first_origin, min(o) AS other_origin FROM g JOIN a USING (l_partkey) WHERE s <> fs GROUP BY ALL""")
def a6_target_conflicts(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return R.target_conflicts(li, "l_partkey", ["l_returnflag", "l_linestatus"], "o", "o")


@query("""WITH r AS (SELECT lang, md5(text) AS m, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents),
    c AS (SELECT lang, i // 4096 AS run, md5(string_agg(m, '' ORDER BY i)) AS m FROM r GROUP BY 1, 2)
    SELECT lang, md5(string_agg(m, '' ORDER BY run)) AS checksum FROM c GROUP BY 1""")
def a13_content_checksum(spark, sf):
    return M.content_checksum(table(spark, sf, "documents").select("lang", "doc_id", F.md5("text").alias("m")), ["lang"], "doc_id", "m")


_GAPS = "m AS (SELECT lang, doc_id, n_chars, 2048 + coalesce(sum(n_chars + doc_id % 3) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \"offset\" FROM documents)"


def _spaced(spark, sf):
    """Documents at offsets that leave up to two bytes between entries."""
    d = table(spark, sf, "documents").select("lang", "doc_id", "n_chars", (F.col("n_chars") + F.col("doc_id") % 3).alias("room"))
    return M.packed_offsets(d, ["lang"], ["doc_id"], size="room")


@query(f"WITH {_GAPS}, g AS (SELECT lang, \"offset\" - coalesce(lag(\"offset\" + n_chars) OVER (PARTITION BY lang ORDER BY \"offset\"), 2048) AS gap FROM m) SELECT lang, sum(gap)::BIGINT AS free_space FROM g GROUP BY lang")
def a14_free_space(spark, sf):
    return M.free_space(_spaced(spark, sf), ["lang"], size="n_chars")


@query("""WITH g AS (SELECT lang, sum(n_chars)::BIGINT AS bytes, max(doc_id % 4) AS max_level, max(CASE lang WHEN 'en' THEN 2000000 ELSE 200000 END) AS limit_bytes FROM documents GROUP BY lang)
    SELECT *, (bytes * 100) // limit_bytes AS percent FROM g WHERE (bytes * 100) // limit_bytes >= 85""")
def a16_budget(spark, sf):
    d = table(spark, sf, "documents").withColumns({"level_rank": F.col("doc_id") % 4, "cap": F.when(F.col("lang") == "en", 2000000).otherwise(200000)})
    return M.budget(d, ["lang"], "cap", size="n_chars")


# --- windows and orders --------------------------------------------------------------------------------------------

@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def w1_keep_first(spark, sf):
    return T.keep_first(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT o_custkey, o_orderstatus, min(o_orderpriority || '/' || lpad(o_orderkey::VARCHAR, 12, '0')) AS source FROM orders GROUP BY ALL")
def w2_first_resolved(spark, sf):
    o = table(spark, sf, "orders").withColumn("source", F.concat_ws("/", "o_orderpriority", F.lpad(F.col("o_orderkey").cast("string"), 12, "0")))
    return R.first_resolved(o, "o_custkey", "o_orderstatus", ["source"])


_OFFSETS = "SELECT lang, doc_id, 2048 + coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM documents"


@query(_OFFSETS)
def w3_packed_offsets(spark, sf):
    return M.packed_offsets(table(spark, sf, "documents").select("lang", "doc_id", "n_chars"), ["lang"], ["doc_id"], size="n_chars").select("lang", "doc_id", "offset")


@query(_OFFSETS)
def w3_packed_offsets_two_level(spark, sf):
    return M.packed_offsets(table(spark, sf, "documents").select("lang", "doc_id", "n_chars"), ["lang"], ["doc_id"], size="n_chars", task_rows=100).select("lang", "doc_id", "offset")


@query("SELECT doc_id FROM (SELECT doc_id, n_chars, lag(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) AS p FROM documents) WHERE n_chars < p")
def w4_check_monotonic(spark, sf):
    return M.check_monotonic(table(spark, sf, "documents").select("lang", "doc_id", "n_chars"), ["lang"], ["doc_id"], "n_chars").select("doc_id")


@query(f"WITH {_GAPS} SELECT doc_id, (\"offset\" - coalesce(lag(\"offset\" + n_chars) OVER (PARTITION BY lang ORDER BY \"offset\"), 2048))::BIGINT AS gap FROM m")
def w5_gaps(spark, sf):
    return M.gaps(_spaced(spark, sf), ["lang"], size="n_chars").select("doc_id", F.col("gap").cast("long").alias("gap"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY coalesce(CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END, ''), o_orderpriority, o_orderkey) AS position FROM orders")
def o1_alias_order(spark, sf):
    o = table(spark, sf, "orders").withColumn("st", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")))
    return T.positions(o, ["st", "o_orderpriority"], ["o_orderkey"]).select("o_orderkey", "position")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_name DESC) AS position FROM nation")
def o2_descending(spark, sf):
    return T.positions(table(spark, sf, "nation"), ["n_name"], descending=True).select("n_nationkey", "position")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_name) AS position FROM customer")
def o3_by_id_and_alias(spark, sf):
    return T.positions(table(spark, sf, "customer"), ["c_mktsegment", "c_name"]).select("c_custkey", "position")


@query("SELECT page_id, row_number() OVER (PARTITION BY page_id % 10 ORDER BY url, page_id) AS position FROM pages")
def o4_listed_order(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", (F.col("page_id") % 10).alias("dir"))
    return T.positions(p, ["url"], ["page_id"], within=["dir"]).select("page_id", "position")


@query("SELECT 'l' AS source_tag, l_orderkey AS key, l_quantity AS q FROM lineitem UNION ALL SELECT 'o', o_orderkey, NULL FROM orders")
def u1_union_sources(spark, sf):
    from assetloom.sources.tables import union_sources

    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("q"))
    return union_sources(("l", li), ("o", table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))))


@query("SELECT DISTINCT x AS \"Name\" FROM (SELECT trim(p_name) AS x FROM part UNION ALL SELECT trim(c_mktsegment) FROM customer UNION ALL SELECT o_orderstatus FROM orders) WHERE x <> '' AND x <> 'F'")
def u2_distinct_names(spark, sf):
    p, c, o = table(spark, sf, "part"), table(spark, sf, "customer"), table(spark, sf, "orders")
    names = [(p, F.concat(F.lit(" "), "p_name")), (c, F.col("c_mktsegment")), (o, F.when(F.col("o_orderstatus") == "F", "default").otherwise(F.col("o_orderstatus"))), (c, F.lit(" "))]
    return T.distinct_names(*names)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u3_orphans(spark, sf):
    return M.orphans(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query(f"WITH {_DIFF} SELECT doc_id, c FROM d INTERSECT SELECT doc_id, c FROM p")
def u4_unchanged(spark, sf):
    return M.unchanged(*_two(spark, sf), "doc_id", "c")


@query("SELECT CASE WHEN l_returnflag = 'R' THEN 'streamed' ELSE 'loaded' END AS storage_class, count(*) AS n FROM lineitem GROUP BY 1")
def u5_split_storage(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("Storage", F.when(F.col("l_returnflag") == "R", "STREAMED").when(F.col("l_returnflag") == "A", "PRIMED"))
    return li.groupBy(T.split_storage("Storage").alias("storage_class")).agg(F.count("*").alias("n"))


# --- the flagship: customers as an alias table compiled from layered templates --------------------------------------

@query("""WITH c AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS vmin0, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 30 END AS vmax0, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS tpl FROM customer),
    i AS (SELECT c.*, coalesce(vmin0, n_regionkey * 10, 92) AS vmin, coalesce(vmax0, 92) AS vmax FROM c LEFT JOIN nation ON n_nationkey = tpl),
    v AS (SELECT * FROM i WHERE vmin <= vmax),
    k AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY c_mktsegment, vmin, vmax ORDER BY c_custkey) = 1)
    SELECT c_mktsegment AS segment, count(*) AS n, sum(vmin)::BIGINT AS total_bytes FROM k GROUP BY 1""")
def flagship_compile(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("t"), "n_nationkey").alias("Name"), (F.col("n_regionkey") * 10).alias("VolMin"))
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(
        "c_custkey",
        F.col("c_mktsegment").alias("segment"),
        F.when(k % 5 != 0, F.concat(F.lit("T"), "c_nationkey")).alias("Template"),
        F.when(k % 4 != 0, F.col("c_nationkey")).alias("VolMin"),
        F.when(k % 6 != 0, F.lit(30)).alias("VolMax"),
    )
    from assetloom.functions.spec import ALIAS

    c = S.apply_defaults(J.inherit(c, n, "Template", "Name", ["VolMin"]), ALIAS)
    c = V.accepted(c, [V.ordered("VolMin", "VolMax")])
    c = T.keep_first(c, ["segment", "VolMin", "VolMax"], ["c_custkey"])
    return M.manifest_totals(c, ["segment"], "VolMin")
