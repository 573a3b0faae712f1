"""Queries of the readers and writers: tables of the driver written in loose formats and read back, or parsed in place."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom.functions import scalars as S
from assetloom.functions.spec import ColumnSpec as C
from assetloom.operators import manifest as M
from assetloom.operators.tables import keep_last_by
from assetloom.plans import jobs
from assetloom.queries.registry import LONG, Registry, signals, table
from assetloom.sources import configs, files, ranges, sinks, snapshots
from assetloom.sources import tables as tab
from assetloom.sources.scratch import scratch

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _csv(df, what):
    path = scratch(df.sparkSession, what)
    df.write.options(header=True, escape='"').csv(path)
    return path


@query("SELECT r_regionkey, r_name FROM region")
def s1_read_table(spark, sf):
    path = _csv(table(spark, sf, "region"), "region")
    return tab.read_table(spark, tab.list_paths(spark, path, "*.csv", False), [C("r_regionkey", "int"), C("r_name")]).drop(*tab.ORDER)


@query("""SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS nation, c_mktsegment AS segment FROM customer
    WHERE c_custkey % 5 NOT IN (1, 2) AND c_custkey % 7 <> 3""")
def s2_read_table_relaxed(spark, sf):
    k = F.col("c_custkey")
    first = F.when(k % 5 == 1, "  ").when(k % 5 == 2, "\t# comment").when(k % 7 == 3, "#off").otherwise(F.concat(F.lit(" c"), k.cast("string"), F.lit(" ")))
    c = table(spark, sf, "customer")
    # two kinds of files with other headers: columns in another order, an unknown one, one missing
    a, b = scratch(spark, "relaxed-a"), scratch(spark, "relaxed-b")
    half = c.select((F.xxhash64("c_custkey") % 2 == 0).alias("h"), first.alias("id"), F.when(k % 4 != 0, F.concat(F.lit(" "), "c_nationkey")).alias("nation"), F.col("c_mktsegment").alias("segment"))
    half.filter("h").select("id", "nation", "segment").write.options(header=True, escape='"').csv(a)
    half.filter("not h").select("id", "segment", F.lit("x").alias("other"), "nation").write.options(header=True, escape='"').csv(b)
    paths = tab.list_paths(spark, a, "*.csv", False) + tab.list_paths(spark, b, "*.csv", False)
    return tab.read_table_relaxed(spark, paths, [C("id"), C("nation", "int"), C("segment")]).drop(*tab.ORDER)


@query("""SELECT n_nationkey, 'region/' || n_regionkey || '.csv' AS "RowSourceFileName", n_regionkey::VARCHAR AS "RowSourceShortName",
    row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1 AS "RowSourceLineNumber" FROM nation""")
def s3_provenance(spark, sf):
    n = table(spark, sf, "nation")
    file = F.concat(F.lit("region/"), F.col("n_regionkey").cast("string"), F.lit(".csv"))
    return tab.with_provenance(n, file, "n_nationkey").select("n_nationkey", "RowSourceFileName", "RowSourceShortName", "RowSourceLineNumber")


@query("SELECT s_suppkey::INT AS s_suppkey, s_name FROM supplier")
def s4_read_tree(spark, sf):
    path = scratch(spark, "tree")
    table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.partitionBy("s_nationkey").options(header=True).csv(path)
    return tab.read_tree(spark, path, "CSV", [C("s_suppkey", "int"), C("s_name")]).drop(*tab.ORDER)


@query("""SELECT lower(p_type) AS template_key, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_type) ORDER BY p_brand DESC, p_partkey DESC) = 1""")
def s5_templates_keep_last(spark, sf):
    p = table(spark, sf, "part").withColumn("template_key", F.lower("p_type"))
    return keep_last_by(p, ["template_key"], ["p_brand", "p_partkey"]).select("template_key", "p_partkey")


@query("""SELECT lower(p_type) AS template_key, p_partkey::INT AS p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_type) ORDER BY p_brand DESC, p_partkey DESC) = 1""")
def s5_read_templates(spark, sf):
    """Templates in files whose names follow brand and key; a later file (then row) overwrites."""
    p = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.initcap("p_type")).otherwise(F.col("p_type")).alias("Name"), "p_partkey", "p_brand")
    path = scratch(spark, "templates")
    p.repartitionByRange(8, "p_brand", "p_partkey").sortWithinPartitions("p_brand", "p_partkey").write.options(header=True, escape='"').csv(path)
    return tab.read_templates(spark, path, [C("Name"), C("p_partkey", "int")]).select("template_key", "p_partkey")


@query("""SELECT 'ORDER' AS source_tag, o_orderkey AS key, 'low' AS "SourceLevel" FROM orders UNION ALL SELECT 'CUSTOMER', c_custkey, NULL FROM customer""")
def s6_load_sources(spark, sf):
    config = spark.createDataFrame([("ORDER", f"{sf}/orders.parquet", "low"), ("CUSTOMER", f"{sf}/customer.parquet", None), ("MUSIC", "none", None)], "Type string, Filename string, Level string")
    readers = {
        "ORDER": lambda p: spark.read.parquet(*p).select(F.col("o_orderkey").alias("key")),
        "CUSTOMER": lambda p: spark.read.parquet(*p).select(F.col("c_custkey").alias("key")),
    }
    return tab.union_sources(*sorted(tab.load_sources(config, readers).items()))


@query("""SELECT event_id, (props->>'$.k')::INT AS k, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS parent FROM events""")
def s7_read_config(spark, sf):
    e = table(spark, sf, "events").withColumn("v", configs.from_json5(F.regexp_replace(F.regexp_replace("props", '"k"', "k"), r"\}", ",\n }"), "k int"))
    return e.select("event_id", F.col("v.k").alias("k"), configs.own_parent_cleared(F.col("event_type"), F.lit("view")).alias("parent"))


def _one_file_each(df, what):
    """Texts (column value) written as a file each."""
    path = scratch(df.sparkSession, what)
    df.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("""SELECT 'z' || (c_custkey // 500) AS zone, CASE WHEN c_custkey // 500 % 2 = 0 THEN '' ELSE 'base' END AS parent, 'all' AS level, 'c' || c_custkey || ',}].csv' AS filename, CASE WHEN c_custkey % 3 = 0 THEN 'low' END AS source_level FROM customer""")
def s7_config_files(spark, sf):
    """Zone configs of up to 500 sources each, a file each, in relaxed JSON; every second zone names itself as parent."""
    k = F.col("c_custkey")
    zone = F.floor(k / 500)
    source = F.concat(F.lit("{Type: 'ALIAS', /* c */ Filename: 'c"), k, F.lit(",}].csv',"), F.when(k % 3 == 0, ' "DefaultAudioCompression": "low",').otherwise(""), F.lit("}, // next\n"))
    g = table(spark, sf, "customer").groupBy(zone.alias("z")).agg(F.array_join(F.array_sort(F.collect_list(source)), "").alias("sources"))
    text = F.concat(F.lit("{\n  Name: 'z"), "z", F.lit("', Parent: '"), F.when(F.col("z") % 2 == 0, F.concat(F.lit("z"), "z")).otherwise("base"), F.lit("',\n  DefaultAudioCompression: 'all',\n  Sources: ["), "sources", F.lit("],\n}"))
    c = configs.read_config(spark, _one_file_each(g.select(text.alias("value")), "configs"))
    rows = c.select(F.col("Name").alias("zone"), F.col("Parent").alias("parent"), F.col("DefaultAudioCompression").alias("level"), F.explode("Sources").alias("s"))
    return rows.select("zone", "parent", "level", F.col("s.Filename").alias("filename"), F.col("s.DefaultAudioCompression").alias("source_level"))


@query("""SELECT 'd' || (event_id // 400) AS "Name", event_id // 400 % 3 <> 0 AS "DefaultAllOn", 'g' || event_id AS "ValueDuckGroup", (event_id % 7)::INT AS "ValueLpf" FROM events WHERE event_id // 400 % 4 <> 1
    UNION ALL SELECT DISTINCT 'd' || (event_id // 400), event_id // 400 % 3 <> 0, NULL, NULL::INT FROM events WHERE event_id // 400 % 4 = 1""")
def s8_duck_files(spark, sf):
    """Ducks of up to 400 values each, a file each; every fourth one has none."""
    g = F.floor(F.col("event_id") / 400)
    value = F.concat(F.lit("{DuckGroup: 'g"), "event_id", F.lit("', Lpf: "), F.col("event_id") % 7, F.lit(",},"))
    e = table(spark, sf, "events").groupBy(g.alias("g")).agg(F.array_join(F.array_sort(F.collect_list(value)), "\n").alias("values"))
    text = F.concat(F.lit("// duck\n{Name: 'd"), "g", F.lit("', "), F.when(F.col("g") % 3 == 0, "DefaultAllOn: false, ").otherwise(""), F.when(F.col("g") % 4 != 1, F.concat(F.lit("Values: ["), "values", F.lit("]"))).otherwise(""), F.lit("}"))
    return configs.read_ducks(spark, _one_file_each(e.select(text.alias("value")), "ducks")).select("Name", "DefaultAllOn", "ValueDuckGroup", "ValueLpf")


@query("""WITH t AS (SELECT conv_id, turn, role, conv_id // 40 AS m, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
    a AS (SELECT *, CASE WHEN turn = 0 THEN 'intro' WHEN turn = last THEN 'exit' ELSE 'loop' END AS r FROM t)
    SELECT 'm' || m AS "Set", 's' || conv_id AS "State", r AS "Role", role AS "AliasName", turn::INT AS "BPM", (turn - (SELECT min(turn) FROM t x WHERE x.conv_id = a.conv_id))::BIGINT AS place FROM a""")
def s9_music_files(spark, sf):
    """Music sets of up to 40 states each, a file each: a conversation is a state, its first turn the intro, its last the exit."""
    c = table(spark, sf, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    asset = F.concat(F.lit("{AliasName: '"), "role", F.lit("', BPM: "), "turn", F.lit("}"))
    role = F.when(F.col("turn") == 0, "intro").when(F.col("turn") == F.col("last"), "exit").otherwise("loop")
    turns = F.array_sort(F.collect_list(F.struct("turn", role.alias("r"), asset.alias("a"))))
    states = c.join(last, "conv_id").groupBy("conv_id").agg(turns.alias("t"))

    def of(name):
        return F.transform(F.filter("t", lambda x: x["r"] == name), lambda x: x["a"])

    text = F.concat(
        F.lit("{Name: 's"), "conv_id", F.lit("', "), F.when(F.size(of("intro")) > 0, F.concat(F.lit("IntroAsset: "), of("intro")[0], F.lit(", "))).otherwise(""),
        F.when(F.size(of("exit")) > 0, F.concat(F.lit("ExitAsset: "), of("exit")[0], F.lit(", "))).otherwise(""), F.lit("LoopAssets: ["), F.array_join(of("loop"), ","), F.lit("]}"),
    )
    sets = states.select(F.floor(F.col("conv_id") / 40).alias("m"), text.alias("s")).groupBy("m").agg(F.array_join(F.collect_list("s"), ",\n").alias("s"))
    path = _one_file_each(sets.select(F.concat(F.lit("{Name: 'm"), "m", F.lit("', StateArray: ["), "s", F.lit("]}")).alias("value")), "music")
    return configs.read_music(spark, path).select("Set", "State", "Role", "AliasName", "BPM", F.col("AssetNo").cast("long").alias("place"))


@query("""SELECT 'd' || event_id AS "Name", CASE WHEN event_id % 3 = 0 THEN false ELSE true END AS "DefaultAllOn", CASE WHEN event_id % 2 = 0 THEN 'g' || (props->>'$.k') END AS "ValueDuckGroup" FROM events""")
def s8_read_ducks(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    text = F.concat(
        F.lit("{Name: 'd"), "event_id", F.lit("', // comment\n"), F.when(F.col("event_id") % 3 == 0, "DefaultAllOn: false,").otherwise(""),
        F.lit("Values: ["), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("{DuckGroup: 'g"), k, F.lit("',},"))).otherwise(""), F.lit("]}"),
    )
    # one config a file is what the reader takes; a table's worth of configs goes through the column function
    one = e.select(text.alias("value"))
    d = one.select(configs.from_json5(F.col("value"), configs.DUCK).alias("v")).select("v.*")
    flat = d.withColumn("value", F.explode_outer("Values"))
    return flat.select("Name", F.coalesce("DefaultAllOn", F.lit(True)).alias("DefaultAllOn"), F.col("value.DuckGroup").alias("ValueDuckGroup"))


@query("SELECT conv_id, turn, role FROM conversations")
def s9_nested_turns(spark, sf):
    c = table(spark, sf, "conversations")
    sets = c.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role")))).alias("j"))
    rows = sets.select("conv_id", F.explode(configs.from_json5(F.col("j"), "array<struct<turn:bigint,role:string>>")).alias("x"))
    return rows.select("conv_id", "x.turn", "x.role")


@query("SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def s10_pair_by_filename(spark, sf):
    return tab.pair_by_filename(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query(r"""SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(url, '([^/]+?)(?:\.[^./]*)?$', 1) AS stem, regexp_extract(url, '\.([^./]*)$', 1) AS ext FROM pages""")
def s11_split_paths(spark, sf):
    return files.split_path(table(spark, sf, "pages"), "url").select("page_id", "parent", "stem", "ext")


def _by_nation(spark, sf):
    """The names of the customers of each nation in a file of its own."""
    path = scratch(spark, "nations")
    c = table(spark, sf, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    c.select("c_nationkey", F.col("c_name").alias("value")).write.partitionBy("c_nationkey").text(path)
    return path


@query("SELECT 'c_nationkey=' || c_nationkey AS folder, 'txt' AS ext, sum(strlen(c_name) + 1)::BIGINT AS size, true AS rightly_named FROM customer GROUP BY c_nationkey")
def s11_list_files(spark, sf):
    f = files.list_files(spark, _by_nation(spark, sf))
    rightly = F.concat_ws("/", "parent", F.concat_ws(".", "stem", "ext")) == F.col("rel_path")
    return f.select(F.regexp_extract("parent", "([^/]+)$", 1).alias("folder"), "ext", "size", rightly.alias("rightly_named"))


@query("SELECT 'c_nationkey=' || c_nationkey AS folder, sum(strlen(c_name) + 1)::BIGINT AS size, upper(md5(string_agg(c_name || chr(10), '' ORDER BY c_custkey))) AS md5 FROM customer GROUP BY c_nationkey")
def s12_read_assets(spark, sf):
    a = files.read_assets(spark, _by_nation(spark, sf))
    return a.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"), "size", "md5")


@query("SELECT doc_id, strlen(text) AS size, upper(md5(text)) AS md5 FROM documents")
def s12_content_hash(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.octet_length("text").cast("long").alias("size"), S.content_md5("text").alias("md5"))


@query(f"WITH {LONG} SELECT vec_id, i, s FROM long")
def s13_wav_round_trip(spark, sf):
    wav = signals(spark, sf).select(F.col("vec_id").cast("string").alias("path"), files.wav_bytes(F.col("samples")).alias("content"))
    chunks = files.wav_to_chunks(wav, chunk_frames=16)
    rows = chunks.select(F.col("asset").cast("long").alias("vec_id"), "chunk_no", F.posexplode("samples").alias("j", "s"))
    return rows.select("vec_id", (F.col("chunk_no") * 16 + F.col("j")).alias("i"), F.col("s").cast("int").alias("s"))


#: The samples of sixteen neighbouring signals, which make up a file, in their order.
_TAKES = f"{LONG}, takes AS (SELECT (vec_id // 16)::BIGINT AS take, row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id, i) - 1 AS i, s FROM long)"


def take_files(spark, sf):
    """A folder of PCM files and (path, size) of them, each of sixteen neighbouring signals and a line end after the data,
    a thousand to a folder."""
    root = scratch(spark, "takes")
    each = signals(spark, sf).groupBy(F.floor(F.col("vec_id") / 16).cast("long").alias("take")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "samples"))).alias("x"))
    path = F.concat(F.lit(f"{root}/"), F.floor(F.col("take") / 1000), F.lit("/take="), "take", F.lit(".wav"))
    return root, ranges.write_signals(each.select(path.alias("path"), F.flatten("x.samples").alias("samples")), after=b"\n")


def take_of(path):
    return F.regexp_extract(path, "take=([0-9]+)[.]wav$", 1).cast("long")


@query(f"WITH {_TAKES} SELECT take, 1 AS channel_count, 48000 AS frame_rate, i, s FROM takes")
def s13_read_ranges(spark, sf):
    """Signals read in ranges of two rows, so that each file is the work of several tasks."""
    listed = files.list_files(spark, take_files(spark, sf)[0])
    rows = ranges.signal_rows(listed, chunk_frames=256, range_bytes=1024)
    each = rows.select(take_of("asset").alias("take"), "channel_count", "frame_rate", "chunk_no", F.posexplode("samples").alias("j", "s"))
    return each.select("take", "channel_count", "frame_rate", (F.col("chunk_no") * 256 + F.col("j")).alias("i"), F.col("s").cast("int").alias("s"))


@query("SELECT 'c_nationkey=' || c_nationkey AS folder, sum(strlen(c_name) + 1)::BIGINT AS size, upper(md5(string_agg(c_name || chr(10), '' ORDER BY c_custkey))) AS md5 FROM customer GROUP BY c_nationkey")
def s12_file_hashes(spark, sf):
    """As ``s12_read_assets``, with files hashed in blocks by the tasks that open them."""
    hashed = ranges.file_hashes(files.list_files(spark, _by_nation(spark, sf)))
    return hashed.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"), "size", "md5")


@query("""SELECT o_orderkey, (8000 + o_custkey % 184000)::INT AS frame_rate, (1 + o_orderkey % 2)::INT AS channel_count, 16 AS bits, o_orderkey * 1000003 AS total_samples FROM orders""")
def s14_flac_streaminfo(spark, sf):
    """Headers of streams. The field of samples has 36 bits, so an order of more samples is two streams: one of as many as
    the field can't hold, counted in multiples of 2^36, and one of the rest."""
    o = table(spark, sf, "orders")
    total = F.col("o_orderkey") * 1000003

    def header(samples):
        word = F.shiftleft(8000 + F.col("o_custkey") % 184000, 12) + F.shiftleft(F.col("o_orderkey") % 2, 9) + (15 << 4) + F.shiftright(samples, 32)
        return F.unhex(F.concat(F.lit(b"fLaC".hex()), F.lit("80000022"), F.lit("10001000"), F.lit("0" * 12), F.lpad(F.hex(word), 8, "0"), F.lpad(F.hex(samples.bitwiseAND(0xFFFFFFFF)), 8, "0"), F.lit("0" * 32)))

    o = o.withColumns({"content": header(total.bitwiseAND((1 << 36) - 1)), "multiples": header(F.shiftright(total, 36))})
    rest = files.flac_streaminfo(o).withColumnRenamed("total_samples", "rest")
    both = files.flac_streaminfo(rest, "multiples").withColumn("total_samples", F.col("total_samples") * (1 << 36) + F.col("rest"))
    return both.select("o_orderkey", "frame_rate", "channel_count", "bits", "total_samples")


def doc_manifest(spark, sf):
    """Documents as manifest entries, one bank per language."""
    d = table(spark, sf, "documents")
    m = d.select(F.concat(F.lit("doc-"), "doc_id").alias("name"), F.col("n_chars").alias("size"), F.md5("text").alias("source_checksum"), F.col("lang").alias("zone"), F.col("doc_id").alias("order"))
    return M.packed_offsets(m.withColumns({"language": F.lit("shared"), "storage_class": F.lit("loaded"), "version": F.lit(3)}), ["zone", "language", "storage_class"], ["order"])


@query("SELECT 'doc-' || doc_id AS name, n_chars AS size, md5(text) AS source_checksum, lang AS zone FROM documents")
def s15_read_manifest(spark, sf):
    path = scratch(spark, "manifest")
    doc_manifest(spark, sf).write.partitionBy("zone", "language", "storage_class").parquet(path)
    return files.read_manifest(spark, path, version=3).select("name", "size", "source_checksum", "zone")


@query("""WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 100)) AS q FROM embeddings)
    SELECT vec_id::INT AS priority, f AS face_no, q[9*f+1] AS x0, q[9*f+9] AS z2 FROM q, range(4) t(f) WHERE vec_id % 3 <> 0
    UNION ALL SELECT vec_id::INT, NULL, NULL, NULL FROM q WHERE vec_id % 3 = 0""")
def s16_read_map_faces(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("q", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("string")))
    face = [F.concat(*[x for p in range(3) for x in (F.lit("( "), F.concat_ws(" ", *[F.col("q")[9 * f + 3 * p + a] for a in range(3)]), F.lit(" ) "))], F.lit("mat 0 0\n")) for f in range(4)]
    brush = F.concat(F.lit("// brush 0\n{\nlayer x\n"), *face, F.lit("mesh\n{\n( 1 2 3 )\n{\n}\n}\n}\n"))
    ent = F.concat(F.lit('// entity 0\n{\n"classname" "trigger_multiple"\ntargetname ambient_package\n"script_ambientpriority" " '), "vec_id", F.lit('"\n'), F.when(F.col("vec_id") % 3 != 0, brush).otherwise(""), F.lit("}\n"))
    path = scratch(spark, "map")
    e.select(ent.alias("value")).write.text(path)
    return files.read_map_faces(spark, path).select("priority", "face_no", F.col("p0")[0].alias("x0"), F.col("p2")[2].alias("z2"))


_CUSTOMER = [C("c_custkey", "int"), C("c_name"), C("c_acctbal", "float"), C("good", "boolean"), C("hidden", written=False)]


@query("""SELECT c_custkey::VARCHAR AS c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_nationkey || CASE c_custkey % 2 WHEN 0 THEN '.5' ELSE '' END END AS c_acctbal,
    CASE WHEN c_custkey % 3 = 0 THEN 'True' ELSE 'False' END AS good FROM customer""")
def k1_write_table(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(
        k.cast("int").alias("c_custkey"), "c_name", F.when(k % 4 != 0, F.col("c_nationkey") + F.when(k % 2 == 0, 0.5).otherwise(0.0)).cast("float").alias("c_acctbal"), (k % 3 == 0).alias("good"), F.lit(1).alias("hidden")
    )
    path = scratch(spark, "table")
    sinks.write_table(c, _CUSTOMER, path)
    # read back as text: what was written is what is compared
    return spark.read.options(header=True, escape='"', lineSep="\r\n", nullValue="\0").csv(path).na.fill("")


@query("""SELECT n_nationkey::VARCHAR AS "Name", n_name AS "Reverb", '' AS "RowSourceFileName" FROM nation""")
def k2_side_table(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("Name"), F.col("n_name").alias("Reverb"), F.lit("x").alias("RowSourceFileName"))
    return sinks.formatted(n, [C("Name"), C("Reverb"), C("RowSourceFileName")], blank=["RowSourceFileName"])


@query("""SELECT 'full' AS kind, 'Name,Bal,Good,RowSourceFileName' AS line UNION ALL SELECT 'empty', 'Name,Bal,Good,RowSourceFileName'
    UNION ALL SELECT 'full', CASE WHEN s_suppkey % 3 = 0 THEN '"a ""' || s_suppkey || '"", b"' ELSE s_name END || ',' || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN '.5' ELSE '' END END || ',' || CASE WHEN s_suppkey % 5 = 0 THEN 'True' ELSE 'False' END || ',' FROM supplier""")
def k2_write_side_tables(spark, sf):
    """A table with cells that need quotes and a column that is always blank, and one without rows, as their lines."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(
        F.when(k % 3 == 0, F.concat(F.lit('a "'), k, F.lit('", b'))).otherwise(F.col("s_name")).alias("Name"),
        F.when(k % 4 != 0, F.col("s_nationkey") + F.when(k % 2 == 0, 0.5).otherwise(0.0)).cast("float").alias("Bal"), (k % 5 == 0).alias("Good"), F.lit("x").alias("RowSourceFileName"),
    )
    spec, out = [C("Name"), C("Bal", "float"), C("Good", "boolean"), C("RowSourceFileName")], []
    for kind, rows in (("full", s), ("empty", s.limit(0))):
        path = scratch(spark, kind)
        sinks.write_table(rows, spec, path, blank=["RowSourceFileName"])
        out.append(spark.read.text(path).select(F.lit(kind).alias("kind"), F.col("value").alias("line")).distinct())  # every part has the header
    return out[0].unionByName(out[1])


@query("SELECT DISTINCT p_name AS \"Name\" FROM part")
def k3_write_names(spark, sf):
    path = scratch(spark, "names")
    sinks.write_names(table(spark, sf, "part"), path, "p_name")
    return spark.read.text(path).select(F.col("value").alias("Name")).filter("Name <> 'Name'")


@query("SELECT 'doc-' || doc_id AS name, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS position FROM documents")
def k4_asset_list(spark, sf):
    from assetloom.operators.tables import positions

    m = doc_manifest(spark, sf)
    return positions(m, [], ["offset", "order"], within=["zone"]).select("name", "position")


@query("SELECT sum(n_chars)::BIGINT::VARCHAR AS value FROM documents")
def k5_write_scalar(spark, sf):
    path = scratch(spark, "total")
    sinks.write_scalar(M.manifest_totals(table(spark, sf, "documents"), size="n_chars").select("total_bytes"), path)
    return spark.read.text(path)


def volume_planes(spark, sf):
    """Embeddings as volumes of five faces each, in whole numbers, one file per label."""
    e = table(spark, sf, "embeddings").withColumn("q", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("double")))
    faces = F.array(*[F.struct(F.lit(i).alias("face_no"), *[F.slice("q", 9 * i + 3 * p + 1, 3).alias(f"p{p}") for p in range(3)]) for i in range(5)])
    return e.select("vec_id", "label", F.explode(faces).alias("f")).select("vec_id", "label", "f.*")


@query("""SELECT label::VARCHAR AS file, count(*) AS n_triggers, sum(5)::BIGINT AS n_planes, max((i - 1) * 5)::BIGINT AS last_index FROM
    (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings) GROUP BY label""")
def k6_geometry_json(spark, sf):
    f = volume_planes(spark, sf).select(
        F.col("label").cast("string").alias("file"), F.col("vec_id").cast("int").alias("entity_no"), F.lit("trigger_multiple").alias("class_name"), F.lit("ambient_package").alias("target_name"),
        F.lit("room").alias("room"), F.lit(0).alias("priority"), F.lit(0).alias("brush_no"), "face_no", "p0", "p1", "p2",
    )
    planes, volumes, triggers, _ = jobs.ambient_volumes(f)
    shape = "Nodes array<string>, Planes array<struct<Plane:array<double>>>, Volumes array<struct<Id:int,PlaneIndex:bigint,PlaneCount:bigint>>, Triggers array<struct<Id:int>>"
    j = sinks.geometry_json(planes, volumes, triggers).select("file", F.from_json("value", shape).alias("g"))
    return j.select(
        "file", F.size("g.Triggers").cast("long").alias("n_triggers"), F.size("g.Planes").cast("long").alias("n_planes"), F.array_max("g.Volumes.PlaneIndex").alias("last_index")
    )


@query("SELECT 'doc-' || doc_id AS name, n_chars AS size, lang AS zone FROM documents")
def k7_deploy(spark, sf):
    a, b = scratch(spark, "cache"), scratch(spark, "ship")
    sinks.deploy(doc_manifest(spark, sf), [a, b])
    return spark.read.parquet(snapshots.folder(spark, b)).select("name", "size", "zone")

