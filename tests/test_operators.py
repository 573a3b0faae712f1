"""Operators on small frames, properties, and knots by definition."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from assetloom.functions import spec as P
from assetloom.functions.scalars import complete
from assetloom.functions.spec import ColumnSpec as C
from assetloom.operators import geometry, inherit, manifest, resolve, signal, tables, validate
from assetloom.plans import jobs
from assetloom.sources import configs, files, sinks
from assetloom.sources import tables as tab
from assetloom.sources.scratch import stored


def test_relaxed_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Name,A,B\n alpha , 1 ,x\n\n,,\n,no name\n# c\n\t# ind\n"""q",1\n,#\nbeta,2\n')
    (tmp_path / "b.csv").write_text("Name,B,A,Other\ngamma,y,3,z\n")
    got = tab.read_table_relaxed(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], [C("Name"), C("A", "int"), C("B"), C("Missing")]).orderBy("Name").collect()
    assert [(r.Name, r.A, r.B, r.Missing) for r in got] == [("alpha", 1, "x", None), ("beta", 2, None, None), ("gamma", 3, "y", None)]


def test_grouped_specs_come_together_by_folder(spark):
    """Rows that name a folder follow one another, each with its files in one order; a path and a folder may be alike."""
    f = spark.createDataFrame([(f"{d}/{i}.wav", d, "wav") for d in ("a", "b", "c") for i in range(20)] + [("d.wav", "", "wav"), ("d.wav/x.wav", "d.wav", "wav"), ("a/no.txt", "a", "txt")], "rel_path string, parent string, ext string")
    s = spark.createDataFrame([(k, "abc"[k % 3]) for k in range(60)] + [(60, "d.wav"), (61, "a/3.wav"), (62, "nowhere"), (63, None)], "k int, spec string")
    found = resolve.resolve_specs(s, f, grouped=True).withColumn("p", F.spark_partition_id()).collect()
    want = [(k, f"{'abc'[k % 3]}/{i}.wav") for k in range(60) for i in range(20)] + [(60, "d.wav"), (60, "d.wav/x.wav"), (61, "a/3.wav")]
    assert sorted((r.k, r.source) for r in found) == sorted(want)
    runs, orders = [], {}
    for r in found:
        if not runs or runs[-1] != (r.p, r.spec):
            runs.append((r.p, r.spec))
        orders.setdefault(r.spec, {}).setdefault(r.k, []).append(r.source)
    assert len(runs) == len(set(runs)) == 5
    assert all(len({tuple(x) for x in by_row.values()}) == 1 for by_row in orders.values())


def test_grouped_specs_of_large_folders_are_dealt_to_tasks(spark, monkeypatch):
    """Tasks share the rows of a folder with a large result, and folders come before paths in each."""
    monkeypatch.setattr(resolve, "PIECE", 500, raising=False)
    f = spark.createDataFrame([(f"{d}/{i}.wav", d, "wav") for d in ("a", "b") for i in range(20)] + [("d.wav/x.wav", "d.wav", "wav")], "rel_path string, parent string, ext string")
    s = spark.createDataFrame([(k, "a") for k in range(400)] + [(k, "b") for k in range(400, 410)] + [(k, f"a/{k % 20}.wav") for k in range(500, 560)] + [(560, "d.wav"), (561, None), (0, "a")], "k int, spec string")
    found = resolve.resolve_specs(s, f, grouped=True)
    assert found.columns == ["spec", "k", "source"]
    found = found.withColumn("p", F.spark_partition_id()).collect()
    want = [(k, f"a/{i}.wav") for k in [*range(400), 0] for i in range(20)] + [(k, f"b/{i}.wav") for k in range(400, 410) for i in range(20)]
    assert sorted((r.k, r.source) for r in found) == sorted(want + [(k, f"a/{k % 20}.wav") for k in range(500, 560)] + [(560, "d.wav/x.wav")])
    assert len({r.p for r in found if r.spec == "a"}) == 4 and len({r.p for r in found if r.spec == "b"}) == 1
    for p in {r.p for r in found}:
        kinds = [r.spec.endswith(".wav") for r in found if r.p == p]
        assert kinds == sorted(kinds)


def test_compared_gives_either_side_and_status(spark):
    new = spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("c", "3", 3), ("n", None, 4)], "name string, source_checksum string, size int")
    old = spark.createDataFrame([("a", "1", 9), ("b", "x", 8), ("d", "4", 7), ("n", None, 6)], "name string, source_checksum string, size int")
    both = manifest.compared(new, old)
    got = {r.name: (r.status, r.new and r.new.size, r.old and r.old.size) for r in both.collect()}
    assert got == {"a": ("keep", 1, 9), "b": ("change", 2, 8), "c": ("add", 3, None), "d": ("remove", None, 7), "n": ("keep", 4, 6)}
    assert {(r.name, r.status) for r in manifest.diff_manifest(new, old).collect()} == {(k, v[0]) for k, v in got.items()}


def test_unclashed_is_claims_without_conflicts(spark):
    rng = random.Random(5)
    rows = [(i, f"t{rng.randrange(40)}", rng.choice(["x", "x", "x", "y", None]), f"by{i}") for i in range(200)]
    a = spark.createDataFrame(rows, "o int, target string, s string, origin string")
    bad = resolve.target_conflicts(a, "target", ["s"], "origin", "o").select("target")
    want = resolve.claimed(a.join(bad, "target", "left_anti"), "target", "o").select(*a.columns)
    got = resolve.unclashed(a, "target", ["s"], "o")
    assert got.columns == a.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() > 0


def test_a_build_joins_manifests_once(spark, monkeypatch):
    """The manifest comes from one comparison of what is wanted and what was, and reads each claim once."""
    from assetloom.queries import signals as Q
    from assetloom.sources import scratch

    seen = []
    was = tables.stored

    def kept(df, what="stored"):
        if what == "groups":
            seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return was(df, what)

    monkeypatch.setattr(tables, "stored", kept)
    assert scratch.stored is was
    jobs.build(*Q.build_inputs(spark, "/root/testdata/sf0.001"))
    assert len(seen) == 1 and seen[0].count("Join FullOuter") == 1 and "LeftSemi" not in seen[0] and "LeftAnti" not in seen[0]


def test_candidates_keep_the_tasks_of_a_shuffle(spark):
    b = spark.range(40 * 60).selectExpr("cast(id % 40 as string) asset", "cast(id div 40 as int) i", "cast((id * 7919) % 101 as double) v")
    found = signal.candidates(stored(signal.knots(b)))
    assert found.rdd.getNumPartitions() == 4 and found.count() > 40 * 60


def test_windows_paths_survive_quoting(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Name,P,Q\na,"c:\\dir\\",next\n')
    r = tab.read_table(spark, [f"{tmp_path}/a.csv"], [C("Name"), C("P"), C("Q")]).first()
    assert r.P == "c:\\dir\\" and r.Q == "next"


def test_strict_scan_refuses_bad_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name,N\na,1\nb,oops\n")
    with pytest.raises(ValueError, match="type of N"):
        tab.read_table(spark, [f"{tmp_path}/a.csv"], [C("Name"), C("N", "int")])


def test_templates_and_trees(spark, tmp_path):
    (tmp_path / "t" / "sub").mkdir(parents=True)
    (tmp_path / "t" / "a.csv").write_text("Name,A\nBase,1\n")
    (tmp_path / "t" / "b.csv").write_text("Name,A\nBASE,2\nother,3\n")
    (tmp_path / "t" / "sub" / "c.CSV").write_text("Name,A\ndeep,4\n")
    spec = [C("Name"), C("A", "int")]
    assert {(r.template_key, r.A) for r in tab.read_templates(spark, f"{tmp_path}/t", spec).collect()} == {("base", 2), ("other", 3)}
    assert tab.read_tree(spark, f"{tmp_path}/t", "csv", spec).count() == 4
    assert tab.read_tree(spark, f"{tmp_path}/none", "csv", spec).count() == 0


def test_configs(spark, tmp_path):
    (tmp_path / "z.szc").write_text("// c\n{Name: 'z', Parent: 'z', Sources: [{Type: 'ALIAS', Filename: 'a,].csv',},],}")
    z = configs.read_config(spark, f"{tmp_path}/z.szc").first()
    assert z.Name == "z" and z.Parent == "" and z.Sources[0].Filename == "a,].csv"
    (tmp_path / "d.duk").write_text("{Name: 'd', Values: [{DuckGroup: 'g', Lpf: 3}, {DuckGroup: 'h'}]}")
    d = configs.read_ducks(spark, f"{tmp_path}/d.duk").collect()
    assert [r.ValueDuckGroup for r in d] == ["g", "h"] and d[0].DefaultAllOn is True
    (tmp_path / "m.mus").write_text("{Name:'m', StateArray:[{Name:'s', IntroAsset:{AliasName:'i'}, LoopAssets:[{AliasName:'l1'},{AliasName:'l2'}]}]}")
    m = configs.read_music(spark, f"{tmp_path}/m.mus").orderBy("AssetNo").collect()
    assert [(r.Role, r.AliasName) for r in m] == [("intro", "i"), ("loop", "l1"), ("loop", "l2")]


def test_files_and_wav(spark, tmp_path):
    import struct

    raw = struct.pack("<6h", 1, -2, 3, -4, 5, -6)
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 48000, 192000, 4, 16) + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", 16)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.wav").write_bytes(b"RIFF" + struct.pack("<I", 4) + head + raw)
    listed = files.list_files(spark, str(tmp_path / "d")).first()
    assert listed.stem == "x" and listed.ext == "wav" and listed.size > 0
    c = files.wav_to_chunks(files.read_assets(spark, f"{tmp_path}/d"), 512).first()
    assert c.channel_count == 2 and c.samples == [1, -2, 3, -4, 5, -6, 0, 0]  # overstated data: padded


def test_features_of_short_and_empty_files(spark):
    def wav(samples):
        col = F.array(*[F.lit(x) for x in samples]).cast("array<int>")
        return files.wav_bytes(col)

    one = spark.range(1)
    sets = {"empty": [], "one": [-16384], "short": [100] * 7 + [8192], "long": [0, 32767] * 40}
    content = None
    for name, x in sets.items():
        row = one.select(F.lit(name).alias("path"), F.lit("m").alias("md5"), wav(x).alias("content"), F.timestamp_seconds(F.lit(5)).alias("mtime"))
        content = row if content is None else content.unionByName(row)
    content = stored(content)
    none = "path string, mtime long, md5 string, frame_rate int, channel_count int, frame_count long, " + ", ".join(f"{c} int" for c in [*[f"envelope_loudness{i}" for i in range(4)], "envelope_time1", "envelope_time2"])
    got = {r.path: r for r in jobs.refresh_features(content.select("path", "mtime"), spark.createDataFrame([], none), read=lambda s: content, store=stored, bucket=4, chunk_frames=16).collect()}
    assert {k: r.frame_count for k, r in got.items()} == {k: len(x) for k, x in sets.items()}
    assert got["empty"].envelope_loudness0 == 0 and got["one"].envelope_time1 == int(65535 * 0.3) and got["long"].envelope_loudness1 == 99


CUBE = [
    ((0, 0, 0), (0, 1, 0), (0, 0, 1)), ((1, 0, 0), (1, 0, 1), (1, 1, 0)), ((0, 0, 0), (0, 0, 1), (1, 0, 0)),
    ((0, 1, 0), (1, 1, 0), (0, 1, 1)), ((0, 0, 0), (1, 0, 0), (0, 1, 0)), ((0, 0, 1), (0, 1, 1), (1, 0, 1)),
]


def brush(faces):
    line = "( {} {} {} ) ( {} {} {} ) ( {} {} {} ) mat 0 0 0"
    return "// brush 0\n{\n" + "\n".join(line.format(*[x for p in f for x in p]) for f in faces) + "\n}\n"


def test_map_volumes(spark, tmp_path):
    ent = '// entity {n}\n{{\n"classname" "trigger_multiple"\n"targetname" "ambient_package"\n"script_ambientroom" "hall"\n"script_ambientpriority" "3"\n{b}}}\n'
    skipped = '// entity 9\n{\n"classname" "light"\nkey a value\n// brush 0\n{\nmesh\n{\n( 1 2 3 )\n}\n}\n}\n'
    flat = [CUBE[0], CUBE[0], CUBE[0]]
    text = "animations\n{\n{\n}\n}\n" + skipped + ent.format(n=0, b=brush(CUBE)) + ent.format(n=1, b=brush(flat)) + ent.format(n=2, b=brush(CUBE))
    (tmp_path / "m.map").write_text(text)
    planes, volumes, triggers, problems = jobs.ambient_volumes(files.read_map_faces(spark, f"{tmp_path}/m.map"))
    assert [(r.id, r.plane_index, r.plane_count) for r in volumes.orderBy("id").collect()] == [(0, 0, 6), (1, 6, 3), (2, 9, 6)]
    assert [(r.id, r.priority, r.room) for r in triggers.orderBy("id").collect()] == [(0, 3, "hall"), (1, 3, "hall"), (2, 3, "hall")]
    assert [(r.id, r.rule) for r in problems.collect()] == [(1, "bounds nothing")]
    j = sinks.geometry_json(planes, volumes, triggers).first().value
    assert '"Nodes":[]' in j and j.count('"Plane":') == 15
    pts = geometry.inside_points(planes.withColumnRenamed("id", "volume").withColumnRenamed("plane_index", "face_no"), geometry.hull_points(planes.withColumnRenamed("id", "volume").withColumnRenamed("plane_index", "face_no")))
    corners = {tuple(round(x, 6) + 0.0 for x in r.point) for r in pts.filter("volume = 0").collect()}
    assert corners == {(x, y, z) for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 1.0)}


def test_keep_first_keeps_contexts(spark):
    rows = [("w", "a.wav", "train", "city", 1), ("w", "a.wav", "train", "country", 2), ("w", "a.wav", "train", "city", 3), ("w", "", None, None, 4), ("w", None, "", "", 5)]
    df = complete(spark.createDataFrame(rows, "Name string, FileSpec string, ContextType string, ContextValue string, n int"), P.ALIAS)
    once = tables.keep_first(df, P.DEDUP_KEYS, ["n"])
    assert sorted(r.n for r in once.collect()) == [1, 2, 4]
    assert sorted(r.n for r in tables.keep_first(once, P.DEDUP_KEYS, ["n"]).collect()) == [1, 2, 4]


def test_diff_properties(spark):
    rnd = random.Random(4)
    a = {f"k{i}": str(rnd.randrange(3)) for i in range(60) if rnd.random() < 0.7}
    b = {f"k{i}": str(rnd.randrange(3)) for i in range(60) if rnd.random() < 0.7}
    new, old = (spark.createDataFrame(sorted(x.items()), "name string, source_checksum string") for x in (a, b))
    diff = manifest.diff_manifest(new, old)
    status = {r.name: r.status for r in diff.collect()}
    assert set(status) == set(a) | set(b)
    applied = manifest.apply_diff(old, diff, new)
    assert {r.name: r.source_checksum for r in applied.collect()} == a
    assert {r.status for r in manifest.diff_manifest(new, applied).collect()} == {"keep"}


def test_offsets_are_gap_free_and_two_levels_agree(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), i, rnd.randrange(0, 1000)) for i in range(500)]
    df = spark.createDataFrame(rows, "bank string, i int, size long")
    one = manifest.packed_offsets(df, ["bank"], ["i"])
    assert {r.free_space for r in manifest.free_space(one.filter("size > 0"), ["bank"]).collect()} == {0}
    two = manifest.packed_offsets(df, ["bank"], ["i"], task_rows=100)
    assert sorted((r.i, r.offset) for r in one.collect()) == sorted((r.i, r.offset) for r in two.collect())


@pytest.mark.parametrize("task_rows", [10, 10_000])
def test_running_and_previous_in_large_groups(spark, task_rows):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i, rnd.choice([None, rnd.randrange(100)])) for i in range(700)] + [("c", 1000, 5)]
    df = spark.createDataFrame(rows, "g string, i int, v long")
    total, up_to, last, want = {}, {}, {}, {}
    for g, i, v in rows:
        want[i] = (total.get(g, 0), total.get(g, 0) + (v or 0), last.get(g))
        total[g], last[g] = total.get(g, 0) + (v or 0), v
    a = {r.i: r.x for r in tables.running(df, ["g"], ["i"], "v", "x", task_rows=task_rows).collect()}
    b = {r.i: r.x for r in tables.running(df, ["g"], ["i"], "v", "x", inclusive=True, task_rows=task_rows).collect()}
    c = {r.i: r.x for r in tables.previous(df, ["g"], ["i"], "v", "x", task_rows=task_rows).collect()}
    assert {i: (a[i], b[i], c[i]) for i in want} == want
    empty = tables.running(df.limit(0), ["g"], ["i"], "v", "x", task_rows=task_rows)
    assert empty.count() == 0 and empty.columns == ["g", "i", "v", "x"]


def test_alias_keys_tell_columns_apart(spark):
    rows = [("z", "a", None), ("z", None, "a"), ("z", "a", ""), ("z", '","', "a"), ("za", None, None)]
    df = complete(spark.createDataFrame(rows, "zone string, ContextType string, ContextType2 string"), P.ALIAS)
    got = [r.k for r in df.select(jobs.alias_key(["zone", *P.DEDUP_KEYS]).alias("k")).collect()]
    assert len(set(got)) == 4 and got[0] == got[2]


def test_build_keeps_aliases_that_differ_in_context_only(spark):
    from assetloom.queries.signals import build_inputs

    requests, ctx = build_inputs(spark, "/root/testdata/sf0.001")
    some = ctx.sources.filter("__file = 'f.csv' and Storage is null and zone = 'east' and PlatformMask like '%PC%'").limit(1)
    one = some.withColumns({"ContextType": F.lit("x"), "ContextType2": F.lit(None).cast("string")})
    two = some.withColumns({"ContextType": F.lit(None).cast("string"), "ContextType2": F.lit("x")})
    ctx.sources = stored(one.unionByName(two))
    b = jobs.build(requests.filter("zone = 'east' and language = 'all'"), ctx)
    assert b.aliases.count() == 2 and b.aliases.filter("FileSource is not null").count() == 2 and b.manifest.filter("name like 'snd%'").count() >= 1


def test_conflicts_and_rules(spark):
    rows = [("t1", "s", "low", "x", 1), ("t1", "s", "high", "y", 2), ("t2", "s", "high", "x", 3), ("t2", "s", "high", "y", 4)]
    df = spark.createDataFrame(rows, "target string, source string, level string, by string, o int")
    (r,) = resolve.target_conflicts(df, "target", ["source", "level"], "by", "o").collect()
    assert (r.target, r.n_settings, r.first_origin, r.other_origin) == ("t1", 2, "x", "y")
    bad = [validate.ordered("o", "o2")]
    with pytest.raises(ValueError, match="o above o2"):
        validate.strict(df.withColumn("o2", F.lit(0)), bad, "target")
    assert validate.accepted(df.withColumn("o2", F.lit(2)), bad).count() == 2


def test_dimension_is_broadcast_only_below_the_bound(spark, capsys):
    d = spark.range(10).withColumnRenamed("id", "k")
    spark.range(100).join(inherit.dimension(d, rows=5), F.col("id") == F.col("k")).explain("simple")
    assert inherit.dimension(d, rows=5) is d and inherit.dimension(d) is not d
    wide = d.select("k", F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.lit("é")).alias("a"))
    assert inherit.dimension(wide, size=5000) is wide and inherit.dimension(wide, size=50_000) is not wide


def knots_by_definition(b):
    """The places that the definition names, one by one: ends, tops after a rise (or a start), and the last but one."""
    n = len(b)
    step = [0] + [(b[j] > b[j - 1]) - (b[j] < b[j - 1]) for j in range(1, n)]

    def rising(m):
        return next((s > 0 for s in reversed(step[: m + 1]) if s), True)

    inner = [m for m in range(n - 2) if b[m] > b[m + 1] and rising(m)]
    if n >= 3 and rising(n - 2):
        falls = [j for j in range(1, n - 1) if step[j] < 0]
        after = [j for j in range(falls[-1] + 1, n - 1) if step[j] > 0] if falls else []
        if not falls or (after and after[0] <= n - 3):
            inner.append(n - 2)
    seq = [0, *inner]
    keep = [k for k in range(len(seq)) if k in (0, len(seq) - 1) or not b[seq[k - 1]] == b[seq[k]] == b[seq[k + 1]]]
    return [*[seq[k] for k in keep], n - 1]


def test_knots_equal_their_definition(spark):
    rnd = random.Random(8)
    sigs = {i: [rnd.randrange(rnd.choice([2, 3, 5])) for _ in range(rnd.randrange(2, 14))] for i in range(3000)}
    df = spark.createDataFrame([(i, j, float(v)) for i, s in sigs.items() for j, v in enumerate(s)], "asset int, i int, v double")
    got = {}
    for r in signal.knots(df).orderBy("asset", "seq").collect():
        got.setdefault(r.asset, []).append(r.i)
    wrong = {i: (s, got[i], knots_by_definition(s)) for i, s in sigs.items() if got[i] != knots_by_definition(s)}
    assert not wrong, (len(wrong), list(wrong.items())[:3])


def test_envelope_score(spark):
    b = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate([0, 10, 20, 30, 60])], "asset string, i int, v double")
    c = spark.createDataFrame([("x", 1, [0.0, 20.0, 30.0, 60.0], [0.0, 0.5, 0.75, 1.0], 5)], "asset string, ordinal int, level array<double>, time array<double>, n int")
    assert signal.score_candidates(c, b).first().score == 0.0


def line_by_definition(b, ks):
    """Buckets on the lines between knots, by the places the definition names: truncated, but for a first bucket known twice."""
    out = []
    for i in range(len(b)):
        if i == 0 and ks[1] == 0:
            out.append(b[0])
            continue
        lo = max((x for x in ks if x < i), default=0)
        hi = min(x for x in ks[1:] if x >= i)
        t = (i - lo) / (hi - lo)
        out.append(float(math.trunc(b[lo] * (1 - t) + b[hi] * t)))
    return out


def envelope_by_definition(b, most=32):
    n = len(b)
    while len(ks := knots_by_definition(b)) >= most:
        b = line_by_definition(b, ks)
    m = len(ks)
    pairs = [(m // 2 - 1, m // 2)] if m <= 4 else [(x, y) for x in range(1, m - 2) for y in range(x + 1, m - 2)]
    best = None
    for x, y in pairs:
        level, time = [b[ks[0]], b[ks[x]], b[ks[y]], b[ks[-1]]], [0.0, ks[x] / n, ks[y] / n, 1.0]
        q = [0, int(time[1] * (n - 1)), int(time[2] * (n - 1)), n - 1]
        e = sum((level[k] * (1 - (i - q[k]) / (q[k + 1] - q[k])) + level[k + 1] * (i - q[k]) / (q[k + 1] - q[k]) - b[i]) ** 2 for k in range(3) for i in range(q[k], q[k + 1]))
        if best is None or round(e / n, 8) < best[0]:
            best = (round(e / n, 8), level, time)
    return best[1], best[2]


def nested(depth):
    """Maxima among maxima: every round of decimation leaves about half of them."""
    return [float(60 + 5 * (((i & -i).bit_length() if i else depth) - 1)) + 0.37 if i % 2 == 0 else 1.5 for i in range(1 << depth)]


def test_smoothing_of_fractional_levels_equals_its_definition(spark):
    rnd = random.Random(18)
    sigs = {i: [rnd.choice([0.0, rnd.uniform(0, 5), rnd.uniform(60, 100), float(rnd.randrange(4))]) for _ in range(rnd.randrange(2, 16))] for i in range(3000)}
    df = spark.createDataFrame([(i, j, v) for i, s in sigs.items() for j, v in enumerate(s)], "asset int, i int, v double")
    got = {}
    for r in signal.smooth(df, signal.knots(df)).orderBy("asset", "i").collect():
        got.setdefault(r.asset, []).append(r.v)
    wrong = {i: (s, got[i]) for i, s in sigs.items() if got[i] != line_by_definition(s, knots_by_definition(s))}
    assert not wrong, (len(wrong), list(wrong.items())[:3])


def test_decimation_ends_below_the_bound_and_loses_no_signal(spark):
    rnd = random.Random(2)
    sigs = {f"s{i}": [rnd.uniform(40, 100) for _ in range(rnd.choice([2, 5, 70, 400]))] for i in range(60)} | {f"n{d}": nested(d) for d in (3, 8, 12)}
    df = spark.createDataFrame([(a, i, v) for a, s in sigs.items() for i, v in enumerate(s)], "asset string, i int, v double")
    b, k = signal.decimate(df, 8, store=stored)
    counts = {r.asset: r["count"] for r in k.groupBy("asset").count().collect()}
    assert set(counts) == set(sigs) and max(counts.values()) < 8
    assert {r.asset: r["count"] for r in b.groupBy("asset").count().collect()} == {a: len(s) for a, s in sigs.items()}


def test_envelopes_equal_their_definition(spark):
    rnd = random.Random(5)
    bucket, rows, sigs = 4, [], {}
    for i in range(40):
        n = rnd.choice([1, 7, 8, 9, 64, 300, 1200])
        loud = [rnd.randrange(1, 32767) if rnd.random() < 0.8 else 0 for _ in range(n // 3 + 1)]
        sigs[f"a{i}"] = [rnd.choice([-1, 1]) * loud[j // 3] for j in range(n)]
    sigs["deep"] = [int(x * 300) for x in nested(9) for _ in range(bucket)]
    for a, s in sigs.items():
        rows += [(a, c, 1, 48000, s[k : k + 64]) for c, k in enumerate(range(0, len(s), 64))]
    chunks = spark.createDataFrame(rows, "asset string, chunk_no long, channel_count int, frame_rate int, samples array<int>")
    got = {r.asset: (r.level, r.time) for r in signal.envelope(chunks, bucket, 64, most=10, store=stored).collect()}
    assert set(got) == set(sigs)
    for a, s in sigs.items():
        n = len(s) // bucket
        if n <= 1:
            p = max(map(abs, s)) / 32768.0
            want = [p] * 4, [0.0, 0.3, 0.6, 1.0]
        else:
            peaks = [max(map(abs, s[k * bucket : (k + 1) * bucket])) / 32768.0 for k in range(n)]
            want = envelope_by_definition([20 * math.log10(p) + 100 if p >= 1e-4 else 0.0 for p in peaks], 10)
        assert got[a][0] == pytest.approx(want[0]) and got[a][1] == pytest.approx(want[1]), a


def resampled_by_definition(s, out, channels):
    n, c = len(s) // channels, signal.COEFFICIENTS
    res = []
    for i in range(out):
        pos = i / out * n
        for ch in range(channels):
            y = [s[(math.floor(pos) + k) % n * channels + ch] for k in (-2, -1, 0, 1, 2, 3)]
            z, v = pos - math.floor(pos) - 0.5, 0.0
            for k in range(5, -1, -1):
                pairs = [(y[3], y[2]), (y[4], y[1]), (y[5], y[0])]
                v = v * z + sum(w * (a + b if k % 2 == 0 else a - b) for w, (a, b) in zip(c[k], pairs, strict=True))
            res.append(math.trunc(max(-32767.0, min(32767.0, v))))
    return res


@pytest.mark.parametrize("channels", [1, 2])
def test_chunked_conditioning_equals_whole_signals(spark, channels):
    rnd = random.Random(7)
    rows, whole = [], {}
    for n in (1, 2, 3, 4, 15, 16, 17, 18, 19, 31, 33, 48, 50, 100):
        for rate in (8000, 44100, 48000, 96000):
            a = f"{n}-{rate}"
            s = [rnd.choice([rnd.randrange(-32768, 32767), rnd.randrange(-200, 200)]) for _ in range(n * channels)]
            level = rnd.choice(["none", "low", "extreme"])
            whole[a] = (s, rate, level)
            rows += [(a, c, channels, rate, level, s[k : k + 16 * channels]) for c, k in enumerate(range(0, len(s), 16 * channels))]
    rows += [("none", 0, channels, 8000, "low", [])]
    chunks = spark.createDataFrame(rows, "asset string, chunk_no long, channel_count int, frame_rate int, level string, samples array<int>")
    got = {}
    for r in signal.condition_chunks(chunks, chunk_frames=16, window=8).orderBy("asset", "chunk_no").collect():
        if r.asset == "none":
            assert r.samples == [] and r.frame_rate == 48000
            continue
        assert r.chunk_no == len(got.setdefault(r.asset, [])) // (16 * channels) and r.frame_rate == 48000
        got[r.asset] += r.samples
    gate, mask = {"none": 0, "low": 128, "extreme": 1024}, {"none": ~0, "low": ~3, "extreme": ~255}
    for a, (s, rate, level) in whole.items():
        v = s if rate == 48000 else resampled_by_definition(s, len(s) // channels * 48000 // rate, channels)
        want = []
        for k in range(0, len(v), 8 * channels):
            block = v[k : k + 8 * channels]
            want += [x & mask[level] for x in block] if max(map(abs, block)) >= gate[level] else [0] * len(block)
        assert got.get(a, []) == want, a


def test_gate_and_condition(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 500, 6, 7],)], "s array<int>")
    assert df.select(signal.silence_gate("s", 500, 2).alias("g")).first().g == [0, 0, 0, 0, 500, 6, 0]
    one = spark.createDataFrame([([100] * 64, 1, 48000, "none"), ([100] * 64, 1, 24000, "low")], "samples array<int>, channel_count int, frame_rate int, level string")
    a, b = signal.condition(one).orderBy(F.size("samples")).collect()
    assert a.samples == [100] * 64 and b.samples == [0] * 128


def test_side_files(spark, tmp_path):
    empty = spark.createDataFrame([], "Name string")
    sinks.write_table(empty, [C("Name"), C("Loop")], f"{tmp_path}/e")
    assert b"".join(f.read_bytes() for f in (tmp_path / "e").glob("part-*")) == b"Name,Loop\r\n"
    names = spark.createDataFrame([("beta",), ("alpha",), ("beta",), ("",)], "n string")
    sinks.write_names(names, f"{tmp_path}/n", "n")
    assert "".join(f.read_text() for f in sorted((tmp_path / "n").glob("part-*"))) == "Name\nalpha\nbeta\n"


def test_manifest_with_a_fault_is_refused(spark, tmp_path):
    m = spark.createDataFrame([("a", 1, 2048, 0, 3, "z", "l", "loaded"), ("a", 1, 2049, 1, 3, "z", "l", "loaded")], "name string, size long, `offset` long, `order` long, version int, zone string, language string, storage_class string")
    m.write.parquet(f"{tmp_path}/bad")
    m.limit(1).write.parquet(f"{tmp_path}/good")
    assert files.read_manifest(spark, f"{tmp_path}/bad").count() == 0
    assert files.read_manifest(spark, f"{tmp_path}/good", 3).count() == 1 and files.read_manifest(spark, f"{tmp_path}/good", 4).count() == 0
    assert files.read_manifest(spark, f"{tmp_path}/none").count() == 0


def test_streamed_manifest(spark, tmp_path):
    from assetloom.streaming.maintain import current, maintain

    path, schema = str(tmp_path / "m"), "name string, source_checksum string, seen_at int"
    assert current(spark, path) is None
    run = maintain(path, parts=4)
    rnd, want, batches = random.Random(1), {}, []
    for i in range(6):
        rows = [(f"k{rnd.randrange(30)}", str(rnd.randrange(3)), 100 * i + j) for j in range(rnd.choice([1, 2, 12]))]
        batches.append(rows)
        run(spark.createDataFrame(rows, schema), i)
        want.update({n: c for n, c, _ in rows})
        assert {r.name: r.source_checksum for r in current(spark, path).collect()} == want
    run(spark.createDataFrame(batches[-1], schema), 5)  # run again
    run(spark.createDataFrame([], schema), 6)
    got = current(spark, path)
    assert got.count() == len(want) and {r.name: r.source_checksum for r in got.collect()} == want
    folders = list((tmp_path / "m").glob("batch-*/__part=*"))
    assert len(folders) <= 2 * 4  # parts without a key of the batch aren't written, superseded ones go


def test_streamed_manifest_with_late_removed_and_null_rows(spark, tmp_path):
    from assetloom.streaming.maintain import current, maintain

    path, schema = str(tmp_path / "m"), "name string, source_checksum string, seen_at int, gone boolean"
    run = maintain(path, removed="gone", parts=2)
    batches = [
        [("a", "1", 3, None), ("b", "1", 1, False), (None, "x", 0, None), ("d", "1", None, None)],
        [("a", "0", -5, None), ("b", None, 2, True), (None, "y", 0, None), ("d", "2", 0, None)],
        [("b", "2", 1, None), ("c", "1", 1, None), ("d", "3", None, None), ("a", "4", 3, None)],
    ]
    want = [{"a": "1", "b": "1", "d": "1"}, {"a": "1", "d": "2"}, {"a": "4", "d": "2", "c": "1"}]
    for i, (rows, state) in enumerate(zip(batches, want, strict=True)):
        for _ in range(2):  # run again: nothing changes
            run(spark.createDataFrame(rows, schema), i)
            assert {r.name: r.source_checksum for r in current(spark, path).collect()} == state
    run(spark.createDataFrame([("b", "9", 7, None)], schema), 3)
    assert {r.name for r in current(spark, path).collect()} == {"a", "b", "c", "d"}
    assert sorted(r.source_checksum for r in spark.read.parquet(f"{path}/rejected").collect()) == ["x", "y"]


def test_a_failed_run_leaves_the_published_manifest(spark, tmp_path):
    from assetloom.sources import sinks, snapshots

    path, schema = str(tmp_path / "m"), "name string, size long, `offset` long, `order` long, version int, zone string, platform string, language string, storage_class string"
    one = spark.createDataFrame([("a", 1, 2048, 0, 1, "z", "pc", "l", "loaded"), ("a", 1, 2048, 0, 1, "z", "ps4", "l", "loaded")], schema)
    sinks.deploy(one, [path, path + "2"])
    assert files.read_manifest(spark, path, 1).count() == files.read_manifest(spark, path + "2", 1).count() == 2
    broken = one.withColumn("size", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        sinks.deploy(broken, [path])
    assert files.read_manifest(spark, path, 1).count() == 2
    for n in range(3):
        sinks.deploy(one.withColumn("version", F.lit(n + 2)), [path])
    assert files.read_manifest(spark, path, 4).count() == 2
    assert len(list((tmp_path / "m").glob("snapshot-*"))) == 2 and snapshots.current(spark, path).startswith("snapshot-")


def test_incremental_builds_do_what_changed(spark):
    import shutil
    from dataclasses import replace

    from assetloom.plans import incremental
    from assetloom.queries.signals import _written_inputs

    requests, inputs, root = _written_inputs(spark, "/root/testdata/sf0.001")
    state = f"{root}/state"
    entries = lambda d: sorted(map(tuple, d.manifest.select("zone", "name", "offset", "order", "version", "source_checksum").collect()))
    first = incremental.build(requests, inputs(), state)
    assert len(first.compiled) == 8 and first.hashed > 0 and {r.change for r in first.changes.collect()} == {"add"}
    want = entries(first)

    def never(*_):
        raise AssertionError("nothing has to be read")

    idle = lambda: replace(inputs(), read=never, hashed=never, zones=never, templates=never, platforms=never, locales=never)
    for what in ("rows", "bad", "hashes"):  # not even what was compiled before
        shutil.move(f"{state}/{what}", f"{state}/_{what}")
    again = incremental.build(requests, idle(), state)
    assert entries(again) == want and again.compiled == [] and again.hashed == 0 and again.build is None
    for what in ("rows", "bad", "hashes"):
        shutil.move(f"{state}/_{what}", f"{state}/{what}")

    # a run that fails leaves the state as it was; the next does what it had to do
    shutil.rmtree(f"{root}/tables/part=5".removeprefix("file:"))
    with pytest.raises(AssertionError, match="nothing"):
        incremental.build(requests, replace(inputs(), templates=never), state)
    assert entries(first) == want
    less = incremental.build(requests, inputs(), state)
    assert less.compiled == [] and [(r.kind, r.change) for r in less.changes.collect()] == [("table", "remove")]
    left = entries(less)
    lost = {r[1] for r in want} - {r[1] for r in left}
    assert lost and all(int(n.split("\\")[-1].split(".")[0]) % 8 == 5 for n in lost)
    # a shared input changes: all tables, no asset; then compacted, and still nothing to do
    (spark.createDataFrame([("t2",)], "value string").coalesce(1).write.mode("append").text(f"{root}/shared"))
    every = incremental.build(requests, inputs(), state)
    assert len(every.compiled) == 7 and every.hashed == 0
    incremental.compact(spark, state)
    last = incremental.build(requests, idle(), state)
    assert entries(last) == left and last.changes.isEmpty()


def test_chunked_plans_bring_no_signal_into_one_task(spark):
    chunks = spark.createDataFrame([("a", 0, 1, 8000, "low", [1] * 16)], "asset string, chunk_no long, channel_count int, frame_rate int, level string, samples array<int>")
    plan = signal.condition_chunks(chunks, chunk_frames=16, window=8)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = signal.condition_chunks(chunks, chunk_frames=16, window=8)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for at, line in enumerate(lines):
        if "Exchange hashpartitioning(asset" in line and "chunk_no" not in line.split("ENSURE")[0] and "__at" not in line.split("ENSURE")[0]:
            below = re.sub(r"size\(samples#\d+, \w+\)", "", lines[at + 1])  # by signal alone: sums and lengths, no samples
            assert "samples" not in below, below


def test_hop_sums_equal_plain_windows(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for n in (1, 10, 11, 12, 30, 64):
        for channels in (1, 2):
            s = [rnd.randrange(-3000, 3000) for _ in range(n * channels)]
            a = f"{n}-{channels}"
            rows += [(a, c, channels, s[k : k + 7 * channels]) for c, k in enumerate(range(0, len(s), 7 * channels))]
            for c in range(channels):
                x = s[c::channels]
                sums = [sum(v * v for v in x[k : k + 11]) for k in range(0, n, 3) if k + 11 < n]
                want[a, c] = 20 * math.log10(math.sqrt(max(sums) / 11) / 32768) if sums else -80.0
    chunks = spark.createDataFrame(rows, "asset string, chunk_no long, channel_count int, samples array<int>")
    got = {(r.asset, r.channel): r.rms_db for r in signal.windowed_rms_db(chunks, 11, 3, 7, channels="channel_count").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_corner_points_of_a_volume_with_many_faces(spark):
    """Planes around a ball: every corner by triples and planes in numpy."""
    import numpy as np

    from assetloom.operators import geometry

    normal = np.random.default_rng(2).standard_normal((24, 3))
    normal /= np.linalg.norm(normal, axis=1)[:, None]
    planes = [("v", i, [*(-n).tolist(), 5.0]) for i, n in enumerate(normal)]  # inside: n . p <= 5
    want = set()
    for i in range(24):
        for j in range(i + 1, 24):
            for k in range(j + 1, 24):
                m = normal[[i, j, k]]
                if abs(np.linalg.det(m)) >= 1e-6 and (normal @ np.linalg.solve(m, [5.0] * 3) <= 5.01).all():
                    want.add((i, j, k))
    df = spark.createDataFrame([*planes, ("none", 0, [1.0, 0.0, 0.0, -1.0]), ("none", 1, [-1.0, 0.0, 0.0, -1.0]), ("none", 2, [0.0, 1.0, 0.0, 0.0])], "volume string, face_no int, plane array<double>")
    got = geometry.inside_points(df).collect()
    assert {(r.i, r.j, r.k) for r in got if r.volume == "v"} == want and {r.volume for r in got} == {"v"}
    for r in got:
        m = normal[[r.i, r.j, r.k]]
        assert np.allclose(r.point, np.linalg.solve(m, [5.0] * 3), atol=1e-6)


def test_streamed_manifest_from_a_stream(spark, tmp_path):
    from assetloom.streaming.maintain import current, maintain

    schema = "name string, source_checksum string, seen_at int"
    for i, rows in enumerate([[("a", "1", 1), ("b", "1", 1)], [("b", "2", 2), ("c", "1", 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = spark.readStream.schema(schema).json(str(tmp_path / "in")).writeStream.foreachBatch(maintain(str(tmp_path / "m"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {r.name: r.source_checksum for r in current(spark, str(tmp_path / "m")).collect()} == {"a": "1", "b": "2", "c": "1"}


def lines_below(path):
    out = {}
    for f in sorted(path.rglob("part-*")):  # in the order of their names
        at = str(f.parent.relative_to(path))
        out[at] = out.get(at, "") + f.read_bytes().decode()
    return out


def test_side_files_of_a_build(spark, tmp_path):
    from assetloom.queries.signals import build_inputs

    requests, ctx = build_inputs(spark, "/root/testdata/sf0.001")
    ctx.sources = stored(ctx.sources.withColumn("Duck", F.when(F.col("__row") % 2 == 0, " music ").otherwise("Default")))
    requests = requests.unionByName(requests.withColumn("platform", F.lit("ps4")))
    ctx.platforms = spark.createDataFrame([("pc", 0.5), ("ps4", 1.0)], "Platform string, CompressionScale float")
    b = jobs.build(requests, ctx)
    assert {(r.platform, r.version) for r in b.manifest.select("platform", "version").distinct().collect()} == {("pc", 1), ("ps4", 1)}
    zones = [("east",), ("west",)]
    side = jobs.Side(
        ambients=complete(spark.createDataFrame([("east", "b", "wind"), ("east", "a", "DEFAULT")], "zone string, Name string, Duck string"), P.AMBIENT),
        reverbs=complete(spark.createDataFrame([("east", "hall"), ("east", "room"), ("west", "cave")], "zone string, Name string"), P.REVERB),
        script_ids=complete(spark.createDataFrame([], "zone string, ScriptId string, AliasName string"), P.SCRIPT_ID),
        ducks=spark.createDataFrame([("east", "ducks/default.duk"), ("east", "x.duk")], "zone string, file string"),
        music=spark.createDataFrame([(*z, "m/theme.mus") for z in zones], "zone string, file string"),
    )
    jobs.write_outputs(b, requests, ctx.locales, side, str(tmp_path / "out"))
    got = {k: lines_below(tmp_path / "out" / k) for k in ("alias", "reverb", "ambient", "scriptid", "ducklist", "musiclist", "memory", "assetcount", "assets")}
    every = {f"by_zone={z}/by_platform={p}/by_language={lang}" for z in ("east", "west") for p in ("pc", "ps4") for lang in ("all", "french")}
    assert set(got["alias"]) == every and all(t.startswith("Name,") and t.endswith("\r\n") for t in got["alias"].values())
    assert set(got["reverb"]) == {f"by_zone={z}/by_platform={p}/by_language=all" for z in ("east", "west") for p in ("pc", "ps4")}  # shared locales only
    reverbs = got["reverb"]["by_zone=east/by_platform=pc/by_language=all"].split("\r\n")
    assert [r.split(",")[0] for r in reverbs] == ["Name", "room", "hall", ""]
    assert [r.split(",")[0] for r in got["ambient"]["by_zone=east/by_platform=pc/by_language=all"].split("\r\n")] == ["Name", "a", "b", ""]
    assert set(got["ambient"]) == set(got["reverb"]) and got["ambient"]["by_zone=west/by_platform=pc/by_language=all"].count("\r\n") == 1  # only a header
    assert [t.split(",")[0] for t in got["scriptid"].values()] == ["ScriptId"] * 4
    assert got["ducklist"]["by_zone=east/by_platform=pc/by_language=all"] == "Name\ndefault\nmusic\nwind\nx\n"
    assert got["musiclist"]["by_zone=west/by_platform=pc/by_language=all"] == "Name\ntheme\n"
    loaded = b.manifest.filter("storage_class = 'loaded' and zone = 'east' and platform = 'pc' and language = 'all'").orderBy("offset").collect()
    at = "by_zone=east/by_platform=pc/by_language=all"
    assert got["assets"][at].splitlines() == [r.name for r in loaded]
    assert loaded and all(".ps4." in n for n in got["assets"][at.replace("pc", "ps4")].splitlines()) and [r.order for r in loaded] == list(range(len(loaded)))
    assert got["memory"][at] == f"{sum(r['size'] for r in loaded)}\n" and got["assetcount"][at] == f"{len(loaded)}\n"


def test_headers_of_streams_beyond_their_field(spark, tmp_path):
    """Totals below, at and far beyond the 36 bits that a header has for them."""
    from assetloom.queries import QUERIES

    keys = [0, 1, 68_719, 68_720, 149_999, 9_000_001]
    spark.createDataFrame([(k, 3 * k) for k in keys], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: tuple(r)[1:] for r in QUERIES["s14_flac_streaminfo"](spark, str(tmp_path)).collect()}
    assert got == {k: (8000 + 3 * k % 184000, 1 + k % 2, 16, k * 1000003) for k in keys}


def test_candidates_that_draw_the_same_line(spark):
    """Lines that differ by their times only have equal errors, which running sums tell apart by what they round off."""
    rng = random.Random(9)
    n, buckets, cands, want = 200, [], [], {}
    for a in range(20):
        v = [1e5 + rng.randrange(20) / 7 for _ in range(n)]
        buckets += [(str(a), i, x) for i, x in enumerate(v)]
        best = None
        for ordinal in range(12):
            first = 1e5 + rng.choice([1, 1, 2])
            level = [first, 1e5 + 1, 1e5 + 1, 1e5 + 1]
            time = [0.0, 0.2, rng.randrange(41, n - 1) / n, 1.0]
            q = [0, math.floor(time[1] * (n - 1)), math.floor(time[2] * (n - 1)), n - 1]
            total = 0.0
            for i in range(n - 1):
                k = 0 if i < q[1] else 1 if i < q[2] else 2
                t = (i - q[k]) / (q[k + 1] - q[k])
                e = level[k] * (1 - t) + level[k + 1] * t - v[i]
                total += e * e
            cands.append((str(a), ordinal, level, time, n))
            scaled = total / n * 1e8
            best = min(x for x in (best, (math.floor(scaled) + (scaled - math.floor(scaled) >= 0.5), ordinal)) if x)
        want[str(a)] = best[1]
    c = spark.createDataFrame(cands, "asset string, ordinal long, level array<double>, time array<double>, n long")
    got = signal.score_candidates(c, spark.createDataFrame(buckets, "asset string, i int, v double"))
    assert {r.asset: r.ordinal for r in got.collect()} == want


def test_groups_of_few_wide_rows_are_split(spark, monkeypatch):
    """Few rows, but more bytes than a task takes."""
    split, ranged = [], tables._ranged
    monkeypatch.setattr(tables, "_ranged", lambda *a: split.append(a) or ranged(*a))
    df = spark.range(60).select("id", F.lit("g").alias("g"), (F.col("id") % 7).alias("size"), F.repeat(F.lit("x"), F.lit(3 << 20)).alias("text"))
    got = tables.running(df, ["g"], ["id"], "size", "before").select("id", "before")
    assert len(split) == 1 and [r.before for r in got.orderBy("id").collect()] == [sum(j % 7 for j in range(i)) for i in range(60)]
    got = tables.previous(df, ["g"], ["id"], "size", "last").select("id", "last")
    assert len(split) == 2 and [r.last for r in got.orderBy("id").collect()] == [None, *[i % 7 for i in range(59)]]
    tables.running(df.drop("text"), ["g"], ["id"], "size", "before")
    assert len(split) == 2


def test_rows_of_one_file_are_compiled_by_many_tasks(spark):
    """A small file of many rows is one task, whose rows become wide."""
    some = spark.range(0, 1000, 1, 1).select(F.lit("z").alias("zone"), F.lit(None).cast("string").alias("source_level"), F.concat(F.lit("a"), "id").alias("Name"), F.lit("snd/a.wav").alias("FileSpec"), F.lit("f.csv").alias("__file"), F.col("id").alias("__row"))
    assert tables.spread(some, ["__file", "__row"], rows=50).rdd.getNumPartitions() == 20
    rows, _ = jobs.compile_rows(complete(some, P.ALIAS), spark.createDataFrame([("z", "low")], "zone string, zone_level string"), complete(spark.createDataFrame([("t",)], "Name string"), P.ALIAS))
    held = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 1000 and len(held) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_specs_carry_columns_of_their_row(spark):
    df = spark.createDataFrame([(1, "a", " ", "LOOPING", "x"), (2, "b", "c", None, "y")], "id long, one string, two string, Looping string, more string")
    got = resolve.unpivot_specs(df, "id", {"main": "one", "sustain": "two"}, carried=["more"])
    assert sorted(map(tuple, got.collect())) == [(1, "main", "a", "LOOPING", "x"), (2, "main", "b", None, "y"), (2, "sustain", "c", "LOOPING", "y")]


def _alias_rows(spark, some):
    frame = spark.createDataFrame(some, "zone string, Name string, FileSpec string, Template string, __file string, __row long")
    return complete(frame.withColumn("source_level", F.lit(None).cast("string")), P.ALIAS)


def test_rows_are_compiled_once_with_their_faults(spark):
    """What is stored of a compilation gives rows and violations without another."""
    from assetloom.sources.scratch import stored

    some = [("z", "a", "s/a.wav", None, "f", 1), ("z", "b c", "s/b b.wav", "no", "f", 2), ("z", "d", "s/d.wav", "T", "g", 3), ("none", "e e", "s/e.wav", "no", "g", 4)]
    zones = spark.createDataFrame([("z", "low")], "zone string, zone_level string")
    checked = stored(jobs.checked_rows(_alias_rows(spark, some), zones, complete(spark.createDataFrame([("t",)], "Name string"), P.ALIAS)))
    rows, bad = jobs.accepted_rows(checked), jobs.bad_rows(checked)
    for frame in (rows, bad):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
    assert sorted(r.Name for r in rows.collect()) == ["a", "d"] and not {"__ok", "__bad"} & set(rows.columns)
    got = sorted((r.zone, r.key, r.rule, r.detail, r["__file"]) for r in bad.collect())
    # a row of no known zone is told of for its reference only
    assert [g[:3] for g in got] == [("none", "e e", "unknown template"), ("z", "b c", "FileSpec has a space"), ("z", "b c", "Name has a space"), ("z", "b c", "unknown template")]
    assert got[0][3:] == ("no", "g") and got[2][3:] == ("b c", "f")


def test_wide_rows_without_a_double_are_not_moved(spark):
    some = [("z", f"a{i % 7}", "s.wav", None, f"f{i % 3}", i) for i in range(20)] + [("y", f"b{i}", "s.wav", None, "f", i) for i in range(20)]
    rows = _alias_rows(spark, some)
    at = lambda df: sorted((r.zone, r.Name, r["__file"], r["__row"]) for r in df.collect())
    assert at(jobs.first_stored_rows(rows)) == at(jobs.first_rows(rows)) and jobs.first_rows(rows).count() == 27
    single = rows.filter("zone = 'y'")
    assert "Window" not in jobs.first_stored_rows(single)._jdf.queryExecution().executedPlan().toString() and jobs.first_stored_rows(single).count() == 20
