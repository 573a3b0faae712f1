"""Mixing, line dedup, neighbours, near-duplicates, quality and decontamination against brute force; the pipeline."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assetloom.llm import decontaminate, linededup, minhash, mixing, neighbours, quality
from assetloom.llm import queries as q
from assetloom.llm._common import components, led

SMALL = "/root/testdata/sf0.001"


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(rows):
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [(i, bag(t), t or "") for i, t in rows]
    for a in range(len(bags)):
        for b in range(a):
            (i, x, s), (j, y, t) = bags[a], bags[b]
            both = sum((x & y).values())
            if s == t or (both and both / (sum(x.values()) + sum(y.values()) - both) >= 0.8):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i, _ in rows}


def test_classes_equal_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    for i in range(60):  # one family whose members differ from one another more than from its head
        w = list(base)
        for _ in range(rnd.randrange(0, 5)):
            w[rnd.randrange(120)] = f"v{rnd.randrange(10**6)}"
        rows.append((10_000 + i, " ".join(w)))
    for i in range(20):  # repeated shingles: multisets count
        rows.append((20_000 + i, " ".join(["a b c d e"] * (10 + i))))
    got = minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows) and len(got) == len(rows)


def test_class_edge_cases(spark, odd):
    got = minhash.near_duplicate_classes(odd).collect()
    assert len(got) == 9
    by = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert by == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6} and all(r.class_id is None for r in got if r.doc_id is None)
    assert minhash.near_duplicate_classes(odd.limit(0)).count() == 0
    kept = minhash.first_of_classes(odd)
    assert kept.columns == odd.columns and sorted(r[0] for r in kept.collect() if r[0] is not None) == [1, 2, 4, 5, 6]
    two = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l")], "doc_id long, text string")
    assert {r.class_id for r in minhash.near_duplicate_classes(two).collect()} == {1}


def test_components_of_a_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        keys = rng.integers(1, 2**62, 40).astype(np.uint64)
        a = rng.integers(0, 9, 40)
        b = np.where(rng.random(40) < 0.6, a, rng.integers(0, 9, 40))
        h = np.concatenate([np.repeat(keys, a), np.repeat(keys, b)])
        s = minhash.bag_signatures(h, np.repeat([0, 1], [a.sum(), b.sum()]), 2, 512)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.035


def brute_lines(rows, least_lines=3, least_words=50, longest=9):
    """Lines of any run that is large enough and equals an earlier one, which it doesn't overlap: all runs, one by one."""
    lines = {i: [tuple(x.split()) for x in text.split("\n") if x.split()] for i, text in rows}
    seen, gone = {}, {i: set() for i in lines}
    for i in sorted(lines):
        for s in range(len(lines[i])):
            for t in range(s, min(len(lines[i]), s + longest)):
                run = tuple(lines[i][s : t + 1])
                if len(run) < least_lines and sum(map(len, run)) < least_words:
                    continue
                j, u, v = seen.setdefault(run, (i, s, t))
                if (j, u) != (i, s) and not (j == i and s <= v):
                    gone[i].update(range(s, t + 1))
    return {i: [" ".join(x) for j, x in enumerate(lines[i]) if j not in gone[i]] for i in lines}


@pytest.mark.parametrize("size", [(3, 50), (2, 12), (1000, 30)])
def test_line_dedup_equals_brute_force(spark, docs, size):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rnd = random.Random(9)
    pool = [" ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.choice([1, 4, 12, 30, 60]))) for _ in range(60)]
    for i in range(300):
        at = rnd.randrange(50)
        run = pool[at : at + rnd.randrange(1, 9)]
        fresh = [" ".join(f"u{rnd.randrange(10**6)}" for _ in range(10)) for _ in range(3)]
        rows.append((10_000 + i, "\n".join(fresh[:1] + run + fresh[1:])))
    rows += [(20_000, "\n".join(["a b c d e"] * 30)), (20_001, "\n".join(["x", *["a b c d e"] * 11]))]
    out = linededup.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), *size).collect()
    got = {r.doc_id: [" ".join(x.split()) for x in r.text.split("\n") if x.split()] for r in out}
    want = brute_lines(rows, *size, longest=31)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_line_dedup_edge_cases(spark, odd):
    out = linededup.drop_repeated_runs(odd, count_col="cut")
    assert out.columns == [*odd.columns, "cut"] and out.count() == 9
    assert sorted(map(str, out.drop("cut").collect())) == sorted(map(str, odd.collect()))
    run = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"head\n{run}\n"), (2, f"{run}\ntail"), (3, run), (None, f"{run}\n{run}")]
    got = {r.doc_id: r.text for r in linededup.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: run, 1: "head\n", 2: "tail", 3: ""}
    assert linededup.drop_repeated_runs(odd.limit(0)).count() == 0


def test_line_dedup_of_long_texts_and_a_line_everywhere(spark):
    run = "\n".join(f"line {i} of the run" for i in range(5))
    rows = [(i, f"own {i}\n{run}\nend {i}") for i in range(3000)] + [(5000, "\n".join(f"long {i % 40_000}" for i in range(80_000)))]
    got = {r.doc_id: r for r in linededup.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), count_col="cut").collect()}
    assert got[0].cut == 0 and all(got[i].cut == 5 and got[i].text == f"own {i}\nend {i}" for i in range(1, 3000))
    assert got[5000].cut == 40_000


@pytest.mark.parametrize("parts", [1, 7])
def test_leads_of_keys(spark, parts):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 1, 2, rnd.randrange(100)]), rnd.choice([None, *range(50)]), i % 3) for i in range(5000)]
    got = led(spark.createDataFrame(rows, "k long, a long, b long"), ["k"], ["a", "b"]).collect()
    spark.conf.set("spark.sql.shuffle.partitions", was)
    low = {}
    for k, a, b in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        low.setdefault(k, (a, b))
    assert len(got) == len(rows) and all((r.lead_a, r.lead_b) == low[r.k] for r in got)
    assert max(Counter((r.k, r.chunk) for r in got).values()) <= 1024


def test_decontamination(spark, docs, odd):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    rnd = random.Random(2)
    rows = []
    for i, text in enumerate(list(items.values())[:20]):
        w = text.split()
        parts = [w[j : j + 7] for j in range(0, len(w), 7)]
        rnd.shuffle(parts)
        rows.append((10_000 + i, "before it " + " and then something else ".join(" ".join(p) for p in parts) + " after it"))
    rows += [(20_000 + i, " ".join(t.split()[: len(t.split()) // 4])) for i, t in enumerate(list(items.values())[:20])]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = decontaminate.contaminated_pairs(both, bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    ids = list(items)
    assert all((10_000 + i, ids[i]) in found for i in range(20)) and not any(d >= 20_000 for d, _ in found)
    whole = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if " ".join(t.split()) in " ".join(r.text.split())}
    assert whole and whole <= found
    blocks = decontaminate.contaminated_pairs(both, bench, block_bytes=500).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, got))
    left = {r.doc_id for r in decontaminate.without_contaminated(both, bench, block_bytes=500).collect()}
    assert left == {r.doc_id for r in both.collect()} - {d for d, _ in found}
    assert decontaminate.contaminated_pairs(odd, bench).count() == 0
    assert decontaminate.without_contaminated(odd, bench).columns == odd.columns
    assert decontaminate.contaminated_pairs(odd, bench.limit(0)).count() == 0
    assert decontaminate.contaminated_pairs(odd.limit(0), bench).count() == decontaminate.without_contaminated(odd.limit(0), bench).count() == 0
    assert decontaminate.without_contaminated(odd, bench).count() == decontaminate.without_contaminated(odd, bench.limit(0)).count() == 9


def plain_words(text):
    import re
    import unicodedata

    t = unicodedata.normalize("NFKC", text or "").lower()
    t = "".join(" " if unicodedata.category(c)[0] in "PSZC" else c for c in t)
    return re.sub("([\u3041-\u30ff\u4e00-\u9fff])", r" \1 ", t).split()


def brute_tiles(passage, text, least):
    """Greedy tiling by looking at every pair of places in every round."""
    a, b = plain_words(passage), plain_words(text)
    least = min(least, len(a))
    mine, other, out = [True] * len(a), [True] * len(b), []
    while a:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and mine[i + n] and other[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            break
        mine[i : i + n], other[j : j + n] = [False] * n, [False] * n
        out.append(n)
    return sum(out), len(a), len(out)


def test_tiling_equals_brute_force(spark):
    rnd = random.Random(12)
    vocabulary = ["a", "b", "c", "été", "Größe", "x", "漢", "Y", "ΣΑΣ"]
    passages = [" ".join(rnd.choice(vocabulary[: rnd.choice([2, 5, 9])]) for _ in range(rnd.choice([1, 3, 5, 8, 14, 25]))) for _ in range(40)] + ["", None]
    texts = []
    for i in range(150):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randrange(20))]
        for _ in range(rnd.randrange(3)):
            p = (passages[rnd.randrange(40)] or "").split()
            lo = rnd.randrange(max(1, len(p)))
            w += [x.upper() + rnd.choice(["", ",", "“", "…", "!"]) for x in p[lo : lo + rnd.randrange(3, 25)]]
        texts.append(" ".join(w))
    texts += ["漢字かな、漢字", "", None, "a a a a a " * 60]
    passages += ["漢字かな", "a a a a a a a a a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.covered, r.item_words, r.n_tiles) for r in decontaminate.contaminated_pairs(docs, bench, least=3).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, p in enumerate(passages):
            covered, size, n = brute_tiles(p, t, 3)
            if size and covered and covered >= 0.5 * size:
                want[d, i] = (covered, size, n)
    assert len(want) > 100 and {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {}
    left = {r.doc_id for r in decontaminate.without_contaminated(docs, bench, least=3, block_bytes=200).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in want}


def test_tiling_of_repetitive_texts_is_fast(spark):
    import time

    docs = spark.createDataFrame([(1, "one two three four five " * 20_000), (2, "x " * 200_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, "one two three four five " * (i + 1)) for i in range(20)], "item_id long, text string")
    began = time.time()
    assert decontaminate.contaminated_pairs(docs, bench).count() == 20 and time.time() - began < 30


def test_runs_equal_brute_force():
    rng = np.random.default_rng(8)
    for kinds in (1, 2, 3, 9):
        for _ in range(40):
            a, b = rng.integers(0, kinds, rng.integers(1, 12)), rng.integers(0, kinds + 1, rng.integers(1, 20))
            want = []
            for i in range(len(a)):
                for j in range(len(b)):
                    if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                        n = 0
                        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                            n += 1
                        want.append((n, i, j))
            assert sorted(decontaminate.runs(a.astype(np.uint64), b.astype(np.uint64))) == sorted(want)


def test_repetitive_texts_and_passages_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    items = decontaminate.Items(list(range(20)), ["x " * (1000 + i) for i in range(20)], 5)
    tracemalloc.start()
    got = list(items.search(pa.array(["x " * 20_000, "y " * 20_000, "x y " * 10_000]), 0.5))
    assert [(d, i, c, n) for d, i, c, n, _ in got] == [(0, i, 1000 + i, 1000 + i) for i in range(20)]
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_tiles_do_not_overlap_and_longest_comes_first():
    items = decontaminate.Items([1], ["a b c d e f g h i j"], 3)
    import pyarrow as pa

    (hit,) = items.search(pa.array(["f g h i j x a b c d e y a b c"]), 0.5)
    assert hit == (0, 0, 10, 10, 2)


def test_quality_on_held_out_labels(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter("doc_id % 2 = 0")
    model = quality.train(docs, known)
    rows = quality.scored(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good, poor = [r.keep for r in rows if r.quality == 1], [r.keep for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.98 and np.mean(poor) <= 0.15


def shaped(spark, n, poor, labelled, odd=0):
    """n documents of words, of which those in ``poor`` are junk; the last ``odd`` are worse junk with a length of their own."""
    rnd = random.Random(9)
    rows = []
    for i in range(n):
        junk = i in poor or i >= n - odd
        words = [rnd.choice(["##|<>", "%%&*{}", "11223", "AAXX!"]) if junk and (i >= n - odd or rnd.random() < 0.7) else rnd.choice(["river", "stone", "of", "the", "winter", "table"]) for _ in range(rnd.randint(20, 60))]
        rows.append((i, " ".join(words), "en", "web" if i < n - odd else "rare", 1_000_000 + i if i >= n - odd else 300 + rnd.randrange(200)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([(i, int(i not in poor)) for i in labelled], "doc_id long, quality int")


def test_quality_sample_keeps_rare_classes(spark):
    poor = set(range(0, 6000, 150))
    docs, labels = shaped(spark, 6000, poor, range(6000))
    model = quality.train(docs, labels, max_labelled=120)
    assert model is not None
    kept = {r.doc_id for r in quality.scored(docs, model, only_kept=True).collect()}
    assert len(kept & poor) <= 2 and len(kept) >= 5900


def test_quality_exchange_sees_every_unlabelled_document(spark, monkeypatch):
    poor = set(range(0, 200, 4))
    docs, labels = shaped(spark, 12_020, poor, range(200), odd=20)
    seen, fit = set(), quality.Logistic.fit

    def spy(self, x, y, weight):
        seen.update(np.round(np.expm1(x[:, 0])).astype(int).tolist() if x.shape[1] > 20 else [])
        return fit(self, x, y, weight)

    monkeypatch.setattr(quality.Logistic, "fit", spy)
    assert quality.train(docs, labels) is not None
    assert {1_000_000 + i for i in range(12_000, 12_020)} <= seen


@pytest.mark.parametrize("flipped", [10, 20])
def test_quality_with_wrong_labels(spark, flipped):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    wrong = F.pmod(F.xxhash64("doc_id"), F.lit(1000)) < flipped
    known = labels.filter("doc_id % 2 = 1").select("doc_id", F.when(wrong, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    rows = quality.scored(docs, quality.train(docs, known)).join(labels.filter("doc_id % 2 = 0"), "doc_id").collect()
    assert np.mean([r.keep for r in rows if r.quality == 1]) >= 0.99 and np.mean([r.keep for r in rows if r.quality == 0]) <= 0.15


def test_quality_cut():
    p, y = np.array([0.01, 0.02, 0.3, 0.6, 0.9, 0.95]), np.array([1, 0, 1, 1, 1, 1])
    assert quality._cut(p, y, 0.2, 0.5) == 0.3
    assert quality._cut(p, np.array([1, 0, 0, 1, 1, 1]), 0.2, 0.5) == 0.5


def test_quality_features_equal_brute_force():
    import math

    import pyarrow as pa

    texts = ["Ab c, 12!\nab ab |x|", "", None, "ünï x", "word " * 300 + "other other", "A" * 5000]
    shape, bag = quality.text_features(pa.array(texts))
    classes = quality._CLASSES
    for row, counts, text in zip(shape, bag, texts, strict=True):
        raw, words = (text or "").encode(), (text or "").encode().split()
        share = [sum(b in c for b in raw) / max(len(raw), 1) for c in classes] + [sum(b >= 128 for b in raw) / max(len(raw), 1)]
        n = max(len(words), 1)
        again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
        rest = [math.log1p(sum(map(len, words)) / n), again, len(set(words)) / n, math.log1p(n), len(set(words)) / n * math.log1p(n)]
        assert np.allclose(row, [math.sqrt(x) for x in share] + rest)
        folded = "".join(c.lower() if c.isalnum() or ord(c) > 127 else " " for c in (text or "")).split()
        assert counts.sum() == len(folded)  # no count is cut
    codes = quality.metadata_codes(pa.array(["en", None]), pa.array(["a", "a"]), pa.array([100, None]))
    view = quality.metadata_features(codes)
    assert view.shape == (2, 4 + 2 * quality._BUCKETS) and view[:, 4:].sum() == 4 and view[1, 0] == 0 and (view[0, -quality._BUCKETS :] == view[1, -quality._BUCKETS :]).all()


def test_quality_scores_equal_the_formula(spark):
    docs, known = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, known)
    rows = docs.collect()
    import pyarrow as pa

    batch = pa.table({c: [r[c] for r in rows] for c in ("text", "lang", "source", "n_chars")}).combine_chunks().to_batches()[0]
    views = quality._views(quality._rows(batch, batch.schema.names))
    one = [m.w[0] + ((x - m.mean) / m.scale) @ m.w[1:] for m, x in zip((model.text, model.meta), views, strict=True)]
    joint = model.joint.w[0] + ((np.column_stack([np.clip(x, -30, 30) for x in one]) - model.joint.mean) / model.joint.scale) @ model.joint.w[1:]
    want = dict(zip([r.doc_id for r in rows], 1 / (1 + np.exp(-joint - model.shift)), strict=True))
    got = {r.doc_id: r.quality_score for r in quality.scored(docs, model).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_quality_edge_cases(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.train(odd, labels.limit(0)) is None
    out = quality.scored(odd, quality.train(odd, labels))
    assert out.columns == [*odd.columns, "quality_score", "keep"] and out.count() == 9
    docs, known = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, known)
    assert quality.scored(odd, model).count() == 9 and quality.scored(odd, model, only_kept=True).columns == odd.columns
    assert quality.scored(odd.limit(0), model).count() == 0 and quality.train(odd.limit(0), labels) is None
    twice = quality.scored(quality.scored(docs, model), model)
    assert twice.columns == [*docs.columns, "quality_score", "keep"] and twice.filter("quality_score is null").count() == 0
    bare = quality.train(docs.select("doc_id", "text"), known)
    assert bare is None or quality.scored(docs.select("text", "doc_id"), bare).count() == docs.count()


def brute_nearest(vectors, ids, k=5):
    rows = sorted(vectors.items())
    m = np.array([v for _, v in rows], float)
    norm = np.linalg.norm(m, axis=1)
    out = {}
    for x in ids:
        v = np.array(vectors[x], float)
        s = np.round(m @ v / (norm * np.linalg.norm(v)), 12)
        best = sorted((-s[i], rows[i][0]) for i in range(len(rows)) if rows[i][0] != x)[:k]
        out[x] = [b for _, b in best]
    return out


def recall(spark, vectors, **options):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    held = {r.vec_id: r.embedding for r in df.collect()}
    asked = [i for i in held if i % 50 == 0]
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(df, df.filter("vec_id % 50 = 0"), **options).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append(r.vec_id)
    want = brute_nearest(held, asked)
    return np.mean([len(set(got[i]) & set(want[i])) / len(want[i]) for i in asked]), got, want


def test_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((40, 32))
    clustered = {i: centre[i % 40] * 2 + rng.standard_normal(32) for i in range(6000)}
    assert recall(spark, clustered, block=256)[0] >= 0.9
    loose = {i: rng.standard_normal(32) for i in range(6000)}
    assert recall(spark, loose, block=256)[0] >= 0.9


def test_neighbours_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.standard_normal(8) for i in range(300)} | {i: np.ones(8) for i in range(300, 900)}
    share, got, want = recall(spark, vectors, block=64)
    assert all(got[i] == want[i] for i in got if 300 <= i)  # equal vectors: the smallest ids
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 2.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    out = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in neighbours.nearest(df, df.filter("vec_id % 50 = 0")).collect()]
    assert sorted(out) == [(0, 1, 7, 1.0), (0, 2, 50, 0.707107), (50, 1, 0, 0.707107), (50, 2, 7, 0.707107)]
    assert neighbours.nearest(df.filter("vec_id = 1")).count() == 0


def test_hilbert_curve_is_continuous():
    for bits, axes in ((4, 2), (3, 3), (2, 4)):
        n = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(n)] * axes, indexing="ij"), -1).reshape(-1, axes)
        path = cells[np.argsort(neighbours.hilbert(cells, bits))]
        assert len(set(neighbours.hilbert(cells, bits).tolist())) == len(cells)
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def solve(p, n, want):
    """The least squares by numpy: plain steps until nothing moves."""
    total = n.sum()
    m = (p * n[:, None]).T @ p / total
    h = np.linalg.inv(m + 1e-6 * np.trace(m) * np.eye(3))
    rate = np.full(len(n), want.sum())
    for _ in range(20_000):
        rate = np.maximum(0, rate - p @ h @ ((p * (n * rate)[:, None]).sum(0) / total - want))
    return (p * (n * rate)[:, None]).sum(0) / total


def test_mixing_meets_targets(spark, docs, odd):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    targets = {"good": 0.7, "poor": 0.2, "toxic": 0.1}
    far = mixing.mix(docs, labels, targets={"toxic": 1.0}).collect()
    assert all(r.rate >= 0 for r in far) and any(r.rate == 0 for r in far)
    rows = mixing.mix(docs, labels, targets=targets).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    n = np.array([r.n_tokens for r in rows], float)
    p = np.array([[r.p_good, r.p_poor, r.p_toxic] for r in rows])
    assert [r.n_tokens for r in sorted(rows)] == [len(r.text.split()) for r in sorted(docs.collect())]
    assert np.allclose(p.sum(1), 1, atol=1e-5)
    got = (p * (n * np.array([r.rate for r in rows]))[:, None]).sum(0) / n.sum()
    want = np.array(list(targets.values()))
    best = solve(p, n, want)
    assert np.linalg.norm(got - want) <= np.linalg.norm(best - want) + 2e-3
    out = mixing.mix(odd, labels.limit(0)).collect()
    assert len(out) == 9 and all(abs(r.p_good - 1 / 3) < 1e-5 for r in out)
    assert mixing.mix(odd.limit(0), labels).count() == 0
    assert {r.rate for r in mixing.mix(odd.filter("doc_id in (2, 3)"), labels).collect()} == {1.0}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_mixing_reaches_targets_within_reach(spark, size):
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    steps = []
    got = mixing.mix(docs, labels, steps=steps)
    shares = got.selectExpr(*[f"sum(rate * n_tokens * p_{d}) / sum(n_tokens) as {d}" for d in mixing.DOMAINS]).first().asDict()
    assert steps[-1] <= 1e-6 and all(abs(shares[d] - mixing.TARGETS[d]) < 1e-4 for d in mixing.DOMAINS)


def test_mixing_ends_at_the_nearest_point(spark):
    """Targets out of reach: the distance is that of a nonnegative least squares over the rays of the posteriors."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    steps = []
    rows = mixing.mix(docs, labels, targets={"toxic": 1.0}, steps=steps).collect()
    n, p = np.array([r.n_tokens for r in rows], float), np.array([[r.p_good, r.p_poor, r.p_toxic] for r in rows])
    m = (p * n[:, None]).T @ p / n.sum()
    root = np.linalg.cholesky(np.linalg.inv(m + 1e-6 * np.trace(m) * np.eye(3))).T
    rays, goal = root @ p[n > 0].T, root @ np.array([0, 0, 1.0])
    nearest = min(  # on a ray, between two, or inside three: here rays and pairs, as the target lies outside
        np.linalg.norm(part @ np.maximum(0, np.linalg.lstsq(part, goal, rcond=None)[0]) - goal)
        for part in [rays[:, [i, j]] for i in np.argsort(-(goal @ rays) / np.linalg.norm(rays, axis=0))[:60] for j in range(rays.shape[1])]
    )
    assert abs(steps[-1] - nearest) < 1e-3 * nearest


def test_posteriors_equal_the_formula(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = mixing.fit_domains(docs.select(F.col("doc_id").alias("id"), "text"), labels, 4000, 128)
    got = {r.doc_id: r.p for r in docs.select("doc_id", mixing.posterior(mixing.features(F.col("text"))["f"], model).alias("p")).collect()}
    for r in docs.collect():
        words = r.text.lower().split()
        repeats = f"repeats {len(set(words)) * 8 // max(len(words), 1)} {int(np.log2(len(words) + 1) / 2)}"
        z = np.array(model["absent"]) + sum((np.array(model["words"][w]) for w in {*words, repeats} & model["words"].keys()), np.zeros(3))
        z = np.array(model["prior"]) + z * model["temper"]
        assert np.allclose(got[r.doc_id], np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    few = [mixing.fit_domains(docs.select(F.col("doc_id").alias("id"), "text").repartition(n), labels, 40, 128) for n in (1, 7)]
    assert few[0] == few[1]


def test_mixing_classifier_knows_domains(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.mix(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good, poor = [r.p_poor for r in rows if r.quality == 1 and r.toxic == 0], [r.p_poor for r in rows if r.quality == 0 and r.toxic == 0]
    assert np.mean(poor) > 3 * np.mean(good)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    cur = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in cur.collect()}
        cur = stage(spark, cur, SMALL).persist()
        assert cur.columns == docs.columns, name
        after = {r.doc_id: r.text for r in cur.collect()}
        assert set(after) <= set(before)
        if name == "line dedup":
            want = brute_lines(sorted(before.items()))
            assert {i: [" ".join(x.split()) for x in t.split("\n") if x.split()] for i, t in after.items()} == want
        if name == "MinHash near-dedup":
            classes = brute_classes(list(before.items()))
            assert set(after) == set(classes.values())
        if name == "benchmark decontamination":
            hit = {r.doc_id for r in decontaminate.contaminated_pairs(docs, bench).collect()}
            assert hit & set(before) and not hit & set(after)
    out = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in out.collect()} == set(after)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("set threads = 4")
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = q.QUERIES[name](spark, SMALL)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({q.SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*cols).collect())
