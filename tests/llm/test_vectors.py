"""Whitening, fingerprints and hard negatives against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from assetloom.llm import hardneg, piecewise, queries, whitening
from assetloom.llm._common import pick

SMALL = "/root/testdata/sf0.001"
_ALL = (1 << 64) - 1


def plain_whitening(x, k=4):
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1], axes[:, ::-1]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ axes[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_whitening_equals_numpy(spark):
    got = queries.op11_whitening(spark, SMALL).toPandas().sort_values(["vec_id", "component"])
    p = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(256 * np.stack(p.embedding).astype(float)).astype(int)
    n, deviation, whitened, explained = plain_whitening(x)
    assert len(got) == 4 * len(x) and set(got.n) == {n}
    assert (got.deviation.to_numpy().reshape(-1, 4) == deviation[:, None]).all()
    mine = got.whitened.to_numpy().reshape(-1, 4)
    assert np.abs(mine * np.sign((mine * whitened).sum(0)) - whitened).max() < 1e-9
    assert np.allclose(got.explained.to_numpy().reshape(-1, 4), explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_whitening_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 3 * 50)
    x = np.random.default_rng(2).integers(-40, 40, (700, 3))
    df = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).toPandas().sort_values(["vec_id", "component"])
    n, deviation, whitened, _ = plain_whitening(x, 3)
    assert set(got.n) == {n} and got.component.max() == 3
    mine = got.whitened.to_numpy().reshape(-1, 3)
    assert np.abs(mine * np.sign((mine * whitened).sum(0)) - whitened).max() < 1e-9
    assert (got.deviation.to_numpy().reshape(-1, 3)[:, 0] == deviation).all()


def test_whitening_edge_cases(spark):
    kind = "vec_id long, embedding array<double>, X string, x string, component int, n long, `a.b` int"
    rest = ("u", "v", 1, 2, 3)
    rows = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (None, [0.5, -0.2]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (6, []), (7, [1.0]), (8, [-0.3, 0.9])]
    got = whitening.whiten(spark.createDataFrame([(*r, *rest) for r in rows], kind)).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == [("1", 1), ("1", 1), ("1", 2), ("1", 2), ("8", 1), ("8", 2), ("None", 1), ("None", 2)]
    assert {r["n"] for r in got} == {3}
    alike = whitening.whiten(spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.1, 0.2])], "vec_id long, embedding array<double>")).collect()
    assert len(alike) == 4 and {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in alike} == {(None, None, None, 0)}
    flat = whitening.whiten(spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.3, 0.2])], "vec_id long, embedding array<double>")).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True)}
    large = whitening.whiten(spark.createDataFrame([(1, [1e13, 0.2]), (2, [-1e13, 0.2])], "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in large} == {None}
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return x ^ (x >> 31)


def plain_fingerprint(text: bytes) -> str:
    """By the definition, byte by byte."""
    level_of, seen = [], set()
    for i in range(len(text)):
        h = mixed(sum(((text[i - k] if i >= k else 0) + 1) * int(piecewise._ROLL[k]) for k in range(piecewise.WINDOW)) & _ALL)
        ones = (~h & (h + 1)).bit_length() - 1
        level_of.append(-1 if h in seen else ones)
        seen.add(h)
    level = max(0, (max(len(text), 1) - 1).bit_length() - 6)
    while sum(v >= level for v in level_of) > piecewise.MOST:
        level += 1
    digits = piecewise._DIGITS.tobytes().decode()

    def signs(at):
        out, start = "", 0
        for i, v in enumerate(level_of):
            if v >= at or i == len(text) - 1:
                h = mixed(sum((b + 1) * pow(piecewise._BASE, j, 1 << 64) for j, b in enumerate(text[start : i + 1])) & _ALL)
                out, start = out + digits[h >> 58] + digits[h >> 52 & 63], i + 1
        return out

    return f"{level}:{signs(level)}:{signs(level + 1)}"


def plain_common(a, b):
    a, b = ([x[i : i + 2] for i in range(0, len(x), 2)] for x in (a, b))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def some_texts():
    rng = random.Random(1)
    out = [bytes(rng.choice(b"abcdef ghijk") for _ in range(n)) for n in (0, 1, 2, 7, 63, 64, 65, 130, 500, 3000)]
    return [*out, b"a" * 3000, b"Of the " * 500, "ünïcödé 漢字 😀 ".encode() * 40]


def test_fingerprints_equal_brute_force():
    for t in some_texts():
        assert piecewise.fingerprint(t) == plain_fingerprint(t)


def test_long_texts_are_hashed_in_segments(monkeypatch):
    whole = [piecewise.fingerprint(t) for t in some_texts()]
    monkeypatch.setattr(piecewise, "SEGMENT", 77)
    assert [piecewise.fingerprint(t) for t in some_texts()] == whole


def test_likeness():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("ABC") + rng.choice("DE") for _ in range(rng.randint(0, 64))) for _ in range(2))
        assert piecewise.common(a, b) == plain_common(a, b)
    words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 99)) for _ in range(3000)]
    text = " ".join(words)
    mark = piecewise.fingerprint(text.encode())
    moved = piecewise.fingerprint(("a new beginning " + text).encode())
    half = piecewise.fingerprint(text[: len(text) // 2].encode())
    other = piecewise.fingerprint(" ".join(reversed(words)).encode())
    assert piecewise.likeness(mark, mark) == 1 and piecewise.likeness(mark, moved) > 0.9
    assert piecewise.likeness(mark, half) > 0.5 and piecewise.likeness(mark, other) < 0.15
    assert piecewise.likeness("0::", "0::") == 1 and piecewise.likeness("0::", mark) == 0


def plain_comparison(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for at, (i, t) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        cut = len(t) // 3
        new = (t[: len(t) - cut] + after[:cut]).encode()
        mark, edited, other = (piecewise.fingerprint(x) for x in (t.encode(), new, after.encode()))
        out.append((str(i), len(t), hashlib.sha256(new).hexdigest(), mark, edited, piecewise.likeness(mark, edited), piecewise.likeness(mark, other)))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_comparison_with_the_next_document(spark, docs, odd, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for df in (docs, odd, docs.filter('doc_id = 3'), docs.filter('doc_id < 0')):
            rows = [(r["i"], r["t"]) for r in pick(df, i="doc_id", t="text").collect()]
            assert sorted((str(r[0]), *r[1:]) for r in piecewise.compared(df).collect()) == plain_comparison(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_fingerprints_tell_edits_from_others(spark):
    got = queries.op12_fingerprints(spark, SMALL).toPandas()
    long = got[got.n_chars > 200]
    assert long.near_edited.quantile(0.05) > 0.4 and long.near_next.quantile(0.95) < 0.1
    assert ((got.near_edited >= 0) & (got.near_edited <= 1) & (got.near_next >= 0) & (got.near_next <= 1)).all()


def test_fingerprints_of_rows(spark, odd):
    got = piecewise.fingerprints(odd)
    assert got.count() == odd.count() and got.filter("fingerprint = '0::'").count() == 3
    both = got.withColumn("like", piecewise.like("fingerprint", "fingerprint"))
    assert {r["like"] for r in both.collect()} == {1.0}


def plain_negatives(rows, asked, positives=5, negatives=3):
    """rows: (id, vector of whole numbers, label)."""
    out = []
    for at, (i, x, label) in enumerate(rows):
        if i not in asked:
            continue
        scored = sorted(((-int(np.dot(x, y)), j, m) for k, (j, y, m) in enumerate(rows) if k != at), key=lambda r: r[:2])
        for p, j, m in [r for r in scored if r[2] == label][:positives]:
            fit = [(n, r) for n, r, other in scored if other != label and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(i, j, rank + 1, r, -p, -n) for rank, (n, r) in enumerate(fit[:negatives])]
    return sorted(out)


def test_hard_negatives_equal_sql_on_given_rows(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    got = queries.op13_hard_negatives(spark, SMALL)
    want = con.sql(queries.SQL["op13_hard_negatives"])
    assert sorted(map(tuple, got.collect())) == sorted(want.select(", ".join(got.columns)).fetchall())


def test_hard_negatives_of_clusters_visit_few_cells(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((40, 16)) * 3
    x = np.floor(256 * (centre[rng.integers(0, 40, 6000)] + rng.standard_normal((6000, 16)) * 0.2)).astype(int)
    x[:1500] = x[0]  # one vector in a quarter of the rows
    label = rng.integers(0, 3, 6000).tolist()
    df = spark.createDataFrame([(i, (v / 256).tolist(), label[i]) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    asked, rounds = set(range(0, 6000, 500)), []
    got = hardneg.hard_negatives(df, spark.createDataFrame([(i,) for i in asked], "vec_id long"), rounds=rounds)
    assert sorted(map(tuple, got.collect())) == plain_negatives([(i, v, label[i]) for i, v in enumerate(x)], asked)
    assert rounds[0][0] < len(asked) * 40 and rounds[-1][1] == 0


def test_hard_negatives_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "FIRST", 8)  # several rounds
    monkeypatch.setattr(hardneg, "SLOT", 16)
    monkeypatch.setattr(hardneg, "GROUP", 3)
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 60)), rng.integers(-3, 4, 3), int(rng.integers(0, 3))) for _ in range(150)]
    rows += rows[:9] + [(7, np.array([0, 0, 0]), 1), (8, np.array([200, 200, 200]), 0)]
    df = [(i, (v / 256).tolist(), m) for i, v, m in rows]
    df += [(None, [0.1, 0.1, 0.1], 1), (1, None, 1), (2, [0.1, None, 0.1], 1), (3, [0.1, float("nan"), 0.1], 1), (4, [0.1, 0.1], 1), (5, [], 1), (6, [0.1, 0.1, 0.1], None)]
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in df], "vec_id long, embedding array<double>, label int, x string, ids int, `a.b` int")
    asked = set(range(0, 60, 5))
    got = hardneg.hard_negatives(df, df.filter("vec_id % 5 = 0").select("vec_id"))
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, asked)
    assert hardneg.hard_negatives(df.limit(0), df.select("vec_id")).count() == 0
    assert hardneg.hard_negatives(df, df.select("vec_id").limit(0)).count() == 0


def test_hard_negatives_without_structure_take_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "FIRST", 16)
    monkeypatch.setattr(hardneg, "TILE", 50)
    monkeypatch.setattr(hardneg, "SLOT", 700)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 24))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(int)
    label = np.where(np.arange(3000) < 2990, rng.integers(0, 4, 3000), 9).tolist()  # and a label of few rows
    df = spark.createDataFrame([(i, (v / 256).tolist(), label[i]) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    asked, rounds = {*range(0, 3000, 100), 2995}, []
    got = hardneg.hard_negatives(df, spark.createDataFrame([(i,) for i in asked], "vec_id long"), rounds=rounds)
    assert sorted(map(tuple, got.collect())) == plain_negatives([(i, v, label[i]) for i, v in enumerate(x)], asked)
    assert len(rounds) <= 8  # those that have k rows a window visit what can reach them, without further steps
    assert rounds[-1] == (0, 0)


def test_products_are_exact():
    a = np.array([[1 << 30, -3]]), np.array([[1 << 30, 5]])
    assert hardneg.products(*a).tolist() == [[(1 << 60) - 15]]
    a = np.array([[-2895, 2895]], np.int16), np.array([[2895, -2894]], np.int16)  # singles hold these, and entries no more
    assert hardneg.products(*a).tolist() == [[-2895 * (2895 + 2894)]]
    a = np.array([[-32768, 3]], np.int16), np.array([[-32768, 5]], np.int16)
    assert hardneg.products(*a).tolist() == [[(1 << 30) + 15]]
    with pytest.raises(OverflowError):
        hardneg.products(np.array([[1 << 40]]), np.array([[1 << 40]]))


