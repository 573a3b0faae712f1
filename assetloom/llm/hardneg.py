"""Hard negatives by an inverted multi-index over half spaces, searched until the windows are certain (operator 13)."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm._common import dropped, numbered, pick, stored
from assetloom.llm.whitening import finite, scaled, usual_length

#: Anchors that are searched together, points that meet them in one task (in tiles), and points that the first round looks for.
GROUP, SLOT, FIRST, TILE = 2048, 32768, 4096, 2048
_KEEP = 6  # equal vectors of one label: no list needs more of them


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers, in the first type that holds every sum of them:
    single, double, 64 bits (a score beyond raises)."""
    reach = [max(int(m.max()), -int(m.min())) if m.size else 0 for m in (a, b)]
    top = reach[0] * reach[1] * max(a.shape[1], 1)
    for bits, kind in ((24, np.float32), (53, np.float64)):
        if top < 1 << bits:
            return a.astype(kind) @ b.astype(kind).T
    if top < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


class Codebooks:
    """Two codebooks, one for each half of the dimensions, and their largest distance to a point they stand for.

    Codes are means of a bounded sample (Lloyd's steps from its first distinct points); ``radius`` is measured over all points."""

    def __init__(self, sample: np.ndarray, codes: int, steps: int = 8):
        self.half, self.codes, self.radius, self.count = sample.shape[1] // 2, [], [None, None], None
        for part in (sample[:, : self.half], sample[:, self.half :]):
            part = part.astype(np.float64)
            c = np.unique(part, axis=0) if part.shape[1] else part[:1]
            c = c[np.random.default_rng(5).permutation(len(c))[:codes]]
            for _ in range(steps):
                near = self._near(part, c)[0]
                n = np.bincount(near, minlength=len(c))
                for k in np.flatnonzero(n):
                    c[k] = part[near == k].mean(0)
            self.codes.append(c)

    @staticmethod
    def _near(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
        return near, np.sqrt(((x - c[near]) ** 2).sum(1))

    def places(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For either half: the code of every row and its distance to it."""
        x = x.astype(np.float64)
        return [self._near(part, c) for part, c in zip((x[:, : self.half], x[:, self.half :]), self.codes, strict=True)]

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For either half: what the half score of a point of each code can be at most, and at least."""
        high, low = [], []
        for part, c, r in zip((x[: self.half].astype(np.float64), x[self.half :].astype(np.float64)), self.codes, self.radius, strict=True):
            mid, reach = c @ part, math.sqrt(float(part @ part)) * r
            slack = 1e-9 * (np.abs(mid) + reach) + 1e-6  # rounding
            high.append(mid + reach + slack)
            low.append(mid - reach - slack)
        return high, low

    def sequence(self, x: np.ndarray):
        """(bound, cell, least score, points) of the cells that hold points, by falling bound.

        The codes of either half are sorted by their bounds. A heap holds, of the pairs of places not yet visited, those
        whose neighbours before them have been: each pop is the largest sum left."""
        (h1, h2), (l1, l2) = self.bounds(x)
        a, b = np.argsort(-h1, kind="stable"), np.argsort(-h2, kind="stable")
        heap, across = [(-(h1[a[0]] + h2[b[0]]), 0, 0)], len(b)
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < across:
                heapq.heappush(heap, (-(h1[a[i]] + h2[b[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(h1[a[i + 1]] + h2[b[0]]), i + 1, 0))
            n = self.count[a[i], b[j]]
            if n:
                yield -bound, int(a[i]) * across + int(b[j]), l1[a[i]] + l2[b[j]], int(n)

    def first(self, x: np.ndarray, least: int, most: int, points: int) -> list[int]:
        """The first cells of the sequence with scores from ``least`` to ``most`` that hold as many points."""
        out, total = [], 0
        for high, cell, low, n in self.sequence(x):
            if high < least or total >= points:
                break
            if low <= most:
                out.append(cell)
                total += n
        return out

    def reaching(self, x: np.ndarray, least: int, most: int, seen: np.ndarray, points: int | None) -> np.ndarray:
        """The cells not ``seen`` that can hold scores from ``least`` to ``most``: all, or the first by falling bound that
        hold as many points."""
        (h1, h2), (l1, l2) = self.bounds(x)
        high, count = (h1[:, None] + h2).ravel(), self.count.ravel()
        cells = np.flatnonzero((high >= least) & ((l1[:, None] + l2).ravel() <= most) & (count > 0) & ~seen)
        if points is None or count[cells].sum() <= points:
            return cells
        cells = cells[np.argsort(-high[cells], kind="stable")]
        return cells[: np.searchsorted(np.cumsum(count[cells]), points) + 1]


def indexed(points: DataFrame, codes: int | None, sample: int) -> tuple[DataFrame, Codebooks]:
    """The points with their cell, stored, and the codebooks with radii and the points of each cell."""
    spark, n = points.sparkSession, points.count()
    codes = min(256, max(4, math.ceil(math.sqrt(n / 64)))) if codes is None else codes
    place = F.pmod(F.xxhash64("x", F.lit(3)), F.lit(1_000_000))
    some = points.filter(place <= int(min(1.0, sample / n) * 1_000_000)).limit(sample).select("x").toArrow()
    book = Codebooks(_matrix((some if some.num_rows else points.limit(1).select("x").toArrow()).column("x")), codes)
    sent = spark.sparkContext.broadcast(book)

    def assign(batches):
        for b in batches:
            (i, d), (j, e) = sent.value.places(_matrix(b.column("x")))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v) for v in (i, d, j, e))], [*b.schema.names, "i", "d", "j", "e"])

    fields = [*points.schema.fields, *(T.StructField(c, k) for c, k in (("i", T.LongType()), ("d", T.DoubleType()), ("j", T.LongType()), ("e", T.DoubleType())))]
    out = stored(points.mapInArrow(assign, T.StructType(fields)), "cells")
    # one row for each cell: at most the product of the codes
    book.count = np.zeros([len(c) for c in book.codes], np.int64)
    book.radius = [np.zeros(len(c)) for c in book.codes]
    for r in out.groupBy("i", "j").agg(F.count("*").alias("n"), F.max("d").alias("d"), F.max("e").alias("e")).collect():
        book.count[r["i"], r["j"]] = r["n"]
        book.radius[0][r["i"]] = max(book.radius[0][r["i"]], r["d"])
        book.radius[1][r["j"]] = max(book.radius[1][r["j"]], r["e"])
    sent.destroy()
    return out.select(*points.columns, (F.col("i") * len(book.codes[1]) + F.col("j")).alias("cell")), book


def _tiles(rows: np.ndarray, size: int):
    """Pieces of the rows, of which the first are small: what they take raises the least score for the others."""
    at, step = 0, min(32, size)
    while at < len(rows):
        yield rows[at : at + step]
        at, step = at + step, min(2 * step, size)


class _Best:
    """The k highest scores (ties: smaller id) of every window, and the least score that each still takes."""

    def __init__(self, windows: pa.ListArray, k: int):
        self.k, self.start = k, windows.offsets.to_numpy() - windows.offsets[0].as_py()
        self.w, self.low, self.high, kth = (windows.flatten().field(c) for c in ("w", "lo", "hi", "kth"))
        self.w, self.low, self.high = (v.to_numpy() for v in (self.w, self.low, self.high))
        self.need = np.maximum(self.low, kth.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False))
        self.found = [np.empty(0, np.int64)] * 3  # window, score, id

    def limits(self) -> tuple[np.ndarray, np.ndarray]:
        """For every anchor the least and the highest score that a window of it takes."""
        return np.minimum.reduceat(self.need, self.start[:-1]), np.maximum.reduceat(self.high, self.start[:-1])

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        times = np.diff(self.start)[anchor]
        row = np.repeat(np.arange(len(anchor)), times)
        window = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + self.start[anchor][row]
        fits = (score[row] >= self.need[window]) & (score[row] <= self.high[window])
        window, row = window[fits], row[fits]
        window, score, ids = (np.concatenate(v) for v in zip(self.found, (window, score[row], ids[row]), strict=True))
        order = np.lexsort((ids, -score, window))
        window = window[order]
        rank = np.arange(len(window)) - np.searchsorted(window, window)
        order, window = order[rank < self.k], window[rank < self.k]
        self.found = [window, score[order], ids[order]]
        last = rank[rank < self.k] == self.k - 1
        self.need[window[last]] = self.found[1][last]


def _search(anchors: DataFrame, windows: DataFrame, points: DataFrame, book: Codebooks, k: int, negatives: bool, rounds: list | None = None) -> DataFrame:
    """(a, w, score, id): per anchor and window (from lo to hi) the k best rows, each once for every time it is there.

    ``anchors``: a, grp, label, x, id; ``windows``: a, w, lo, hi, which are open for positives. Anchors of a group visit
    cells together. In the first round each names the first of its sequence; then an anchor is certain when no cell that
    its group has not visited can reach the k-th score of each window. If it has them all it names every cell that
    can, else those that hold sixteen times as many points as in the round before. An anchor is done after as many
    rounds as it takes to find k rows a window, and one more."""
    spark = anchors.sparkSession
    sent = spark.sparkContext.broadcast(book)
    slot, tile = SLOT, TILE
    found, budget, seen, planned = None, FIRST, spark.createDataFrame([], "grp long, cells array<long>"), []
    rows = windows.withColumn("kth", F.lit(None).cast("long"))
    active = anchors

    def plan(left: pa.Table, right: pa.Table) -> pa.Table:
        book, out = sent.value, {"grp": [], "a": [], "named": [], "slots": [], "cells": []}
        seen, union = (np.zeros(book.count.size, bool) for _ in range(2))
        for cells in right.column("cells").to_pylist():
            seen[cells] = True
        for a, x, w in zip(left.column("a").to_pylist(), _matrix(left.column("x")), left.column("windows").to_pylist(), strict=True):
            known = all(v["kth"] is not None for v in w)
            least, most = min(v["lo"] if v["kth"] is None else max(v["lo"], v["kth"]) for v in w), max(v["hi"] for v in w)
            cells = book.reaching(x, least, most, seen, None if known else budget) if right.num_rows else book.first(x, least, most, budget)
            if len(cells):
                union[cells] = True
                out["a"].append(a)
                out["named"].append(len(cells))
        live = len(out["a"])
        if live:  # and a last row with the cells of all
            out["grp"] = [left.column("grp")[0].as_py()] * (live + 1)
            out["slots"] = [-(-int(book.count.ravel()[union].sum()) // slot)] * (live + 1)
            out["cells"] = [None] * live + [np.flatnonzero(union)]
            out["a"].append(None)
            out["named"].append(None)
        return pa.table({c: pa.array(v, pa.list_(pa.int64()) if c == "cells" else pa.int64()) for c, v in out.items()})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        best = None
        if left.num_rows and right.num_rows:
            best = _Best(left.column("windows").combine_chunks(), k)
            asking, there = _matrix(left.column("x")), _matrix(right.column("x"))
            label, other, me = left.column("label").to_numpy(), right.column("label").to_numpy(), left.column("id").to_numpy()
            ids = right.column("ids").combine_chunks()
            at, ids = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten().to_numpy()
            # rows of other labels are met all at once, those of the same label by label
            pairs = [(np.arange(len(label)), np.arange(len(other)))]
            if not negatives:
                pairs = [(np.flatnonzero(label == v), np.flatnonzero(other == v)) for v in np.unique(label)]
            for asked, all_of in pairs:
                for near in _tiles(all_of, tile):
                    s = products(asking[asked], there[near])
                    least, most = (v[asked, None].astype(s.dtype) for v in best.limits())
                    ok = (s >= least) & (s <= most)
                    if negatives:
                        ok &= label[asked, None] != other[near]
                    r, c = np.nonzero(ok)
                    mine, r, c = s[r, c].astype(np.int64), asked[r], near[c]
                    times = (at[1:] - at[:-1])[c]
                    row = np.repeat(np.arange(len(c)), times)
                    each = ids[np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + at[c][row]]
                    r, c, mine = r[row], c[row], mine[row]
                    if not negatives:  # not the anchor itself: of rows equal to it, one less
                        own = np.flatnonzero(each == me[r])
                        own = own[(there[c[own]] == asking[r[own]]).all(1)]
                        keep = np.ones(len(r), bool)
                        keep[own[np.unique(r[own], return_index=True)[1]]] = False
                        r, mine, each = r[keep], mine[keep], each[keep]
                    best.add(r, mine, each)
        window, value, ids = best.found if best else [np.empty(0, np.int64)] * 3
        a, w = (left.column("a").to_numpy()[np.searchsorted(best.start, window, "right") - 1], best.w[window]) if best else (window, window)
        return pa.table({"a": a, "w": w, "score": value, "id": ids})

    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), "id")
    while True:
        asked = active.join(rows.groupBy("a").agg(F.collect_list(F.struct("w", "lo", "hi", "kth")).alias("windows")), "a")
        asked = stored(asked, "asked")
        plans = asked.select("grp", "a", "x", "windows").groupBy("grp").cogroup(seen.groupBy("grp"))
        plans = stored(plans.applyInArrow(plan, "grp long, a long, named long, slots long, cells array<long>"), "planned")
        planned.append(asked)
        planned.append(plans)
        live, named = plans.agg(F.count("a"), F.coalesce(F.sum("named"), F.lit(0))).first()
        if rounds is not None:
            rounds.append((named, live))
        if not live:
            break
        union = plans.filter("a is null")
        near = points.join(union.select("grp", "slots", F.explode("cells").alias("cell")), "cell")
        near = near.select("grp", F.pmod(F.xxhash64("x", "label"), "slots").alias("slot"), "label", "x", "ids")
        meeting = asked.join(plans.filter("a is not null").select("a", "slots"), "a")
        meeting = meeting.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), "a", "id", "label", "x", "windows")
        near, meeting = near.toDF(*near.columns), meeting.toDF(*meeting.columns)  # new attributes for the cogroup
        got = meeting.groupBy("grp", "slot").cogroup(near.groupBy("grp", "slot")).applyInArrow(score, "a long, w long, score long, id long")
        was, got = found, got if found is None else got.unionByName(found)
        found = stored(got.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n"), "found")
        if was is not None:
            dropped(was)
        kth = found.groupBy("a", "w").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        active = anchors.join(plans.select("a"), "a", "left_semi")
        rows = windows.join(kth, ["a", "w"], "left")
        seen = seen.unionByName(union.select("grp", "cells"))
        budget *= 16
    for old in planned:
        dropped(old)
    sent.destroy()
    return found if found is not None else spark.createDataFrame([], "a long, w long, score long, id long")


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    codes: int | None = None,
    sample: int = 10_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    rounds: list | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every anchor and each of its
    positives the first ``negatives`` rows of other labels that score from ``low`` to ``high`` percent of the positive.

    Entries count as floor(256 * entry), scores are whole inner products with the anchor, higher ones come first, ties
    go to smaller ids. ``anchors`` names the anchors (a column vec_id). An anchor's positives are its first rows of the same
    label other than itself. The result is exact.

    The index: either half of the dimensions has a codebook (``codes`` of each, by default the root of a 64th of the
    points, 4 to 256, fitted on at most ``sample`` points); a pair of codes is a cell. An anchor visits cells by the sum
    of the two half scores' bounds (product with the code plus length times radius) from a heap, first until its positives
    are certain, then until its windows are; cells that cannot reach into a window are skipped. Anchors of similar place
    are searched in groups of ``GROUP``, which meet ``SLOT`` points in a task; only scores that can still be among the best
    leave the product. Vectors without structure have loose bounds, and their anchors visit most cells: the anchors are
    then a query set that meets all rows, in blocks, for which the rows are shuffled about once a group and search.
    ``rounds`` takes of every round the cells that anchors named and how many anchors did; the last of a search has none.

    Equal vectors of one label are one point with its smallest ids, as many as a list can hold.

    Nulls and edge cases: rows with a null id or label, or a vector that is null, empty, of another length than most (the
    longer on a tie) or holds null or non-finite entries take no part; rows may repeat, and each counts (an anchor has
    its copies as positives, a repeated anchor comes out as often); a window below zero is empty (its positive scores
    less than zero); with too few rows all are returned; no anchors or no rows give no rows. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = pick(vectors, id=id_col, vec=vector_col, label=label_col).filter("id is not null and label is not null")
    rows = rows.select(*[F.col(c).cast(t).alias(c) for c, t in (("id", "long"), ("label", "long"), ("vec", "array<double>"))])
    rows = rows.filter(finite(F.col("vec"))).select("id", "label", scaled(F.col("vec")).alias("x")).filter("size(x) > 0")
    rows = stored(rows, "whole-numbers")
    d = usual_length(rows, "x")
    if d is None:
        return spark.createDataFrame([], names)
    rows = rows.filter(F.size("x") == d)
    # entries in the first type that holds them all and their negatives: rows are moved several times
    top = rows.agg(F.greatest(F.max(F.array_max("x")), -(F.min(F.array_min("x")) + 1))).first()[0]
    rows = rows.withColumn("x", F.col("x").cast("array<smallint>" if top < (1 << 15) - 1 else "array<int>" if top < (1 << 31) - 1 else "array<bigint>"))
    least = Window.partitionBy(F.xxhash64("x", "label"), "x", "label").orderBy("id")  # sorted by a number first
    keep = max(_KEEP, positives + 1, negatives)
    points = rows.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= keep).groupBy("x", "label").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points, book = indexed(stored(points, "points"), codes, sample)

    ids = pick(anchors, id="vec_id").select(F.col("id").cast("long").alias("id")).distinct()
    asked = rows.join(ids, "id").groupBy("id", "label", "x").agg(F.count("*").alias("times"))
    sent = spark.sparkContext.broadcast(book)

    def cell_of(batches):
        for b in batches:
            (i, _), (j, _) = sent.value.places(_matrix(b.column("x")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(i), pa.array(j)], [*b.schema.names, "i", "j"])

    fields = [*asked.schema.fields, T.StructField("i", T.LongType()), T.StructField("j", T.LongType())]
    asked = numbered(asked.mapInArrow(cell_of, T.StructType(fields)), ["i", "j", "id"], "a", "anchors")
    asked = stored(asked.drop("i", "j").withColumn("grp", F.floor(F.col("a") / GROUP)), "asked")
    if asked.isEmpty():
        return spark.createDataFrame([], names)

    far = (1 << 63) - 1
    everything = asked.select("a", F.lit(0).cast("long").alias("w"), F.lit(-far).alias("lo"), F.lit(far).alias("hi"))
    found = _search(asked, everything, points, book, positives, False, rounds)
    found = found.select("a", F.col("score").alias("w"), F.col("id").alias("positive_id"))
    # the whole numbers s with low * w <= 100 * s <= high * w
    window = found.select("a", "w", F.ceil(F.col("w") * low / F.lit(100).cast("decimal(3,0)")).cast("long").alias("lo"), F.floor(F.col("w") * high / F.lit(100).cast("decimal(3,0)")).cast("long").alias("hi"))
    window = window.filter("lo <= hi").distinct()  # as many as positives at most
    hard = _search(asked, window, points, book, negatives, True, rounds)
    hard = hard.withColumn("rank", F.row_number().over(Window.partitionBy("a", "w").orderBy(F.desc("score"), "id")))
    hard = hard.select("a", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(hard, ["a", "w"]).join(asked.select("a", F.col("id").alias("anchor_id"), "times"), "a")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("w").alias("positive_score"), "negative_score")
