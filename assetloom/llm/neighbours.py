"""Approximate nearest neighbours from shifted Hilbert orderings (operator 3)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetloom.llm._common import pick, stored


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with integer coordinates below 2**bits (rows), as unsigned integers.

    The coordinates are turned into the transposed index by undoing, from the highest bit down, the exchange or
    inversion of low bits that each cell of the curve applies, and then Gray decoding; the bits are interleaved last.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            up = (x[i] >> b) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << np.uint64(1)) | ((x[i] >> b) & 1).astype(np.uint64)
    return key


class Curves:
    """Several orderings: each projects unit vectors by its own random directions, shifts the grid and follows the curve."""

    def __init__(self, dim: int, curves: int, axes: int, bits: int, seed: int, sample: np.ndarray):
        rng = np.random.default_rng(seed)
        axes = min(axes, dim)
        self.bits, self.parts = bits, []
        for _ in range(curves):
            basis, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
            basis = basis[:, :axes]
            at = sample @ basis
            scale = np.maximum(at.std(0), 1e-9)
            self.parts.append((basis, at.mean(0), scale, rng.random(axes)))

    def keys(self, unit: np.ndarray) -> list[np.ndarray]:
        out, top = [], (1 << self.bits) - 1
        for basis, mean, scale, shift in self.parts:
            at = (unit @ basis - mean) / scale  # about normal: most of it lies within three deviations
            cells = np.clip(np.floor((at + 3) / 6 * top + shift), 0, top)
            out.append((hilbert(cells, self.bits) >> np.uint64(1)).view(np.int64))
        return out


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of scores the k best columns (largest score, then smallest id)."""
    k = min(k, scores.shape[1])
    order = np.argsort(ids, kind="stable")
    top = np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores[:, order], top, 1), ids[order][top]


_PAIR = "query long, rep long, score double"


def _pairs(query: np.ndarray, scores: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(query, scores.shape[1])), pa.array(reps.ravel()), pa.array(scores.ravel())], ["query", "rep", "score"]
    )


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part: a usable vector of the most frequent length, one per id."""
    v = pick(vectors, vec_id=id_col, vec=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec"))
    v = v.filter("vec_id is not null and vec is not null and size(vec) > 0")
    v = v.filter(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).filter(F.exists("vec", lambda x: x != 0))
    size = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    v = v.filter(F.size("vec") == (size[0]["n"] if size else 0))
    return v.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def nearest(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 5,
    curves: int = 8,
    axes: int = 8,
    bits: int = 6,
    block: int = 2048,
    group: int = 2048,
    wanted: float = 0.97,
    probes: int = 64,
    sample: int = 10_000,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The k nearest of every query by cosine: (query_id, rank, vec_id, score); ties go to the smaller vec_id.

    ``queries`` has the ids to search for (a column vec_id; None: all). Candidates are all rows but the query itself.

    Equal vectors are one point with the k + 1 smallest ids, so a vector in a third of the rows is no hot spot and its
    ties come out exactly. Points are ordered along ``curves`` Hilbert curves by range partitioning; ranks come from the
    counts of the partitions. A query meets the blocks of at most ``block`` ranks that its window touches on each curve;
    the queries of a block are dealt to groups of about ``group``, so no task holds more than a block and a group. The
    best of all curves are merged and have exact scores. The window is fitted: for at most ``probes`` queries the true
    neighbours are found by comparing them with all rows (a stated, bounded query set), and the window is as wide as
    brings ``wanted`` of those neighbours into reach on some curve, whatever the number of rows. Vectors without structure need windows in
    proportion to the rows; clustered ones don't. Projections are scaled on at most ``sample`` rows.

    Nulls and edge cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite
    components take no part, nor do null ids; rows with one id are one row (the smallest vector); with fewer than k
    candidates all are returned; no usable vector gives no rows. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, id_col, vector_col), "vectors")
    out_schema = "query_id long, rank int, vec_id long, score double"
    rep = rows.groupBy("vec").agg(F.min("vec_id").alias("rep"))
    points = stored(rep, "points")
    n = points.count()
    if not n:
        return spark.createDataFrame([], out_schema)
    low = Window.partitionBy("rep").orderBy("vec_id")
    member = stored(rows.join(points, "vec").select("vec_id", "rep"), "members")
    ids_of = (
        member.withColumn("i", F.row_number().over(low)).filter(F.col("i") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    asked = member if queries is None else member.join(pick(queries, vec_id="vec_id").select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id")
    asked = stored(asked, "asked")
    leads = asked.select(F.col("rep").alias("query")).distinct()

    place = F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1_000_000))
    some = points.filter(place <= int(min(1.0, sample / n) * 1_000_000)).limit(sample).select("vec").toArrow()
    unit = _unit(_matrix(some.column("vec").combine_chunks())) if some.num_rows else None
    if unit is None:
        unit = _unit(_matrix(points.limit(1).toArrow().column("vec").combine_chunks()))
    guide = spark.sparkContext.broadcast(Curves(unit.shape[1], curves, axes, bits, seed, unit))

    def keyed(batches):
        for b in batches:
            ids = b.column("rep")
            for c, key in enumerate(guide.value.keys(_unit(_matrix(b.column("vec"))))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), c, np.int32)), pa.array(key), ids], ["curve", "key", "rep"])

    def numbered(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            pos = np.arange(at, at + b.num_rows)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("curve"), b.column("rep"), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(pos)], ["curve", "rep", "part", "pos"]
            )

    parts = max(curves, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = stored(
        points.mapInArrow(keyed, "curve int, key long, rep long")
        .repartitionByRange(parts, "curve", "key", "rep")
        .sortWithinPartitions("curve", "key", "rep")
        .mapInArrow(numbered, "curve int, rep long, part int, pos long"),
        "curves",
    )
    # rows of a curve in a partition and its first place there: one row per curve and partition
    held = placed.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("pos").alias("from"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = held.select("curve", "part", "from", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = stored(placed.join(F.broadcast(start), ["curve", "part"]).select("curve", "rep", (F.col("base") + F.col("pos") - F.col("from")).alias("at")), "ranks")

    probe = leads.join(points, leads["query"] == points["rep"]).select("query", "vec")
    probe = probe.orderBy(F.xxhash64("query", F.lit(seed + 1)), "query").limit(probes).toArrow()
    window = n
    if probe.num_rows:
        ids, q = probe.column("query").to_numpy(), _unit(_matrix(probe.column("vec").combine_chunks()))

        def exact(batches):
            for b in batches:
                scores = q @ _unit(_matrix(b.column("vec"))).T
                mine = b.column("rep").to_numpy()
                scores[ids[:, None] == mine[None, :]] = -2
                s, r = _best(scores, mine, k)
                yield _pairs(ids, s, r)

        top = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
        true = points.mapInArrow(exact, _PAIR).withColumn("i", F.row_number().over(top)).filter(F.col("i") <= k).filter("score > -2")
        true = true.select("query", "rep")
        mine, other = ranked.select("curve", F.col("rep").alias("query"), F.col("at").alias("a")), ranked.withColumnRenamed("at", "b")
        far = true.join(other, "rep").join(mine, ["curve", "query"]).groupBy("query", "rep").agg(F.min(F.abs(F.col("a") - F.col("b"))).alias("d"))
        got = sorted(r["d"] for r in far.select("d").collect())  # probes times k numbers
        if got:
            window = max(1, int(got[min(len(got) - 1, int(wanted * len(got)))]))

    block = int(min(block, max(16, window // 4)))  # small blocks, or most of what a query meets would be out of its window
    lo, hi = F.floor(F.greatest(F.col("at") - window, F.lit(0)) / block), F.floor(F.least(F.col("at") + window, F.lit(n - 1)) / block)
    reach = ranked.join(leads.withColumnRenamed("query", "rep"), "rep").select("curve", F.col("rep").alias("query"), F.explode(F.sequence(lo, hi)).alias("block"))
    # queries of a block are dealt to groups of about ``group`` that each meet the block: one row for a curve and block
    load = stored(reach.groupBy("curve", "block").agg(F.ceil(F.count("*") / group).cast("int").alias("groups")), "groups")
    reach = reach.join(load, ["curve", "block"]).withColumn("part", F.pmod(F.xxhash64("query", F.lit(seed)), F.col("groups")).cast("int"))
    reach = reach.join(points.select(F.col("rep").alias("query"), "vec"), "query").select("curve", "block", "part", "query", "vec")
    blocks = ranked.select("curve", "rep", F.floor(F.col("at") / block).alias("block")).join(load, ["curve", "block"])
    blocks = blocks.select("curve", "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "rep")
    cand = blocks.join(points, "rep").select("curve", "block", "part", "rep", "vec")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [_pairs(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros((0, 1), np.int64))]
        if left.num_rows and right.num_rows:
            ids, q = left.column("query").to_numpy(), _matrix(left.column("vec").combine_chunks())
            mine, x = right.column("rep").to_numpy(), _matrix(right.column("vec").combine_chunks())
            norm = np.linalg.norm(x, axis=1)
            for i in range(0, len(q), 256):
                part = q[i : i + 256]
                scores = (part @ x.T) / (np.linalg.norm(part, axis=1)[:, None] * norm)
                scores[ids[i : i + 256, None] == mine[None, :]] = -2
                s, r = _best(scores, mine, k)
                out.append(_pairs(ids[i : i + 256], s, r))
        return pa.Table.from_batches(out)

    keys = ["curve", "block", "part"]
    reach, cand = reach.toDF(*keys, "query", "vec"), cand.toDF(*keys, "rep", "vec")  # new attributes for the cogroup
    found = reach.groupBy(*keys).cogroup(cand.groupBy(*keys)).applyInArrow(rerank, _PAIR)
    # one row per pair: curves meet the same pairs, whose scores may differ in the last bit
    best = found.filter("score > -2").groupBy("query", "rep").agg(F.max("score").alias("score"))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    best = best.withColumn("i", F.row_number().over(top)).filter(F.col("i") <= k).select("query", "rep", "score")

    dot = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    own = points.join(leads, points["rep"] == leads["query"]).select("query", "rep", (dot / (F.sqrt(dot) * F.sqrt(dot))).alias("score"))
    each = best.unionByName(own).join(ids_of, "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    each = asked.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")).join(each, "query").filter("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
