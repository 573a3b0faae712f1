"""Near-duplicate classes by BagMinHash (operator 4)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetloom.llm import _words
from assetloom.llm._common import components, led, pick, positional, stored

_STEP, _REG = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def bag_signatures(shingle: np.ndarray, doc: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash signatures (n x m, float32; inf where a text has no shingle) of the multisets of shingles.

    Weights are the integers 1, 2, 3, ... Levels form blocks 1, 2, 3-4, 5-8, ..., each with one Poisson process per
    shingle whose rate is the block's width; a point carries a level of its block and counts if the weight reaches it,
    so a weight w needs about log2(w) processes. Points come in ascending order, and a process stops at the bound by
    which the text's m registers have all been hit (doubled until they are), hence the signature is exact.
    """
    order = np.lexsort((shingle, doc))
    s, d = shingle[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    s, d, c = s[at], d[at], np.diff(np.append(at, len(s)))
    sig = np.full(n * m, np.inf)
    if not len(s):
        return sig.reshape(n, m).astype(np.float32)
    seeds, docs, caps, lows, rates = [], [], [], [], []
    k, has = 0, np.arange(len(s))
    while len(has):
        low = 0 if k == 0 else 1 << (k - 1)
        seeds.append(_words.mix(s[has] ^ np.uint64(k * 0x51ED270B0A1F39C1 & 0xFFFFFFFFFFFFFFFF)))
        docs.append(d[has])
        caps.append(c[has])
        lows.append(np.full(len(has), low))
        rates.append(np.full(len(has), max(low, 1)))
        k += 1
        has = has[c[has] > 1 << (k - 1)]
    seed, d, cap, low, rate = (np.concatenate(x) for x in (seeds, docs, caps, lows, rates))
    mass = np.bincount(doc, minlength=n)
    until = np.where(mass > 0, m * (np.log(m) + 3) / np.maximum(mass, 1), -1.0)

    def gap(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        u = (_words.mix(seed[i] + j.astype(np.uint64) * _STEP) >> np.uint64(11)).astype(np.float64)
        return -np.log((u + 1) * 2.0**-53) / rate[i]

    j = np.zeros(len(seed), np.int64)
    every = np.arange(len(seed))
    x = gap(every, j)
    live = every[x <= until[d]]
    while True:
        while len(live):
            r = _words.mix((seed[live] ^ _REG) + j[live].astype(np.uint64) * _STEP)
            level = low[live] + 1 + ((r >> np.uint64(32)).astype(np.int64) & (rate[live] - 1))
            ok = level <= cap[live]
            np.minimum.at(sig, d[live[ok]] * m + (r[ok] % np.uint64(m)).astype(np.int64), x[live[ok]])
            j[live] += 1
            x[live] += gap(live, j[live])
            live = live[x[live] <= until[d[live]]]
        open_ = np.isinf(sig.reshape(n, m)).any(axis=1) & (mass > 0)
        if not open_.any():
            return sig.reshape(n, m).astype(np.float32)
        until[open_] *= 2
        live = every[open_[d] & (x <= until[d])]


def _signed(m: int):
    def run(batches):
        for b in _words.pieces(batches, "text"):
            w = _words.words(b.column("text"))
            h, doc, _ = _words.shingles(w)
            raw = np.ascontiguousarray(bag_signatures(h, doc, w.n, m)).tobytes()
            some = pa.array(np.diff(w.first) > 0)
            bounds = np.arange(w.n + 1, dtype=np.int32) * (4 * m)
            sig = pa.Array.from_buffers(pa.binary(), w.n, [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
            sig = pc.if_else(some, sig, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("digest"), sig], ["id", "digest", "sig"])

    return run


def _registers(sig: pa.Array, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(sig.to_pylist()), np.uint32).reshape(len(sig), m)


def _bands(bands: int, rows: int):
    def run(batches):
        for b in batches:
            v = _registers(b.column("sig"), bands * rows).reshape(-1, bands, rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _REG, v.shape[:2]).copy()
            for r in range(rows):
                key = _words.mix(key + v[:, :, r] * _STEP + np.uint64(r + 1))
            rep, band = np.repeat(b.column("rep").to_numpy(), bands), np.tile(np.arange(bands, dtype=np.int32), len(v))
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(band), pa.array(key.ravel().view(np.int64))], ["rep", "band", "key"])

    return run


def _sets(batches):
    """The multisets of shingles as sets: each shingle with the number of its occurrence, as sorted 64-bit hashes."""
    for b in _words.pieces(batches, "text"):
        h, doc, _ = _words.shingles(_words.words(b.column("text")))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        h = _words.mix(h + (np.arange(len(h)) - first).astype(np.uint64) * _STEP)
        h = h[np.lexsort((h, doc))]
        bounds = np.searchsorted(doc, np.arange(b.num_rows + 1)) * 8
        raw = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(h.tobytes())])
        yield pa.RecordBatch.from_arrays([b.column("id"), raw.cast(pa.binary())], ["rep", "shingles"])


def _block_links(bands: int, rows: int, least: float, threshold: float):
    """Links that join the classes of one block pair: texts of different classes whose signatures agree in ``least`` of the
    registers are held against each other by their shingles, and a link makes one class of two, within the block. A pair
    that meets in several bands is compared in the first of them."""
    m = bands * rows

    def run(group: pa.Table) -> pa.Table:
        rep, of, side, band = (group.column(c).to_numpy() for c in ("rep", "component", "side", "band"))
        of, v = of.copy(), _registers(group.column("sig").combine_chunks(), m)
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        right, out = np.flatnonzero(side != 0), []
        for i in np.flatnonzero(side != 1):
            j = right[(of[right] != of[i]) & ((rep[right] > rep[i]) | (side[i] == 0))]
            same = v[j] == v[i]
            near = same.mean(axis=1) >= least
            j, same = j[near], same[near].reshape(-1, bands, rows).all(axis=2)
            for x in j[same.argmax(axis=1) == band[i]]:
                if of[x] == of[i]:
                    continue
                both = len(np.intersect1d(sets[i], sets[x], assume_unique=True))
                if both / (len(sets[i]) + len(sets[x]) - both) >= threshold:
                    out.append((min(rep[i], rep[x]), max(rep[i], rep[x])))
                    of[of == of[x]] = of[i]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _overlaps(threshold: float):
    def run(batches):
        for b in _words.pieces(batches, "tb", 1 << 19):
            parts = []
            for col in ("ta", "tb"):
                h, p, _ = _words.shingles(_words.words(b.column(col)))
                key, first, n = np.unique(_words.mix(h + p.astype(np.uint64) * _STEP), return_index=True, return_counts=True)
                parts.append((key, p[first], n, np.bincount(p, minlength=b.num_rows)))
            (ka, pa_, na, sa), (kb, _, nb, sb) = parts
            _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
            both = np.bincount(pa_[i], weights=np.minimum(na[i], nb[j]), minlength=b.num_rows)
            sim = both / np.maximum(sa + sb - both, 1)
            keep = pa.array(sim >= threshold)
            yield pa.RecordBatch.from_arrays(
                [b.column("a").filter(keep), b.column("b").filter(keep), pa.array(sim).filter(keep)], ["a", "b", "similarity"]
            )

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, chunk) whose multisets of shingles overlap enough.

    Text b travels with its pair, text a once for every chunk of at most 1,024 pairs, so that a frequent a is split."""
    left = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    heads = pairs.select("a", "chunk").distinct().join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(heads, ["a", "chunk"])
    return both.select("a", "b", "ta", "tb").mapInArrow(_overlaps(threshold), "a long, b long, similarity double")


#: Keys of open buckets are broadcast up to this number (8 bytes each, counted first); more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def near_duplicate_classes(
    docs: DataFrame,
    threshold: float = 0.8,
    bands: int = 32,
    rows: int = 5,
    deviations: float = 4.0,
    block: int = 2048,
    block_bytes: int = 8 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row ``(doc_id, class_id)`` per input row; class_id is the smallest id of the class.

    Texts are linked if the multisets of their five-word shingles have a weighted Jaccard similarity of at least
    ``threshold``; classes are the connected components. Candidates share a band of the signature: at similarity 0.8 a
    pair is missed with a chance of about 3e-6 (32 bands of 5), and every link is verified on the texts themselves.

    Equal texts are one vertex, the smallest id, and have one signature in the buckets. First the members of a bucket
    are paired with its smallest member only (``led``: a bucket is sorted over as many tasks as its rows need), so work
    is linear in its size; that joins nearly all that belongs together. In buckets whose other members are not one class
    then, members of different classes are compared by their signatures, in pairs of blocks of about ``block`` members
    (fewer, if their shingles take more than ``block_bytes``); those that agree in a share of registers that is at most
    ``deviations`` standard deviations below the threshold are held against each other there by their shingles, and only
    links that join classes leave a block. Nothing is capped; but a family of n texts that share a bucket without being
    one class costs the square of n in comparisons of signatures, and each member's shingles go to n / ``block`` blocks.

    Nulls and edge cases: a null text counts as empty; empty texts (and texts of only white space that are equal) are
    copies of one another; an empty table has no rows. Rows with one id are one document. A null id gets a null class. Extra columns are ignored.
    """
    m = bands * rows
    src = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    known = src.filter("id is not null").withColumn("digest", F.unhex(F.md5("text")))
    sig = stored(known.mapInArrow(_signed(m), "id long, digest binary, sig binary"), "signatures")
    unique = stored(sig.groupBy("digest").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "unique")
    copies = sig.select("id", "digest").join(unique.select("digest", "rep"), "digest").select("id", "rep").distinct()
    keyed = unique.filter("sig is not null").select("rep", "sig").mapInArrow(_bands(bands, rows), "rep long, band int, key long")
    member = led(keyed, ["key"], ["rep"], "buckets").filter("rep <> lead_rep").select("key", "band", "rep", F.col("lead_rep").alias("leader"), "chunk")
    involved = member.select("rep").unionByName(member.select(F.col("leader").alias("rep"))).distinct()
    # the text of a representative is that of its own digest, also where rows with one id differ
    texts = stored(
        known.join(involved.join(unique.select("rep", "digest"), "rep").withColumnRenamed("rep", "id"), ["id", "digest"])
        .groupBy("id", "digest")
        .agg(F.min("text").alias("text"))
        .select("id", "text"),
        "texts",
    )
    pairs = member.groupBy(F.col("leader").alias("a"), F.col("rep").alias("b")).agg(F.min("chunk").alias("chunk"))
    links = stored(verified(pairs, texts, threshold), "links")
    label = stored(components(links.select("a", "b")), "labels")

    told = member.select("key", "band", "rep").join(label.withColumnRenamed("id", "rep"), "rep", "left")
    told = stored(told.select("key", "band", "rep", F.coalesce("component", "rep").alias("component")), "told")
    split = stored(told.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key"), "split")
    few = split.count() <= BROADCAST_KEYS
    left = told.join(F.broadcast(split) if few else split, "key")
    sets = stored(left.select(F.col("rep").alias("id")).distinct().join(texts, "id").mapInArrow(_sets, "rep long, shingles binary"), "sets")
    left = stored(left.join(sets.select("rep", F.octet_length("shingles").cast("long").alias("bytes")), "rep"), "open")
    parts = F.ceil(F.greatest(F.count("*") / block, F.sum("bytes") / block_bytes)).cast("int").alias("parts")
    load = left.groupBy("key").agg(parts)
    left = left.join(F.broadcast(load) if few else load, "key").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # a block meets every later block of its bucket, and itself: side 0, 1, or 2 for both
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key",
        "band",
        F.least("part", "other").alias("lo"),
        F.greatest("part", "other").alias("hi"),
        F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1).alias("side"),
        "rep",
        "component",
    )
    least = threshold - deviations * math.sqrt(threshold * (1 - threshold) / m)
    full = left.join(unique.select("rep", "sig").join(sets, "rep"), "rep")
    found = full.groupBy("key", "lo", "hi").applyInArrow(_block_links(bands, rows, least, threshold), "a long, b long").distinct()
    more = stored(found, "links")
    if not more.isEmpty():
        links = links.select("a", "b").unionByName(more)
        label = stored(components(links.select("a", "b")), "labels")
    # rows of one id with different texts tie their classes together
    ties = copies.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    several = copies.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id").limit(1)
    if not several.isEmpty():
        label = stored(components(links.select("a", "b").unionByName(ties)), "labels")
        ids = copies.select("id").distinct().select("id", F.col("id").alias("rep"))
    else:
        ids = copies
    out = ids.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "id", F.coalesce("component", "rep").alias("class_id")
    )
    rows_ = src.select("id")
    return rows_.join(out, "id", "left").select(F.col("id").alias("doc_id"), "class_id")


def first_of_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the smallest id, of several rows of that id the one
    with the smallest text, of equal ones the one with the smallest hash of its columns.

    Rows with a null id stay; null and empty texts are one class; an empty table stays empty; extra columns pass through.
    """
    inner, (id_, text) = positional(docs, id_col, text_col)
    classes = near_duplicate_classes(inner, id_col=id_, text_col=text, **options)
    first = classes.filter("doc_id = class_id").select("doc_id").distinct()
    mine = inner.join(first, F.col(id_).cast("long") == F.col("doc_id")).drop("doc_id")
    whole = F.xxhash64(*[f.name for f in inner.schema.fields if "map<" not in f.dataType.simpleString()])
    order = Window.partitionBy(id_).orderBy(F.col(text).asc_nulls_first(), whole)
    kept = mine.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
    return kept.unionByName(inner.filter(F.col(id_).isNull())).toDF(*docs.columns)
