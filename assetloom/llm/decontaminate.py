"""Benchmark passages in documents by greedy string tiling (operator 10)."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm import _words
from assetloom.llm._common import pick, positional, stored

#: Benchmark bytes that one pass over the documents takes; a larger benchmark is taken in as many blocks as it needs.
BLOCK_BYTES = 8 << 20


def folded(texts: pa.Array) -> pa.Array:
    """Texts in compatibility form and lower case, with spaces for punctuation and around signs that are words of their own."""
    texts = pc.fill_null(texts, "")
    plain = pc.string_is_ascii(texts)
    if pc.all(plain).as_py() is not False:
        return texts  # what is left to do in ASCII is done where words are cut
    rest = texts.filter(pc.invert(plain))
    rest = pc.utf8_lower(pc.utf8_normalize(rest, "NFKC"))
    rest = pc.replace_substring_regex(rest, r"[\p{P}\p{S}\p{Z}\p{C}]+", " ")
    rest = pc.replace_substring_regex(rest, r"([\p{Han}\p{Hiragana}\p{Katakana}])", r" \1 ")
    return pc.replace_with_mask(texts, pc.invert(plain), rest)


def _of(words: _words.Words, at: int) -> np.ndarray:
    return words.hash[words.first[at] : words.first[at + 1]]


def _edges(a: np.ndarray, b: np.ndarray, at: np.ndarray, by_a: np.ndarray, by_b: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of equal codes a[i] = b[j] whose neighbours by_a[i] and by_b[j] differ or are not there (-1); ``at`` are the
    places of b with a code. Of pairs whose neighbours are equal none is made."""
    key = b[at] * (kinds + 1) + by_b[at] + 1
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    lo, hi = np.searchsorted(key, a * (kinds + 1)), np.searchsorted(key, (a + 1) * (kinds + 1))
    same = a * (kinds + 1) + by_a + 1
    from_, to = np.where(by_a < 0, lo, np.searchsorted(key, same)), np.where(by_a < 0, lo, np.searchsorted(key, same, "right"))
    i, j = [], []
    for x, y in ((lo, from_), (to, hi)):
        n = y - x
        i.append(np.repeat(np.arange(len(a)), n))
        j.append(at[np.repeat(x - (np.cumsum(n) - n), n) + np.arange(n.sum())])
    return np.concatenate(i), np.concatenate(j)


def runs(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """All maximal runs a[i : i + n] = b[j : j + n], as (n, i, j).

    Only the first and the last pair of every run are made, and matched in order along their diagonal: texts that repeat
    a period have few runs but as many pairs as the product of their lengths."""
    values, a = np.unique(a, return_inverse=True)
    code = np.minimum(np.searchsorted(values, b), len(values) - 1)
    b = np.where(values[code] == b, code, -1)
    at = np.flatnonzero(b >= 0)
    none = np.array([-1])
    ends = []
    for by_a, by_b in ((np.concatenate([none, a[:-1]]), np.concatenate([none, b[:-1]])), (np.concatenate([a[1:], none]), np.concatenate([b[1:], none]))):
        i, j = _edges(a, b, at, by_a, by_b, len(values))
        order = np.lexsort((i, j - i))
        ends.append((i[order], j[order]))
    (i, j), (last, _) = ends
    return list(zip((last - i + 1).tolist(), i.tolist(), j.tolist(), strict=True))


class Items:
    """The words of a block of benchmark passages and the hashes of all their runs of ``least`` words (the seeds).

    A passage with fewer words has one seed, all its words."""

    def __init__(self, ids: list, texts: list[str], least: int):
        w = _words.words(folded(pa.array(texts, pa.string())), folded=True)
        size = np.diff(w.first)
        self.least, self.ids, self.words = least, ids, [_of(w, i) for i in range(w.n)]
        self.seeds = {}
        for k in sorted({min(int(n), least) for n in size if n}):
            h, item, at = _words.shingles(w, k)
            mine = size[item] >= least if k == least else size[item] == k
            h, item, at = h[mine], item[mine], at[mine]
            order = np.lexsort((at, item))  # seeds of a passage in their order
            own = h[order], np.searchsorted(item[order], np.arange(w.n + 1))
            order = np.argsort(h, kind="stable")
            self.seeds[k] = h[order], item[order], (at - w.first[item])[order], own

    def tiles(self, item: int, text: np.ndarray, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Greedy string tiling of one passage against one text from the runs of seeds (how many, places in passage and text).

        Seeds are equal fingerprints of ``least`` words; runs of them make up the maximal matches, whose words are compared. The longest match is marked first (ties: earlier in the passage, then in the text);
        what a match loses to earlier marks splits it, and pieces of at least ``least`` words compete again. It ends
        when no stretch of ``least`` words of the passage is free.
        """
        mine = self.words[item]
        least = min(self.least, len(mine))
        heap = [(-(n + least - 1), x, y) for n, x, y in found]
        heapq.heapify(heap)
        taken, used, out = np.zeros(len(mine), bool), np.zeros(len(text), bool), []
        while heap:
            n, x, y = heapq.heappop(heap)
            busy = np.flatnonzero(taken[x : x - n] | used[y : y - n] | (mine[x : x - n] != text[y : y - n]))
            if not len(busy):
                taken[x : x - n] = used[y : y - n] = True
                out.append((x, y, -n))
                walls = np.concatenate([[-1], np.flatnonzero(taken), [len(mine)]])
                if np.diff(walls).max() <= least:
                    break
                continue
            walls = np.concatenate([[-1], busy, [-n]])
            for k in np.flatnonzero(np.diff(walls) > least):
                lo = int(walls[k]) + 1
                heapq.heappush(heap, (-(int(walls[k + 1]) - lo), x + lo, y + lo))
        return out

    def search(self, texts: pa.Array, threshold: float):
        """(text, item, words covered, words of the item, tiles) where the tiles cover enough of the item."""
        if not self.seeds:
            return
        w = _words.words(folded(texts), folded=True)
        for k, (seed, item_of, place, (own, first)) in self.seeds.items():
            h, doc, _ = _words.shingles(w, k)
            whole = np.diff(w.first)[doc] >= k
            h, doc = h[whole], doc[whole]
            known = np.searchsorted(seed, h)
            hit = np.flatnonzero(seed[np.minimum(known, len(seed) - 1)] == h)
            some, begin = np.unique(doc[hit], return_index=True)  # texts come in their order
            for d, x, y in zip(some.tolist(), begin, np.append(begin[1:], len(hit)), strict=False):
                # every place of a passage once, however often the text has its seed
                each = np.unique(h[hit[x:y]])
                lo, n = np.searchsorted(seed, each), np.searchsorted(seed, each, "right")
                n -= lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                at = at[np.argsort(item_of[at], kind="stable")]
                item = item_of[at]
                bound = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]]))
                mine = h[slice(*np.searchsorted(doc, [d, d + 1]))]
                for a, b in zip(bound[:-1], bound[1:], strict=True):
                    of = int(item[a])
                    size = len(self.words[of])
                    reach = np.zeros(size + 1, np.int64)
                    np.add.at(reach, place[at[a:b]], 1)
                    np.add.at(reach, place[at[a:b]] + k, -1)
                    if np.count_nonzero(np.cumsum(reach)) < threshold * size:
                        continue
                    tiles = self.tiles(of, _of(w, d), runs(own[first[of] : first[of + 1]], mine))
                    covered = sum(t for _, _, t in tiles)
                    if covered >= threshold * size:
                        yield d, of, covered, size, len(tiles)


def blocks(benchmark: DataFrame, least: int, block_bytes: int, id_col: str, text_col: str):
    """The benchmark as broadcast blocks, each with whether it is the last and of about ``block_bytes`` at most (or one passage)."""
    spark = benchmark.sparkSession
    src = pick(benchmark, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long")).filter("text is not null")
    size = src.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = math.ceil(size / block_bytes) if size else 0
    part = F.pmod(F.xxhash64("id", "text"), F.lit(max(n, 1)))
    for k in range(n):
        rows = src.filter(part == k).orderBy("id", "text").collect()
        yield spark.sparkContext.broadcast(Items([r["id"] for r in rows], [r["text"] for r in rows], least)), k == n - 1


def contaminated_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.5,
    least: int = 5,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Pairs (doc_id, item_id, covered, item_words, coverage, n_tiles) whose tiles cover ``threshold`` of the passage.

    Words are compared in lower case without punctuation, in any script; ideographs and kana are words of their own.
    Tiles hold at least ``least`` words and overlap neither in the text nor in the passage, so a passage whose parts were
    put in another order is still found. A passage of fewer words counts where it stands whole.

    The benchmark is a query set against all documents: a block of bounded size is broadcast at a time. A larger
    benchmark takes a pass over the documents for each block, whose pairs are stored before the next is broadcast, so
    only one is held at once. Documents are read where they are; there is no shuffle.

    Nulls and edge cases: null or empty texts and passages match nothing; empty tables give no pairs; repeated rows give
    repeated pairs; ids may be null; extra columns are ignored.
    """
    schema = "doc_id long, item_id long, covered long, item_words long, n_tiles long"
    src = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def scan(block):
        def run(batches):
            items = block.value
            for b in _words.pieces(batches, "text"):
                got = sorted(items.search(b.column("text"), threshold))
                if got:
                    d, item, *rest = zip(*got, strict=True)
                    ids = pa.array([items.ids[i] for i in item], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(d)), ids, *(pa.array(x, pa.int64()) for x in rest)],
                        ["doc_id", "item_id", "covered", "item_words", "n_tiles"],
                    )

        return src.mapInArrow(run, schema)

    out = None
    for block, last in blocks(benchmark, least, block_bytes, item_col, item_text):
        found = scan(block)
        if not (last and out is None):  # more than one block
            found = stored(found, "pairs")
            block.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumn("coverage", F.round(F.col("covered") / F.col("item_words"), 6))


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: int = 5, block_bytes: int = BLOCK_BYTES, text_col: str = "text"
) -> DataFrame:
    """``docs`` without the rows that ``contaminated_pairs`` would report.

    One filtering pass for each block of the benchmark; what is left after a block is stored if another follows.

    Nulls and edge cases: rows with null or empty texts or null ids stay like any that match nothing; an empty benchmark
    keeps every row; an empty table stays empty; repeated rows go or stay together; extra columns pass through, whatever
    their names.
    """
    inner, (text,) = positional(docs, text_col)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in inner.schema.fields])

    def drop(df, block):
        def run(batches):
            for b in _words.pieces(batches, text):
                keep = np.ones(b.num_rows, bool)
                keep[[d for d, *_ in block.value.search(b.column(text), threshold)]] = False
                yield b.filter(pa.array(keep))

        return df.mapInArrow(run, schema)

    for block, last in blocks(benchmark, least, block_bytes, "item_id", "text"):
        inner = drop(inner, block)
        if not last:
            inner = stored(inner, "left")
            block.destroy()
    return inner.toDF(*docs.columns)
