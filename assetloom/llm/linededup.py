"""Repeated runs of lines across documents by winnowing (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm import _words
from assetloom.llm._common import led, positional, stored


def line_table(texts: pa.Array, keys: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines that hold a word: (key, words, text, byte start, byte end); the end is past the newline.

    A line's key is two hashes (128 bits) of its words, so lines that differ in white space alone are equal; it is left
    out (no columns) unless ``keys``.
    """
    w = _words.words(texts)
    if not len(w.hash):
        none = np.zeros(0, np.int64)
        return np.zeros((0, 2), np.uint64), none, none, none, none
    breaks = np.flatnonzero(w.data == 10) + 1
    bounds = np.union1d(breaks, w.offsets)
    line = np.searchsorted(bounds, w.start, "right") - 1
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    end = np.append(first[1:], len(line))
    h = np.zeros((len(first), 0), np.uint64)
    if keys:
        other = _words.ranges(_words.OTHER_VALUES[w.data], w.start, w.end, _words.OTHER_BASE, _words.OTHER_INVERSE)
        one = _words.ranges(w.hash, first, end, _words._WORD_BASE, _words._WORD_INVERSE)
        h = np.column_stack([one, _words.ranges(other, first, end, _words.OTHER_WORD_BASE, _words.OTHER_WORD_INVERSE)])
    at = line[first]
    return h, end - first, w.doc[first], bounds[at], bounds[at + 1]


def windows(n: np.ndarray, first: np.ndarray, lines: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(last line of the smallest window that starts at each line, first line of the smallest that ends at each), -1: none.

    A window is large enough if it has ``lines`` lines or ``words`` words. n: words of each line; first: where texts
    begin, and the number of lines.
    """
    k = len(n)
    total, at = np.concatenate([[0], np.cumsum(n)]), np.arange(k)
    text = np.searchsorted(first, at, "right") - 1
    last = np.minimum(np.searchsorted(total, total[:-1] + words) - 1, at + lines - 1)
    begin = np.maximum(np.searchsorted(total, total[1:] - words, "right") - 1, at - lines + 1)
    return np.where(last < first[text + 1], last, -1), np.where(begin >= first[text], begin, -1)


def fingerprints(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Lines that winnowing selects: of the lines of each window (``last`` as of ``windows``) the one of least hash, of
    equal ones the last. Equal runs that are large enough select the same lines, whatever stands around them."""
    at = np.flatnonzero(last >= 0)
    best, end = at.copy(), last[at]
    for j in range(1, int((end - at).max(initial=0)) + 1):
        some = np.flatnonzero(at + j <= end)
        some = some[h[at[some] + j] <= h[best[some]]]
        best[some] = at[some] + j
    return np.unique(best)


def _lists(values: pa.Array, sizes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


_LINES = "id long, th binary, keys binary, words array<int>, prints array<struct<k1:long,k2:long,line:int>>"


def _lines(lines: int, words: int):
    def run(batches):
        for b in _words.pieces(batches, "text"):
            h, n, doc, _, _ = line_table(b.column("text"), keys=True)
            first = np.searchsorted(doc, np.arange(b.num_rows + 1))
            chosen = fingerprints(h[:, 0], windows(n, first, lines, words)[0])
            of = doc[chosen]
            keep = np.flatnonzero(np.bincount(of, minlength=b.num_rows))
            raw, take = np.ascontiguousarray(h), pa.array(keep)
            prints = pa.StructArray.from_arrays([pa.array(h[chosen, 0].view(np.int64)), pa.array(h[chosen, 1].view(np.int64)), pa.array((chosen - first[of]).astype(np.int32))], ["k1", "k2", "line"])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").take(take),
                    b.column("th").take(take),
                    pa.array([raw[first[d] : first[d + 1]].tobytes() for d in keep], pa.binary()),
                    _lists(pa.array(np.concatenate([n[first[d] : first[d + 1]] for d in keep]) if len(keep) else [], pa.int32()), first[keep + 1] - first[keep]),
                    _lists(prints, np.bincount(of, minlength=b.num_rows)[keep]),
                ],
                ["id", "th", "keys", "words", "prints"],
            )

    return run


_SPREAD = "k1 long, k2 long, id long, th binary, line int, last int"


def _spread(lines: int, words: int):
    """Matched positions extended both ways: the windows of guaranteed size around them, keyed by all their lines."""

    def run(batches):
        for b in batches:
            row, key, line, last = [], [], [], []
            for i, (raw, n, at) in enumerate(zip(*(b.column(c) for c in ("keys", "words", "matched")), strict=True)):
                raw, n = raw.as_py(), n.values.to_numpy()
                k = len(n)
                to, begin = windows(n, np.array([0, k]), lines, words)
                hit = np.zeros(k + 1, np.int64)
                hit[at.values.to_numpy() + 1] = 1
                hit = np.cumsum(hit)
                own = np.arange(k)
                pairs = np.unique(np.concatenate([np.column_stack([own, to])[to >= 0], np.column_stack([begin, own])[begin >= 0]]), axis=0)
                for s, t in pairs[hit[pairs[:, 1] + 1] > hit[pairs[:, 0]]].tolist():
                    row.append(i)
                    key.append(xxhash.xxh3_128_digest(raw[16 * s : 16 * (t + 1)]))
                    line.append(s)
                    last.append(t)
            k = np.frombuffer(b"".join(key), np.int64).reshape(-1, 2)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(k[:, 0])), pa.array(np.ascontiguousarray(k[:, 1])), b.column("id").take(take), b.column("th").take(take), pa.array(line, pa.int32()), pa.array(last, pa.int32())],
                ["k1", "k2", "id", "th", "line", "last"],
            )

    return run


def _cut(text_at: int, hits_at: int, counted: bool, names: list[str]):
    def run(batches):
        for whole in batches:
            for b in _words.pieces([whole], whole.schema.names[text_at]):
                texts, hits = b.column(text_at), b.column(hits_at)
                gone = np.zeros(b.num_rows, np.int64)
                rows = np.flatnonzero(~np.asarray(hits.is_null()))
                if len(rows):
                    sub = texts.take(pa.array(rows))
                    _, _, doc, start, end = line_table(sub)
                    first = np.searchsorted(doc, np.arange(len(rows) + 1))
                    new: list = texts.to_pylist()
                    base = _words.words(sub).offsets
                    for i, row in enumerate(rows):
                        f, g = first[i], first[i + 1]
                        drop = np.zeros(g - f, bool)
                        for hit in hits[int(row)].as_py():
                            drop[hit["line"] : hit["last"] + 1] = True
                        raw = new[row].encode()
                        out, at = [], 0
                        for s, e in zip((start[f:g] - base[i])[drop].tolist(), (end[f:g] - base[i])[drop].tolist(), strict=True):
                            out.append(raw[at:s])
                            at = e
                        out.append(raw[at:])
                        text = b"".join(out)
                        new[row] = (text[:-1] if at == len(raw) and text.endswith(b"\n") and not raw.endswith(b"\n") else text).decode()
                        gone[row] = int(drop.sum())
                    texts = pa.array(new, pa.string())
                cols = [texts if i == text_at else b.column(i) for i in range(b.num_columns) if i != hits_at]
                if counted:
                    cols.append(pa.array(gone))
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def drop_repeated_runs(
    docs: DataFrame, least_lines: int = 3, least_words: int = 50, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None
) -> DataFrame:
    """``docs`` with later repeated runs of lines cut out of the text; every row and column stays.

    A run of consecutive lines with at least ``least_lines`` lines or ``least_words`` words is deleted where an equal run
    (lines equal up to white space) comes earlier in the corpus, in order of (id, digest of the text, line), also within
    one text, where it must not overlap the earlier one. What repeats for fewer lines and words stays, and so do
    passages that begin or end within a line. ``count_col`` adds the number of lines cut.

    Winnowing: of every smallest window of that size the line of least hash is a fingerprint, so every run that is large
    enough holds one, the same in all its copies. Positions of equal fingerprints are joined; around each matched one,
    matches are extended both ways to the windows of guaranteed size that hold it, which are joined to the first
    occurrence of all their lines. Windows that overlap make up longer runs, so exactly the union of all maximal repeated
    runs goes. Both joins follow a sort (``led``), so a line or passage in a third of all texts is split over tasks and
    gives one row each, not pairs. Keys of lines and windows have 128 bits. Texts travel once, by id; else line keys do.

    Nulls and edge cases: null and empty texts stay as they are; lines without a word are neither counted nor cut;
    null ids come first in the order; rows equal in id and text are one document and keep the same lines; a text may
    become empty; an empty table stays empty. Extra columns pass through, whatever their names.
    """
    inner, (id_, text) = positional(docs, id_col, text_col)
    wide = inner.withColumn("th", F.unhex(F.md5(text)))
    src = wide.select(F.col(id_).cast("long").alias("id"), "th", F.col(text).alias("text"))
    lines = stored(src.filter("text is not null").mapInArrow(_lines(least_lines, least_words), _LINES), "lines")
    place = ["id", "th", "line"]
    prints = lines.select("id", "th", F.explode("prints").alias("p")).select("p.k1", "p.k2", "id", "th", "p.line")
    again = led(prints, ["k1", "k2"], place, "prints").filter(~F.struct(*place).eqNullSafe(F.struct(*[f"lead_{c}" for c in place])))
    matched = again.select(*place).unionByName(again.select(*[F.col(f"lead_{c}").alias(c) for c in place]))
    matched = matched.groupBy("id", "th").agg(F.collect_set("line").alias("matched")).withColumnsRenamed({"id": "near_id", "th": "near_th"})
    # rows equal in id and text give equal windows, which are one place
    chosen = lines.join(matched, F.col("id").eqNullSafe(F.col("near_id")) & (F.col("th") == F.col("near_th"))).select("id", "th", "keys", "words", "matched")
    place = ["id", "th", "line", "last"]
    spread = led(stored(chosen.mapInArrow(_spread(least_lines, least_words), _SPREAD), "windows"), ["k1", "k2"], place, "runs")
    same_text = F.col("id").eqNullSafe(F.col("lead_id")) & (F.col("th") == F.col("lead_th"))
    later = (
        spread.filter(~(same_text & (F.col("line") <= F.col("lead_last"))))
        .groupBy(F.col("id").alias("hit_id"), F.col("th").alias("hit_th"))
        .agg(F.collect_set(F.struct("line", "last")).alias("hits"))
    )
    wide = wide.join(later, F.col(id_).cast("long").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left")
    names = list(inner.columns) + ([count_col] if count_col else [])
    fields = inner.schema.fields + ([T.StructField(count_col, T.LongType())] if count_col else [])
    at = inner.columns.index(text)
    cut = wide.select(*inner.columns, "hits").mapInArrow(_cut(at, len(inner.columns), bool(count_col), names), T.StructType(fields))
    return cut.toDF(*docs.columns, *([count_col] if count_col else []))
