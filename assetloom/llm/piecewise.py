"""Document fingerprints by context-triggered piecewise hashing (operator 12)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm._common import pick, stored
from assetloom.llm._words import mix, pieces

#: Bytes on which a boundary depends, pieces of a signature at most, and signs of a piece.
WINDOW, MOST, SIGNS = 7, 64, 2
#: Bytes of a text that are hashed at once; memory is about 60 times this.
SEGMENT = 1 << 19
_DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_ROLL = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWER, _BACK = _powers(_BASE, SEGMENT), _powers(_INVERSE, SEGMENT)


def _levels(data: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every byte, the hash of it and the six before, and how many of its low bits are ones; ``lead`` are six bytes before."""
    both = np.concatenate([lead, data]).astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(data), np.uint64)
    for k in range(WINDOW):
        h += both[WINDOW - 1 - k : len(both) - k] * _ROLL[k]
    h = mix(h)
    low = ~h & (h + np.uint64(1))  # the lowest bit that is zero
    return h, np.where(low == 0, 64, np.frexp(low.astype(np.float64))[1] - 1).astype(np.int8)


def _pieces(data: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The level of a text, the ends of its pieces there, and the sums of bytes times powers up to every end.

    A byte ends a piece at a level if that many low bits of its window's hash are ones and the text has no such window
    before (or repetitive texts had ends everywhere), so the ends of a level are among those of the one below. The level
    is the lowest that gives at most ``MOST`` ends, of those at which ``MOST`` pieces of usual length make up the text."""
    n = len(data)
    level = max(0, (max(n, 1) - 1).bit_length() - 6)
    ends, sums, marks, seen = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.uint64)
    lead, carry, scale = np.zeros(WINDOW - 1, np.uint8), np.uint64(0), 1
    for at in range(0, n, SEGMENT):
        part = data[at : at + SEGMENT]
        h, high = _levels(part, lead)
        total = np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWER[: len(part)]) * np.uint64(scale) + carry
        kept = np.flatnonzero(high >= level)
        kept = kept[np.sort(np.unique(h[kept], return_index=True)[1])]
        kept = kept[~np.isin(h[kept], seen)]
        ends, sums, marks, seen = (np.concatenate(x) for x in ((ends, at + kept + 1), (sums, total[kept]), (marks, high[kept]), (seen, h[kept])))
        while len(ends) > MOST:
            level += 1
            keep = marks >= level
            ends, sums, marks, seen = ends[keep], sums[keep], marks[keep], seen[keep]
        carry, scale = total[-1], scale * pow(_BASE, len(part), 1 << 64) % (1 << 64)
        lead = np.concatenate([lead, part])[-(WINDOW - 1) :]
    if n and (not len(ends) or ends[-1] < n):  # what follows the last boundary is a piece as well
        ends, sums, marks = np.append(ends, n), np.append(sums, carry), np.append(marks, np.int8(0))
    marks[-1:] = 127  # the end of the text ends a piece of any level
    return level, np.stack([ends, marks.astype(np.int64)]), sums


def _signature(ends: np.ndarray, sums: np.ndarray) -> str:
    start = np.concatenate([[0], ends[:-1]])
    back = _BACK[start % SEGMENT] * np.array([pow(_INVERSE, x, 1 << 64) for x in (start // SEGMENT * SEGMENT).tolist()], np.uint64)
    h = mix((sums - np.concatenate([[np.uint64(0)], sums[:-1]])) * back)
    return _DIGITS[np.stack([(h >> np.uint64(58 - 6 * k)).astype(np.int64) & 63 for k in range(SIGNS)], 1)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    """``level:signature:signature``: the level of the text's pieces, their signs (two for each piece), and the signs of the
    pieces of the next level. Pieces are cut where the content says so, so a change of the text changes the pieces around it."""
    level, (ends, marks), sums = _pieces(np.frombuffer(text, np.uint8))
    above = marks > level
    return f"{level}:{_signature(ends, sums)}:{_signature(ends[above], sums[above])}"


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence of two signatures, in pieces (bit-parallel: a word has a bit for each piece of ``a``)."""
    at: dict[str, int] = {}
    for i in range(0, len(a), SIGNS):
        at[a[i : i + SIGNS]] = at.get(a[i : i + SIGNS], 0) | 1 << i // SIGNS
    full = (1 << len(a) // SIGNS) - 1
    row = full
    for i in range(0, len(b), SIGNS):
        hit = row & at.get(b[i : i + SIGNS], 0)
        row = ((row + hit) | (row - hit)) & full
    return (full ^ row).bit_count()


def _near(a: str, b: str) -> float:
    """One minus the edit distance (insertions and deletions) over the pieces of both."""
    n = (len(a) + len(b)) // SIGNS
    return 2 * common(a, b) / n if n else 0.0


def likeness(a: str, b: str) -> float:
    """0 to 1: how much of two fingerprints is equal in order, at the levels that both have; 0 if they have none in common."""
    if a == b:
        return 1.0
    (i, a1, a2), (j, b1, b2) = a.split(":"), b.split(":")
    if i == j:
        return max(_near(a1, b1), _near(a2, b2))
    if int(i) == int(j) + 1:
        return _near(a1, b2)
    return _near(a2, b1) if int(i) == int(j) - 1 else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text, as it lies: no shuffle.

    Nulls and edge cases: a null text is an empty one (``0::``); repeated rows and null ids come out as they are; an empty
    table gives no rows; extra columns are ignored. A long text is hashed in segments, so memory doesn't grow with it
    beyond the text itself.
    """
    src = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches):
        for b in pieces(batches, "text"):
            texts = pc.fill_null(b.column("text"), "").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(fingerprint, texts), pa.string())], ["doc_id", "fingerprint"])

    return src.mapInArrow(run, "doc_id long, fingerprint string")


@F.udf(T.DoubleType(), useArrow=True)
def like(a, b):
    """``likeness`` of two fingerprint columns; null where one is null."""
    return None if a is None or b is None else likeness(a, b)


def spliced(text: str, after: str) -> str:
    """The text with its last third (rounded down, in code points) replaced by as much of the start of ``after``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + after[:cut]


_FIELDS = [
    ("doc_id", T.LongType(), pa.int64()),
    ("n_chars", T.LongType(), pa.int64()),
    ("edited_sha256", T.StringType(), pa.string()),
    ("fingerprint", T.StringType(), pa.string()),
    ("edited_fingerprint", T.StringType(), pa.string()),
    ("near_edited", T.DoubleType(), pa.float64()),
    ("near_next", T.DoubleType(), pa.float64()),
]
_EDGE = [("part", T.IntegerType(), pa.int32()), ("edge", T.StringType(), pa.string()), ("text", T.StringType(), pa.string())]


def _schema(fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind, _ in fields])


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    """Rows as a batch; of none, an empty one."""
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, _, kind) in zip(cols, fields, strict=True)], [name for name, _, _ in fields])


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint beside those of its edited text (``spliced`` with the next document) and of the next one:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next smaller id; after the last comes the first. Rows are range-partitioned and
    sorted once, and each task compares a row with the one that follows it. A task's last row meets the first of the next
    task in a join of two rows a task.

    Nulls and edge cases: a null text is an empty one; null ids come last; rows of one id come in the order of their
    texts' MD5, so repeated rows follow one another; the only row of a table is its own next one; an empty table gives no
    rows; extra columns are ignored.
    """
    src = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.md5("text")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(row, after):
        (i, text, mark), (_, follower, other) = row, after
        new = spliced(text, follower)
        raw = new.encode()
        edited = fingerprint(raw)
        return i, len(text), hashlib.sha256(raw).hexdigest(), mark, edited, likeness(mark, edited), likeness(mark, other)

    def run(batches):
        part, first, last, done = TaskContext.get().partitionId(), None, None, []

        def edge(row, kind):  # the first and the last row of a task, with their texts
            i, text, mark = row
            return (i, None, None, mark, None, None, None, part, kind, text)

        for b in pieces(batches, "text"):
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                row = (i, text, fingerprint(text.encode()))
                if last is None:
                    first = row
                else:
                    done.append((*compare(last, row), part, None, None))
                last = row
            if done:
                yield _batch(done, _FIELDS + _EDGE)
                done = []
        if last is not None:
            yield _batch([edge(first, "first"), edge(last, "last")], _FIELDS + _EDGE)

    sorted_rows = src.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    out = stored(sorted_rows.mapInArrow(run, _schema(_FIELDS + _EDGE)), "followed")
    inner = out.filter("edge is null").select(*[name for name, _, _ in _FIELDS])

    # which task follows which: numbers only, one row a task
    tasks = out.filter("edge = 'first'").select("part")
    follows = Window.orderBy("part")
    link = tasks.select(F.col("part").alias("of"), F.lead("part").over(follows).alias("to"), F.min("part").over(Window.partitionBy()).alias("top"))
    link = link.select("of", F.coalesce("to", "top").alias("to"))
    ends = out.filter("edge = 'last'").select(F.col("part").alias("of"), "doc_id", "text", "fingerprint")
    heads = out.filter("edge = 'first'").select(F.col("part").alias("to"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    pairs = ends.join(link, "of").join(heads, "to").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")

    def finish(batches):
        for b in batches:
            yield _batch([compare((r["doc_id"], r["text"], r["fingerprint"]), (None, r["next_text"], r["next_fingerprint"])) for r in b.to_pylist()], _FIELDS)

    return inner.unionByName(pairs.mapInArrow(finish, _schema(_FIELDS)))
