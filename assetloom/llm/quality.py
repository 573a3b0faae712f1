"""Quality scores by co-training of a text view and a metadata view (operator 9)."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm import _words
from assetloom.llm._common import pick, positional, stored

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!", b"%#$&*@^~", b"|<>{}[]\\", b".", b",;:", b"\n"]
_KIND = np.zeros(256, np.int64)
for _i, _c in enumerate(_CLASSES):
    _KIND[list(_c)] = _i + 1
_KIND[128:] = len(_CLASSES) + 1
_N = len(_CLASSES) + 2
_BUCKETS = 32
#: Numbers kept of a document: the shape of its text, and the metadata before languages and sources become columns.
_TEXT = _N + 4
_WIDE = [f"f{i}" for i in range(_TEXT + 3)]
#: Buckets of hashed words; a document keeps its number of words in each (32 bits).
_WORDS = 192
#: Words are many and rare: their weights are held back more than those of the shape.
_WORD_RIDGE = 60.0


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of whole texts, a row each: their shape (shares of character classes, word length, repetition; floats), and how
    many of their words (lower case, without punctuation) fall into each bucket."""
    w = _words.words(texts, folded=True)
    bag = np.bincount(w.doc * _WORDS + (w.hash % np.uint64(_WORDS)).astype(np.int64), minlength=w.n * _WORDS).reshape(w.n, _WORDS)
    bag = bag.astype(np.uint32)
    w = _words.words(texts)
    n = w.n
    size = np.maximum(np.diff(w.offsets), 1)
    doc_of = np.repeat(np.arange(n), np.diff(w.offsets))
    counts = np.bincount(doc_of * _N + _KIND[w.data], minlength=n * _N).reshape(n, _N)
    share = counts / size[:, None]
    words = np.maximum(np.diff(w.first), 1)
    length = np.bincount(w.doc, weights=w.end - w.start, minlength=n) / words
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    again = np.bincount(w.doc, weights=same, minlength=n) / words
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=n) / words
    return np.column_stack([np.sqrt(share[:, 1:]), np.log1p(length), again, distinct, np.log1p(words), distinct * np.log1p(words)]), bag


def metadata_codes(lang: pa.Array, source: pa.Array, n_chars: pa.Array, buckets: int = _BUCKETS) -> np.ndarray:
    """What is known of a text without reading it: stated length (logarithm), language and source (hashed)."""
    chars = np.asarray(pc.fill_null(n_chars.cast(pa.float64(), safe=False), 0.0).to_numpy(zero_copy_only=False))
    chars = np.log1p(np.maximum(np.nan_to_num(chars), 0))
    code = [np.array([zlib.crc32(f"{salt}{v}".encode()) % buckets for v in col.to_pylist()], float) for col, salt in ((lang, "l"), (source, "s"))]
    return np.column_stack([chars, *code])


def metadata_features(codes: np.ndarray, buckets: int = _BUCKETS) -> np.ndarray:
    """The metadata view of ``metadata_codes``: one column per bucket of language and source."""
    chars = codes[:, 0]
    out = [chars, chars**2 / 10, np.minimum(chars, 6), np.maximum(chars, 9)]
    for code in codes[:, 1:].T:
        hot = np.zeros((len(code), buckets))
        hot[np.arange(len(code)), code.astype(int)] = 1
        out.extend(hot.T)
    return np.column_stack(out)


@dataclass
class Logistic:
    """Ridge-regularised logistic regression on standardised features, fitted by Newton steps."""

    ridge: float = 1.0
    more: dict[int, float] = field(default_factory=dict)  # from a column on, another weight of the ridge
    mean: np.ndarray = field(default=None)
    scale: np.ndarray = field(default=None)
    w: np.ndarray = field(default=None)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        w = np.zeros(z.shape[1])
        reg = np.full(len(w), self.ridge)
        for first, ridge in self.more.items():
            reg[1 + first :] = ridge
        reg[0] = 1e-3
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (weight * (p - y)) + reg * w
            hess = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(reg)
            step = np.linalg.solve(hess, grad)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.w[0] + ((x - self.mean) / self.scale) @ self.w[1:], -30, 30)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class CoTrained:
    """Two views and the combination of their calibrated logits."""

    text: Logistic
    meta: Logistic
    joint: Logistic
    cut: float
    shift: float = 0.0

    def score(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        return _sigmoid(self.joint.logit(np.column_stack([self.text.logit(t), self.meta.logit(m)])) + self.shift)


def co_train(rows: np.ndarray, y: np.ndarray, surest, shift: float = 0.0, rounds: int = 4, each: int = 400, sure: float = 0.95) -> CoTrained | None:
    """rows, y: labelled documents, 1 good, 0 poor. A fifth of them is held out to calibrate and to combine the views.

    In every round each view names up to ``each`` unlabelled rows of either class that it is surest of (probability at
    least ``sure``), and the other view learns from them with half weight. ``surest(fits, shift, each, sure)`` finds them
    among all unlabelled documents and returns (rows, labels) by view. ``shift`` is the logarithm by which the odds of
    good are higher in the corpus than among ``rows``. Returns None if a class has under five rows.
    """
    if min((y == 1).sum(), (y == 0).sum()) < 5:
        return None
    t, m = views = _views(rows)
    known = np.arange(len(y))
    held = known[known % 5 == 4]
    train = np.setdiff1d(known, held)
    if len(set(y[held])) < 2 or len(set(y[train])) < 2:
        held = train = known

    def fit(v: int, more: np.ndarray, labels: np.ndarray) -> Logistic:
        x = np.concatenate([views[v][train], _views(more)[v]])
        return Logistic(more={_TEXT: _WORD_RIDGE} if v == 0 else {}).fit(x, np.concatenate([y[train], labels]), np.concatenate([np.ones(len(train)), np.full(len(more), 0.5)]))

    none = np.zeros((0, len(_WIDE) + _WORDS)), np.zeros(0)
    fits = [fit(0, *none), fit(1, *none)]
    for _ in range(rounds):
        named = surest(fits, shift, each, sure)
        if not any(len(labels) for _, labels in named):
            break
        fits = [fit(0, *named[1]), fit(1, *named[0])]
    pair = np.column_stack([fits[0].logit(t[held]), fits[1].logit(m[held])])
    joint = Logistic(ridge=0.1).fit(pair, y[held].astype(float), np.ones(len(held)))
    worst = int(np.argmin(joint.w[1:]))
    if joint.w[1 + worst] < 0:  # few held-out rows turned a view against itself: the other one decides
        pair[:, worst] = 0.0
        joint = Logistic(ridge=0.1).fit(pair, y[held].astype(float), np.ones(len(held)))
        joint.w[1 + worst] = 0.0
    out = CoTrained(fits[0], fits[1], joint, 0.5, shift)
    # odds among ``rows``, so that the cut isn't lower where poor documents are rare
    p = out.score(t[held], m[held])
    out.cut = _cut(p, y[held], *(float(_sigmoid(shift + math.log(x / (1 - x)))) for x in (_FLOOR, 0.5)))
    return out


#: A good document lost counts as much as so many poor ones kept; for exact probabilities, the cut is then at _FLOOR.
_GOOD_COSTS = 4.0
_FLOOR = 1 / (1 + _GOOD_COSTS)


def _cut(p: np.ndarray, y: np.ndarray, low: float, high: float) -> float:
    """The highest cut between ``low`` and ``high`` with the least loss on rows of probability ``p`` and label ``y``.

    Wrong labels far below ``low`` cost the same at every cut, so they don't draw it down among the poor documents.
    """
    at = np.unique(np.concatenate([[low, high], p[(p > low) & (p < high)]]))
    good, poor = np.sort(p[y == 1]), np.sort(p[y == 0])
    loss = _GOOD_COSTS * np.searchsorted(good, at) + len(poor) - np.searchsorted(poor, at)
    return float(at[np.flatnonzero(loss == loss.min())[-1]])


_NEEDS = ("text", "lang", "source", "n_chars")


def _views(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text view and the metadata view of rows as ``_rows`` gives them: shape, metadata, words."""
    k = len(_WIDE)
    words = np.sqrt(rows[:, k:])
    return np.column_stack([rows[:, :_TEXT], words / np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1)]), metadata_features(rows[:, _TEXT:k])


def _rows(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
    texts = b.column(names.index("text"))

    def col(name, kind):
        return b.column(names.index(name)) if name in names else pa.nulls(b.num_rows, kind)

    shape, bag = text_features(texts)
    return np.column_stack([shape, metadata_codes(col("lang", pa.string()), col("source", pa.string()), col("n_chars", pa.int64())), bag])


def _columns(rows: np.ndarray) -> list[pa.Array]:
    """Rows as columns: the numbers, and the words as one binary column."""
    bag = np.ascontiguousarray(rows[:, len(_WIDE) :]).astype(np.uint32)
    bounds = np.arange(len(rows) + 1, dtype=np.int32) * (4 * _WORDS)
    packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(bounds), pa.py_buffer(bag.tobytes())])
    return [*(pa.array(np.ascontiguousarray(c)) for c in rows[:, : len(_WIDE)].T), packed]


_KEPT = [*_WIDE, "bag"]
_KINDS = ", ".join([*(f"{c} double" for c in _WIDE), "bag binary"])


def _wide(b) -> np.ndarray:
    """The rows of a batch or table with the columns of ``_columns``."""
    numbers = [np.asarray(b.column(b.schema.names.index(c)).to_numpy(), float) for c in _WIDE]
    bag = np.frombuffer(b"".join(b.column(b.schema.names.index("bag")).to_pylist()), np.uint32).reshape(b.num_rows, _WORDS)
    return np.column_stack([*numbers, bag]) if b.num_rows else np.zeros((0, len(_WIDE) + _WORDS))


def _first(v: np.ndarray, each: int) -> np.ndarray:
    """The first ``each`` places of either class and view. v: columns view, label, logit, features; surest first, then by features."""
    order = np.lexsort([*v.T[2 + len(_WIDE) : 2 : -1], -np.abs(v[:, 2]), v[:, 1], v[:, 0]])
    group = v[order, 0] * 2 + v[order, 1]
    start = np.searchsorted(group, group)
    return order[np.arange(len(order)) - start < each]


def surest_of(pool: DataFrame):
    """For ``co_train``: the rows of ``pool`` that each view is surest of.

    Every row is scored by both views. Each task keeps the first ``each`` of either class and view, a second level of
    tasks those of about a square root of the tasks, and the driver merges what is left.
    """
    names = ["view", "label", "logit", *_KEPT]
    kinds = f"view double, label double, logit double, {_KINDS}"
    groups = max(1, math.ceil(math.sqrt(pool.rdd.getNumPartitions())))

    def batch(v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in v[:, :3].T), *_columns(v[:, 3:])], names)

    def matrix(b) -> np.ndarray:
        head = np.column_stack([b.column(b.schema.names.index(c)).to_numpy() for c in names[:3]]).reshape(b.num_rows, 3)
        return np.column_stack([head, _wide(b)])

    def best(fits: list[Logistic], shift: float, each: int, sure: float):
        least = math.log(sure / (1 - sure))

        def name(batches):
            kept = np.zeros((0, 3 + len(_WIDE) + _WORDS))
            for b in batches:
                rows = _wide(b)
                parts = [kept]
                for view, x in enumerate(_views(rows)):
                    z = fits[view].logit(x) + shift
                    at = np.flatnonzero(np.abs(z) >= least)
                    parts.append(np.column_stack([np.full(len(at), float(view)), (z[at] > 0).astype(float), z[at], rows[at]]))
                kept = np.concatenate(parts)
                kept = kept[_first(kept, each)]
            yield batch(kept)

        def merge(batches):
            kept = np.zeros((0, 3 + len(_WIDE) + _WORDS))
            for b in batches:
                kept = np.concatenate([kept, matrix(b)])
                kept = kept[_first(kept, each)]
            yield batch(kept)

        v = matrix(pool.select(*_KEPT).mapInArrow(name, kinds).repartition(groups).mapInArrow(merge, kinds).toArrow())
        v = v[_first(v, each)]
        return [(v[v[:, 0] == view][:, 3:], v[v[:, 0] == view][:, 1]) for view in (0, 1)]

    return best


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, **options) -> CoTrained | None:
    """Fit on labelled and all unlabelled documents.

    At most ``max_labelled`` labelled documents reach the driver, chosen by a hash of the id, half of them from either
    class if it has so many (else all of the class); scores are corrected for that. Every document without a label is
    scored in each round of co-training. The features of all documents (18 numbers and 192 bytes each) are written once
    to the shared folder.

    Nulls and edge cases: labels without id or quality, or of documents that are not in ``docs``, don't count; several
    labels of one id count by their mean (a tie is good), and all rows of that id have it. Null or empty texts have the
    shape of no words; null language or source is a value of its own, null length counts as 0, and so does a column that
    is missing. Rows without an id are unlabelled. Fewer than five documents of a class, or an empty table, give no
    model (None). Extra columns are ignored.
    """
    cols = [c for c in _NEEDS if c in docs.columns]
    lab = (
        pick(labels, doc_id="doc_id", quality="quality")
        .filter("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("double").alias("y"))
    )
    src = pick(docs, id="doc_id", **{c: c for c in cols}).withColumn("id", F.col("id").cast("long"))

    def run(batches):
        for b in _words.pieces(batches, "text"):
            v = _rows(b, b.schema.names)
            yield pa.RecordBatch.from_arrays([b.column("id"), *_columns(v)], ["id", *_KEPT])

    found = src.mapInArrow(run, f"id long, {_KINDS}")
    # rows without an id are dealt by their features, so that they are no hot key
    found = found.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64(*_WIDE)).otherwise(0))
    found = stored(found.join(lab.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left").select("id", "y", *_KEPT), "quality")
    have = {int(r["y"]): r["count"] for r in found.filter("y is not null").groupBy("y").count().collect()}
    if min(have.get(0, 0), have.get(1, 0)) < 5:
        return None
    half = max_labelled // 2
    take = {c: min(have[c], max(half, max_labelled - have[1 - c])) for c in (0, 1)}
    place, full = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 40)), 1 << 40
    parts = []
    for c in (0, 1):
        near = int(min(1.0, (take[c] + 5 * math.sqrt(take[c]) + 50) / have[c]) * full)
        some = found.filter((F.col("y") == c) & (place < near)).withColumn("place", place)
        parts.append(some.orderBy("place", "id", *_WIDE).limit(take[c]).select("id", "y", *_KEPT).toArrow())
    got = pa.concat_tables(parts)
    got = got.take(pc.sort_indices(got, sort_keys=[(c, "ascending") for c in ("id", *_WIDE)]))
    y = got.column("y").to_numpy()
    shift = math.log(have[1] / max((y == 1).sum(), 1)) - math.log(have[0] / max((y == 0).sum(), 1))
    return co_train(_wide(got), y, surest_of(found.filter("y is null")), shift, **options)


def scored(docs: DataFrame, model: CoTrained | None, only_kept: bool = False) -> DataFrame:
    """``docs`` with ``quality_score`` and ``keep``; or its own columns with the kept rows alone.

    Columns of these two names that ``docs`` has already are replaced (unless ``only_kept``, which adds none). Without a
    model every score is null and every row is kept.

    Nulls and edge cases: null and empty texts are scored by their shape like any other; null or missing metadata as in
    ``train``; repeated rows are scored each; ids don't matter; an empty table stays empty; extra columns pass through.
    """
    more = [] if only_kept else ["quality_score", "keep"]
    inner, (text,) = positional(docs, "text")
    names = [n for n in docs.columns if n not in more]
    inner = inner.select(*[c for c, n in zip(inner.columns, docs.columns, strict=True) if n not in more])
    kinds = [T.StructField("quality_score", T.DoubleType()), T.StructField("keep", T.BooleanType())]

    def run(batches):
        for b in _words.pieces(batches, text):
            if model is None:
                p, keep = pa.nulls(b.num_rows, pa.float64()), pa.array(np.ones(b.num_rows, bool))
            else:
                v = model.score(*_views(_rows(b, names)))
                p, keep = pa.array(v), pa.array(v >= model.cut)
            if only_kept:
                yield b.filter(keep)
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, p, keep], [*b.schema.names, *more])

    out = inner.mapInArrow(run, inner.schema if only_kept else T.StructType(inner.schema.fields + kinds))
    return out.toDF(*names, *more)
