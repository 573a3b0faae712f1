"""Vectorised word and shingle hashing over the buffers of an Arrow string column.

A word is a maximal run of bytes that are not separators. Its hash is a polynomial over random byte values modulo
2**64, taken from one running sum over the batch, so that a batch of texts costs a few passes of numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once, unless one text is longer. Memory is about 60 times this.
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD_BASE, _WORD_INVERSE = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCTUATION = _SPACE.copy()
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
#: A second family of hashes, for keys of 128 bits.
OTHER_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
OTHER_BASE, OTHER_WORD_BASE = np.uint64(0xC6A4A7935BD1E995), np.uint64(0xFF51AFD7ED558CCD)
OTHER_INVERSE, OTHER_WORD_INVERSE = (np.uint64(pow(int(b), -1, 1 << 64)) for b in (OTHER_BASE, OTHER_WORD_BASE))
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1)."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK // 4), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 8 * CHUNK:
            _powers[int(base)] = have
    return have[:n]


def ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray, base=_BASE, inverse=_INVERSE) -> np.ndarray:
    """Polynomial hash of values[start:end] for every pair of bounds."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values)), out=total[1:])
    return mix((total[end] - total[start]) * _power(inverse, len(values) + 1)[start])


@dataclass
class Words:
    """Words of ``n`` texts: hash, text and the byte bounds in ``data``; ``first[d]:first[d + 1]`` are those of text d."""

    n: int
    data: np.ndarray
    offsets: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words(texts: pa.Array, folded: bool = False) -> Words:
    """folded: ASCII letters in lower case and ASCII punctuation as separators; else only ASCII white space separates."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    lo, hi = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
    data = np.frombuffer(data, np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    offsets = offsets - lo
    solid = ~(_PUNCTUATION if folded else _SPACE)[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    hashes = ranges((_FOLDED if folded else _VALUES)[data], start, end) if len(start) else np.zeros(0, np.uint64)
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(n, data, offsets, hashes, doc, start, end, np.searchsorted(doc, np.arange(n + 1)))


_PLACE = mix(np.arange(11, 75, dtype=np.uint64)) | np.uint64(1)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of every run of k words; a text of one to k - 1 words has one shingle, of all its words."""
    count = np.diff(w.first)
    m = len(w.hash) - k + 1
    if m > 0:
        h = np.zeros(m, np.uint64)
        for j in range(k):
            h += w.hash[j : j + m] * _PLACE[j]
        at = np.flatnonzero(w.doc[:m] == w.doc[k - 1 :])
        h, doc = mix(h[at]), w.doc[at]
    else:
        h, doc, at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            extra[has] += w.hash[w.first[short[has]] + j] * _PLACE[j]
        h = np.concatenate([h, mix(extra ^ np.uint64(k))])
        doc, at = np.concatenate([doc, short]), np.concatenate([at, w.first[short]])
    return h, doc, at


def pieces(batches, column: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``size`` bytes of text, or one row."""
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.concatenate([[0], np.cumsum(length)]), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
