"""Token counts of whole texts by heap-and-linked-list pair merging (operator 5)."""

from __future__ import annotations

import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm._common import pick

#: Counts of words kept by a Python worker; the table is emptied when it is full.
CACHED = 400_000
_loaded: dict[str, "PairCounter"] = {}


def piece_kinds(model: bytes) -> set[int]:
    """The kinds of the pieces of a sentencepiece model (1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte)."""

    def number(at: int) -> tuple[int, int]:
        value, shift = 0, 0
        while True:
            b = model[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    def fields(at: int, end: int):
        while at < end:
            tag, at = number(at)
            if tag & 7 == 2:
                size, at = number(at)
                yield tag >> 3, at, at + size
                at += size
            elif tag & 7 == 0:
                value, to = number(at)
                yield tag >> 3, value, None
                at = to
            else:
                at += 4 if tag & 7 == 5 else 8

    kinds = set()
    for no, lo, hi in fields(0, len(model)):
        if no == 1 and hi is not None:
            kinds.add(next((v for n, v, end in fields(lo, hi) if n == 3 and end is None), 1))
    return kinds


class PairCounter:
    """Counts tokens as a sentencepiece model of byte-pair kind with the identity normaliser gives them."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            if piece_kinds(f.read()) & {4, 5}:
                raise ValueError("this model has user-defined or unused pieces, which aren't made by merging")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                self.rank[sp.id_to_piece(i)] = -sp.get_score(i)
        if any(re.search("[^▁]▁", p) for p in self.rank) or sp.encode(" a  b ", out_type=str) != sp.encode("▁a▁▁b▁", out_type=str):
            raise ValueError("pieces of this model cross from a word into the next, or it normalises its input")
        self.newline = not any("\n" in p for p in self.rank)
        self.seen: dict[str, int] = {}

    def merged(self, s: str) -> int:
        """Tokens of a run of symbols that no merge can leave: pop the adjacent pair of lowest rank, leftmost first,
        until none is left; each merge makes one symbol less. Symbols without a piece count their bytes."""
        n, rank = len(s), self.rank
        text, left, right = list(s), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, p) for i in range(n - 1) if (r := rank.get(p := text[i] + text[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = right[i]
            if j < 0 or not text[i] or text[i] + text[j] != piece:
                continue
            text[i], text[j] = piece, ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (r := rank.get(p := piece + text[k])) is not None:
                    heapq.heappush(heap, (r, i, p))
            h = left[i]
            if h >= 0 and (r := rank.get(p := text[h] + piece)) is not None:
                heapq.heappush(heap, (r, h, p))
        return sum(1 if t in rank else len(t.encode()) for t in text if t)

    def word(self, s: str) -> int:
        n = self.seen.get(s)
        if n is None:
            n = self.merged(s)
            if len(s) <= 64:
                if len(self.seen) >= CACHED:
                    self.seen.clear()
                self.seen[s] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = "▁" + text.replace(" ", "▁")
        total = 0
        for part in text.split("\n") if self.newline else [text]:
            # a word with the marks before it: no piece continues from a word into the mark that follows
            words = part.split("▁")
            if "" not in words[1:]:
                head, rest = words[0], words[1:]
                if head:
                    total += self.word(head)
                for w in rest:
                    total += self.word("▁" + w)
            else:
                for w in re.findall("▁*[^▁]+|▁+$", part):
                    total += self.word(w)
        return total + (text.count("\n") if self.newline else 0)


def _counter(path: str) -> PairCounter:
    if path not in _loaded:
        _loaded[path] = PairCounter(path)
    return _loaded[path]


def _run(path: str | None):
    def run(batches):
        if path is None:
            import public_tokenizers

            counter = _counter(public_tokenizers.path("piece_bpe_32k.model"))
        else:
            counter = _counter(path)
        for b in batches:
            texts = b.column("text")
            size = pc.binary_length(texts).cast(pa.int64())
            tokens = np.fromiter((counter.count(t.as_py()) for t in texts), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, limit: int = 4096, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``path`` is a sentencepiece model (default: piece_bpe_32k.model of ``public_tokenizers``) that every executor has.
    No identifiers are made: a count is the symbols minus the merges, plus the further bytes of symbols without a piece.
    Texts are cut only where no piece can reach across, so counts are exact for texts of any length; a row needs
    memory in proportion to its own text and there is no shuffle.

    Nulls and edge cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; ids may be
    null; extra columns are ignored.
    """
    src = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInArrow(_run(path), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
