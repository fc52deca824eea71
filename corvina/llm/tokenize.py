"""Problem 8: encoding of a whole corpus with a public tokenizer.

Encoding is a monoid tree reduction: a text is halved down to leaves, leaves are encoded, and two
neighbours are joined by re-encoding only a window around their border. The window grows until the
tokens outside it provably cannot change:

* The pre-tokenizer scans left to right without looking behind, so what follows a piece border
  depends only on the text after it. A piece is settled once three more characters than its start
  and one more than its end are known (contractions look two ahead, white space one).
* So the left side keeps all tokens before its last settled border, and the right side keeps all
  tokens from the first border that the scan of the window shares with its own scan.
* A single blank between something printed and a letter opens a piece in every scan, so a window from
  such a blank on the left to one on the right needs no scan at all; texts without blanks take the other way.
* Inside a piece the merges see no other text, so equal pieces have equal ids.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.session import spread, table

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZER_DIR = os.environ.get("CORVINA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenization pattern of the byte-level vocabulary.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for the scan of windows: white space is the Unicode property, as in the codec.
SCAN = PIECES.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
#: Characters of a leaf of the tree, and of the first joining window. Most texts are longer than a leaf.
LEAF, WINDOW = 192, 32


class TreeEncoder:
    """Ids of texts by a byte-level vocabulary; ``leaf`` and ``window`` change the work, never the result."""

    def __init__(self, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY, leaf: int = LEAF, window: int = WINDOW):
        import regex
        import tiktoken

        with open(os.path.join(folder, vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.codec = tiktoken.Encoding("corpus", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.width = {i: len(b) for b, i in ranks.items()}
        self.pieces = regex.compile(SCAN)
        self.anchor = regex.compile(r"\P{White_Space} (?=\p{L})")
        self.leaf, self.window = leaf, window
        self.joins = 0  # inner nodes of all trees so far

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text`` without special tokens; an empty list for null and for empty texts."""
        if not text:
            return []
        return self._span(text, 0, len(text))

    def _span(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.codec.encode_ordinary(text[a:b])
        m = (a + b) // 2
        return self._join(text, a, m, b, self._span(text, a, m), self._span(text, m, b))

    def _join(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[a:b] from those of text[a:m] and text[m:b]."""
        self.joins += 1
        w = self.window
        while True:
            lo, hi = max(a, m - w), min(b, m + w)
            p, q = self._blank_before(text, lo, m), self._blank_after(text, m, hi)
            if p is not None and q is not None:
                head = self._cut(left, len(text[p:m].encode()), from_end=True)
                tail = self._cut(right, len(text[m:q].encode()), from_end=False)
                return left[:head] + self.codec.encode_ordinary(text[p:q]) + right[tail:]
            start = self._settled(text, a, lo, m)
            if start is not None:
                stop = self._shared(text, start, m, hi, b)
                if stop is not None:
                    head = self._cut(left, len(text[start:m].encode()), from_end=True)
                    tail = self._cut(right, len(text[m:stop].encode()), from_end=False)
                    ids = self.codec.encode_ordinary(text[start:hi])  # with what its last pieces look ahead to
                    ids = ids[: self._cut(ids, len(text[start:stop].encode()), from_end=False)]
                    return left[:head] + ids + right[tail:]
            if lo == a and hi == b:  # the window is the whole span
                return self.codec.encode_ordinary(text[a:b])
            w *= 2

    @staticmethod
    def _opens(text: str, i: int) -> bool:
        """Whether the blank at ``i`` opens a piece; letters of old scripts only, whose class no Unicode version changes."""
        return text[i + 1] < "\u0530" and text[i + 1].isalpha() and not text[i - 1].isspace()

    def _blank_before(self, text: str, lo: int, m: int) -> int | None:
        """The last blank of text[lo:m] that opens a piece whatever stands around text[lo:m]."""
        i = m - 1
        while (i := text.rfind(" ", lo + 1, i)) >= 0:
            if self._opens(text, i):
                return i
        return None

    def _blank_after(self, text: str, m: int, hi: int) -> int | None:
        """The first such blank of text[m:hi]."""
        i = m
        while (i := text.find(" ", i + 1, hi - 1)) >= 0:
            if self._opens(text, i):
                return i
        return None

    def _borders(self, text: str, a: int, b: int, known: int):
        """Ends of the pieces of text[a:b] that text after ``known`` cannot move, in order."""
        for p in self.pieces.finditer(text[a:b]):
            if a + p.start() + 3 > known or a + p.end() + 1 > known:
                return
            yield a + p.end()

    def _settled(self, text: str, a: int, lo: int, m: int) -> int | None:
        """The last piece border of text[a:m] at or after ``lo`` that no later text can move; None if unknown.

        A scan that doesn't start at ``a`` starts at a border that is certain: a single blank between
        something printed and a letter, which opens the letter's piece.
        """
        pos = lo
        if lo > a:
            hit = self.anchor.search(text[lo:m])
            if hit is None:
                return None
            pos = lo + hit.start() + 1
        best = pos if pos == a or pos + 3 <= m else None
        for end in self._borders(text, pos, m, m):
            best = end
        return best

    def _shared(self, text: str, start: int, m: int, hi: int, b: int) -> int | None:
        """The first border at or after ``m`` common to the scans from ``start`` and from ``m``; None if none is settled before ``hi``."""
        known = b + 3 if hi == b else hi
        own = {m, *self._borders(text, m, hi, known)}
        return next((e for e in self._borders(text, start, hi, known) if e in own), None)

    def _cut(self, ids: list[int], size: int, from_end: bool) -> int:
        """Index in ``ids`` that leaves ``size`` bytes after it (from_end) or before it."""
        k = len(ids) if from_end else 0
        while size > 0:
            if from_end:
                k -= 1
                size -= self.width[ids[k]]
            else:
                size -= self.width[ids[k]]
                k += 1
        if size:
            raise ValueError("a token crosses a piece border")
        return k


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row; whole texts, an empty list for null and for empty texts. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = TreeEncoder(folder, vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [coder.encode(t) for t in pdf["text"]]})

    return spread(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))).mapInPandas(run, "doc_id bigint, ids array<int>")


def count_tokens(df: DataFrame, keys: list[str], text: str = "text", folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keys`` and ``tokens`` (bigint) of every row; only counts leave the Python worker."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = TreeEncoder(folder, vocabulary)
        for pdf in batches:
            out = pdf[keys].copy()
            out["tokens"] = [len(coder.encode(t)) for t in pdf["__text"]]
            yield out

    return spread(df.select(*keys, F.col(text).cast("string").alias("__text"))).mapInPandas(run, schema)


def decode_ids(ids: list[int], coder: TreeEncoder) -> str:
    """The text of ``ids``: the bytes of the halves are joined up the tree, and read as UTF-8 at the root."""

    def part(a: int, b: int) -> bytes:
        if b - a <= coder.leaf:
            return b"".join(coder.bytes_of[i] for i in ids[a:b])
        m = (a + b) // 2
        return part(a, m) + part(m, b)

    return part(0, len(ids)).decode("utf-8")


def decode_corpus(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids); an empty text for an empty or null list. No shuffle.

    Ids that aren't in the vocabulary raise KeyError, as do bytes that aren't UTF-8 a UnicodeDecodeError.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = TreeEncoder(folder, vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": ["" if x is None else decode_ids(list(x), coder) for x in pdf["ids"]]})

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInPandas(run, "doc_id bigint, text string")


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return encode_corpus(table(spark, base, "documents"))


def p8_decoded(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, text): every document encoded up the tree and decoded up the tree again; null becomes an empty text."""
    return decode_corpus(p8_ids(spark, base))
