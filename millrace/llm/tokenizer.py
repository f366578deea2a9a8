"""Encoding a corpus with the rank file of a public byte-level BPE.

Short words are merged on a contiguous rank array: part boundaries and the ranks of adjacent parts lie
side by side, the array is scanned for the least rank, its right boundary is deleted and the two
neighbouring ranks are made anew. Words beyond ``SHORT`` bytes, for which repeated scans would cost the
square of their length, are merged with a heap over the same ranks and give the same ids. A word met
before is taken from a bounded table.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

SHORT = 96
#: Words kept per worker process; beyond it the table starts anew. It only saves time.
KEPT_WORDS = 400_000
#: Characters of text per batch handed back to Spark.
BATCH_CHARS = 4_000_000

# The pattern that splits text before the merges of the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same split with the classes of ``re``, which is twice as fast. It differs only at ``ODD`` characters.
FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?(?:[^\W\d_]+|\d+|(?:[^\s\w]|_)+)|\s+(?!\S)|\s+")
EXACT = regex.compile(SPLIT)
#: Numbers that are no decimal digits, and separators that are blanks to ``re`` alone.
ODD = regex.compile(r"[\p{Nl}\p{No}\x1c-\x1f]")
NO_RANK = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a rank file: lines of a token in base64 and its id."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in lines}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by the contiguous rank array."""
    bounds = list(range(len(word) + 1))
    near = [ranks.get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while near:
        least = min(near)
        if least == NO_RANK:
            break
        i = near.index(least)
        del bounds[i + 1], near[i]
        if i < len(near):
            near[i] = ranks.get(word[bounds[i] : bounds[i + 2]], NO_RANK)
        if i:
            near[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by a heap of adjacent ranks over linked parts."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\x01") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or after[after[i]] != end:
            continue
        gone = after[i]
        alive[gone] = 0
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        left = before[i]
        if left >= 0 and (r := ranks.get(word[left:end])) is not None:
            heapq.heappush(heap, (r, left, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class _OddWord(Exception):
    pass


class Words(dict):
    """Word to its ids as packed 32-bit integers, filled on demand."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks
        self.exact = False

    def __missing__(self, word: str) -> bytes:
        if not self.exact and ODD.search(word):
            raise _OddWord
        raw = word.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None:
            ids = [whole]
        else:
            ids = (merge_short if len(raw) <= SHORT else merge_long)(raw, self.ranks)
        packed = array("i", ids).tobytes()
        if len(self) >= KEPT_WORDS:
            self.clear()
        # Odd words stay out: the fast split must meet them again to be told.
        if not (self.exact and ODD.search(word)):
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        try:
            return b"".join(map(self.__getitem__, FAST.findall(text)))
        except _OddWord:
            self.exact = True
            try:
                return b"".join(map(self.__getitem__, EXACT.findall(text)))
            finally:
                self.exact = False


#: Tables of this worker process, by the file they come from.
_TABLES: dict[str, Words] = {}


def encode(df: DataFrame, id_column: str, text_column: str, rank_file: str) -> DataFrame:
    """One row per row of ``df``: ``id_column`` and ``ids`` (array of int), without special tokens.

    Null and empty texts give an empty list. The text is encoded as it is and whole, however long; the
    names of special tokens in it are ordinary text. The rank file is read on the driver and its ranks
    are broadcast: their number is fixed by the vocabulary, not by the data.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _TABLES.get(rank_file)
        if words is None:
            words = _TABLES[rank_file] = Words(ranks.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            start, chars, packed = 0, 0, []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                packed.append(words.encode(text) if text else b"")
                chars += len(text or "")
                if chars >= BATCH_CHARS or i + 1 == batch.num_rows:
                    ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
                    flat = np.frombuffer(b"".join(packed), dtype=np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([keys.slice(start, len(packed)), ids], [id_column, "ids"])
                    start, chars, packed = i + 1, 0, []

    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")
