"""Passages of held-out test items in a training corpus, by a distributed positional inverted index.

``build_index`` reads the corpus once. Its rows are shards of documents: the words of a shard and, for each
word, the list of all places at which it stands. It does not depend on any test items, so it can be stored
(``stored``) and searched with new ones. ``search`` takes the shards where they lie; nothing moves. For every
run of eight words of a test item it begins with the places of the rarest word in that shard, moves them by the
word's offset and keeps those at which the next rarest stands at its own offset, until nothing or the exact
matches are left. All runs of a shard go through these steps together.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import checkpoint_dir, cut

RUN = 8
#: Words of a shard, after which the next begins; a longer document has a shard of its own.
SHARD_WORDS = 2_000_000
#: Characters of test items that are searched at once; more items are taken in blocks, one after another.
BLOCK_CHARS = 8_000_000
#: Words kept free between documents, so that no run and no window reaches from one into the next.
GAP = 64
#: Places that are followed at once in the search of a shard; it only bounds memory.
AT_ONCE = 2_000_000

# Han, kana and their marks; each is a word.
_CJK = (
    "\u2e80-\u2fd5\u3005\u3007\u3021-\u3029\u3038-\u303b\u3041-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff"
    "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U0001aff0-\U0001b16f\U00020000-\U000323af"
)
_WORD = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+")
_WORD_ASCII = re.compile("[a-z0-9]+")
_ESCAPE = re.compile(
    r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|([abfnrtv0])|([\"'\\/`])|\r?\n)"
)
_SURROGATES = re.compile("([\ud800-\udbff])([\udc00-\udfff])")
_TAG = re.compile(
    r"<!--.*?-->|</?[A-Za-z][A-Za-z0-9:-]*(?:\s+[\w:@.-]+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=`]+))?)*\s*/?>",
    re.S,
)
# What is invisible though no format character: fillers, joiners and variation selectors.
_UNSEEN_MORE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10)]
_UNSEEN = re.compile(
    "[" + "".join(map(chr, _UNSEEN_MORE)) + "\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff"
    "\ufff9-\ufffb\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0001-\U000e01ef]"
)


def _unescaped(m: re.Match) -> str:
    code = m[1] or m[2] or m[3] or m[4]
    if code:
        value = int(code, 16)
        return chr(value) if value < 0x110000 else " "
    return m[6] or " "


def plain(text: str) -> str:
    """What a text says: escapes, tags and entities resolved, letters in one form, invisible ones gone."""
    # Strings in strings, however deep: every pass shortens the text or is the last.
    while "\\" in text:
        found = _ESCAPE.sub(_unescaped, text)
        if found == text:
            break
        text = _SURROGATES.sub(lambda m: (m[1] + m[2]).encode("utf-16", "surrogatepass").decode("utf-16"), found)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return text.lower()
    text = _UNSEEN.sub("", text)
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def words(text: str | None) -> list[str]:
    """The words of a text as compared; none of null."""
    if not text:
        return []
    text = plain(text)
    return (_WORD_ASCII if text.isascii() else _WORD).findall(text)


INDEX_SCHEMA = "docs array<bigint>, begins array<int>, words array<string>, ends array<int>, places array<int>"
_INTS = pa.list_(pa.int32())
_INDEX_ARROW = pa.schema(
    [("docs", pa.list_(pa.int64())), ("begins", _INTS), ("words", pa.list_(pa.string())), ("ends", _INTS), ("places", _INTS)]
)


def _shard(docs: list[int], begins: list[int], said: list[list[str]]) -> pa.RecordBatch:
    """One row: documents and where they begin, and words with their places; ``ends`` bounds the places of each word."""
    coded = pa.array([w for found in said for w in found], pa.string()).dictionary_encode()
    lengths = np.fromiter(map(len, said), np.int64, len(said))
    shift = np.repeat(np.array(begins, np.int64) - (np.cumsum(lengths) - lengths), lengths)
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    places = (order + shift[order]).astype(np.int32)
    ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary))).astype(np.int32)
    columns = [pa.array(docs, pa.int64()), pa.array(begins, pa.int32()), coded.dictionary, pa.array(ends), pa.array(places)]
    rows = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
    return pa.RecordBatch.from_arrays(rows, schema=_INDEX_ARROW)


def build_index(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The positional inverted index of a corpus: INDEX_SCHEMA, a row per shard.

    Every word of every text is in it, at all its places; places count words from the shard's beginning. Null
    and empty texts have no postings. Rows without id are not indexed. Shards are made where the documents are
    read, so nothing moves, and hold at most SHARD_WORDS words (or one longer document).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, begins, said, at = [], [], [], 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                found = words(texts[i].as_py())
                if not found:
                    continue
                if docs and at + len(found) > SHARD_WORDS:
                    yield _shard(docs, begins, said)
                    docs, begins, said, at = [], [], [], 0
                docs.append(keys[i].as_py())
                begins.append(at)
                said.append(found)
                at += len(found) + GAP
        if docs:
            yield _shard(docs, begins, said)

    read = df.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint"), text_column)
    return read.mapInArrow(run, INDEX_SCHEMA)


def stored(index: DataFrame, path: str | None = None) -> DataFrame:
    """``index`` written as a Parquet table and read again; in the shared folder of the session unless ``path`` is given."""
    spark = index.sparkSession
    path = path or f"{checkpoint_dir(spark)}/leakage-index-{uuid.uuid4().hex}"
    index.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


class Queries:
    """Test items as runs of numbered words.

    ``uses`` lists for each run the rows of ``items`` and the offsets in them. Items are told apart by their
    row, so those that share an id are searched each.
    """

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        numbers: dict[str, int] = {}
        runs: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.items: list[tuple[int, int]] = []
        for row, (item, prompt) in enumerate(items):
            said = [numbers.setdefault(w, len(numbers)) for w in words(prompt)]
            self.items.append((item, len(said)))
            for j in range(len(said) - RUN + 1):
                runs.setdefault(tuple(said[j : j + RUN]), []).append((row, j))
        self.words = list(numbers)
        self.runs = np.array(list(runs), np.int32).reshape(-1, RUN)
        self.uses = list(runs.values())


class Shard:
    """The postings of a shard for the words of some queries, by their numbers."""

    def __init__(self, asked: Queries, vocabulary: pa.Array, ends: np.ndarray, places: np.ndarray) -> None:
        number = pc.index_in(vocabulary, value_set=pa.array(asked.words, pa.string())).fill_null(-1).to_numpy().astype(np.int64)
        counts = np.diff(ends, prepend=0)
        self.count = np.zeros(len(asked.words), np.int64)
        self.first = np.zeros(len(asked.words), np.int64)
        known = number >= 0
        self.count[number[known]] = counts[known]
        self.first[number[known]] = (ends - counts)[known]
        self.places = places
        # The number of the word at each place, so that a list is asked for a place at once; a border on either side.
        self.margin = GAP
        self.at = np.full((int(places.max()) + 1 if len(places) else 0) + 2 * GAP, -1, np.int32)
        here = np.repeat(known, counts)
        self.at[places[here] + GAP] = np.repeat(number, counts)[here]

    def rarest(self, runs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of ``runs`` whose words the shard holds: their numbers, the places of the rarest word of each, and the order of words.

        Comes in portions of about AT_ONCE places; a longer list is cut.
        """
        frequency = self.count[runs]
        present = np.flatnonzero(frequency.min(axis=1, initial=1) > 0)
        if not len(present):
            return
        order = np.argsort(frequency[present], axis=1, kind="stable")
        lead = runs[present, order[:, 0]]
        size, first = self.count[lead], self.first[lead]
        upto = np.cumsum(size)
        for low in range(0, int(upto[-1]), AT_ONCE):
            flat = np.arange(low, min(low + AT_ONCE, int(upto[-1])))
            which = np.searchsorted(upto, flat, side="right")
            yield present[which], self.places[first[which] + flat - (upto[which] - size[which])], order[which]

    def exact(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of runs, and places at which all their words stand in succession."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for run, place, order in self.rarest(runs):
            start = place.astype(np.int64) - order[:, 0]
            for k in range(1, runs.shape[1]):
                offset = order[:, k]
                fits = start + offset + self.margin >= 0
                fits &= self.at[np.clip(start + offset + self.margin, 0, len(self.at) - 1)] == runs[run, offset]
                run, start, order = run[fits], start[fits], order[fits]
            out.append((run, start))
        return tuple(np.concatenate(c) for c in zip(*out))

    def near(self, runs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of runs, and places of their rarest word, where one window of so many words holds all words of the run."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        reach = np.arange(1 - window, window)
        for run, place, order in self.rarest(runs):
            # Which windows, by their first word, hold what has been sought so far: the rarest word itself first.
            open_ = np.ones((len(run), window), bool)
            for k in range(1, runs.shape[1]):
                sought = runs[run, order[:, k]]
                met = self.at[place[:, None] + (reach + self.margin)[None, :]] == sought[:, None]
                seen = np.cumsum(met, axis=1, dtype=np.int16)
                seen = np.concatenate([np.zeros((len(run), 1), np.int16), seen], axis=1)
                open_ &= seen[:, window:] > seen[:, :window]
                fits = open_.any(axis=1)
                run, place, order, open_ = run[fits], place[fits], order[fits], open_[fits]
            out.append((run, place.astype(np.int64)))
        return tuple(np.concatenate(c) for c in zip(*out))


RESULT_SCHEMA = "doc_id bigint, item_id bigint, covered int, near int, length int"
_RESULT_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("covered", pa.int32()), ("near", pa.int32()), ("length", pa.int32())]
)


def _covered(asked: Queries, begins: np.ndarray, hits: tuple[np.ndarray, np.ndarray]) -> dict[tuple[int, int], set[int]]:
    """The words of each item that hits cover in each document."""
    out: dict[tuple[int, int], set[int]] = {}
    if len(hits[0]):
        doc = np.searchsorted(begins, hits[1], side="right") - 1
        for d, r in np.unique(np.stack([doc, hits[0]]), axis=1).T.tolist():
            for row, j in asked.uses[r]:
                out.setdefault((d, row), set()).update(range(j, j + RUN))
    return out


def search(index: DataFrame, queries: Queries, slop: int | None = None) -> DataFrame:
    """Documents and test items that share a run of RUN words: RESULT_SCHEMA.

    ``covered`` counts the words of the item in runs of RUN or more that stand in the document in
    succession, ``length`` all of its words. With ``slop``, ``near`` counts those in runs all of whose words
    stand in one window of RUN + slop words in any order, and pairs with such runs alone come too; else it is
    null. A shard is searched where it lies, fresh or stored. Items of fewer than RUN words match nothing. The
    queries are sent to all tasks; ``item_blocks`` bounds their size.
    """
    if slop is not None and RUN + slop > GAP:
        raise ValueError(f"slop must be at most {GAP - RUN}")
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                docs, begins, vocabulary, ends, places = (c[i].values for c in batch.columns)
                begins = begins.to_numpy()
                shard = Shard(asked, vocabulary, ends.to_numpy().astype(np.int64), places.to_numpy())
                exact = _covered(asked, begins, shard.exact(asked.runs))
                loose = _covered(asked, begins, shard.near(asked.runs, RUN + slop)) if slop is not None else {}
                rows = [
                    (docs[d].as_py(), asked.items[row][0], len(exact.get((d, row), ())),
                     None if slop is None else len(loose.get((d, row), ())), asked.items[row][1])
                    for d, row in sorted(exact.keys() | loose.keys())
                ]
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT_ARROW)], schema=_RESULT_ARROW)

    return index.mapInArrow(run, RESULT_SCHEMA)


def item_blocks(items: DataFrame, id_column: str, prompt_column: str) -> Iterator[Queries]:
    """Test items in blocks of about BLOCK_CHARS characters, one in memory at a time; those without id are left out."""
    kept = items.select(F.col(id_column).cast("bigint").alias("i"), F.col(prompt_column).alias("p")).filter("i is not null")
    size = kept.agg(F.sum(F.length("p"))).first()[0] or 0
    n = int(size // BLOCK_CHARS) + 1
    for b in range(n):
        part = kept.filter(F.pmod(F.xxhash64("i"), F.lit(n)) == b) if n > 1 else kept
        yield Queries([(r.i, r.p) for r in part.collect()])


def search_all(index: DataFrame, items: DataFrame, item_column: str, prompt_column: str, slop: int | None = None) -> DataFrame:
    """``search`` of all items in a stored index. Of several blocks each is searched, and its result kept, before the next."""
    out, blocks = None, item_blocks(items, item_column, prompt_column)
    block, following = next(blocks), next(blocks, None)
    while True:
        part = search(index, block, slop)
        if out is None and following is None:
            return part
        part = cut(part)
        out = part if out is None else out.unionByName(part)
        if following is None:
            return out
        block, following = following, next(blocks, None)


def matches(
    docs: DataFrame, id_column: str, text_column: str, items: DataFrame, item_column: str, prompt_column: str,
    slop: int | None = None,
) -> DataFrame:
    """``search_all`` over the index of all documents, which is built and stored once.

    Documents and items that occur repeatedly under one id are matched each; empty tables give no row.
    """
    return search_all(stored(build_index(docs, id_column, text_column)), items, item_column, prompt_column, slop)


def leaks(found: DataFrame) -> DataFrame:
    """Of ``matches``, the pairs in which runs cover at least half of the item's words."""
    return found.filter(F.col("covered") * 2 >= F.col("length"))
