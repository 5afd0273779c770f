"""Benchmark decontamination by suffix arrays.

Each shard of the corpus (a bounded run of documents of one partition) gets a
suffix array over its words, sorted to the depth of a window. Every suffix of
the benchmark is binary-searched in it, one word deeper at a time; the range
that is left at a window's length holds the places of a verbatim match, and
matches along a diagonal join into the longest ones. Suffixes whose first two
words stand nowhere in the benchmark are left out before sorting: no test suffix
can match them for two words.

The benchmark is read in blocks of bounded size, each a broadcast of its own that
a worker loads, searches and lets go, so no table is assumed to be small. The
corpus is read once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm._shared import Shipped, map_arrow
from docweave.llm._text import Words, chunks, find_words, lower_bytes, mix64, read_words, same_words, text_buffers, word_table

WINDOW = 13
#: Words of benchmark text in one broadcast block.
BLOCK_WORDS = 1 << 20
#: Bytes of text in one shard's suffix array.
SHARD_BYTES = 1 << 19
FILTER_BITS = 22

REPORT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("longest_match", T.LongType()),
    T.StructField("longest_start", T.LongType()),
])


@dataclass
class Spaced:
    """Words of documents one behind the other: ``hashes`` with a zero behind each document
    and some more at the end, ``heads`` where documents start in it, ``number`` the place of
    each hash's word in ``words``."""

    hashes: np.ndarray
    heads: np.ndarray
    number: np.ndarray
    words: Words

    def same(self, i: np.ndarray, other: Spaced, j: np.ndarray) -> np.ndarray:
        """Whether the words at ``i`` here and ``j`` there are words and equal in all bytes."""
        out = (self.hashes[i] == other.hashes[j]) & (self.hashes[i] != 0)
        at = np.flatnonzero(out)
        out[at] = same_words(self.words, self.number[i[at]], other.words, other.number[j[at]])
        return out


@dataclass
class Block:
    """A part of the benchmark. ``text`` holds the items one behind the other; ``suffix``
    are the starts to search, one for each different window, ``length`` their windows'
    lengths, ``items[first[i]:first[i + 1]]`` the items (as strings) that contain window i."""

    text: Spaced
    suffix: np.ndarray
    length: np.ndarray
    first: np.ndarray
    items: np.ndarray
    pairs: np.ndarray
    singles: np.ndarray


def _slot(words: np.ndarray, after: np.ndarray) -> np.ndarray:
    return (mix64(words * np.uint64(3) + after) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def spaced(data: np.ndarray, bounds: np.ndarray, table: np.ndarray, window: int) -> tuple[Spaced, np.ndarray]:
    """The words of lower-cased texts, and each text's first word and the total."""
    starts, ends, first = find_words(data, bounds, table)
    words = read_words(data, starts, ends)
    n = len(first) - 1
    hashes = np.zeros(len(words) + n + window + 1, dtype=np.uint64)
    number = np.zeros(len(hashes), dtype=np.int64)
    place = np.arange(len(words)) + np.repeat(np.arange(n), np.diff(first))
    hashes[place], number[place] = np.maximum(words.hashes, np.uint64(1)), np.arange(len(words))
    return Spaced(hashes, first + np.arange(n + 1), number, words), first


def _equal_windows(text: Spaced, i: np.ndarray, other: Spaced, j: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the windows of ``length`` words at ``i`` and ``j`` are equal in all bytes."""
    out = np.ones(len(i), dtype=bool)
    for d in range(int(length.max(initial=0))):
        at = np.flatnonzero(out & (length > d))
        out[at] = text.same(i[at] + d, other, j[at] + d)
    return out


def make_block(ids: list, texts: list[str], window: int = WINDOW) -> Block:
    bounds, data = text_buffers(pa.array(texts, type=pa.large_string()))
    text, _ = spaced(lower_bytes()[data], bounds, word_table("alnum"), window)
    starts, lengths, owners = [], [], []
    for i in range(len(ids)):
        lo, n = int(text.heads[i]), int(text.heads[i + 1] - text.heads[i] - 1)
        if n:
            count = max(1, n - window + 1)
            starts.append(np.arange(lo, lo + count))
            lengths.append(np.full(count, min(n, window)))
            owners.append(np.full(count, i))
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    key = np.zeros((len(start), window + 1), dtype=np.uint64)
    for d in range(window):
        key[:, d] = np.where(d < length, text.hashes[start + d], 0)
    key[:, window] = length.astype(np.uint64)
    _, unique, inverse = np.unique(key, axis=0, return_index=True, return_inverse=True) if len(start) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
    odd = np.flatnonzero(~_equal_windows(text, start, text, start[unique][inverse], length))
    inverse[odd] = len(unique) + np.arange(len(odd))  # alike in hashes only: windows of their own
    unique = np.concatenate([unique, odd])
    order = np.argsort(inverse, kind="stable")
    pairs = np.zeros(1 << FILTER_BITS, dtype=bool)
    at = start[unique]
    pairs[_slot(text.hashes[at], text.hashes[at + 1])] = True
    return Block(text, at, length[unique], np.searchsorted(inverse[order], np.arange(len(unique) + 1)), np.array([str(x) for x in ids], dtype=object)[owner[order]], pairs, np.unique(text.hashes[at][length[unique] == 1]))


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> Iterator[Block]:
    """The benchmark's items a block at a time; the driver holds one block and one
    partition of the table."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for item, text in benchmark.select(id_col, text_col).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        ids.append(item)
        texts.append(text)
        size += 1 + len(text) // 2
        if size >= block_words:
            yield make_block(ids, texts, window)
            ids, texts, size = [], [], 0
    if ids:
        yield make_block(ids, texts, window)


def suffix_array(words: np.ndarray, block: Block, window: int) -> np.ndarray:
    """Starts of the shard's suffixes that can match, in the order of their first
    ``window`` words. ``words`` ends with ``window`` zeros."""
    here = words[: len(words) - window]
    keep = block.pairs[_slot(here, words[1 : len(here) + 1])]
    if len(block.singles):
        keep |= np.isin(here, block.singles)
    at = np.flatnonzero(keep & (here != 0))
    if len(at) < 2:
        return at
    return at[np.lexsort([words[at + d] for d in range(window - 1, -1, -1)])]


def _bisect(words: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, sought: np.ndarray, right: bool) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        there = words[order[np.minimum(mid, len(order) - 1)] + depth]
        less = (there <= sought) if right else (there < sought)
        lo = np.where(open_ & less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)


def search(words: np.ndarray, order: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of every verbatim occurrence of a window in the shard."""
    n = len(block.suffix)
    if not len(order) or not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    active = np.arange(n)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    found, below, above = [], [], []
    depth = 0
    while len(active):
        sought = block.text.hashes[block.suffix[active] + depth]
        lo, hi = _bisect(words, order, lo, hi, depth, sought, False), _bisect(words, order, lo, hi, depth, sought, True)
        depth += 1
        left = lo < hi
        active, lo, hi = active[left], lo[left], hi[left]
        done = block.length[active] == depth
        found.append(active[done])
        below.append(lo[done])
        above.append(hi[done])
        active, lo, hi = active[~done], lo[~done], hi[~done]
    window, lo, hi = np.concatenate(found), np.concatenate(below), np.concatenate(above)
    count = hi - lo
    rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(window, count), order[np.repeat(lo, count) + rank]


def confirmed(text: Spaced, block: Block, window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The occurrences whose words are equal in all bytes, not in their hashes only."""
    out = _equal_windows(text, place, block.text, block.suffix[window], block.length[window])
    return window[out], place[out]


def longest(text: Spaced, block: Block, window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the matches that the occurrences grow into along their
    diagonals, each grown from the head of its run."""
    source = block.suffix[window]
    order = np.lexsort((place, place - source))
    source, place, size = source[order], place[order], block.length[window][order]
    head = np.ones(len(place), dtype=bool)
    head[1:] = ((place - source)[1:] != (place - source)[:-1]) | (place[1:] != place[:-1] + 1)
    run = np.cumsum(head) - 1
    start, at = place[head].copy(), source[head].copy()
    end = np.zeros(len(start), np.int64)
    np.maximum.at(end, run, place + size)
    size = end - start
    while True:
        grow = (start > 0) & (at > 0)
        grow[grow] = text.same(start[grow] - 1, block.text, at[grow] - 1)
        if not grow.any():
            break
        start, at, size = start - grow, at - grow, size + grow
    while True:
        grow = (start + size < len(text.hashes)) & (at + size < len(block.text.hashes))
        grow[grow] = text.same((start + size)[grow], block.text, (at + size)[grow])
        if not grow.any():
            return start, size
        size = size + grow


class Scanner:
    """Finds the benchmark's windows in batches of texts."""

    def __init__(self, sources: list, window: int) -> None:
        self.sources, self.window = sources, window
        self.held = [sources[0].get()] if len(sources) == 1 else []  # of more, one at a time
        self.lower, self.table = lower_bytes(), word_table("alnum")

    def report(self, column: pa.Array) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in REPORT}
        bounds, data = text_buffers(column)
        for lo, hi in chunks(bounds, SHARD_BYTES if len(self.sources) < 2 else 8 * SHARD_BYTES):
            self._shard(self.lower[data[bounds[lo] : bounds[hi]]], bounds[lo : hi + 1] - bounds[lo], out)
        return out

    def _shard(self, data: np.ndarray, bounds: np.ndarray, out: dict[str, list]) -> None:
        text, first = spaced(data, bounds, self.table, self.window)
        words, heads = text.hashes, text.heads
        n = len(heads) - 1
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        best, best_at = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        items: dict[int, set[str]] = {}
        for block in self.held or (s.get() for s in self.sources):
            window, place = confirmed(text, block, *search(words, suffix_array(words, block, self.window), block))
            if len(window):
                np.add.at(edge, place, 1)
                np.add.at(edge, place + block.length[window], -1)
                doc = np.searchsorted(heads, place, side="right") - 1
                for d, w in np.unique(np.stack([doc, window], axis=1), axis=0).tolist():
                    items.setdefault(d, set()).update(block.items[block.first[w] : block.first[w + 1]])
                start, size = longest(text, block, window, place)
                doc = np.searchsorted(heads, start, side="right") - 1
                for d, s, k in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True):
                    at = s - int(heads[d])
                    if k > best[d] or k == best[d] and at < best_at[d]:
                        best[d], best_at[d] = k, at
        hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        n_words = np.diff(first)
        n_hit = hit[heads[1:]] - hit[heads[:-1]]
        names = [",".join(sorted(items.get(d, ()))) for d in range(n)]
        out["n_words"].extend(n_words.tolist())
        out["n_hit"].extend(n_hit.tolist())
        out["n_items"].extend(len(items.get(d, ())) for d in range(n))
        out["items_sha256"].extend(hashlib.sha256(x.encode()).hexdigest() for x in names)
        out["contaminated"].extend(((n_hit > 0) & (20 * n_hit >= n_words)).tolist())
        out["longest_match"].extend(best.tolist())
        out["longest_start"].extend(x if x >= 0 else None for x in best_at.tolist())


def _sources(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, window: int) -> list:
    return [Shipped(docs.sparkSession, b) for b in blocks(benchmark, id_col, text_col, window=window)]


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: its id and the columns of ``REPORT``.

    A text is lower-cased in A-Z; words are runs of ASCII letters and digits and of
    non-ASCII characters. A window is ``window`` consecutive words of an item, or
    all words of a shorter one; an item without words has none. A null text has no
    words and is clean. Items without id or text take no part; an item id that
    comes twice counts once. Repeated rows of ``docs`` each get a row. An empty
    benchmark finds nothing; an empty table gives no rows. Of longest matches alike the
    first is told. A text of any length is one document. Hashes only find the places; every
    hit is confirmed on the bytes of its words. Other columns of ``docs`` are not read,
    whatever their names."""
    sources = _sources(docs, benchmark, item_id, item_text, window)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sources, window)
        for batch in batches:
            found = scanner.report(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[f.name], type=_ARROW[type(f.dataType)]()) for f in REPORT)], [doc_id, *found])

    narrow = docs.select(doc_id, text)
    return map_arrow(narrow, scan, T.StructType([narrow.schema[0], *REPORT]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns and
    rules as in :func:`contamination`."""
    sources = _sources(docs, benchmark, item_id, item_text, window)
    place = docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sources, window)
        for batch in batches:
            found = scanner.report(batch.column(place))
            yield batch.filter(pa.array([not x for x in found["contaminated"]], type=pa.bool_()))

    return map_arrow(docs, scan, docs.schema)


_ARROW = {T.LongType: pa.int64, T.StringType: pa.string, T.BooleanType: pa.bool_}
