"""Vectorised text primitives shared by the corpus operators.

Everything here works on Arrow string buffers with numpy, a bounded chunk of
documents at a time: no per-word Python objects are made for the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays."""
    x = x ^ (x >> _S33)
    x = x * _MIX_1
    x = x ^ (x >> _S33)
    x = x * _MIX_2
    return x ^ (x >> _S33)


def word_table(kind: str) -> np.ndarray:
    """Which bytes belong to words: ``alnum`` is [0-9A-Za-z] and every byte of a
    non-ASCII character, ``nonspace`` is all but space and 0x09 to 0x0D."""
    table = np.zeros(256, dtype=bool)
    if kind == "alnum":
        for lo, hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
            table[lo:hi] = True
    else:
        table[:] = True
        table[0x20] = False
        table[0x09:0x0E] = False
    return table


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return bounds, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(bounds: np.ndarray, limit: int = CHUNK_BYTES):
    """(first row, last row + 1) of runs of documents with at most ``limit`` bytes;
    a longer document stands alone."""
    row, n = 0, len(bounds) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def find_words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the total) for documents
    lying one behind the other in ``data``; ``bounds`` starts at 0."""
    inside = table[data]
    n = len(inside)
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0] = after[-1] = False
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        heads = bounds[:-1][bounds[:-1] < n]
        before[heads] = False
        after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


@dataclass
class Words:
    """The bytes of words, told apart exactly: ``sizes`` in bytes, and from ``first`` on the
    word's bytes in blocks of eight, the last one filled up with zeros. ``hashes`` mixes
    each block with its place before it sums, so it is not linear in the bytes."""

    hashes: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    blocks: np.ndarray

    def __len__(self) -> int:
        return len(self.sizes)


def lower_bytes() -> np.ndarray:
    """For each byte itself, for A-Z the small letter."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def _runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place within the owner) of the items of runs of these lengths."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def read_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Words:
    """The words ``data[start:end]``, none of which is empty."""
    sizes = (ends - starts).astype(np.int64)
    counts = (sizes + 7) >> 3
    first = np.cumsum(counts) - counts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    if len(sizes) and counts.max() == 1:
        blocks, place = eights[starts], np.zeros(1, np.uint64)
        left = sizes
    else:
        owner, at = _runs(counts)
        blocks, place = eights[starts[owner] + 8 * at], at.astype(np.uint64)
        left = np.minimum(sizes[owner] - 8 * at, 8)
    blocks = blocks & _MASKS[left]
    mixed = mix64(blocks ^ mix64((place + np.uint64(1)) * _BASE))
    sums = np.add.reduceat(mixed, first) if len(mixed) else mixed
    return Words(mix64(sums ^ (sizes.astype(np.uint64) * _MIX_1)), sizes, first, blocks)


#: Blocks compared at once.
STEP_BLOCKS = 1 << 20


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether words ``i`` of ``a`` have the bytes of words ``j`` of ``b``."""
    same = a.sizes[i] == b.sizes[j]
    rows = np.flatnonzero(same)
    rows = rows[a.blocks[a.first[i[rows]]] == b.blocks[b.first[j[rows]]]]
    same[:] = False
    same[rows] = True
    rows = rows[a.sizes[i[rows]] > 8]
    counts = (a.sizes[i[rows]] + 7) >> 3
    ends = np.cumsum(counts)
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_BLOCKS, side="right")))
        some = rows[at:end]
        owner, k = _runs(counts[at:end])
        bad = a.blocks[a.first[i[some]][owner] + k] != b.blocks[b.first[j[some]][owner] + k]
        same[some[np.unique(owner[bad])]] = False
        at = end
    return same


def told_apart(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(representatives, the number of each word's representative): words with equal bytes
    share one. Equal hashes of different words cost a second look, nothing else."""
    _, one, number = np.unique(words.hashes, return_index=True, return_inverse=True)
    odd = np.flatnonzero(~same_words(words, np.arange(len(words)), words, one[number]))
    more: dict[bytes, tuple[int, int]] = {}
    for i in odd.tolist():
        own = words.blocks[words.first[i] : words.first[i] + (words.sizes[i] + 7 >> 3)].tobytes() + words.sizes[i].tobytes()
        if own not in more:
            more[own] = (len(one) + len(more), i)
        number[i] = more[own][0]
    return np.concatenate([one, np.array([i for _, i in more.values()], dtype=one.dtype)]), number


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
