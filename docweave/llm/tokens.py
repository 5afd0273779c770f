"""Token counts of a unigram tokenizer, by count-only Viterbi.

An Aho-Corasick automaton over the vocabulary's UTF-8 bytes enumerates, at every
position, the pieces that end there, longest first. Dynamic programming carries the
best score and its number of pieces, no path. Ties follow the tokenizer: a later
start must be strictly better, so the longest last piece wins. A character without
a piece of its own may be unknown, at the least score less ``PENALTY``; it counts as
its bytes where the vocabulary has byte pieces, else a run of them as one.

Spaces become U+2581, which starts a segment; segments are tokenized alone, so the
distinct segments of a chunk walk the automaton together, a byte a step.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweave.llm._shared import Shipped, map_arrow
from docweave.llm._text import chunks, read_words, text_buffers, told_apart

PENALTY = 10.0
MARK = "▁".encode()
#: Bytes of text whose segments are made distinct together.
STEP_BYTES = 1 << 23
#: Cells of the score table held at once.
CELLS = 1 << 22
#: Segments that are walked one by one rather than side by side, and bytes of one at a time.
FEW, WALK_BYTES = 8, 1 << 16


@dataclass
class Vocabulary:
    classes: np.ndarray  # byte -> column of ``step``
    step: np.ndarray  # [node, class] -> node
    out: np.ndarray  # node -> longest piece that ends here, as a node, or 0
    shorter: np.ndarray  # piece node -> next shorter piece that ends here, or 0
    score: np.ndarray  # piece node -> score
    length: np.ndarray  # piece node -> bytes
    unknown: float
    byte_pieces: bool


def load_pieces(model_file: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, in order of ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


def compile_vocabulary(pieces: list[tuple[str, float]]) -> Vocabulary:
    known = dict(reversed([(p.encode(), s) for p, s in pieces if p]))
    used = sorted({b for p in known for b in p})
    classes = np.zeros(256, dtype=np.uint8 if len(used) < 255 else np.uint16)
    classes[used] = np.arange(1, len(used) + 1)
    children: list[dict[int, int]] = [{}]
    ends: dict[int, bytes] = {}
    for piece in known:
        node = 0
        for b in piece:
            node = children[node].setdefault(int(classes[b]), len(children))
            if node == len(children):
                children.append({})
        ends[node] = piece
    n = len(children)
    step = np.zeros((n, len(used) + 1), dtype=np.int32)
    fail, out, shorter = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    score, length = np.zeros(n), np.zeros(n, np.int32)
    for node, piece in ends.items():
        score[node], length[node] = known[piece], len(piece)
    todo = deque([0])
    while todo:
        node = todo.popleft()
        if node:
            step[node] = step[fail[node]]
            shorter[node] = out[fail[node]]
            out[node] = node if length[node] else shorter[node]
        for c, child in children[node].items():
            fail[child] = step[fail[node], c] if node else 0
            todo.append(child)
        for c, child in children[node].items():
            step[node, c] = child
    return Vocabulary(classes, step, out, shorter, score, length, min((s for _, s in pieces), default=0.0) - PENALTY, all(f"<0x{b:02X}>".encode() in known for b in range(256)))


def count_words(v: Vocabulary, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Pieces of each segment ``data[start : start + length]``."""
    order = np.argsort(lengths, kind="stable")
    counts = np.zeros(len(starts), dtype=np.int64)
    at = 0
    while at < len(order):
        end = at + 1
        width = int(lengths[order[at]]) + 1
        while end < len(order) and (end - at + 1) * (int(lengths[order[end]]) + 1) <= CELLS and lengths[order[end]] <= 2 * width + 8:
            end += max(1, min(4096, len(order) - end, CELLS // (int(lengths[order[end]]) + 1) - (end - at)))
        end = min(end, len(order))
        some = order[at:end]
        if len(some) <= FEW:
            for i in some.tolist():
                counts[i] = _walk_one(v, data[starts[i] : starts[i] + lengths[i]])
        else:
            counts[some] = _walk(v, data, starts[some], lengths[some])
        at = end
    return counts


def _walk(v: Vocabulary, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Lengths ascend. Scores are kept for as many positions as a piece is long."""
    n, longest = len(starts), int(lengths[-1]) if len(lengths) else 0
    ring = int(v.length.max(initial=1)) + 4
    best = np.full((ring + 1, n), -np.inf)
    pieces = np.zeros((ring + 1, n), dtype=np.int64)
    open_run = np.zeros((ring + 1, n), dtype=bool)
    best[0] = 0.0
    result = np.zeros(n, dtype=np.int64)
    state = np.zeros(n, dtype=np.int32)
    char = np.zeros(n, dtype=np.int64)
    size = ring + 1
    first = 0
    for e in range(1, longest + 1):
        while first < n and lengths[first] < e:
            first += 1
        rows = np.arange(first, n)
        byte = data[starts[first:] + e - 1]
        char[first:] = np.where((byte & 0xC0) != 0x80, e - 1, char[first:])
        state[first:] = v.step[state[first:], v.classes[byte]]
        here = e % size
        best[here, first:], open_run[here, first:] = -np.inf, False
        node = v.out[state[first:]]
        single = np.zeros(n - first, dtype=bool)
        live = np.flatnonzero(node)
        while len(live):
            r, k = rows[live], node[live]
            begin = e - v.length[k]
            single[live] |= begin == char[r]
            value = best[begin % size, r] + v.score[k]
            better = value > best[here, r]
            r, b = r[better], begin[better] % size
            best[here, r], pieces[here, r], open_run[here, r] = value[better], pieces[b, r] + 1, False
            node[live] = v.shorter[k]
            live = live[node[live] > 0]
        done = np.ones(n - first, dtype=bool)
        inside = e < lengths[first:]
        done[inside] = (data[starts[first:][inside] + e] & 0xC0) != 0x80
        lone = np.flatnonzero(done & ~single)
        if len(lone):
            r = rows[lone]
            b = char[r] % size
            value = best[b, r] + v.unknown
            better = value > best[here, r]
            r, b = r[better], b[better]
            added = (e - char[r]) if v.byte_pieces else (~open_run[b, r]).astype(np.int64)
            best[here, r], pieces[here, r], open_run[here, r] = value[better], pieces[b, r] + added, True
        ended = rows[lengths[first:] == e]
        result[ended] = pieces[here, ended]
    return result


def _walk_one(v: Vocabulary, data: np.ndarray) -> int:
    """:func:`_walk` of one segment, a byte a step without arrays."""
    size, n = int(v.length.max(initial=1)) + 5, len(data)
    step, out, shorter, score, length = (x.item for x in (v.step, v.out, v.shorter, v.score, v.length))
    best, pieces, open_run = [0.0] + [-np.inf] * (size - 1), [0] * size, [False] * size
    state = char = 0
    for at in range(0, n, WALK_BYTES):
        part = data[at : at + WALK_BYTES + 1]
        kinds, heads = v.classes[part].tolist(), ((part & 0xC0) != 0x80).tolist() + [True]
        for e in range(at + 1, min(n, at + WALK_BYTES) + 1):
            if heads[e - 1 - at]:
                char = e - 1
            state = step(state, kinds[e - 1 - at])
            value, count, run, single = -np.inf, 0, False, False
            node = out(state)
            while node:
                begin = e - length(node)
                single = single or begin == char
                other = best[begin % size] + score(node)
                if other > value:
                    value, count = other, pieces[begin % size] + 1
                node = shorter(node)
            if not single and heads[e - at]:
                b = char % size
                other = best[b] + v.unknown
                if other > value:
                    value, count, run = other, pieces[b] + (e - char if v.byte_pieces else int(not open_run[b])), True
            best[e % size], pieces[e % size], open_run[e % size] = value, count, run
    return pieces[n % size]


class Counter:
    def __init__(self, v: Vocabulary) -> None:
        self.v = v

    def counts(self, column: pa.Array) -> np.ndarray:
        bounds, data = text_buffers(column)
        return np.concatenate([np.zeros(0, np.int64), *(self._chunk(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]) for lo, hi in chunks(bounds, STEP_BYTES))])

    def _chunk(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sizes = np.diff(bounds)
        heads = bounds[:-1][sizes > 0]
        if not len(heads):
            return np.zeros(len(sizes), dtype=np.int64)
        space = data == 0x20
        # each space becomes a mark's three bytes; a text without a leading mark gets one
        marked = np.zeros(len(data), dtype=bool)
        if len(data) > 2:
            marked[:-2] = (data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2])
        given = np.zeros(len(data), dtype=bool)
        given[heads] = ~(space[heads] | marked[heads])
        wide = 1 + 2 * space.astype(np.int64) + 3 * given
        place = np.concatenate([[0], np.cumsum(wide)])
        out = np.empty(int(place[-1]), dtype=np.uint8)
        body = place[:-1] + 3 * given
        out[body] = data
        for where in (place[:-1][space], place[:-1][given]):
            for i, b in enumerate(MARK):
                out[where + i] = b
        starts = np.sort(np.concatenate([place[:-1][space | given], body[marked]]))
        ends = np.append(starts[1:], len(out))
        one, inverse = told_apart(read_words(out, starts, ends))
        counts = count_words(self.v, out, starts[one], (ends - starts)[one])[inverse]
        sums = np.concatenate([[0], np.cumsum(counts)])
        cut = np.searchsorted(starts, place[bounds])
        return sums[cut[1:]] - sums[cut[:-1]]


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for each row of ``docs``: the tokens of its whole text. A
    null or empty text has none; an empty table gives no rows. Repeated rows each get
    a row; other columns are not read. ``pieces`` is the vocabulary with scores. A text of
    any length is counted whole; long segments take a step a byte. Segments share a count
    only if their bytes are equal, so a row's count depends on its text alone."""
    shared = Shipped(docs.sparkSession, pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(compile_vocabulary(shared.get()))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.counts(batch.column(1)), type=pa.int64())], [doc_id, "n_tokens"])

    narrow = docs.select(doc_id, text)
    return map_arrow(narrow, run, T.StructType([narrow.schema[0], T.StructField("n_tokens", T.LongType())]))
