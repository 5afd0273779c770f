"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words. Every passage is encoded from
counts of its characters and words by a learned layer; gated attention weighs the
passages of a text, and the weighted sum of their encodings gives the score. Only
texts have labels; which passages matter is learned.

Fitting uses a sample of at most about ``SAMPLE`` labelled ids, chosen by a hash of
the id, and of whole texts of theirs with ``PASSAGES`` passages at most in all, chosen by
a hash of the row; scoring reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm._shared import Shipped, Tables, map_arrow
from docweave.llm._text import chunks, find_words, lower_bytes, read_words, text_buffers, word_table
from docweave.llm.toxicity import held_out, sample_rows, training_rows

PASSAGE = 64
#: Labelled ids that the model is fitted on, about.
SAMPLE = 5_000
#: Passages that the model is fitted on, at most; a text with more than a hundredth of
#: them is scored like any other but never fitted on.
PASSAGES = 60_000
FEATURES = 12
HIDDEN, ATTENTION = 16, 8
EPOCHS, RATE, DECAY, SEED = 400, 0.02, 1e-4, 7

_UPPER, _LETTER, _DIGIT, _SYMBOL, _STOP, _BREAK, _WIDE = range(7)


def _kinds() -> np.ndarray:
    kinds = np.zeros((7, 256), dtype=np.int8)
    kinds[_UPPER, 0x41:0x5B] = 1
    kinds[_LETTER, 0x41:0x5B] = kinds[_LETTER, 0x61:0x7B] = kinds[_LETTER, 0xC0:] = 1
    kinds[_DIGIT, 0x30:0x3A] = 1
    for c in range(0x21, 0x7F):
        if not chr(c).isalnum() and chr(c) not in ".,;:?'\"-()":
            kinds[_SYMBOL, c] = 1
    for c in b".?!":
        kinds[_STOP, c] = 1
    kinds[_BREAK, 0x0A] = 1
    kinds[_WIDE, 0x80:] = 1
    return kinds


class Encoder:
    """Passage features of texts."""

    def __init__(self) -> None:
        self.lower, self.table, self.kinds = lower_bytes(), word_table("nonspace"), _kinds()

    def bags(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts: (features of their passages, first passage of each
        text and the total). A text without words has one passage of zeros."""
        bounds, data = text_buffers(column)
        for lo, hi in chunks(bounds):
            yield self._chunk(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])

    def _chunk(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = find_words(data, bounds, self.table)
        hashes = read_words(self.lower[data], starts, ends).hashes
        sizes = np.diff(first)
        each = np.maximum(1, sizes // PASSAGE)  # a short rest belongs to the last passage
        head = np.concatenate([[0], np.cumsum(each)])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(len(starts)) - first[doc]
        passage = head[doc] + np.minimum(within // PASSAGE, each[doc] - 1)
        n = int(head[-1])
        count = lambda weights: np.bincount(passage, weights=weights, minlength=n)
        words = count(None).astype(float)
        x = np.zeros((n, FEATURES))
        one = np.maximum(words, 1)
        length = (ends - starts).astype(float)
        size = np.maximum(count(length), 1)
        for k in (_UPPER, _LETTER, _DIGIT, _SYMBOL, _STOP, _WIDE):
            sums = np.concatenate([[0], np.cumsum(self.kinds[k][data], dtype=np.int64)])
            x[:, k] = count((sums[ends] - sums[starts]).astype(float)) / size
        breaks = np.concatenate([[0], np.cumsum(self.kinds[_BREAK][data], dtype=np.int64)])
        x[:, _BREAK] = count((breaks[starts] - breaks[np.maximum(starts - 1, bounds[doc])]).astype(float)) / one
        x[:, 7] = size / one / 10
        again = np.zeros(len(starts))
        again[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
        x[:, 8] = count(again) / one
        order = np.argsort(hashes, kind="stable")
        repeat = (hashes[order][1:] == hashes[order][:-1]) & (passage[order][1:] == passage[order][:-1])
        x[:, 9] = np.bincount(passage[order][1:][repeat], minlength=n) / one
        tail = self.kinds[_SYMBOL][data[ends - 1]].astype(float) if len(ends) else np.zeros(0)
        x[:, 10] = count(tail) / one
        x[:, 11] = np.log1p(words) / 5
        return x, head


def _thinned(bag: np.ndarray, most: int) -> np.ndarray:
    """At most so many passages, evenly spread over the bag."""
    return bag if len(bag) <= most else bag[(np.arange(most) * len(bag)) // most]


def _segments(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first[:-1], axis=0) if len(first) > 1 else np.zeros((0, *x.shape[1:]))


class Model:
    """Gated attention over encoded passages."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.mean, self.scale = mean, scale
        self.p = {"w": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "v": draw(HIDDEN, ATTENTION), "u": draw(HIDDEN, ATTENTION), "a": draw(ATTENTION, 1), "c": draw(HIDDEN, 1), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = np.exp(np.clip((t * g) @ p["a"], -30, 30))
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        a = e / _segments(e, first)[doc]
        z = _segments(a * h, first)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": y[:, 0], "doc": doc}

    def gradient(self, f: dict[str, np.ndarray], y: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, h, t, g, a, doc = self.p, f["h"], f["t"], f["g"], f["a"], f["doc"]
        dy = ((f["y"] - y) / len(y))[:, None]
        dz = (dy @ p["c"].T)[doc]
        da = (dz * h).sum(axis=1, keepdims=True)
        ds = a * (da - _segments(a * da, first)[doc])
        dtg = ds @ p["a"].T
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        return {"w": f["x"].T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ ds, "c": f["z"].T @ dy, "d": dy.sum(axis=0)}

    def train(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> Model:
        """Adam on all bags at once; the same rows give the same model."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for step in range(1, EPOCHS + 1):
            for k, d in self.gradient(self.forward(x, first), y, first).items():
                d = d + DECAY * self.p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held: int = 0, sample: int = SAMPLE) -> Model | float:
    """The model learned from the labels outside the held-out fold, or the share of
    label 1, smoothed, if these do not hold both labels.

    About ``sample`` labelled ids are looked at; texts alike with one label count once, and
    as many texts are fitted on as ``PASSAGES`` passages hold. Of a text of more than a
    hundredth of these, as many passages evenly spread over the whole text are taken."""
    tables = Tables(docs.sparkSession, "quality")
    chosen = sample_rows(training_rows(labels, doc_id, label, folds, held), doc_id, sample)
    texts = docs.select(doc_id, F.col(text).alias("text"))
    # a text counts once, however often it stands there; its place in 4,096 buckets of nearly
    # equal size decides whether it is fitted on
    rows = texts.join(F.broadcast(chosen), doc_id).withColumn("h", F.xxhash64(F.lit(11), "text")).dropDuplicates(["h", "label"])
    rows = rows.select("text", "label", F.pmod("h", F.lit(4096)).cast("int").alias("bucket"))
    most = max(1, PASSAGES // 100)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in batches:
            bags = [_thinned(bag, most) for x, head in encoder.bags(batch.column(0)) for bag in np.split(x, head[1:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), batch.column(2), pa.array([len(bag) for bag in bags], type=pa.int32()), pa.array([bag.tobytes() for bag in bags], type=pa.binary())], ["label", "bucket", "n", "x"])

    encoded = tables.keep(map_arrow(rows, encode, "label int, bucket int, n int, x binary"), "bags")
    sizes = encoded.groupBy("bucket").agg(F.sum("n").alias("n")).orderBy("bucket").collect()
    left, taken = PASSAGES, []
    for r in sizes:  # a bucket that does not fit is passed over, the next ones are not
        if r.n <= left:
            left -= r.n
            taken.append(r.bucket)
    if sizes and not taken:
        raise ValueError(f"no bucket of labelled texts fits into {PASSAGES} passages")
    got = sorted((r.label, bytes(r.x)) for r in encoded.where(F.col("bucket").isin(taken)).collect())
    tables.drop("bags")
    y = np.array([one for one, _ in got], dtype=float)
    if not y.any() or y.all():
        return float((y.sum() + 1) / (len(y) + 2))
    bags = [np.frombuffer(x).reshape(-1, FEATURES) for _, x in got]
    x, first = np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return Model(x.mean(axis=0), x.std(axis=0) + 1e-3).train(x, first, y)


def score(docs: DataFrame, model: Model | float, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier), ``n_passages`` and
    ``top_passage``, the passage that weighs most. Columns of these names are
    replaced. A null or empty text is one empty passage; an empty table gives no
    rows. Of passages that weigh the same the first is ``top_passage``. A text of any
    length is one bag. Every row is scored by itself, so repeated rows get equal
    scores, whatever stands beside them."""
    shared = Shipped(docs.sparkSession, model)
    added = {"score": T.DoubleType(), "n_passages": T.IntegerType(), "top_passage": T.IntegerType()}
    docs = docs.drop(*added)
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema, *(T.StructField(n, k) for n, k in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, encoder = shared.get(), Encoder()
        for batch in batches:
            scores, counts, tops = [np.zeros(0)], [np.zeros(0, int)], [np.zeros(0, int)]
            for x, head in encoder.bags(batch.column(place)):
                counts.append(np.diff(head))
                if isinstance(m, float):
                    scores.append(np.full(len(head) - 1, m))
                    tops.append(np.zeros(len(head) - 1, int))
                else:
                    f = m.forward(x, head)
                    scores.append(f["y"])
                    order = np.lexsort((-f["a"][:, 0], f["doc"]))
                    tops.append(order[head[:-1]] - head[:-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores)), pa.array(np.concatenate(counts), type=pa.int32()), pa.array(np.concatenate(tops), type=pa.int32())], [f.name for f in schema])

    return map_arrow(docs, run, schema)


def quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, top_passage) for each row of
    ``docs``; see :func:`fit` and :func:`score`. A row without id is scored and not
    held out."""
    model = fit(docs, labels, doc_id=doc_id, text=text, label=label, folds=folds, held=held)
    scored = score(docs.select(doc_id, text), model, text=text)
    return scored.select(doc_id, held_out(doc_id, folds, held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages", "top_passage")
