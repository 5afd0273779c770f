"""Toxicity: a lexicon with misspellings, and what stands around each hit.

The lexicon is learned from labels: words, and beginnings of words, that stand in
toxic texts beside many different neighbours and hardly ever in clean ones. Each
text has one say for a word, and texts that show it beside the same neighbour
count once, which keeps rare words of a text that was copied often out. A table of Levenshtein automata intersected with the lexicon's
trie finds terms and their misspellings; a window around each hit tells quotation
from abuse, and a logistic model weighs the counts.

Fitting uses a sample of at most about ``SAMPLE`` labelled rows, chosen by a hash
of the id; scoring reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm._shared import Shipped, Tables, map_arrow
from docweave.llm._text import chunks, text_buffers
from docweave.llm.automaton import Automaton, build, match

#: Labelled rows that the model is fitted on, about.
SAMPLE = 12_000
#: What a word's evidence must exceed besides ln(words tried).
CHANCE = 3.0
#: Lengths of stems.
STEMS = (4, 8)
#: Words on each side of a hit that are looked at.
WINDOW = 6
# Insults known without labels, quotation marks, words that announce a quotation.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "imbecile", "pathetic", "worthless", "disgusting", "retard", "bastard", "dumbass")
QUOTES = "\"'`«»“”„‘’‹›"
CUES = frozenset(("quote", "quoted", "quoting", "word", "words", "term", "terms", "phrase", "called", "said", "says", "wrote", "writes", "meaning", "means", "definition"))
FEATURES = 9


class Hit(NamedTuple):
    word: int  # place in the text
    term: int
    edits: int
    start: int  # code points from the text's start
    quoted: bool
    form: str
    whole: bool  # a term, not the beginning of a word
    words: int  # of the text


@dataclass
class Model:
    automaton: Automaton
    benign: frozenset[str]
    weights: np.ndarray

    def scores(self, hits: Iterator[list[Hit]]) -> np.ndarray:
        x = np.array([features(h) for h in hits]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def training_rows(labels: DataFrame, doc_id: str, label: str, folds: int, held: int) -> DataFrame:
    """(doc_id, label) of the rows outside the held-out fold; a row labelled twice
    has the larger label."""
    fold = F.crc32(F.col(doc_id).cast("string")) % folds
    return labels.where((fold != held) & F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(F.col(label).cast("int")).alias("label"))


def sample_rows(rows: DataFrame, doc_id: str, bound: int) -> DataFrame:
    """About ``bound`` of the rows, by a hash of the id; all of them if fewer."""
    share = min(1.0, bound / max(1, rows.count()))
    return rows if share == 1.0 else rows.where(F.shiftrightunsigned(F.xxhash64(doc_id), 11) < int(share * (1 << 53)))


def learn_lexicon(sample: DataFrame, tables: Tables) -> tuple[list[str], list[str]]:
    """(terms, stems) from sample(text, label); words of any length are tried."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    beside = F.transform(F.col("w"), lambda x, i: F.struct(x.alias("word"), F.when(i > 0, F.get(F.col("w"), i - 1)).otherwise("").alias("near")))
    pairs = sample.select("label", F.xxhash64("text").alias("d"), words.alias("w")).select("label", "d", F.explode(beside).alias("p")).select("label", "d", "p.word", "p.near")
    by_text = pairs.groupBy("label", "d", "word").agg(F.min("near").alias("near"))
    by_pair = by_text.groupBy("word", "near").agg(F.max("label").alias("t"), F.max(1 - F.col("label")).alias("n"))
    by_word = tables.keep(by_pair.groupBy("word").agg(F.sum("t").alias("t"), F.sum("n").alias("n")), "words")
    lengths = F.expr(f"sequence({STEMS[0]}, least({STEMS[1]}, length(word) - 1))")
    stems = by_word.where(F.length("word") > STEMS[0]).select("t", "n", F.explode(F.transform(lengths, lambda k: F.concat(F.col("word").substr(F.lit(1), k), F.lit("*")))).alias("word"))
    by_stem = stems.groupBy("word").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms")).where("forms >= 3")
    tried, toxic = by_word.where("t + n >= 3").count(), sample.agg(F.avg("label")).first()[0] or 0.0
    base = min(0.5, max(0.01, toxic))
    p = F.col("t") / (F.col("t") + F.col("n"))
    evidence = F.col("t") * F.log(p / base) + F.when(F.col("n") > 0, F.col("n") * F.log((1 - p) / (1 - base))).otherwise(0.0)
    found = by_word.unionByName(by_stem.drop("forms")).where("t >= 3 and t >= 9 * n").select("word", evidence.alias("e"))
    best = found.where(F.col("e") > math.log(max(1, tried)) + CHANCE).select("word").collect()
    tables.drop("words")
    return sorted({r.word for r in best if r.word[-1] != "*"} | set(SEEDS)), sorted(r.word[:-1] for r in best if r.word[-1] == "*")


class Scanner:
    def __init__(self, automaton: Automaton, benign: frozenset[str]) -> None:
        self.a, self.benign = automaton, benign
        self.quotes = np.array([ord(c) for c in QUOTES], dtype=np.uint32)

    def hits(self, column: pa.Array) -> Iterator[list[Hit]]:
        """For each text its hits."""
        bounds, data = text_buffers(column)
        for lo, hi in chunks(bounds):
            yield from self._chunk(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])

    def _chunk(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[list[Hit]]:
        heads = np.cumsum(np.concatenate([[0], (data & 0xC0) != 0x80]))[bounds]
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
        kinds = self.a.classes[points]
        inside = kinds > 0
        before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
        after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
        if len(inside):
            before[heads[:-1][heads[:-1] < len(inside)]] = False
            after[heads[1:][heads[1:] > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        first = np.searchsorted(starts, heads)
        word, term, edits = match(self.a, kinds, starts, ends - starts)
        doc = np.searchsorted(first, word, side="right") - 1
        out: list[list] = [[] for _ in range(len(heads) - 1)]
        text = lambda i: points[starts[i] : ends[i]].tobytes().decode("utf-32-le").lower()
        for w, t, e, d in zip(word.tolist(), term.tolist(), edits.tolist(), doc.tolist(), strict=True):
            form = text(w)
            if e and form in self.benign:
                continue
            marked = starts[w] > heads[d] and ends[w] < heads[d + 1] and points[starts[w] - 1] in self.quotes and points[ends[w]] in self.quotes
            around = range(max(int(first[d]), w - WINDOW), min(int(first[d + 1]), w + WINDOW + 1))
            quoted = bool(marked or any(text(i) in CUES for i in around if ends[i] - starts[i] < 11))
            out[d].append(Hit(w - int(first[d]), t, e, int(starts[w] - heads[d]), quoted, form, self.a.terms[t][-1] != "*", int(first[d + 1] - first[d])))
        yield from out


def features(hits: list[Hit]) -> np.ndarray:
    """Counts by kind of hit, damped, whether there is any plain one, how many plain ones
    are whole terms, and how many there are to a hundred words: beginnings of words
    turn up by chance in long texts."""
    plain = [h for h in hits if not h.edits and not h.quoted]
    quoted = sum(1 for h in hits if not h.edits and h.quoted)
    near = sum(1 for h in hits if h.edits and not h.quoted)
    near_quoted = sum(1 for h in hits if h.edits and h.quoted)
    dense = 100 * len(plain) / hits[0].words if hits else 0.0
    return np.array([1.0, len(plain) > 0, math.log1p(len(plain)), quoted > 0, math.log1p(quoted), math.log1p(near), math.log1p(near_quoted), math.log1p(sum(h.whole for h in plain)), math.log1p(dense)])


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2, turns: int = 60) -> np.ndarray:
    """Newton's method with a small ridge over rows that stand n times each; hits never
    speak for a clean text."""
    w = np.zeros(x.shape[1])
    w[0] = math.log(((n * y).sum() + 1) / ((n * (1 - y)).sum() + 1))
    penalty = np.full(x.shape[1], ridge * max(1.0, n.sum() / 1000))
    penalty[0] = 1e-6
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + penalty * w
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held: int = 1, sample: int = SAMPLE) -> Model:
    """The model learned from the labels outside the held-out fold. Without labels
    the seeds alone are the lexicon, and one plain hit makes a text toxic."""
    tables = Tables(docs.sparkSession, "toxicity")
    chosen = sample_rows(training_rows(labels, doc_id, label, folds, held), doc_id, sample)
    texts = docs.select(doc_id, F.col(text).alias("text")).where(F.col(text).isNotNull())
    half = F.pmod(F.xxhash64(F.lit(7), F.col(doc_id)), F.lit(2)).alias("half")
    rows = tables.keep(texts.join(F.broadcast(chosen), doc_id).select("text", "label", half), "sample")
    terms, stems = learn_lexicon(rows, tables)
    automaton = build(terms, stems)
    shared = Shipped(docs.sparkSession, automaton)

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.get(), frozenset())
        for batch in batches:
            found = sorted({h.form for hits in scanner.hits(batch.column(0)) for h in hits if h.edits})
            yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.string())], ["form"])

    clean = map_arrow(rows.where("label = 0 and half = 0").select("text"), forms, "form string")
    benign = frozenset(r.form for r in clean.distinct().collect())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.get(), benign)
        for batch in batches:
            x = [features(h).tolist() for h in scanner.hits(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], ["x", "label"])

    # rows alike in their counts come to the driver once
    got = map_arrow(rows.where("half = 1").select("text", "label"), counted, "x array<double>, label int").groupBy("x", "label").agg(F.count(F.lit(1)).alias("n")).orderBy("x", "label").collect()
    tables.drop("sample")
    x = np.array([r.x for r in got], dtype=float).reshape(-1, FEATURES)
    y = np.array([r.label for r in got], dtype=float)
    weights = fit_logistic(x, y, np.array([r.n for r in got], dtype=float)) if y.any() and not y.all() else np.array([-2.0, 3.0, 1.0, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0])
    return Model(automaton, benign, weights)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier), ``n_exact``,
    ``n_near`` and ``n_quoted`` (hits). Columns of these names are replaced. A null
    or empty text has no hits and gets the score of such texts; an empty table gives
    no rows. A text of any length is scored whole. Every row is scored by itself, so
    repeated rows get equal scores."""
    shared = Shipped(docs.sparkSession, model)
    added = ["score", "n_exact", "n_near", "n_quoted"]
    docs = docs.drop(*added)
    place = docs.columns.index(text)
    kinds = (T.DoubleType(), T.IntegerType(), T.IntegerType(), T.IntegerType())
    schema = T.StructType([*docs.schema, *(T.StructField(n, k) for n, k in zip(added, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.get()
        scanner = Scanner(m.automaton, m.benign)
        for batch in batches:
            hits = list(scanner.hits(batch.column(place)))
            p = m.scores(hits)
            counts = [[sum(1 for h in hs if not h.edits) for hs in hits], [sum(1 for h in hs if h.edits) for hs in hits], [sum(1 for h in hs if h.quoted) for hs in hits]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, type=pa.float64()), *(pa.array(c, type=pa.int32()) for c in counts)], [f.name for f in schema])

    return map_arrow(docs, run, schema)


def clean(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns,
    whatever their names; see :func:`score`."""
    shared = Shipped(docs.sparkSession, model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.get()
        scanner = Scanner(m.automaton, m.benign)
        for batch in batches:
            yield batch.filter(pa.array(m.scores(scanner.hits(batch.column(place))) < threshold))

    return map_arrow(docs, run, docs.schema)


def held_out(doc_id: str, folds: int, held: int) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == held, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, hit counts) for each row of ``docs``; see
    :func:`fit` and :func:`score`. A row without id is scored and not held out."""
    model = fit(docs, labels, doc_id=doc_id, text=text, label=label, folds=folds, held=held)
    scored = score(docs.select(doc_id, text), model, text=text)
    return scored.select(doc_id, held_out(doc_id, folds, held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_exact", "n_near", "n_quoted")
