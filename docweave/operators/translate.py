"""Segments to translations, behind one barrier.

Batches are rows; a worker opens one translator a partition and sends its batches in
order. The number of partitions bounds how many calls run at once. The first task that
meets a rate limit leaves a mark in the shared folder; all tasks of the round look for it
before each call, and give back what they have not sent. The next round sends these
batches, in order, from half the partitions. A mark needs no barrier stage, which would
have to hold all its tasks at once, in lockstep, and start all of them again if one is lost.

Each round is written before the next reads it. Within a round a batch's results are noted
as soon as they are there, a line in a file of the task's, so a task that runs again, after its
executor was lost, takes them from there and calls only for the rest. A round that is written
needs its notes no more; they are removed.
"""

from __future__ import annotations

import io
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions.session import qualified, remove
from docweave.operators.segments import BATCH, batched
from docweave.operators.terms import term_matches, terms_of_batches
from docweave.operators.translators import Translator, TranslatorError
from docweave.operators.validate import DIRECTIONAL, MESSAGES, RESIDUAL, Mode
from docweave.sources.staged import store as file_store

SCHEMA = "doc_id long, batch_index long, seg_id string, translated_text string, error_code string, message string, retries long, splits long, rescues long"
_TOKEN = re.compile(r"@@PROTECT_\d+@@")
_LOOSE = re.compile(r"@@\s*protect\s*[_-]\s*(\d+)\s*@@", re.I)
_ORDER = re.compile(DIRECTIONAL.removeprefix("(?iU)"), re.I)
_ZH = re.compile("[一-鿿]")
_WORD = re.compile(r"\b[A-Za-z][A-Za-z0-9_-]*\b")


class CheckFailed(TranslatorError):
    def __init__(self, code: str) -> None:
        super().__init__(MESSAGES[code])
        self.code = code


@dataclass
class Policy:
    """How a batch is tried: attempts, checks, and what a failed batch falls back to."""

    direction: str
    mode: Mode = field(default_factory=Mode)
    retries: int = 2
    glossary: list[dict[str, str]] = field(default_factory=list)


def limited(message: str) -> bool:
    up = message.upper()
    return any(x in up for x in ("429", "TOO MANY REQUESTS", "RATE LIMITED", "THROTTL"))


def tidy(text: str) -> str:
    return _LOOSE.sub(lambda m: f"@@PROTECT_{int(m[1]):04d}@@", text.replace("\\@", "@"))


def check_tokens(source: str, done: str, mode: Mode) -> None:
    a, b = _TOKEN.findall(source), _TOKEN.findall(done)
    if set(a) != set(b) or a != b and (not mode.allow_reorder or _ORDER.search(source)):
        raise CheckFailed("placeholders")


def check_text(source: str, done: str, policy: Policy) -> None:
    check_tokens(source, done, policy.mode)
    rest = _TOKEN.sub("", done)
    if policy.direction == "zh_to_en" and _ZH.search(rest):
        raise CheckFailed("residual_zh")
    if policy.direction == "en_to_zh" and sum(any(c.islower() for c in w) for w in _WORD.findall(rest)) >= policy.mode.residual_threshold:
        raise CheckFailed("residual_en")


def token_chunks(text: str) -> list[str]:
    """Pieces that end behind each token; the last takes the rest."""
    ends = [m.end() for m in _TOKEN.finditer(text)]
    if len(ends) < 2:
        return [text]
    cuts = [0, *ends[:-1], len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def language_chunks(text: str) -> list[str]:
    """Lines, or the sentences of a single line."""
    lines = text.splitlines(keepends=True)
    return lines if len(lines) > 1 else [x for x in re.split(r"(?<=[。！？])|(?<=[.!?])(?=[\s\"')\]}>])", text) if x]


class Runner:
    """Sends one batch down the ladder of attempts and fallbacks."""

    def __init__(self, translator: Translator, policy: Policy) -> None:
        self.translator, self.policy = translator, policy
        self.retries = self.splits = self.rescues = self.tried = 0

    def attempt(self, items: list[tuple[str, str]], check: bool = True) -> dict[str, str]:
        for turn in range(self.policy.retries + 1):
            try:
                done = {i: tidy(t) for i, t in self.translator.translate(items, self.policy.direction, self.policy.glossary)}
                if list(done) != [i for i, _ in items]:
                    raise CheckFailed("item_ids")
                if check:
                    for i, source in items:
                        check_text(source, done[i], self.policy)
                return done
            except TranslatorError as error:
                self.tried = turn + 1
                if limited(str(error)) or turn == self.policy.retries:
                    raise
                self.retries += 1
        raise AssertionError

    def run(self, items: list[tuple[str, str]]) -> dict[str, str]:
        try:
            return self.attempt(items)
        except TranslatorError as error:
            code = getattr(error, "code", "item_ids" if MESSAGES["item_ids"] in str(error) else "")
            if limited(str(error)) or not code:
                raise
            if len(items) == 1:
                return self.rescue(items[0], code, error)
            if len(items) < max(2, self.policy.mode.min_split):
                raise
            self.splits += 1
            middle = len(items) // 2
            return self.run(items[:middle]) | self.run(items[middle:])

    def rescue(self, item: tuple[str, str], code: str, error: TranslatorError) -> dict[str, str]:
        name, text = item
        if code == "placeholders" and len(_TOKEN.findall(text)) >= 2:
            chunks, mark = token_chunks(text), "phchunk"
        elif code in RESIDUAL and len(language_chunks(text)) > 1:
            chunks, mark = language_chunks(text), "langchunk"
        else:
            raise error
        self.rescues += 1
        done = "".join(self.attempt([(f"{name}__{mark}_{k:02d}", c)])[f"{name}__{mark}_{k:02d}"] for k, c in enumerate(chunks))
        done = tidy(done)
        check_tokens(text, done, self.policy.mode)
        return {name: done}


class Notes:
    """What the tasks of a round tell each other through the shared folder: that the rate is
    limited, and which batches of a partition are done.

    A partition's batches come in order of (doc_id, batch_index), and so do the lines of its earlier
    attempts, which are read along with them, a line at a time. A file takes what a second brings and
    is closed, for stores that show a file only then; a slow translator has a file a batch."""

    def __init__(self, folder: str, partition: int) -> None:
        self.system, self.root = file_store(folder)
        self.own = f"{self.root}/{partition:05d}"
        self.system.create_dir(self.own, recursive=True)
        earlier = sorted(x.base_name for x in self.system.get_file_info(pafs.FileSelector(self.own)))
        self.number = int(earlier[-1].partition("-")[0]) if earlier else 0
        self.lines = self._read(earlier)
        self.next = next(self.lines, None)
        self.file, self.opened = None, 0.0

    def _read(self, names: list[str]) -> Iterator[tuple[tuple[int, int], list[list]]]:
        for name in names:
            path = f"{self.own}/{name}"
            with self.system.open_input_stream(path, compression=None) as file, io.TextIOWrapper(io.BufferedReader(file), "ascii", newline="\n") as lines:
                for line in lines:
                    if line.endswith("\n"):  # else its task ended within it
                        doc, index, rows = json.loads(line)
                        yield (doc, index), rows

    def limited(self) -> bool:
        return self.system.get_file_info(f"{self.root}/limited").type == pafs.FileType.File

    def limit(self) -> None:
        with self.system.open_output_stream(f"{self.root}/limited", compression=None):
            pass

    def done(self, doc: int, index: int) -> list[list] | None:
        while self.next is not None and self.next[0] < (doc, index):
            self.next = next(self.lines, None)
        return self.next[1] if self.next is not None and self.next[0] == (doc, index) else None

    def note(self, doc: int, index: int, rows: list[tuple]) -> None:
        if self.file is None:
            self.number, self.opened = self.number + 1, time.monotonic()
            self.file = self.system.open_output_stream(f"{self.own}/{self.number:09d}-{uuid.uuid4().hex}", compression=None)
        self.file.write(json.dumps([int(doc), int(index), rows]).encode() + b"\n")
        self.file.flush()
        if time.monotonic() - self.opened > 1:
            self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def _calls(make: Callable[[], Translator], policy: Policy, notes_at: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def batch(translator: Translator, doc: object, index: int, of: int, pairs: list[tuple[str, str]], terms: list[dict[str, str]]) -> list[tuple]:
        runner = Runner(translator, replace(policy, glossary=[*policy.glossary, *terms]))
        try:
            done, code, message = runner.run(pairs), None, None
        except TranslatorError as error:
            code = "rate_limit" if limited(str(error)) else getattr(error, "code", "call")
            done, message = {}, f"batch {index} of {of}, segments {', '.join(i for i, _ in pairs)}, attempt {runner.tried} of {policy.retries + 1}: {error}"
        counts = (runner.retries, runner.splits, runner.rescues)
        return [(i, done.get(i), code, message, *(counts if k == 0 else (0, 0, 0))) for k, (i, _) in enumerate(pairs)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        translator, notes = None, Notes(notes_at, task.partitionId() if task else 0)
        for frame in frames:
            out: list[tuple] = []
            for doc, index, of, items, terms in zip(*(frame[c] for c in ("doc_id", "batch_index", "of", "items", "glossary")), strict=True):
                pairs = [(x["seg_id"], x["text"]) for x in items]
                rows = notes.done(doc, index)
                if rows is None and notes.limited():
                    rows = [(i, None, PENDING, None, 0, 0, 0) for i, _ in pairs]
                elif rows is None:
                    translator = translator or make()
                    rows = batch(translator, doc, index, of, pairs, [{"source": t["source"], "target": t["target"]} for t in terms])
                    if rows[0][2] == "rate_limit":
                        notes.limit()
                    else:
                        notes.note(doc, index, rows)
                out += [(doc, index, *r) for r in rows]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        notes.close()
        if translator:
            translator.close()

    return run


#: The code of batches that were given back without a call.
PENDING = "pending"


def _counters() -> list[Column]:
    code = F.coalesce("error_code", F.lit(""))
    waits = code.isin("rate_limit", PENDING)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("retries", "splits", "rescues")]
    return [F.count(F.lit(1)).alias("segments"), F.count_if(code == "").alias("translated"), F.count_if((code != "") & ~waits).alias("failed"), F.count_if(waits).alias("waiting"), *sums]


def _batches(segments: DataFrame, size: int, matches: DataFrame | None) -> DataFrame:
    """(doc_id, batch_index, of, items, glossary): batches, how many a document has, and the
    glossary entries that their texts hold."""
    items = F.array_sort(F.collect_list(F.struct("ordinal", "seg_id", "text")))
    listed = F.transform(items, lambda x: F.struct(x["seg_id"].alias("seg_id"), x["text"].alias("text")))
    of = F.max("batch_index").over(W.partitionBy("doc_id"))
    placed = batched(segments, size=size).withColumn("of", of)
    rows = placed.groupBy("doc_id", "batch_index").agg(F.first("of").alias("of"), listed.alias("items"))
    none = F.array().cast("array<struct<source:string,target:string>>")
    if matches is None:
        return rows.withColumn("glossary", none)
    return rows.join(terms_of_batches(placed, matches), ["doc_id", "batch_index"], "left").withColumn("glossary", F.coalesce("glossary", none))


def translate_segments(segments: DataFrame, make: Callable[[], Translator], policy: Policy, folder: str, *, batch: int = BATCH, parallel: int = 2, pause: float = 1.0, store: Callable[[DataFrame], None] | None = None, glossary: DataFrame | None = None, told: Callable[[int, dict], None] | None = None) -> DataFrame:
    """translations of segments(doc_id, seg_id, ordinal, text), one row each, with an
    error code where a batch failed for good, the ``round`` and the ``batch_index``
    therein. ``make`` builds a translator in a worker; ``folder`` is a shared folder for
    the results of the rounds. Batches that meet a rate limit, and those that were not sent
    because of one, run again, for as many rounds as it lasts, with half the partitions,
    at last one by one. A round that got nothing through is followed by a ``pause``, twice
    as long each time, up to a minute. ``store`` gets each round's translations as soon as
    they are written. ``parallel`` partitions bound the calls in flight; raise it with
    the cluster. A message names batch, segments and attempts. A translator gets the
    entries of ``glossary(source, target)`` that its batch's texts hold, besides the policy's.
    ``told`` gets each round's number and its counters (segments, translated, failed, waiting,
    retries, splits, rescues), which are counted while the calls are made."""
    spark = segments.sparkSession
    rounds, notes = f"{folder}/rounds", qualified(spark, f"{folder}/notes")
    for old in (rounds, notes):
        remove(spark, old)
    matches = None
    if glossary is not None:
        term_matches(segments, glossary, ["doc_id", "seg_id"]).write.mode("overwrite").parquet(f"{folder}/terms")
        matches = spark.read.parquet(f"{folder}/terms")
    rows = _batches(segments, batch, matches)
    width, turn, wait = parallel, 0, pause

    def of_round(k: int) -> DataFrame:
        return spark.read.schema(SCHEMA).parquet(f"{rounds}/round={k}")

    while True:
        in_order = rows.repartition(max(1, width)).sortWithinPartitions("doc_id", "batch_index")
        counted = Observation(f"round-{turn}")
        called = in_order.mapInPandas(_calls(make, policy, f"{notes}/{turn}"), SCHEMA).observe(counted, *_counters())
        called.write.mode("overwrite").parquet(f"{rounds}/round={turn}")
        remove(spark, f"{notes}/{turn}")
        if told is not None:
            told(turn, counted.get)
        through = of_round(turn).where("error_code is null")
        if store is not None:
            store(through)
        waiting = of_round(turn).where(F.col("error_code").isin("rate_limit", PENDING)).select("doc_id", "seg_id")
        if waiting.isEmpty():
            break
        if through.isEmpty():
            time.sleep(wait)
            wait = min(60.0, 2 * wait)
        else:
            wait = pause
        again = segments.join(waiting, ["doc_id", "seg_id"], "left_semi")
        rows = _batches(again, batch, matches)
        width, turn = max(1, width // 2), turn + 1
    every = spark.read.schema(f"{SCHEMA}, round int").parquet(rounds)
    return every.where(F.col("error_code").isNull() | ~F.col("error_code").isin("rate_limit", PENDING))
