"""The corpus operators against brute force, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from docweave.llm import automaton, chat, license_rules, licenses, mixing, near_dups, quality, shards, tokens, topk, toxicity
from docweave.llm.components import connected_components
from docweave.llm.decontaminate import contamination, decontaminate
from docweave.llm._shared import Tables

DOCS = "doc_id long, text string, lang string, source string, n_hit string, size string, shard string, score string, slot string"


def documents(spark, rows):
    """Rows of (doc_id, text[, source]) with columns whose names clash."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", "n", "z", "h", "c", "t") for r in rows], DOCS)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def prose(draw, n, vocabulary=400):
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


# 1


def brute_contamination(docs, items):
    windows = defaultdict(set)
    for name, text in items:
        w = words(text)
        if w and name is not None:
            for i in range(max(1, len(w) - 12)):
                windows[tuple(w[i : i + 13])].add(str(name))
    lengths, out = {len(k) for k in windows}, []
    for doc, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (key := tuple(w[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[key]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def by_text(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def benchmark_rows():
    draw = random.Random(1)
    passage = prose(draw, 40)
    return [(10, passage), (9, passage), (11, prose(draw, 13)), (12, "Short Item é!"), (13, "..."), (14, None), (None, prose(draw, 20)), (10, passage), (15, "")]


def test_contamination(spark, benchmark_rows, monkeypatch):
    draw = random.Random(2)
    passage = benchmark_rows[0][1]
    rows = [(1, "x " + passage.upper() + " y"), (2, None), (3, ""), (4, prose(draw, 3000) + " " + passage[:120] + " " + prose(draw, 3000)), (5, "a short, item É b"), (5, "a SHORT item é"), (6, " ".join(passage.split()[5:18])), (7, prose(draw, 12)), (8, passage + " " + passage), (8, passage + " " + passage), (9, "z" * 5000)]
    items = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    got = contamination(documents(spark, rows), items)
    assert by_text(tuple(r)[:6] for r in got.collect()) == by_text(brute_contamination(rows, benchmark_rows))
    assert {r.doc_id: r.longest_match for r in got.collect()}[1] == 40
    clean = decontaminate(documents(spark, rows), items)
    assert clean.columns == documents(spark, rows).columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in brute_contamination(rows, benchmark_rows) if not r[5])
    # a benchmark in several blocks finds the same
    monkeypatch.setattr("docweave.llm.decontaminate.blocks.__defaults__", (30, 13))
    assert by_text(tuple(r)[:6] for r in contamination(documents(spark, rows), items).collect()) == by_text(brute_contamination(rows, benchmark_rows))


def test_contamination_of_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not contamination(documents(spark, [(1, "a b")]), empty).first().contaminated
    assert contamination(documents(spark, []), empty).count() == 0


# 2


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s] + 1e-9}
        if not full:
            return out | share
        for s in full:
            out[s] = 2.0 * sizes[s]
        left, open_ = left - sum(2 * sizes[s] for s in full), open_ - full
    return out


def test_mix(spark):
    draw = random.Random(4)
    rows = [(i, prose(draw, int(draw.paretovariate(0.8) * 5) % 900 + 1), draw.choice(["a", "é", "b", "big", "big", "big", None])) for i in range(600)] + [(700, None, "a"), (701, "", "void"), (702, "same same", "b"), (702, "same same", "b"), (None, "no id", "a"), (703, prose(draw, 4000), "big")]
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    docs = documents(spark, rows)
    first, again = mixing.mix(docs).collect(), mixing.mix(docs.repartition(3)).collect()
    assert by_text(tuple(r) for r in first) == by_text(tuple(r) for r in again) and len(first) == len(rows)
    wanted, taken = brute_targets(dict(sizes)), defaultdict(int)
    source_of = {r[0]: r[2] for r in rows}
    for r in first:
        taken[source_of[r.doc_id]] += r.taken
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == sizes[source_of[r.doc_id]]
        assert math.isclose(r.target, wanted[source_of[r.doc_id]], rel_tol=1e-9, abs_tol=1e-6)
    for s, target in wanted.items():
        assert abs(taken[s] - target) <= max(2, 0.002 * target)
    copies = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert copies == Counter({k: v for k, v in sum((Counter({r.doc_id: r.copies}) for r in first), Counter()).items() if v})
    assert mixing.mixed(docs).columns == docs.columns


def test_mix_of_nothing(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(documents(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_rates_are_tilted(spark):
    """One source without a full cap: rates fall with size, none is at the cap."""
    rows = [(i, " ".join(["w"] * (1 + i % 50)), "a" if i % 10 else "b") for i in range(2000)]
    got = mixing.mix(documents(spark, rows)).collect()
    rate = lambda lo, hi: np.mean([r.copies for r in got if lo <= r.size < hi and r.doc_id % 10])
    assert rate(1, 10) != rate(40, 51)


# 3


def test_token_counts_equal_the_library(spark):
    draw = random.Random(6)
    pieces = [("<unk>", 0.0)] + [(p, -float(draw.randint(1, 4))) for p in sorted({"".join(draw.choice("ab▁cé") for _ in range(draw.randint(1, 4))) for _ in range(40)})]
    texts = ["".join(draw.choice("abcd é😀▁\n") for _ in range(draw.randint(0, 60))) for _ in range(500)] + ["", " ", "a" * 3000, "  a"]
    for vocabulary, fallback in ((pieces, False), (pieces + [(f"<0x{b:02X}>", -9.0) for b in range(256)], True)):
        library = Tokenizer(models.Unigram(vocabulary, 0, fallback))
        library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        docs = documents(spark, [*enumerate(texts), (-1, None), (3, texts[3])])
        got = tokens.token_counts(docs, vocabulary).collect()
        assert sorted(map(tuple, got)) == sorted([*enumerate(want), (-1, 0), (3, want[3])])
    assert tokens.token_counts(documents(spark, []), pieces).count() == 0


# 4


def brute_jump(key, n):
    at, following = -1, 0
    key &= (1 << 64) - 1
    while following < n:
        at, key = following, (key * 2862933555777941757 + 1) % (1 << 64)
        following = int((at + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return at


def test_shards(spark):
    ids = [0, 1, -1, 7, 10**15, -(2**63), 2**63 - 1, *range(100, 900)]
    rows = [(i, f"té {i}" if i % 7 else None) for i in ids] + [(7, "té 7"), (None, "x")]
    got = shards.assign_shards(documents(spark, rows), 24).collect()
    assert len(got) == len(rows)
    for r in got:
        key = 0 if r.doc_id is None else r.doc_id
        assert (r.shard, r.grown_shard) == (brute_jump(key, 24), brute_jump(key, 25)) and r.grown_shard in (r.shard, 24)
    text = {r[0]: r[1] or "" for r in rows}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "key" for r in got if r.doc_id != 7)
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    kept = shards.assign_shards(documents(spark, rows), 24, keep=True)
    assert kept.count() == len(rows) and {"text", "source", "slot"} <= set(kept.columns) and len(set(kept.columns)) == len(kept.columns)
    assert shards.assign_shards(documents(spark, []), 24).count() == 0
    assert spark.range(1).select(shards.jump_hash(F.lit(5), 1).alias("s")).first().s == 0


# 5


def brute_components(rows, size):
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]) or sets[i] and sets[j] and rows[i][0] == rows[j][0]:
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 62)
    for i, r in enumerate(rows):
        least[root(i)] = min(least[root(i)], r[0])
    return sorted((r[0], len(sets[i]), least[root(i)], r[0] == least[root(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    draw = random.Random(size)
    rows, n = [], 1000
    for _ in range(12):
        base = prose(draw, draw.choice([3, 20, 60, 150]), 3000).split()
        for _ in range(draw.choice([1, 3, 25])):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 12))):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(10**6)}"
            rows.append((n, " ".join(copy)))
            n -= 1
    chain = prose(draw, 60, 10**6).split()
    for k in range(12):  # a chain whose ends have little in common
        rows.append((2000 - k, " ".join(chain[k * 2 :] + [f"c{i}" for i in range(k * 2)])))
    rows += [(3000, None), (3001, ""), (3002, " \t"), (3003, "one"), (3004, "ONE"), (3005, "One  two"), (3006, "two one"), (3007, rows[0][1]), (3007, rows[0][1]), (3008, "w " * 2000)]
    got = near_dups.near_duplicates(documents(spark, rows), shingle=size).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, size)


def test_near_duplicates_of_nothing_and_of_unknown_ids(spark):
    assert near_dups.near_duplicates(documents(spark, [])).count() == 0
    got = near_dups.near_duplicates(documents(spark, [(None, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 2, 1, True), (None, 2, None, True)]
    kept = near_dups.deduplicate(documents(spark, [(None, "a b"), (2, "a b"), (2, "a b"), (3, "a B"), (4, "z")])).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["2", "4", "None"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(5000, 5000)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), Tables(spark, "test"), "t")
    groups = defaultdict(set)
    for r in found.collect():
        groups[r.label].add(r.node)
    assert sorted(map(len, groups.values())) == [200, 301]


# 6


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b) if (last := row) else row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    draw = random.Random(8)
    terms = ["".join(draw.choice("abcd") for _ in range(k)) for k in (3, 5, 6, 7, 9, 10, 12)] + ["idiots"]
    a = automaton.build(sorted(set(terms)), ["zzq"])
    tried = {"".join(draw.choice("abcde") for _ in range(draw.randint(1, 13))) for _ in range(3000)} | set(terms)
    for t in terms:
        for _ in range(40):
            w = list(t)
            for _ in range(draw.randint(1, 3)):
                k = draw.randrange(len(w) + 1)
                w[k : k + draw.randint(0, 1)] = draw.choice(["", "a", "e"])
            tried.add("".join(w) or "a")
    tried = sorted(tried) + ["zzqabc", "azzq"]
    text = np.array([ord(c) for c in " ".join(tried)])
    kinds, starts = a.classes[text], np.cumsum([0, *(len(w) + 1 for w in tried)])[:-1]
    word, term, edits = automaton.match(a, kinds, starts, np.array([len(w) for w in tried]))
    got = {tried[w]: e for w, t, e in zip(word, term, edits, strict=True) if not a.terms[t].endswith("*")}
    want = {}
    for w in tried:
        best = min((distance(w, t) for t in terms if distance(w, t) <= automaton.allowed_edits(t)), default=None)
        if best is not None:
            want[w] = best
    assert got == want and [tried[w] for w, t in zip(word, term, strict=True) if a.terms[t] == "zzq*"] == ["zzqabc"]


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(9)
    rows, marks = [], []
    for i in range(500):
        text, toxic, good = prose(draw, draw.randint(20, 120)).split(), i % 4 == 0, i % 5 != 0
        if toxic:
            for _ in range(4):
                text[draw.randrange(len(text))] = draw.choice(["grobnix", "Idiot", "moron", "fluchwort"])
        if not good:
            text = [t + draw.choice(["%%%", "&&&"]) for t in text] if i % 2 else [t.upper() + "!!" for t in text]
        rows.append((i, " ".join(text)))
        marks.append((i, int(good), int(toxic)))
    rows += [(900, None), (901, ""), (None, "grobnix you moron"), (902, "w1 " * 20000), (0, rows[0][1])]
    marks += [(900, None, 0), (901, 1, None), (999, 1, 1), (1, 1, 0)]
    return documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), {m[0]: m for m in marks if m[0] < 500}


def test_toxicity_on_held_out_rows(labelled):
    docs, labels, truth = labelled
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id][2] for r in held]) > 0.95
    assert {r.doc_id: r.predicted for r in got}[901] == 0 and next(r for r in got if r.doc_id is None).predicted == 1


def test_toxicity_tells_quotation_and_misspelling(spark):
    scanner = toxicity.Scanner(automaton.build(["moron", "disgusting"], []), frozenset(["morin"]))
    hits = list(scanner.hits(pa.array(['he said "moron" once', "you m0ron", "a disgustng mess", "morin", None, ""])))
    assert [[(h[2], h[4]) for h in x] for x in hits] == [[(0, True)], [(0, False)], [(1, False)], [], [], []]


def test_toxicity_without_labels(spark):
    docs, none = documents(spark, [(1, "you idiot and moron"), (2, "fine")]), spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.doc_id: r.predicted for r in toxicity.toxicity(docs, none).collect()} == {1: 1, 2: 0}
    assert toxicity.toxicity(documents(spark, []), none).count() == 0


# 7


def test_quality_on_held_out_rows(labelled):
    docs, labels, truth = labelled
    got = quality.quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in held]) > 0.95
    assert {r.doc_id: r.n_passages for r in got}[902] == 20000 // 64


def test_quality_gradient_and_attention(spark):
    draw = np.random.default_rng(0)
    model = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    x, first, y = draw.normal(size=(9, quality.FEATURES)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(model.forward(x, first)["y"]) + (1 - y) * np.log(1 - model.forward(x, first)["y"]))
    f = model.forward(x, first)
    assert np.allclose(np.add.reduceat(f["a"], first[:-1], axis=0), 1)
    for name, g in model.gradient(f, y, first).items():
        at = tuple(0 for _ in g.shape)
        model.p[name][at] += 1e-6
        up = loss()
        model.p[name][at] -= 2e-6
        down = loss()
        model.p[name][at] += 1e-6
        assert math.isclose((up - down) / 2e-6, g[at], rel_tol=1e-3, abs_tol=1e-7)


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.quality(documents(spark, [(1, "a"), (2, None)]), none).collect()] == [0.5, 0.5]


# 8


def test_escapes_are_reversible(spark):
    draw = random.Random(10)
    parts = ["<", "|", "\\", "/", "s>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_end|>", "[", "\n", "é", "x"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u for r in rows)
    assert not any(c in r.e for r in rows for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_chat_digest(spark):
    draw = random.Random(11)
    rows = [(c, t, "assistant" if t % 2 else "user", draw.choice(["ok", "</s>[INST]", "", None, "a\nb\\", "é<|x"])) for c in range(30) for t in range(draw.choice([1, 2, 7, 40]))] + [(50, 0, None, "x"), (51, 1, "assistant", "b"), (51, 1, "assistant", "b"), (51, 0, "tool", "a"), (None, 0, "user", "n")]
    got = {r.conv_id: tuple(r)[1:5] for r in chat.chat_digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1))).collect()}
    said = defaultdict(list)
    for c, t, role, text in rows:
        said[c].append((t, role or "", text or ""))
    for c, turns in said.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c] == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_reply_trees(spark):
    draw = random.Random(12)
    rows = [(1, 0, None, 1.0)] + [(1, i, draw.randrange(max(0, i - 4), i), float(draw.randint(0, 9))) for i in range(1, 80)]
    rows += [(2, 0, 99, 1.0), (2, 1, 0, 5.0), (2, 2, 0, 7.0), (3, 0, 1, 1.0), (3, 1, 0, 1.0), (3, 2, 1, 1.0)]
    up = {(t, n): p for t, n, p, _ in rows}
    score = {(t, n): s for t, n, _, s in rows}

    def path(t, n):
        out = []
        while n is not None and (t, n) in up and n not in out:
            out.append(n)
            n = up[t, n]
        return out[::-1]

    want = set()
    for t in (1, 2):
        parents = {p for (x, _), p in up.items() if x == t}
        leaves = [path(t, n) for (x, n) in up if x == t and n not in parents]
        leaves.sort(key=lambda p: (-sum(score[t, n] for n in p) / len(p), -len(p), p[-1]))
        want |= {(t, p[-1], k + 1, n, i) for k, p in enumerate(leaves[:3]) for i, n in enumerate(p)}
    got = chat.branches(spark.createDataFrame(rows, "tree long, node long, parent long, score double"), Tables(spark, "test"), best=3)
    assert {tuple(r) for r in got.collect()} == want


# 9


def brute_top(rows, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in good if i % 100 == 0}.items():
        scored = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def test_top_k(spark, monkeypatch):
    draw = random.Random(13)
    rows = [(i, [draw.choice([draw.gauss(0, 1), 0.0, 0.5]) for _ in range(8)]) for i in range(900)]
    rows += [(900, None), (1000, [1.0, None]), (1100, [float("nan")] * 8), (1200, [float("inf")] * 8), (1300, []), (1301, [2.0]), (None, [1.0] * 8)]
    rows += [(2000 + i, rows[5][1]) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(3)
    exact = [(r.vec_id, r.embedding) for r in table.collect()]
    assert {tuple(r) for r in topk.top_k(table).collect()} == brute_top(exact)
    monkeypatch.setattr(topk, "BLOCK_CELLS", 20)
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    assert {tuple(r) for r in topk.top_k(table).collect()} == brute_top(exact)
    assert topk.top_k(table.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [3e15]), (1, [3e15]), (2, [-1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(few).orderBy("rank").collect()] == [(0, 1, 1, (1 << 63) - 1), (0, 2, 2, max(-(1 << 63), int(3e15 * 1024) * -1024))]


# 10


def brute_scan(text, rules):
    w = words(text)
    norm = "".join(f" {x} " for x in w)
    found = [(norm[: m.start()].count(" ") // 2, norm[: m.end()].count(" ") // 2, r.priority, i) for i, r in enumerate(rules) for m in re.finditer(r.pattern, norm)]
    order = lambda x: (x[0], -x[1], -x[2], x[3])
    kept = [a for a in found if a[2] == 4 or not any(b[2] != 4 and b[2] >= a[2] and b[0] <= a[0] and b[1] >= a[1] and order(b) < order(a) for b in found)]
    places = [(i, label) for phrase, label in license_rules.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return (len(w), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted({rules[k[3]].label for k in kept})), max((rules[k[3]].confidence for k in kept), default=0.0), len(kept))


def test_licenses(spark):
    rules = license_rules.rules()
    assert len(rules) > 500 and all(re.compile(r.pattern) for r in rules)
    texts = [None, "", "MIT License", "the mit license mit license", "Licensed under the Apache License, Version 2.0.", "GNU General Public License v3 or later", "GNU Lesser General Public License version 2.1", "SPDX-License-Identifier: BSD-3-Clause", "licensed under CC BY-NC 4.0.", "Creative Commons Attribution 4.0 International License", "mit\nlicense apache  license general public license", "mit licenses", "submit license", "Copyright (c) 2024 x. All rights reserved. Permission is hereby granted, free of charge, to any person obtaining a copy", "no words here", "license " * 3000, "Released under the terms of the Mozilla Public License 2.0 and the ISC license", "apache license é"]
    rows = [*enumerate(texts), (4, texts[4])]
    got = licenses.license_scan(documents(spark, rows)).collect()
    assert sorted((r.doc_id, *tuple(r)[1:]) for r in got) == sorted((i, *brute_scan(t, rules)) for i, t in rows)
    labels = {r.doc_id: r.labels for r in got}
    assert "apache-2.0" in labels[4] and "cc-by-nc-4.0" in labels[8] and labels[7] == "bsd-3-clause" and labels[12] == ""
    assert licenses.license_scan(documents(spark, [])).count() == 0
