"""Long texts, large groups, many matches and odd values, against plain versions."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.llm import license_rules, licenses, mixing, near_dups, quality, shards, tokens, topk, toxicity
from docweave.llm._shared import Tables
from tests.llm.test_licenses_whole import brute as brute_labels
from tests.llm.test_operators import brute_components, brute_jump, distance, documents, prose


def edited(draw, base, edits):
    out = list(base)
    for _ in range(edits):
        at = draw.randrange(len(out))
        kind = draw.randrange(3)
        if kind == 0:
            out[at] = f"x{draw.randrange(10**6)}"
        elif kind == 1 and len(out) > 4:
            del out[at]
        else:
            out.insert(at, f"y{draw.randrange(10**6)}")
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_large_group_of_near_copies(spark, size):
    """Copies at all distances from one text, some of which are copies of each other
    and no longer of the text, beside a text that shares half with all of them."""
    draw = random.Random(size)
    base = prose(draw, 120, 10**5).split()
    rows = [(i, " ".join(edited(draw, base, draw.randint(0, 14)))) for i in range(260)]
    for k in range(20):
        far = edited(draw, base, 16)
        rows += [(1000 + 10 * k + j, " ".join(edited(draw, far, 2))) for j in range(3)]
    half = base[:60] + prose(draw, 60, 10**5).split()
    rows += [(2000 + i, " ".join(edited(draw, half, draw.randint(0, 14)))) for i in range(120)]
    got = near_dups.near_duplicates(documents(spark, rows), shingle=size).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, size)


def test_near_copies_of_very_long_texts(spark):
    words = np.char.add("w", np.random.default_rng(3).integers(0, 10**9, 260_000).astype(str))
    rows = []
    for i in range(5):  # three quarters are shared
        own = words.copy()
        own[i * 26_000 : i * 26_000 + 36_000] = [f"z{i}_{k}" for k in range(36_000)]
        rows.append((i, " ".join(own)))
    rows.append((9, rows[2][1] + " tail"))
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(documents(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 9: 2}


def test_components_of_a_given_threshold(spark):
    draw = random.Random(9)
    base = prose(draw, 50, 10**5).split()
    rows = [(i, " ".join(edited(draw, base, draw.randint(0, 20)))) for i in range(80)]
    for percent in (50, 100):
        got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(documents(spark, rows), shingle=1, percent=percent).collect()}
        sets = {i: set(t.split()) for i, t in rows}
        linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
        want = {i: i for i in sets}
        for _ in sets:
            want = {i: min(want[j] for j in sets if linked(i, j)) for i in sets}
        assert got == want


def test_top_k_of_the_largest_numbers(spark):
    rows = [(0, [1e306, 1.0]), (1, [1e306, 0.0]), (2, [-1e306, 0.0]), (3, [0.0, 2.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, (1 << 63) - 1), (0, 2, 3, 1024 * 2048), (0, 3, 2, -(1 << 63))]


def test_many_license_matches_in_a_text(spark):
    rules = license_rules.rules()
    text = "mit license " * 100_000
    licenses.license_scan(documents(spark, [(0, "mit license")])).collect()
    began = time.time()
    r = licenses.license_scan(documents(spark, [(1, text)])).first()
    assert (r.n_base, r.first_word, r.last_word, r.labels) == (100_000, 0, 199_998, "mit") and time.time() - began < 60
    draw = random.Random(5)
    parts = ["mit license", "licensed under the", "apache license", "version 2.0", "gnu", "general public license", "v3", "cc by-sa 4.0", "all rights reserved", "spdx-license-identifier:", "bsd 3 clause", "license", "x"]
    rows = [(i, " ".join(draw.choice(parts) for _ in range(draw.choice([3, 30, 300])))) for i in range(40)]
    got = {r.doc_id: (r.labels, r.score, r.n_found) for r in licenses.license_scan(documents(spark, rows)).collect()}
    assert got == {i: brute_labels(t, rules) for i, t in rows}


def test_jumps_among_many_shards(spark):
    keys = [random.Random(1).getrandbits(63) - (1 << 62) for _ in range(300)]
    for n in (1, 2, 3, 24, 1000, 20_000):
        rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", shards.jump_hash(F.col("k"), n).alias("s")).collect()
        assert all(r.s == brute_jump(r.k, n) for r in rows)


def test_slots_of_one_key_in_all_rows(spark):
    got = shards.assign_shards(documents(spark, [(None, f"t{i % 50}") for i in range(400)]), 24).collect()
    assert len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == list(range(400))


def test_long_words_count_like_short_ones(spark):
    pieces = [("<unk>", 0.0), ("▁", -2.0), ("a", -3.0), ("b", -3.0), ("ab", -4.0), ("bab", -4.5)]
    text = "ab" * 40_000
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(documents(spark, [(1, text), (2, "ab" * 40), (3, None)]), pieces).collect()}
    want = len(one_by_one(pieces, "▁" + "ab" * 40))
    assert got[2] == want and got[3] == 0 and abs(got[1] - 1000 * want) <= 1000


def one_by_one(pieces, text):
    score = dict(pieces)
    best = [(0.0, [])] + [(-math.inf, [])] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 3), e):
            if text[s:e] in score and best[s][0] + score[text[s:e]] > best[e][0]:
                best[e] = (best[s][0] + score[text[s:e]], best[s][1] + [text[s:e]])
    return best[-1][1]


# plain versions of the models' scores


def plain_passages(text):
    found = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    groups = [found[i : i + 64] for i in range(0, len(found), 64)] or [[]]
    if len(groups) > 1 and len(groups[-1]) < 64:
        groups[-2:] = [groups[-2] + groups[-1]]
    out = []
    for g in groups:
        w = [text[a:b].encode() for a, b in g]
        size, n = max(1, sum(map(len, w))), max(1, len(w))
        share = lambda test: sum(sum(map(test, x)) for x in w) / size
        symbol = lambda c: 0x21 <= c < 0x7F and not chr(c).isalnum() and chr(c) not in ".,;:?'\"-()"
        lower = [x.lower() for x in w]
        out.append([
            share(lambda c: 0x41 <= c < 0x5B), share(lambda c: 0x41 <= c < 0x5B or 0x61 <= c < 0x7B or c >= 0xC0), share(lambda c: 0x30 <= c < 0x3A), share(symbol), share(lambda c: c in b".?!"),
            sum(a > 0 and text[a - 1] == "\n" for a, _ in g) / n, share(lambda c: c >= 0x80), size / n / 10,
            sum(a == b for a, b in zip(lower, lower[1:])) / n, (len(lower) - len(set(lower))) / n, sum(symbol(x[-1]) for x in w) / n, math.log1p(len(w)) / 5,
        ])
    return np.array(out)


def plain_score(model, text):
    x = (plain_passages(text or "") - model.mean) / model.scale
    h = np.tanh(x @ model.p["w"] + model.p["b"])
    e = np.exp((np.tanh(h @ model.p["v"]) / (1 + np.exp(-h @ model.p["u"]))) @ model.p["a"])
    return float(1 / (1 + np.exp(-((e / e.sum() * h).sum(axis=0) @ model.p["c"] + model.p["d"])))[0])


TEXTS = ["hello world", "abc\n", "abc", None, "", "\nfirst of all. " + "word " * 200, "A B c! %% %% é\nü", "x " * 63, "y y " * 64, "z"]


def test_quality_scores_equal_a_plain_version(spark):
    model = quality.Model(np.linspace(0, 1, quality.FEATURES), np.linspace(0.5, 2, quality.FEATURES))
    got = {r.doc_id: r.score for r in quality.score(documents(spark, list(enumerate(TEXTS))), model).collect()}
    assert all(math.isclose(got[i], plain_score(model, t), rel_tol=1e-9) for i, t in enumerate(TEXTS))


def test_quality_of_a_text_does_not_depend_on_its_neighbours():
    model = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    alone = lambda t: model.forward(*next(quality.Encoder().bags(pa.array([t], pa.string()))))["y"][0]
    for _ in range(20):
        order = random.Random(_).sample(TEXTS, len(TEXTS))
        together = model.forward(*next(quality.Encoder().bags(pa.array(order, pa.string()))))["y"]
        assert np.allclose(together, [alone(t) for t in order], rtol=1e-12)


def test_quality_fits_on_a_bounded_number_of_passages(spark, monkeypatch):
    monkeypatch.setattr(quality, "PASSAGES", 300)
    docs = documents(spark, [(i % 40, ("Fine words here. " if i % 2 else "@@ %% ## ") * 30) for i in range(400)] + [(50, "w " * 50_000)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(50, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality.Model, "train", lambda self, x, first, y: seen.append(len(x)) or self)
    quality.fit(docs, labels)
    assert 0 < seen[0] <= 300


def test_quality_fit_survives_repeated_rows_and_long_texts(spark, monkeypatch):
    """A labelled row that stands 5,000 times counts once, wherever its bucket lies, and a
    text longer than the bound is thinned, not left out."""
    monkeypatch.setattr(quality, "PASSAGES", 400)
    few = [(i, ("Fine words here again. " if i % 2 else "@@ %% ## ") * (3 + i)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(77, 1), (78, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality.Model, "train", lambda self, x, first, y: seen.append((len(x), np.diff(first).tolist(), y.tolist())) or self)
    for turn in range(6):
        docs = documents(spark, few + [(77, f"hot text {turn}")] * 5000 + [(78, "long one " * 40_000)])
        assert not isinstance(quality.fit(docs, labels), float)
    for n, bags, y in seen:
        # held-out ids are no part; the long text gives PASSAGES // 100 passages
        assert 0 < n <= 400 and max(bags) <= 4 and len(bags) > 20 and {0.0, 1.0} == set(y)


@pytest.mark.parametrize("term", ["xq", "坏蛋", "k", "z" * 45, "q" * 300, "abc", "vwxyz"])
def test_toxic_terms_of_any_length_are_learned(spark, term):
    draw = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 2
        words_ = [f"w{draw.randrange(300):03d}" for _ in range(12)] + [term] * toxic
        draw.shuffle(words_)
        rows.append((i, " ".join(words_)))
        labels.append((i, toxic))
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, marks).where("held_out").collect()
    assert all(r.predicted == r.doc_id % 2 for r in got) and len(got) > 100


def plain_hits(a, terms, stems, text, benign):
    """(edits, quoted, whole) of each hit by edit distances alone, and the words."""
    fold = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
    letters = {c for t in [*terms, *stems] for c in t}
    same = lambda w: "".join(fold.get(c, c) if c not in letters else c for c in w.lower())
    found = list(re.finditer(r"[^\W_]+", text))
    out = []
    for i, m in enumerate(found):
        w = same(m[0])
        exact = any(w.startswith(s) for s in stems)
        best = 0 if exact else min((distance(w, t) for t in terms if distance(w, t) <= (0 if len(t) < 5 else 1 if len(t) < 10 else 2)), default=None)
        if best is None or best and m[0].lower() in benign:
            continue
        marked = m.start() and m.end() < len(text) and text[m.start() - 1] in toxicity.QUOTES and text[m.end()] in toxicity.QUOTES
        near = [x[0].lower() for x in found[max(0, i - toxicity.WINDOW) : i + toxicity.WINDOW + 1]]
        out.append((best, bool(marked or any(x in toxicity.CUES for x in near)), not exact))
    return out, len(found)


def plain_toxicity(model, terms, stems, text):
    hits, words = plain_hits(model, terms, stems, text or "", model.benign)
    n = Counter((bool(e), q) for e, q, _ in hits)
    whole = sum(w for e, q, w in hits if not e and not q)
    x = [1, n[False, False] > 0, math.log1p(n[False, False]), n[False, True] > 0, math.log1p(n[False, True]), math.log1p(n[True, False]), math.log1p(n[True, True]), math.log1p(whole), math.log1p(100 * n[False, False] / words if hits else 0)]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(x, model.weights))))))


def test_toxicity_scores_equal_a_plain_version(spark):
    draw = random.Random(4)
    terms, stems, benign = ["moron", "disgusting", "scum"], ["fluch"], frozenset(["moran"])
    model = toxicity.Model(toxicity.build(terms, stems), benign, np.array([-2.0, 1.0, 0.7, 0.3, 0.2, 0.4, 0.1, 0.6, 0.5]))
    parts = ["moron", "Moron", "m0ron", "moran", "morn", "disgustng", "disgstng", "scum", "scun", "fluchwort", "flucht", '"moron"', "said", "the word", *(f"w{i}" for i in range(20)), "é", "."]
    texts = [" ".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(300)] + [None, "", "moron"]
    got = {r.doc_id: r for r in toxicity.score(documents(spark, list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        assert math.isclose(got[i].score, plain_toxicity(model, terms, stems, t), rel_tol=1e-9), t
    kept = toxicity.clean(documents(spark, list(enumerate(texts))), model)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i].score < 0.7)
    assert {r.score for r in kept.collect()} == {"c"} and kept.columns == documents(spark, []).columns


def test_tilts_equal_bisection(spark):
    """Each source's tilt solves its constraint; copies follow the rates to one a class."""
    draw = random.Random(6)
    rows = [(i, " ".join(["w"] * draw.randint(1, 60)), draw.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    got = mixing.mix(documents(spark, rows)).collect()
    by = defaultdict(list)
    source = {i: s for i, _, s in rows}
    for r in got:
        by[source[r.doc_id]].append(r)
    for s, mine in by.items():
        target, total = mine[0].target, sum(r.size for r in mine)
        mean = total / len(mine)
        if target >= 2 * total - 1e-6:
            assert all(r.copies == 2 for r in mine)
            continue
        lo, hi = -60.0, 60.0
        rate = lambda t, x: min(2.0, 1.5 * math.exp(t * x / mean))
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if sum(r.size * rate(mid, r.size) for r in mine) > target else (mid, hi)
        sizes = sorted({r.size for r in mine}, reverse=True)
        reached, want = 0.0, {}
        for z in sizes:
            n = sum(r.size == z for r in mine)
            want[z] = math.floor(reached + n * rate(lo, z) + 0.5) - math.floor(reached + 0.5)
            reached += n * rate(lo, z)
        off = sum(abs(sum(r.copies for r in mine if r.size == z) - want[z]) for z in sizes)
        assert off <= 8, (s, off)  # rounding of the totals, and single documents that make it up
        for z in sizes:
            each = {r.copies for r in mine if r.size == z}
            assert max(each) - min(each) <= 1


def test_one_document_that_outweighs_its_source(spark):
    classes = spark.createDataFrame([("a", 1, 10), ("a", 10**9, 1)], "source string, size long, n long")
    goals = spark.createDataFrame([("a", 10**9 + 10, 7e8)], "source string, source_size long, target double")
    r = mixing.tilts(classes, goals, Tables(spark, "test"), 1.5, 2).first()
    taken = sum(n * z * min(2.0, 1.5 * math.exp(max(-60.0, min(60.0, r.tilt * z / r.mean)))) for z, n in ((1, 10), (10**9, 1)))
    assert math.isclose(taken, 7e8, rel_tol=1e-6)
