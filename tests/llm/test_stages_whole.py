"""Ids that the pipeline's stages keep, against brute force on each stage's own input."""

import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from docweave.llm import toxicity
from docweave.llm.mixing import mix
from tests.llm.test_hard_cases import plain_toxicity
from tests.llm.test_operators import brute_components, brute_contamination, brute_targets

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def kept(spark, docs, name):
    return Counter(r.doc_id for r in dict(corpus_pipeline.STAGES)[name](spark, docs, DATA).collect())


def test_near_dedup_keeps_the_first_of_each_group(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5)
    want = Counter(i for i, _, _, first in found if first)
    assert 0 < len(want) < len(found) and kept(spark, docs, "near_dedup") == want


def test_decontamination_keeps_all_clean_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = brute_contamination([(r.doc_id, r.text) for r in docs.collect()], items)
    want = Counter(r[0] for r in found if not r[-1])
    assert 0 < len(want) < len(found) and kept(spark, docs, "decontamination") == want


def test_toxicity_keeps_what_a_plain_version_passes(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    names = model.automaton.terms
    terms, stems = [t for t in names if t[-1] != "*"], [t[:-1] for t in names if t[-1] == "*"]
    some = docs.join(labels.where("toxic is not null").select("doc_id").limit(60), "doc_id").where("length(text) < 800")
    want = Counter()
    for r in some.collect():
        want[r.doc_id] += plain_toxicity(model, terms, stems, r.text) < 0.7
    kept_ids = Counter(r.doc_id for r in toxicity.clean(some, model).collect())
    assert kept_ids == +want and kept_ids
    # the stage itself: all rows that score below the threshold, and no other
    scored = Counter(r.doc_id for r in toxicity.score(docs.select("doc_id", "text"), model).where("score < 0.7").collect())
    assert kept(spark, docs, "toxicity") == scored


def test_mixing_takes_each_document_as_the_plan_says(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = [(r.doc_id, size(r.text), r.source) for r in docs.collect()]
    sizes = Counter()
    for _, n, s in rows:
        sizes[s] += n
    copies, taken = kept(spark, docs, "mixing"), Counter()
    for i, n, s in rows:
        assert copies[i] <= 2
        taken[s] += n * copies[i]
    for s, target in brute_targets(dict(sizes)).items():
        gap = target - taken[s]  # no single document, once more or once less, would make it smaller
        assert all(n == 0 or n >= 2 * abs(gap) for i, n, x in rows if x == s and (copies[i] < 2 if gap > 0 else copies[i] > 0)) or abs(gap) < 1
    planned = {r.doc_id: r.copies for r in mix(docs).collect()}
    assert copies == +Counter(planned)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in all columns, blanks, repeats, ties and clashing names; empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, n_exact string, n string, id string, size string, copies string, shard string, slot string, n_hit string, kept string, salt string"
    passage = " ".join(f"p{i}" for i in range(30))
    texts = {1: "plain words stand here and say little", 2: "plain words stand here and say little", 3: None, 4: "", 5: " \t", 6: passage, 7: "you idiot moron scum loser", 8: "x " * 30_000, None: "no id stands here at all", 9: "UPPER lower"}
    odd = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None, *["c"] * 11) for k, (i, t) in enumerate(texts.items())]
    odd += [odd[0], odd[8], (None, None, None, None, None, *[None] * 11)]
    docs = spark.createDataFrame(odd, schema)
    spark.createDataFrame([(1, 0), (7, 1), (99, 1), (None, 1), (2, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage), (None, "x"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    every = Counter(r[0] for r in odd)
    gone = {"toxicity": Counter({7: 1}), "near_dedup": Counter({2: 1, 1: 1}), "decontamination": Counter({6: 1})}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = Counter(r.doc_id for r in out.collect())
        if name in gone:
            assert out.columns == docs.columns and got == every - gone[name], name
            assert {r.score for r in out.collect()} == {"c", None}
        elif name == "mixing":
            assert out.columns == docs.columns and set(got) <= set(every) and all(got[i] <= 2 * every[i] for i in got)
        else:
            assert got == every and {r.score for r in out.collect()} == {"c", None}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
