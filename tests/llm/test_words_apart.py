"""Words that a hash linear in its bytes cannot tell apart: a Thue-Morse word of two
letters and its complement. op1, op3 and op5 give what brute force gives."""

import numpy as np
import pyarrow as pa
import pytest

from docweave.llm import _text, near_dups, tokens
from docweave.llm.decontaminate import contamination
from docweave.llm.queries import VOCABULARY
from tests.llm.test_operators import brute_contamination, by_text, documents


def pair(n):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


SIZES = (8, 64, 1024, 4096)


@pytest.mark.parametrize("n", SIZES)
def test_hashes_differ(n):
    one, other = pair(n)
    data = np.frombuffer(f"{one} {other} {one}".encode(), dtype=np.uint8)
    starts, ends, _ = _text.find_words(data, np.array([0, len(data)]), _text.word_table("alnum"))
    words = _text.read_words(data, starts, ends)
    assert words.hashes[0] == words.hashes[2] != words.hashes[1]
    assert _text.same_words(words, np.array([0, 0]), words, np.array([1, 2])).tolist() == [False, True]


def test_equal_hashes_are_told_apart():
    """Even where all hashes are one."""
    texts = ["a", "b", "a", "longer than eight", "longer than eighu", "b", "longer than eight", "a\0", "a" * 8, "a" * 9]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    words = _text.read_words(data, ends - [len(t) for t in texts], ends)
    words.hashes[:] = 7
    one, number = _text.told_apart(words)
    assert [texts[i] for i in one[number]] == texts and len(one) == len(set(texts))


@pytest.mark.parametrize("alike", [False, True])
def test_contamination(spark, alike, monkeypatch):
    if alike:  # every word of one size has one hash: only the bytes decide
        from docweave.llm import decontaminate as d

        def poor(data, starts, ends):
            words = _text.read_words(data, starts, ends)
            return _text.Words((words.sizes + 5).astype(np.uint64), words.sizes, words.first, words.blocks)

        monkeypatch.setattr(d, "read_words", poor)
    items = [(i, w) for i, w in enumerate(p for n in SIZES for p in pair(n)[:1])] + [(50, " ".join(f"w{k:02d}" for k in range(14))), (51, " ".join(f"v{k:02d}" for k in range(14)))]
    docs = [(i, w) for i, w in enumerate(p for n in SIZES for p in pair(n))] + [(90, "x " + items[-1][1].upper()), (91, " ".join(f"u{k:02d}" for k in range(14))), (92, pair(1024)[1] + " " + pair(1024)[0])]
    got = contamination(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_text(tuple(r) for r in got.collect()) == by_text(brute_contamination(docs, items))


def test_counts_depend_on_the_text_alone():
    counter = tokens.Counter(tokens.compile_vocabulary(tokens.load_pieces(VOCABULARY)))
    for n in SIZES:
        texts = [*pair(n), f"x {pair(n)[0]} {pair(n)[1]}"]
        alone = [int(counter.counts(pa.array([t]))[0]) for t in texts]
        assert counter.counts(pa.array(texts)).tolist() == alone


def test_no_link_between_them(spark):
    rows = [(2 * k + i, w) for k, n in enumerate(SIZES) for i, w in enumerate(pair(n))]
    got = near_dups.near_duplicates(documents(spark, rows), shingle=2).collect()
    assert all(r.component_id == r.doc_id and r.kept and r.n_shingles == 1 for r in got) and len(got) == len(rows)
