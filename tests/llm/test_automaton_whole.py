"""Lexicons of many scripts: every letter has a class of its own."""

import numpy as np

from docweave.llm import automaton


def test_lexicon_of_more_than_250_letters():
    letters = [chr(0x4E00 + i) for i in range(600)] + [chr(0xAC00 + i) for i in range(300)] + [chr(0x20000 + i) for i in range(20)]
    terms = ["".join(letters[i : i + 2]) for i in range(0, 400, 2)] + ["".join(letters[i : i + 6]) for i in range(400, 880, 6)]
    stems = ["".join(letters[i : i + 4]) for i in range(880, 920, 4)]
    a = automaton.build(terms, stems)
    said = [*terms, *(s + "x" for s in stems), terms[-1][:5] + "x", terms[0][0] + "x"]
    points = np.array([ord(c) for w in said for c in w])
    lengths = np.array([len(w) for w in said])
    word, term, edits = automaton.match(a, a.classes[points], np.cumsum(lengths) - lengths, lengths)
    n = len(terms) + len(stems)
    assert word.tolist() == list(range(n + 1))
    assert term.tolist() == [*range(n), len(terms) - 1]
    assert edits.tolist() == [0] * n + [1]
