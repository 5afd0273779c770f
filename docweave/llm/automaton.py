"""Levenshtein automata intersected with a lexicon trie, as one deterministic table.

A state is a set of (trie node, edits so far); reading a character matches,
substitutes or inserts, and skipping a child deletes. Sets are made deterministic
once, so all words of a chunk walk the table together, one character a step, and
nearly all leave it within a few steps.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np

#: Character classes: 0 is no part of a word, 1 any other letter or digit.
BOUNDARY, OTHER = 0, 1
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}


@dataclass
class Automaton:
    classes: np.ndarray  # class of each code point
    step: np.ndarray  # [state, class] -> state; state 0 is dead, 1 the start
    term: np.ndarray  # term accepted when a word ends in a state, or -1
    edits: np.ndarray  # edits of that term
    stem: np.ndarray  # term accepted as soon as a state is reached, or -1
    terms: list[str]
    longest: int


#: Letters of the longest term that may be misspelled; longer ones match as they stand.
LONGEST_MISSPELLED = 64


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 or len(term) > LONGEST_MISSPELLED else 1 if len(term) < 10 else 2


def _classes(terms: list[str]) -> tuple[np.ndarray, dict[str, int]]:
    letters = sorted({c for t in terms for c in t})
    classes = np.zeros(sys.maxunicode + 1, dtype=np.min_scalar_type(OTHER + len(letters)))
    classes[0x10000:0xE0000] = OTHER
    classes[[c for c in range(0x10000) if chr(c).isalnum()]] = OTHER
    known = {c: OTHER + 1 + i for i, c in enumerate(letters)}
    for c, k in known.items():
        classes[ord(c)] = k
        if len(c.upper()) == 1:
            classes[ord(c.upper())] = k
    for digit, letter in LOOKALIKES.items():
        if digit not in known:
            classes[ord(digit)] = known.get(letter, OTHER)
    return classes, known


def build(terms: list[str], stems: list[str]) -> Automaton:
    """The automaton of ``terms`` (whole words, within their allowed edits) and
    ``stems`` (exact beginnings of words)."""
    names = [*terms, *(f"{s}*" for s in stems)]
    classes, known = _classes([*terms, *stems])
    children: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    stem_at: dict[int, int] = {}
    reach = [0]
    for i, word in enumerate([*terms, *stems]):
        edits = allowed_edits(word) if i < len(terms) else 0
        node = 0
        reach[0] = max(reach[0], edits)
        for c in word:
            node = children[node].setdefault(known[c], len(children))
            if node == len(children):
                children.append({})
                ends.append(-1)
                reach.append(0)
            reach[node] = max(reach[node], edits)
        if i < len(terms):
            ends[node] = i
        else:
            stem_at[node] = i
    limit = [allowed_edits(terms[k]) if k >= 0 else -1 for k in ends]

    def closed(found: dict[int, int]) -> frozenset:
        todo = list(found.items())
        while todo:
            node, e = todo.pop()
            if found[node] < e:
                continue
            for child in children[node].values():
                if e + 1 <= reach[child] and found.get(child, 9) > e + 1:
                    found[child] = e + 1
                    todo.append((child, e + 1))
        return frozenset(found.items())

    dead, start = frozenset(), closed({0: 0})
    ids = {dead: 0, start: 1}
    order = [dead, start]
    width = OTHER + 1 + len(known)
    rows = [np.zeros(width, dtype=np.int32)]
    at = 1
    while at < len(order):
        state = order[at]
        inserted: dict[int, int] = {}
        for node, e in state:
            if e + 1 <= reach[node]:
                inserted[node] = min(inserted.get(node, 9), e + 1)
            for child in children[node].values():
                if e + 1 <= reach[child] and inserted.get(child, 9) > e + 1:
                    inserted[child] = e + 1
        exact: dict[int, dict[int, int]] = {}
        for node, e in state:
            for c, child in children[node].items():
                here = exact.setdefault(c, {})
                here[child] = min(here.get(child, 9), e)

        def number(found: dict[int, int]) -> int:
            key = closed(found)
            if key not in ids:
                ids[key] = len(order)
                order.append(key)
            return ids[key]

        row = np.full(width, number(dict(inserted)), dtype=np.int32)
        row[BOUNDARY] = 0
        for c, here in exact.items():
            row[c] = number(inserted | {n: min(e, inserted.get(n, 9)) for n, e in here.items()})
        rows.append(row)
        at += 1
    term, edits, stem = (np.full(len(order), -1, dtype=np.int32) for _ in range(3))
    for k, state in enumerate(order):
        best = min(((e, ends[n]) for n, e in state if ends[n] >= 0 and e <= limit[n]), default=None)
        if best:
            edits[k], term[k] = best
        stem[k] = max((stem_at[n] for n, e in state if e == 0 and n in stem_at), default=-1)
    return Automaton(classes, np.stack(rows), term, edits, stem, names, max(map(len, names), default=0) + 2)


def match(a: Automaton, kinds: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, term, edits) of the words that the automaton accepts; ``kinds`` are
    the character classes of the text."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    word = np.arange(len(starts))
    state = np.ones(len(starts), dtype=np.int32)
    for j in range(a.longest + 1):
        over = lengths[word] == j
        if over.any():
            hit = over & (a.term[state] >= 0)
            found.append((word[hit], a.term[state[hit]], a.edits[state[hit]]))
            word, state = word[~over], state[~over]
        if not len(word):
            break
        state = a.step[state, kinds[starts[word] + j]]
        stem = a.stem[state]
        sure = stem >= 0
        if sure.any():
            found.append((word[sure], stem[sure], np.zeros(sure.sum(), np.int32)))
        live = (state > 0) & ~sure
        word, state = word[live], state[live]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    words, terms, edits = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(words, kind="stable")
    return words[order], terms[order], edits[order]
