"""Names in sentences written by hand, which share no frame with the tables; the lists that names are learned from have many of their parts."""

from __future__ import annotations

import re

from gridloom.llm import pii

from plain_sentences import NOBODY, SENTENCES


def _marked(line: str) -> tuple[str, set[tuple[int, int]]]:
    text, names = "", set()
    for piece in re.split(r"(\[[^\]]*\])", line):
        if piece.startswith("["):
            names.add((len(text), len(text) + len(piece) - 2))
            piece = piece[1:-1]
        text += piece
    return text, names


def test_names_in_plain_sentences():
    wanted = found = wrong = 0
    for line in SENTENCES:
        text, names = _marked(line)
        got = {(a, b) for kind, a, b in pii.spans([text])[0] if kind == "name"}
        wanted, found, wrong = wanted + len(names), found + len(names & got), wrong + len(got - names)
    assert found >= 0.75 * wanted and wrong <= 0.05 * wanted, (wanted, found, wrong)


def test_places_are_no_names():
    assert sum(bool(x) for x in pii.spans(NOBODY)) <= 2


def test_nothing_without_candidate_is_read():
    assert pii.candidates("no person lives in this sentence.", frozenset()) == ([], [])
    assert pii.spans(["", None, "no person lives here."]) == [[], [], []]
