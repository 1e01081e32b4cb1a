"""Trains the tagger of pii.py from labelled spans and stores its weights beside this module.

    python -m gridloom.llm.pii_training TABLES_DIR [EPOCHS [OUT [MODEL_TO_GO_ON_FROM]]]

Labelled spans come from two places. Texts of pii_frames are made and know their spans. A bounded sample of documents (SAMPLE_DOCS)
is labelled by the forms of pii_rules, by the lexicon and by formats in which only a name stands; its windows are learned from
a second time with other names in place of theirs, a part of these in one letter case. So the tagger learns a name's
surroundings and sound rather than a list.
"""

from __future__ import annotations

import os
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import regex as re

from . import pii_frames
from .crf_tagger import KINDS, WINDOW, Tagger, encode, fold_text, spans_of
from .pii_rules import JOINING, NAME, TITLES, Lexicon, forms, split_name

#: At most so many documents are labelled and learned from, and so many texts are made.
SAMPLE_DOCS, MADE_TEXTS = 4500, 36_000
MODEL = Path(__file__).with_name("pii_model.npz")
#: Formats in which only a person's name stands: behind the dashes of a mail's signature, in a field called name, and before an address in angle brackets.
SURE = re.compile(r"(?m)^-- ?\n(\p{L}[^\d\n@]{1,30}(?:\s[^\d\n@:]{2,20})?)\n|\bname=([^|\n]{4,50}?)[ ]+\||\"([^\"\n@]{4,50})\"[ ]+<")


def load_lexicon(rows) -> Lexicon:
    """rows: (name_part, role)."""
    given, family = set(), set()
    for part, role in rows:
        if part:
            (given if role == "given" else family).add(fold_text(part).lower())
    return Lexicon(given, family)


def label_names(text: str, lex: Lexicon, taken: np.ndarray) -> list[tuple[int, int]]:
    """Spans of two parts that are known, or sound like known ones (the lexicon is incomplete), or of an initial and a known family part."""
    out, at = [], 0
    for m in SURE.finditer(text):
        lo, hi = m.span(m.lastindex)
        if split_name(text[lo:hi]) and not taken[lo:hi].any():
            out.append((lo, hi))
            taken = taken.copy()
            taken[lo:hi] = 1
    while m := NAME.search(text, at):
        start, end = m.span()
        parts, found = split_name(text[start:end]), False
        if parts and parts[0].lower().rstrip(".") not in TITLES | JOINING:
            g, f = lex.role(parts[0]), lex.role(parts[1])
            initial = len(parts[0]) == 2 and parts[0][1] == "."
            upper = parts[0][:1].isupper() == parts[1][:1].isupper()
            known_g, known_f = g in ("g", "b"), f in ("f", "b")
            found = (known_f and (known_g or (initial and upper))) or (upper and not initial and (known_f and _sounds(parts[0]) or known_g and _sounds(parts[1]) or parts[0][:1].isupper() and _sounds(parts[0]) and _sounds(parts[1])))
        if found and not taken[start:end].any():
            out.append((start, end))
            at = end
        else:
            nxt = re.compile(r"[\s,]+").search(text, start)
            at = max(start + 1, nxt.end() if nxt and nxt.end() <= end else end)
    return out


def _sounds(part: str) -> bool:
    word = part.split()[-1].lower()
    return len(word) >= 4 and word not in _ORDINARY and re.fullmatch(r"[\p{L}'’-]+", word) is not None and bool(_SHAPE.search(word))


#: Endings of the lexicon's parts, and words that the sample writes in small letters as well; filled by the functions below.
_SHAPE = re.compile(r"(?!)")
_ORDINARY: set[str] = set()


def learn_ordinary(texts: list[str], least: int = 3) -> None:
    """Words that the texts write in small letters at least half as often as with a capital: they are no names where they stand in capitals."""
    small: Counter = Counter()
    tall: Counter = Counter()
    for t in map(fold_text, texts):
        small.update(re.findall(r"(?<![\p{L}@.])\p{Ll}{4,}(?![\p{L}@])", t))
        tall.update(w.lower() for w in re.findall(r"(?<![\p{L}@.])\p{Lu}\p{L}{3,}(?![\p{L}@])", t))
    _ORDINARY.clear()
    _ORDINARY.update(w for w, n in small.items() if n >= max(least, tall[w] / 2))


def learn_endings(lex: Lexicon) -> None:
    """Endings of three letters that at least three lexicon parts share."""
    global _SHAPE
    seen = Counter(w[-3:] for w in lex.given | lex.family if len(w) > 4)
    ends = sorted(e for e, n in seen.items() if n >= 3)
    _SHAPE = re.compile("(?:" + "|".join(map(re.escape, ends)) + ")$") if ends else re.compile(r"(?!)")


def label(text: str, lex: Lexicon) -> np.ndarray:
    """Tags of a folded text."""
    tags = np.zeros(len(text), np.int8)
    exact = forms(text)
    for k, kind in enumerate(KINDS):
        spans = label_names(text, lex, tags) if kind == "name" else [(a, b) for j, a, b in exact if j == k]
        for s, e in spans:
            if not tags[s:e].any():
                tags[s:e] = 2 + 2 * k
                tags[s] = 1 + 2 * k
    return tags


def renamed(text: str, tags: np.ndarray, g: np.random.Generator, lex_parts: list[str]) -> tuple[str, np.ndarray]:
    """The text with each labelled name's longer words replaced by invented ones of mixed beginnings and endings."""
    out, out_tags, at = [], [], 0
    for kind, s, e in spans_of(tags):
        if KINDS[kind] != "name":
            continue
        out.append(text[at:s])
        out_tags.append(tags[at:s])

        def swap(m):
            w = m.group(0)
            if len(w) < 4 or g.random() < 0.4:
                return w
            new = pii_frames.mixed(lex_parts, g)
            return new.upper() if w.isupper() else new.lower() if w.islower() else new

        # one in three becomes another name as a whole, the others change their longer words
        new = pii_frames.person(g) if g.random() < 0.33 else re.sub(r"\p{L}{2,}", swap, text[s:e])
        t = np.full(len(new), 2 + 2 * kind, np.int8)
        t[0] = 1 + 2 * kind
        out.append(new)
        out_tags.append(t)
        at = e
    out.append(text[at:])
    out_tags.append(tags[at:])
    return "".join(out), np.concatenate(out_tags)


def cut(folded: str, tags: np.ndarray, g: np.random.Generator, spare: float, xs: list, ys: list) -> None:
    """Windows of a text; those without a span are left out with the chance `spare`."""
    ids = encode(folded)
    step = WINDOW * 3 // 4
    first = int(g.integers(0, step))
    for at in range(-first, max(1, len(ids)), step):
        lo = max(0, at)
        x, y = ids[lo : at + WINDOW], tags[lo : at + WINDOW]
        if len(x) < 12 or (not y.any() and g.random() < spare):
            continue
        # padding stands for what lies outside
        px, py = np.full(WINDOW, -1, np.int16), np.zeros(WINDOW, np.int8)
        px[lo - at : lo - at + len(x)], py[lo - at : lo - at + len(x)] = x, y
        xs.append(px)
        ys.append(py)


def windows_of(labelled: list[tuple[str, np.ndarray]], parts: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Training windows of labelled texts, with those that hold a name once more under other names, and of made texts."""
    g = np.random.default_rng(seed)
    xs, ys = [], []
    for folded, tags in labelled:
        cut(folded, tags, g, 0.75, xs, ys)
        if (tags >= 2 * KINDS.index("name") + 1).any():
            folded, tags = renamed(folded, tags, g, parts)
            roll = g.random()
            plain = folded.lower() if roll < 0.15 else folded.upper() if roll < 0.3 else folded
            cut(plain if len(plain) == len(folded) else folded, tags, g, 1.0, xs, ys)
    for text, tags in pii_frames.made(MADE_TEXTS, seed + 1, parts, sorted(_ORDINARY)):
        cut(fold_text(text), tags, g, 0.2, xs, ys)
    return np.stack(xs), np.stack(ys)


def main(tables: str, epochs: int = 12, out: str | Path = MODEL, start: str | Path | None = None) -> None:
    import duckdb

    con = duckdb.connect()
    docs = [d for d, in con.execute(f"select text from read_parquet('{tables}/documents.parquet') where text is not null order by hash(doc_id) limit {SAMPLE_DOCS}").fetchall()]
    lex = load_lexicon(con.execute(f"select name_part, role from read_parquet('{tables}/name_lexicon.parquet')").fetchall())
    learn_endings(lex)
    learn_ordinary(docs)
    parts = sorted(p.lower() for p in lex.given | lex.family)
    labelled = [(f, label(f, lex)) for f in map(fold_text, docs)]
    tagger, workers = Tagger.load(start) if start else Tagger.fresh(), os.cpu_count() or 1

    def said(epoch, loss):
        print(epoch, round(loss, 5), flush=True)
        tagger.save(out)

    x, y = windows_of(labelled, parts, 23 if start else 5)  # other texts when going on
    print(len(docs), "documents", x.shape, "windows; spans", np.bincount(y[(y % 2) == 1] // 2, minlength=5), flush=True)
    tagger.fit(x, y, epochs, said=said, workers=workers, rate=0.004 if start else 0.008)


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]), *sys.argv[3:5])
