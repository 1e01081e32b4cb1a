"""Personal information in free text: found by the character tagger, checked by its form, replaced by typed placeholders.

A text is read for candidates first: forms of pii_rules, and pairs of words that the acceptance below could take for a name. The
tagger (crf_tagger) reads all of them with the characters around, in overlapping windows, and decides; what holds no candidate
could not be accepted whatever the tagger said, so leaving it unread loses nothing. Of emails, phones, numbers and addresses
that it proposes, the form gives the exact start and end; a name is the span that it decodes, without titles and joining words.
Nothing is reported where the tagger proposes nothing.

A name is accepted if both of its parts begin with a capital, or a part is in the lexicon, or a label, a title, such a word as
`by` or the dash of a signature stands before it.

Null and empty texts have no spans and stay as they are. Rows are independent, so repeated rows give repeated results;
texts of any length are read whole.
"""

from __future__ import annotations

import io
import pkgutil
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .crf_tagger import KINDS, Tagger, encode, fold_text, spans_of
from .pii_rules import JOINING, NAME, OPENERS, PARTICLE, TITLES, forms, joined, lowered, split_name

MODEL = "pii_model.npz"
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Words and signs between two names.
_BETWEEN = re.compile(r"\s+(?:and|with|by|for|und|y|et|mit|con|avec)\s+|\s*[&/;:()<>\"]+\s*", re.I)
_FIRST = re.compile(r"(\p{L}+)(\.?)[\s,]+")
_LAST = re.compile(r"[\s,]+(\p{L}+)$")
_BEFORE = re.compile(r"(?<![\p{L}\p{M}])(\p{L}\.|\p{Lu}[\p{L}\p{M}'’-]+)\s+$")
#: Known parts of names are sent to the workers up to this many; a larger lexicon is joined with the words of the texts.
MAX_KNOWN = 200_000
#: Added once to a span of a kind with an exact form, as that form checks it afterwards.
LEAN = np.array([0.0] + [4.0 if kind != "name" and place == "b" else 0.0 for kind in KINDS for place in "bi"], np.float32)
#: Two words that both begin with a capital, an initial and such a word, with initials and particles between them.
_CAPITALS = re.compile(rf"(?<![\p{{L}}\p{{M}}])\p{{Lu}}(?:\.|[\p{{L}}\p{{M}}'’-]+),?\s+(?:(?i:{PARTICLE})\s+|\p{{L}}\.\s+){{0,3}}\p{{Lu}}")
#: What stands before a person: a label, a title or such a word, or the dash of a signature or list.
_CUES = r"\b(?:name|user|author|contact|cc|attn|who)\s*[=:]\s*|(?<![\p{L}\p{M}])(?:by|for|von|ask|cc|contact|attn|thanks|" + "|".join(sorted(TITLES)) + r")\.?\s+(?!(?:" + "|".join(sorted(JOINING)) + r")\s)|(?:^|\n)[^\S\n]*--?\s*"
_CUE, _CUE_BEFORE = re.compile(_CUES, re.I), re.compile(f"(?:{_CUES})$", re.I)
#: Words that a letter follows as a number does, so that it is no initial.
_NUMBERED = re.compile(r"\b(?:unit|flat|apt|apartment|suite|floor|block|room|part|side|section|option|plan|grade|type|class|building|gate|platform|in|key of)\.?\s+$", re.I)
_WORD = re.compile(r"[\p{L}\p{M}'’]+")
#: Characters that a name, at most 80 long, may take around a sign of it.
AROUND_NAME = 28
_TAGGER: list[Tagger] = []


def tagger() -> Tagger:
    """The stored model, read once in each Python worker."""
    if not _TAGGER:
        _TAGGER.append(Tagger.load(io.BytesIO(pkgutil.get_data(__package__, MODEL))))  # also from a zip file
    return _TAGGER[0]


def candidates(text: str, known: frozenset[str]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """The forms of a folded text, and the regions that hold these and all names that could be accepted."""
    exact = forms(text)
    around = [(a, b) for _, a, b in exact]
    around += [(m.start(), m.end() + AROUND_NAME) for m in _CAPITALS.finditer(text)]
    around += [(m.start(), m.end() + AROUND_NAME) for m in _CUE.finditer(text) if text[m.end() : m.end() + 1].isalpha()]
    if known:
        around += [(max(0, m.start() - AROUND_NAME), m.end() + AROUND_NAME) for m in _WORD.finditer(lowered(text)) if m.group() in known]
    around.sort()
    return exact, joined([(a, min(b, len(text))) for a, b in around])


def _word_edges(text: str, s: int, e: int) -> tuple[int, int]:
    while s > 0 and s < len(text) and (text[s].isalpha() and text[s - 1].isalpha()):
        s -= 1
    while e < len(text) and e > 0 and text[e - 1].isalpha() and text[e].isalpha():
        e += 1
    return s, e


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    """Without titles and joining words at the ends."""
    while m := _FIRST.match(text, s, e):
        word = m.group(1).lower()
        small = m.group(1).islower() and word in JOINING
        if not (small or word in TITLES) or m.end() >= e or (m.group(2) and word not in TITLES):
            break
        s = m.end()
    while m := _LAST.search(text, s, e):
        if not (m.group(1).islower() and m.group(1) in JOINING):
            break
        e = m.start()
    return s, e


def _is_name(text: str, s: int, e: int, known: frozenset[str]) -> bool:
    parts = split_name(text[s:e])
    if parts is None or e - s > 80 or parts[1].lower() in OPENERS or parts[0].lower() in JOINING:
        return False
    if len(parts[0]) == 2 and parts[0][1] == "." and _NUMBERED.search(text, max(0, s - 24), s):
        return False
    if parts[0][:1].isupper() and parts[1][:1].isupper():
        return True
    return any(w in known for w in _WORD.findall(lowered(text[s:e]))) or bool(_CUE_BEFORE.search(text, max(0, s - 32), s))


def _name(text: str, s: int, e: int, known: frozenset[str] = frozenset()) -> tuple[int, int] | None:
    """The name form that shares most with the proposed span."""
    s, e = _word_edges(text, s, e)
    if e < len(text) and text[e] == "." and e - s >= 2 and text[e - 2 : e - 1] in " \n" and text[e - 1].isalpha():
        e += 1
    while s < e and not text[s].isalpha():
        s += 1
    while e > s and not (text[e - 1].isalpha() or text[e - 1] == "."):
        e -= 1
    s, e = _trimmed(text, s, e)
    if _is_name(text, s, e, known):
        return s, e
    if e - s >= 3 and not re.search(r"\s", text[s:e]):  # one part alone: its initial or other part may stand in front
        m = _BEFORE.search(text, max(0, s - 32), s)
        if m and m.group(1).rstrip(".").lower() not in TITLES | JOINING and _is_name(text, m.start(1), e, known):
            return m.start(1), e
    best, most = None, 0.5
    starts = [s] + [i + 1 for i in range(max(0, s - 16), e) if text[i] in " \n\t\"(" and i + 1 != s]
    for at in starts:
        m = NAME.match(text, at)
        if not m:
            continue
        for end in sorted({m.end(), min(m.end(), e)}):
            a, b = _trimmed(text, at, end)
            if b <= a or not _is_name(text, a, b, known):
                continue
            share = max(0, min(b, e) - max(a, s)) / max(1, max(b, e) - min(a, s))
            if share > most:
                best, most = (a, b), share
    return best


def resolve(text: str, tags: np.ndarray, exact: list[tuple[int, int, int]], known: frozenset[str] = frozenset()) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a folded text from its tags and its forms, in order, none overlapping another."""
    found: list[tuple[int, int, int]] = []
    for kind, s, e in spans_of(tags):
        if KINDS[kind] == "name":
            cuts = [s, *(x for m in _BETWEEN.finditer(text, s, e) for x in m.span()), e]
            for a, b in zip(cuts[::2], cuts[1::2]):
                hit = _name(text, a, b, known) if b - a > 3 else None
                if hit:
                    found.append((kind, *hit))
            continue
        found += [(k, a, b) for k, a, b in exact if k == kind and min(b, e) > max(a, s) and min(b, e) - max(a, s) >= 0.5 * min(b - a, e - s)]
    taken, out = [], []
    for kind, a, b in sorted(set(found)):
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            out.append((KINDS[kind], a, b))
    return sorted(out, key=lambda x: x[1])


def spans(texts: list[str | None], known: frozenset[str] | list[frozenset[str]] = frozenset()) -> list[list[tuple[str, int, int]]]:
    """The spans of each text, as 0-based code points. known holds for all texts, or there is one set for each."""
    folded = [fold_text(t) if t else "" for t in texts]
    parts = known if isinstance(known, list) else [known] * len(texts)
    read = [candidates(f, k) for f, k in zip(folded, parts)]
    tags = tagger().tag_texts([encode(f) if r[1] else np.empty(0, np.int16) for f, r in zip(folded, read)], [r[1] for r in read], LEAN)
    return [resolve(f, t, r[0], k) if t.any() else [] for f, t, r, k in zip(folded, tags, read, parts)]


@F.pandas_udf(StringType())
def _folded_words(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else " ".join(sorted(set(_WORD.findall(lowered(fold_text(t)))))))


def _with_known(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame | None, column: str = "name_part") -> tuple[DataFrame, frozenset[str] | None]:
    """(id, text, parts) and the parts of the lexicon, folded; or, where it has more than MAX_KNOWN rows, each text's own parts in `parts`.

    Rows of a null id are kept; rows of equal ids and texts share their parts.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    none = rows.withColumn("parts", F.lit(None).cast("array<string>"))
    if lexicon is None:
        return none, frozenset()
    named = lexicon.select(F.col(column).alias("part")).filter(F.col("part").isNotNull())
    if named.limit(MAX_KNOWN + 1).count() <= MAX_KNOWN:
        return none, frozenset(lowered(fold_text(r[0])) for r in named.collect())
    keyed = rows.withColumn("key", F.xxhash64("text"))
    words = keyed.filter(F.col("text").isNotNull()).select("key", F.explode(F.split(_folded_words("text"), " ")).alias("part")).distinct()
    own = words.join(named.select(_folded_words("part").alias("part")).distinct(), "part", "left_semi").groupBy("key").agg(F.collect_set("part").alias("parts"))
    return keyed.join(own, "key", "left").select("id", "text", "parts"), None


def _sets(batch: pa.RecordBatch, known: frozenset[str] | None) -> frozenset[str] | list[frozenset[str]]:
    return known if known is not None else [frozenset(p or ()) for p in batch.column(2).to_pylist()]


def _spread(df: DataFrame) -> DataFrame:
    """As many partitions as the session can run at once, at least: reading is cheap here, tagging is not."""
    want = max(df.sparkSession.sparkContext.defaultParallelism * 4, 16)
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon: DataFrame | None = None) -> DataFrame:
    """(id, kind, start_char, length): one row an occurrence, start_char 1-based in code points."""
    rows, known = _with_known(df, id_col, text_col, lexicon)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, kinds, starts, lengths = [], [], [], []
                for key, found in zip(part.column(0).to_pylist(), spans(part.column(1).to_pylist(), _sets(part, known))):
                    for kind, a, b in found:
                        ids.append(key)
                        kinds.append(kind)
                        starts.append(a + 1)
                        lengths.append(b - a)
                yield pa.RecordBatch.from_arrays([pa.array(ids, part.schema.field(0).type), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32())], ["id", "kind", "start_char", "length"])

    return _spread(rows.filter(F.col("text").isNotNull())).mapInArrow(tag, f"id {rows.schema['id'].dataType.simpleString()}, kind string, start_char int, length int")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon: DataFrame | None = None) -> DataFrame:
    """(id, text, replaced): each text with its spans replaced by placeholders, and their number; null texts stay null."""
    rows, known = _with_known(df, id_col, text_col, lexicon)

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts, out, counts = part.column(1).to_pylist(), [], []
                for text, found in zip(texts, spans(texts, _sets(part, known))):
                    counts.append(len(found))
                    if found:
                        bits, at = [], 0
                        for kind, a, b in found:
                            bits += [text[at:a], PLACEHOLDER[kind]]
                            at = b
                        text = "".join(bits) + text[at:]
                    out.append(text)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), pa.array(counts, pa.int32())], ["id", "text", "replaced"])

    return _spread(rows).mapInArrow(swap, f"id {rows.schema['id'].dataType.simpleString()}, text string, replaced int")
