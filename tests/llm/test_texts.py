"""Text operators: leaks against brute force, mixtures against their bounds, placeholders against an exact round trip and held-out accuracy."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import same_rows

from gridloom.llm import crf_tagger, leaks, mixing, pii, quota
from gridloom.llm.queries import QUERIES, SQL

WORDS = [f"w{i}" for i in range(60)]


def test_words_ignore_markup_and_accents():
    assert leaks.words("Café <b>No</b>ir,​ sec​onds &amp; <br>foo_bar — STRAßE") == ["cafe", "noir", "seconds", "foo", "bar", "strasse"]
    assert leaks.words(None) == leaks.words("") == leaks.words("...") == []


def test_leaks_equal_brute_force(spark):
    g = random.Random(4)
    items = [(i, " ".join(g.choices(WORDS, k=25))) for i in range(12)] + [(99, "too short"), (100, None)]
    docs = []
    for k in range(80):
        body = g.choices(WORDS, k=40)
        if k % 3 == 0:
            words = items[k % 12][1].split()
            n, at = g.randrange(7, 15), g.randrange(0, 10)
            body[10:10] = words[at : at + n]
        docs.append((k, "  ".join(body)))
    docs += [(500, None), (501, ""), (502, "w1 " * 30_000), (None, docs[0][1])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item", "'x' as gram")
    got = {tuple(r) for r in leaks.found(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    runs = {}
    for i, t in items:
        w = (t or "").split()
        for k in range(len(w) - 9):
            runs.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = {(d, i) for d, t in docs if d is not None for w in [(t or "").split()] for k in range(len(w) - 9) for i in runs.get(tuple(w[k : k + 10]), ())}
    assert got == want and want
    assert leaks.found(frame.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


def naive_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (leaks.MATCH if a[i] == b[j] else leaks.MISMATCH), h[i, j + 1] + leaks.GAP, h[i + 1, j] + leaks.GAP)
    return h.max()


def test_alignment_equals_the_table():
    g = np.random.default_rng(5)
    for _ in range(60):
        a, b = g.integers(0, 6, g.integers(1, 25)), g.integers(0, 6, g.integers(1, 25))
        score, matched, run = leaks.align(a, b)
        assert score == naive_alignment(a, b)
        longest = max((k for k in range(26) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if (a[i : i + k] == b[j : j + k]).all()), default=0)
        assert run == longest and matched <= min(len(a), len(b))
    assert leaks.align(np.array([]), np.array([1])) == (0, 0, 0)


def docs_for_mixing(spark):
    rows = [(i, "aa 11 !" * (1 + i % 5), "big") for i in range(300)] + [(1000 + i, "bb cc", " Small ") for i in range(3)] + [(2000, None, "big"), (2001, "", "big"), (2002, "x", None), (2003, "x", "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_mixture_reaches_its_shares(spark):
    docs = docs_for_mixing(spark)
    plan = spark.createDataFrame([(1, "BIG", 0.7, 3), (1, "small", 0.5, 2), (1, "absent", 0.1, 4), (2, "big", 1.9, 1)], "plan_id int, source string, target_share double, max_repeats int").selectExpr("*", "1 as size", "2 as docs", "'k' as key")
    total = sum(r.size for r in mixing.totals(mixing.sized(docs)).collect()) // 2
    rows = mixing.mixture(docs, plan).collect()
    assert all(r.copies <= {(1, "BIG"): 3, (1, "small"): 2, (2, "big"): 1}[r.plan_id, r.source] for r in rows)
    big = sum(r["size"] * r.copies for r in rows if (r.plan_id, r.source) == (1, "BIG"))
    assert abs(big / total - 0.7) < 0.1
    assert {r.copies for r in rows if r.source == "small"} == {2}
    assert {tuple(r) for r in mixing.unreachable(docs, plan).collect()} == {(1, "small"), (1, "absent")}
    shares = {(r.plan_id, r.source): r for r in mixing.shares(docs, plan).collect()}
    assert shares[1, "absent"].documents == 0 and len(shares) == 4
    assert mixing.mixture(docs.limit(0), plan).count() == 0


def test_sizes(spark):
    rows = spark.createDataFrame([("Ab1 c-d!",), ("",), ("  \t",), ("été 12٣",)], "text string")
    assert [r[0] for r in rows.select(mixing.size_of()).collect()] == [6, 0, 0, 2]


def test_quota_goes_to_relatives_first():
    parent = {"rock": "guitar", "metal": "guitar", "jazz": "concert"}
    rows = [dict(category=c, wanted=w, available=a) for c, w, a in (("rock", 10, 4), ("metal", 5, 20), ("jazz", 5, 50))]
    got = {r["category"]: (r["granted"], r["unmet"]) for r in quota.hand_down(rows, parent)}
    assert got == {"rock": (4, 6), "metal": (11, 0), "jazz": (5, 0)}
    rows = [dict(category=c, wanted=w, available=a) for c, w, a in (("rock", 10, 4), ("metal", 5, 6), ("jazz", 5, 50))]
    assert {r["category"]: r["granted"] for r in quota.hand_down(rows, parent)} == {"rock": 4, "metal": 6, "jazz": 10}  # siblings are empty, so cousins
    poor = quota.hand_down([dict(category="a", wanted=5, available=0), dict(category="b", wanted=0, available=2)], {})
    assert [r["granted"] for r in poor] == [0, 2]
    ring = quota.hand_down([dict(category="a", wanted=1, available=1), dict(category="b", wanted=1, available=1)], {"a": "b", "b": "a"})
    assert [r["granted"] for r in ring] == [1, 1]
    assert quota.hand_down([], {}) == []


def test_tree_from_words_and_from_a_table(spark):
    assert quota.words_tree([("acidjazz", "Acid Jazz"), ("jazz", "jazz"), ("dub", "Dub")]) == {"acidjazz": "jazz"}
    plan = spark.createDataFrame([(1, "Rock", 0.0, 10), (1, "Metal", 0.0, 5), (1, "Jazz", 0.0, 5)], "plan_id int, genre string, target_share double, min_rows int")
    have = spark.createDataFrame([("rock", 4), ("metal", 20), ("jazz", 50)], "category string, available bigint")
    tree = spark.createDataFrame([("rock", "guitar"), ("metal", "Guitar"), (None, "x")], "category string, parent string")
    got = {r.genre: r.granted for r in quota.allocate(plan, have, tree=tree).collect()}
    assert got == {"Rock": 4, "Metal": 11, "Jazz": 5}
    assert quota.allocate(plan.limit(0), have).count() == 0


def test_sample_holds_what_was_granted(spark, tables):
    sample = {(r.plan_id, r.genre): r["count"] for r in QUERIES["p3_sample"](spark, tables).groupBy("plan_id", "genre").count().collect()}
    report = {(r.plan_id, r.genre): r.granted for r in QUERIES["p3_report"](spark, tables).collect()}
    assert sample == {k: v for k, v in report.items() if v}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, tables, duck):
    same_rows(QUERIES[name](spark, tables), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, tables):
    QUERIES[name](spark, tables).count()


TEXT = 'Ask Dorette Aspwick for the stems, d.aspwick@harbor.test. Phone: +44 20 7946 0789 after six. On file: SSN: 000-10-6586. Send the tapes to 138 Kestrel Street, Flat 4. The Stella Rhodan with serial ZK7514821 hums.'


def test_spans_and_placeholders(spark):
    want = {"name": "Dorette Aspwick", "email": "d.aspwick@harbor.test", "phone": "+44 20 7946 0789", "id_number": "000-10-6586", "address": "138 Kestrel Street"}
    (found,) = pii.spans([TEXT])
    assert {k: TEXT[a:b] for k, a, b in found} == want
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, TEXT), (5, "\U0001f3b9 " * 3000 + TEXT)], "doc_id bigint, text string").selectExpr("*", "'x' as id", "'y' as kind")
    starts = {(r.id, r.kind): r.start_char for r in pii.find(df).collect()}
    assert starts[1, "name"] == TEXT.index("Dorette") + 1 and starts[5, "email"] == 6000 + TEXT.index("d.asp") + 1
    assert {k for k, _ in starts} == {1, 4, 5}
    rows = {r.id: r for r in pii.redact(df).collect()}
    assert rows[2].text is None and rows[3].text == "" and rows[1].replaced == 5
    back = rows[1].text
    for k, v in want.items():
        assert back.count(pii.PLACEHOLDER[k]) == 1
        back = back.replace(pii.PLACEHOLDER[k], v)
    assert back == TEXT
    assert pii.find(df.limit(0)).count() == 0


def test_held_out_accuracy(tables, duck):
    """Recall and precision against the labeller, on documents of a table that the model was not trained on."""
    from gridloom.llm import pii_training as P

    lex = P.load_lexicon(duck.execute("select name_part, role from name_lexicon").fetchall())
    P.learn_endings(lex)
    texts = [r[0] for r in duck.execute("select text from documents where text is not null").fetchall()]
    P.learn_ordinary(texts)
    want, got = set(), set()
    for n, (text, found) in enumerate(zip(texts, pii.spans(texts, frozenset(lex.given | lex.family)))):
        tags = P.label(crf_tagger.fold_text(text), lex)
        want |= {(n, crf_tagger.KINDS[k], s) for k, s, _ in crf_tagger.spans_of(tags)}
        got |= {(n, k, s) for k, s, _ in found}
    assert len(want & got) >= 0.93 * len(want) and len(want & got) >= 0.9 * len(got)


def test_training_learns_and_folding_keeps_places():
    g = np.random.default_rng(6)
    x = g.integers(97, 123, (256, 40)).astype(np.int16)
    y = np.where(x < 100, 1, 0)
    tagger = crf_tagger.Tagger.fresh(hidden=8)
    losses = []
    tagger.fit(x, y, 40, batch=32, rate=0.02, said=lambda _, loss: losses.append(loss))
    assert losses[-1] < losses[0] / 2
    for text in ("áé１ ß\U0001f3b9", "ﬁx", ""):
        assert len(crf_tagger.fold_text(text)) == len(text)


def test_gradients_are_those_of_the_loss():
    g = np.random.default_rng(7)
    tagger = crf_tagger.Tagger.fresh(hidden=4)
    tagger.w = {k: v.astype(np.float64) for k, v in tagger.w.items()}
    x, y = g.integers(97, 101, (6, 2)), g.integers(0, 4, (6, 2))
    loss, grads = tagger.gradients(x, y)
    for name, at in (("trans", (0, 1)), ("out", (1, 2)), ("rec_f", (0, 3)), ("emb_b", (98, 2))):
        old = tagger.w[name][at]
        tagger.w[name][at] = old + 1e-3
        up = tagger.gradients(x, y)[0]
        tagger.w[name][at] = old - 1e-3
        down = tagger.gradients(x, y)[0]
        tagger.w[name][at] = old
        assert grads[name][at] / 8 == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-4)


def test_names_in_small_letters_do_not_need_the_lexicon():
    """Of names without a known part, the surroundings decide, not the lexicon."""
    known = frozenset({"somebody"})
    tail = "Tempo 112, same as with tabla."
    for text, name in (
        (f"{tail} name=dorrin raskovar | phone=030/23125365 | addr=94A Rope Road", "dorrin raskovar"),
        (f"The hum of the ostinato gets glassy. Written for uluric vaskieretti by Yasiel Aspurst. {tail}", "uluric vaskieretti"),
        (f"The groove (ref 502/53). Ask haldymir vaskieretti before you cut it. {tail}", "haldymir vaskieretti"),
    ):
        tags = np.zeros(len(text), np.int64)
        at = text.index(name)
        begin = 1 + 2 * pii.KINDS.index("name")
        tags[at], tags[at + 1 : at + len(name)] = begin, begin + 1
        assert ("name", at, at + len(name)) in pii.resolve(text, tags, [], known)
    words = "Neither bass clarinet nor\n> celesta settle before loose brass."
    tags = np.zeros(len(words), np.int64)
    at = words.index("celesta")
    tags[at], tags[at + 1 : at + len("celesta settle")] = begin, begin + 1
    assert pii.resolve(words, tags, [], known) == []


def test_large_lexicons_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the tape was played by nobody. jorolo vask came."), (2, None), (3, "")], "id bigint, text string")
    lexicon = spark.createDataFrame([("Jorolo", "given"), ("Vask", "family"), (None, "given")], "name_part string, role string")
    rows, known = pii._with_known(docs, "id", "text", lexicon)
    assert known == frozenset({"jorolo", "vask"})
    monkeypatch.setattr(pii, "MAX_KNOWN", 1)
    rows, known = pii._with_known(docs, "id", "text", lexicon)
    assert known is None and {r.id: set(r.parts or ()) for r in rows.collect()} == {1: {"jorolo", "vask"}, 2: set(), 3: set()}
