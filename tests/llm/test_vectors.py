"""Vector operators against brute force on fixtures with clusters, copies, ties, nulls and unusable vectors."""

from __future__ import annotations

import numpy as np
import pytest

from gridloom.llm import clusters, neighbours, overlap, varied
from gridloom.llm import pairs as pairs_
from gridloom.llm import vectors as V

SCHEMA = "rec_id bigint, label string, filename string, embedding array<array<float>>, split string, source string, side string, cell int, vec string, id int"


def layers(v):
    return [[float(x) for x in v[i * 16 : (i + 1) * 16]] for i in range(4)]


@pytest.fixture(scope="module")
def fixture(spark):
    """(DataFrame, {id: vector}) with crowds, near pairs, exact copies, redelivered rows and unusable vectors."""
    g = np.random.default_rng(1)
    vecs: dict[int, np.ndarray] = {}
    n = 0

    def put(v):
        nonlocal n
        n += 1
        vecs[n] = np.float32(v)

    for size, noise in ((30, 0.25), (12, 0.05), (9, 0.05), (5, 0.3), (40, 0.35)):
        c = g.normal(size=64)
        for _ in range(size):
            put(c + noise * g.normal(size=64))
    for _ in range(60):
        put(g.normal(size=64))
    same = np.float32(g.normal(size=64))
    put(same * 3)  # no copy, but as similar, and of a smaller id
    for _ in range(20):
        put(same)
    put(same * 2)
    put(g.normal(size=64) * 1e-20)
    put(g.normal(size=64) * 1e18)
    splits = ["train", "TRAIN ", "test", "val", None, "Validation"]
    rows = [(i, "piano" if i % 3 else None, f"f{i}.wav", layers(v), splits[i % 6], "s", "x", 1, "y", 2) for i, v in vecs.items()]
    rows += rows[:25]  # delivered twice
    bad = [None, [], [[1.0] * 16] * 3, [[1.0] * 16] * 3 + [[1.0] * 9], [[0.0] * 16] * 4, [[float("nan")] + [1.0] * 15] + [[1.0] * 16] * 3, [[float("inf")] + [1.0] * 15] + [[1.0] * 16] * 3, [None, [1.0] * 16, [1.0] * 16, [1.0] * 16], [[None] + [1.0] * 15] + [[1.0] * 16] * 3]
    rows += [(10_000 + i, None, None, e, "train", None, "x", 1, "y", 2) for i, e in enumerate(bad)]
    rows.append((None, "a", "b.wav", layers(vecs[1]), "train", "s", "x", 1, "y", 2))
    return spark.createDataFrame(rows, SCHEMA).repartition(3), vecs


def similarities(vecs):
    ids = np.array(sorted(vecs))
    x = np.array([vecs[i] for i in ids], np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    return ids, np.round(x @ x.T, 9)


def groups(vecs, floor, least):
    ids, s = similarities(vecs)
    label = np.arange(len(ids))
    for _ in range(len(ids)):
        new = np.array([label[s[i] >= floor].min() for i in range(len(ids))])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    size = np.bincount(label, minlength=len(ids))
    return {(int(ids[label[i]]), int(ids[i])) for i in range(len(ids)) if size[label[i]] >= least}


def test_clusters_equal_brute_force(fixture):
    df, vecs = fixture
    assert {tuple(r) for r in clusters.linked(df, "rec_id", 0.90, 3).collect()} == groups(vecs, 0.90, 3)


def test_hot_cells_are_salted_without_loss(fixture, monkeypatch):
    df, vecs = fixture
    monkeypatch.setattr(V, "PART_ROWS", 8)
    assert {tuple(r) for r in clusters.linked(df, "rec_id", 0.90, 3).collect()} == groups(vecs, 0.90, 3)


def test_descriptions_cover_all_records(fixture):
    df, vecs = fixture
    rows = clusters.describe(df, "rec_id", "label").collect()
    assert sum(r.size for r in rows) == len(vecs)
    assert all(r.typical_1 in vecs for r in rows)


def test_trees_merge_and_stay_bounded():
    g = np.random.default_rng(2)
    y = V.unit(g.normal(size=(3000, 64)).astype(np.float32))
    tree = clusters.CFTree(100)
    tree.add(np.ones(len(y)), y.astype(np.float64), np.arange(len(y)), y)
    assert len(tree.n) <= 100 and tree.n.sum() + tree.aside == len(y)
    crowd = V.unit((y[0] + 0.1 * g.normal(size=(3000, 64))).astype(np.float32))
    tree = clusters.CFTree(100)
    tree.add(np.ones(len(crowd)), crowd.astype(np.float64), np.arange(len(crowd)), crowd)
    assert tree.aside == 0 and tree.n.sum() == len(crowd) and np.allclose(tree.sums.sum(0), crowd.sum(0), atol=1e-3)
    labels = clusters.ward(np.ones(4), np.array([[1, 0], [0.99, 0.1], [-1, 0], [-0.99, 0.1]], float), 0.1)
    assert labels[0] == labels[1] != labels[2] == labels[3]


def brute_nearest(vecs, k, floor):
    ids, s = similarities(vecs)
    np.fill_diagonal(s, -9)
    out = set()
    for i in range(len(ids)):
        for j in np.lexsort((ids, -s[i]))[:k]:
            if s[i, j] >= floor:
                out.add((int(ids[i]), int(ids[j])))
    return out


def test_neighbours_recall_and_precision(fixture):
    df, vecs = fixture
    got = {(r.id, r.other) for r in neighbours.nearest(df, "rec_id", 5, 0.90).collect()}
    want = brute_nearest(vecs, 5, 0.90)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_copies_beyond_k_cost_their_size(fixture):
    df, vecs = fixture
    far = neighbours.copies(df, "rec_id", 5).collect()
    first = min(i for i, v in vecs.items() if i + 1 in vecs and (v == vecs[i + 1]).all())
    assert len(far) == 20 - 6 and all(list(r.firsts) == list(range(first, first + 5)) for r in far)


def test_scan_abandons_far_pairs_only():
    g = np.random.default_rng(3)
    base = g.normal(size=(300, 64))
    y = V.unit(np.concatenate([base, base + 0.2 * g.normal(size=base.shape)]).astype(np.float32))
    z = y @ neighbours._ROTATION
    i, j, _ = neighbours.scan(z, z, np.arange(len(z)), np.full(len(z), 0.2, np.float32))
    true = {(a, b) for a, b in zip(*np.nonzero(y @ y.T >= 0.9)) if a != b}
    assert len(true & set(zip(i.tolist(), j.tolist()))) >= 0.995 * len(true)


def test_dense_group_of_many_parts(spark, monkeypatch):
    """A group whose records are all near one another is one list, cut into parts that meet pair by pair; every block is tested in its tiles."""
    g = np.random.default_rng(6)
    c = g.normal(size=64)
    x = np.float32(c / np.linalg.norm(c) + 0.035 * g.normal(size=(1500, 64)))
    vecs = {i + 1: v for i, v in enumerate(x)}
    want = brute_nearest(vecs, 5, 0.90)
    for rows in (10**9, 400):
        monkeypatch.setattr(V, "PART_ROWS", rows)
        got = {(r.id, r.other) for r in neighbours.nearest(frame(spark, x), "rec_id", 5, 0.90).collect()}
        assert got <= want and len(got) >= 0.99 * len(want)


def test_nearest_without_a_floor(spark):
    x = np.float32(np.random.default_rng(9).normal(size=(40, 64)))
    rows = neighbours.nearest(frame(spark, x), "rec_id", 3, -1.0).groupBy("id").count().collect()
    assert all(r["count"] <= 3 for r in rows)


def test_pairs_of_parts_meet_once():
    own, parts = np.array([0, 1, 2, 2]), np.array([3, 3, 3, 3])
    at, task, side = V.in_pairs(own, parts)
    tasks = {}
    for a, t, s in zip(at, task, side):
        tasks.setdefault(t, []).append((int(a), int(s)))
    for a in range(4):
        for b in range(4):
            assert sum((a in [x for x, _ in rows]) and (b in [x for x, _ in rows]) for t, rows in tasks.items() if t % 4 or a == b or own[a] == own[b]) >= 1


def test_crowds_equal_brute_force(fixture, monkeypatch):
    df, vecs = fixture
    assert {tuple(r) for r in varied.crowds(df, "rec_id", 0.995, 8).collect()} == groups(vecs, 0.995, 8)
    monkeypatch.setattr(varied, "PART_ROWS", 3)
    assert {tuple(r) for r in varied.crowds(df, "rec_id", 0.995, 8).collect()} == groups(vecs, 0.995, 8)


def test_pairs_in_doubt_are_computed_exactly(spark):
    """Two stars whose arms lie a hair's breadth on either side of the bound."""
    g = np.random.default_rng(8)
    vecs, n = {}, 0
    for far in (0.995 + 1e-5, 0.995 - 1e-5):
        c = g.normal(size=64)
        c /= np.linalg.norm(c)
        n += 1
        vecs[n] = np.float32(c)
        for _ in range(9):
            d = g.normal(size=64)
            d -= (d @ c) * c
            d /= np.linalg.norm(d)
            n += 1
            vecs[n] = np.float32(far * c + np.sqrt(1 - far * far) * d)
    df = spark.createDataFrame([(i, layers(v)) for i, v in vecs.items()], "rec_id bigint, embedding array<array<float>>")
    pairs = spark.createDataFrame([(b, a) for a, b in [(1, i) for i in range(2, 11)] + [(11, i) for i in range(12, 21)]], "u bigint, v bigint")
    for n in (1, 10**9):
        assert {tuple(sorted(r)) for r in pairs_.verified(df, "rec_id", pairs, n, 0.995).collect()} == {(1, i) for i in range(2, 11)}


def stars(g, centres, far, arms=7):
    """A record for each centre with arms that are linked to it at a similarity of far, not to one another."""
    out = []
    for c in centres:
        c = c / np.linalg.norm(c)
        d = g.normal(size=(arms, 64))
        d -= (d @ c)[:, None] * c
        d /= np.linalg.norm(d, axis=1, keepdims=True)
        out += [c, *(far * c + np.sqrt(1 - far * far) * d)]
    return np.float32(out)


def frame(spark, x):
    return spark.createDataFrame([(i + 1, layers(v)) for i, v in enumerate(x)], "rec_id bigint, embedding array<array<float>>")


def test_no_link_of_a_hot_crowd_is_lost_between_its_parts(spark, monkeypatch):
    """Stars within a ball that is one cell of many parts, with and without records around its pivot."""
    g = np.random.default_rng(12)
    c = g.normal(size=64)
    c /= np.linalg.norm(c)
    for noise, tight in ((0.02, 0), (0.02, 60), (0.012, 0)):
        x = np.concatenate([stars(g, c + noise * g.normal(size=(60, 64)), 0.9955), np.float32(c + 0.002 * g.normal(size=(tight, 64)))])
        want = groups({i + 1: v for i, v in enumerate(x)}, 0.995, 8)
        monkeypatch.setattr(varied, "PART_ROWS", 64)
        assert {tuple(r) for r in varied.crowds(frame(spark, x), "rec_id", 0.995, 8).collect()} == want


def test_no_link_is_lost_between_cells(spark, monkeypatch):
    """Stars, and chains, of eight that a single lost link splits, over many cells."""
    g = np.random.default_rng(14)
    x = [stars(g, g.normal(size=(40, 64)), far) for far in (0.9953, 0.9968)]
    for _ in range(40):
        v = g.normal(size=64)
        chain = [v / np.linalg.norm(v)]
        while len(chain) < 8:
            chain.append(stars(g, chain[-1:], 0.9955, 1)[1])
        x.append(np.float32(chain))
    x = np.concatenate([*x, np.float32(g.normal(size=(400, 64)))])
    monkeypatch.setattr(varied, "CELL_ROWS", 20)
    assert {tuple(r) for r in varied.crowds(frame(spark, x), "rec_id", 0.995, 8).collect()} == groups({i + 1: v for i, v in enumerate(x)}, 0.995, 8)


def test_subset_thins_crowds(fixture):
    df, vecs = fixture
    got = [r.id for r in varied.subset(df, "rec_id", "label", 40).collect()]
    assert len(got) == len(set(got)) == 40 and set(got) <= set(vecs)
    alone = [i for i in got if 97 <= i <= 156]  # the records without any crowd
    assert len(alone) / 40 > 60 / len(vecs)
    assert varied.subset(df, "rec_id", "label", 10_000).count() == len(vecs)


def test_subset_thins_a_crowd_among_many(spark):
    """A crowd of 100 among 20 000: taken at a fifth of the uniform rate at most, as the codes have as many bits as the count asks for."""
    g = np.random.default_rng(16)
    c = g.normal(size=64)
    x = np.float32(np.concatenate([c + 0.05 * g.normal(size=(100, 64)), g.normal(size=(19_900, 64))]))
    df = frame(spark, x)
    got = {r.id for r in varied.subset(df, "rec_id", None, 2000).collect()}
    assert len(got) == 2000 and sum(i <= 100 for i in got) <= 2


def test_cut_is_exact(spark, monkeypatch):
    monkeypatch.setattr(varied, "FEW_ROWS", 10)
    g = np.random.default_rng(17)
    keys = np.concatenate([g.exponential(size=400) ** 4, np.full(300, 0.5)])
    df = spark.createDataFrame([(i, float(k)) for i, k in enumerate(keys)], "id bigint, key double")
    order = sorted((float(k), i) for i, k in enumerate(keys))
    for size in (1, 37, 350, 500, 699):
        assert tuple(varied.cut(df, "key", size)) == order[size - 1]
    assert varied.cut(df, "key", 700) is None


def test_overlaps(fixture):
    df, vecs = fixture
    side = {0: 0, 1: 0, 2: 1, 3: 1, 4: None, 5: 1}
    ids, s = similarities(vecs)
    want = {(int(a), int(b)) for a, x in zip(ids, s) for b, v in zip(ids, x) if v >= 0.995 and side[a % 6] == 0 and side[b % 6] == 1}
    assert {tuple(r) for r in overlap.by_vector(df, "rec_id").collect()} == want


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("x/Café Noir 12.wav", "café_noir-12 copy.MP3", True), ("take 3.wav", "take 3 (1).wav", True), ("take 3.wav", "take 4.wav", False), ("a - Kopie.wav", "A.flac", True),
        ("song_011.wav", "song_012.wav", False), ("copy.wav", "copy (2).wav", True), ("d\\e\\Lead.aif", "lead.wav", True), ("lead (live).wav", "lead.wav", False), ("a.b.wav", "a.b.mp3", True),
    ],
)
def test_file_names(a, b, same):
    assert (overlap.canonical_name(a) == overlap.canonical_name(b)) is same


def test_names_count_only_without_a_vector(spark):
    good = layers(np.arange(64.0) + 1)
    other = layers(np.cos(np.arange(64.0)))
    rows = [(1, "a.wav", good, "train"), (2, "a (1).wav", other, "test"), (3, "A.mp3", None, "val"), (4, "a.wav", None, "train"), (5, None, None, "test"), (6, "a.wav", None, None)]
    df = spark.createDataFrame(rows, "rec_id bigint, filename string, embedding array<array<float>>, split string").selectExpr("*", "'s' as source")
    assert {tuple(r)[:2] for r in overlap.overlaps(df).collect()} == {(1, 3), (4, 2), (4, 3)}
    assert {(r.split, r.by, r.pairs) for r in overlap.report(df).collect()} == {("validation", "filename", 2), ("test", "filename", 1)}


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert clusters.linked(df, "rec_id").count() == 0
    assert clusters.describe(df, "rec_id", "label").count() == 0
    assert neighbours.nearest(df, "rec_id").count() == 0
    assert varied.crowds(df, "rec_id").count() == 0
    assert varied.subset(df, "rec_id", "label", 5).count() == 0
    assert overlap.overlaps(df).count() == 0
