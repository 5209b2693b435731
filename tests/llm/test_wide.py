"""Groups by the similarity of shingle sets, against brute force."""

import random

import numpy as np
import pytest

from quillon.llm import wide

random.seed(5)
WORDS = [f"w{i}" for i in range(3000)]


def near_copy(text, share):
    words = text.split(" ")
    for i in random.sample(range(len(words)), max(1, int(len(words) * share))):
        words[i] = "new"
    return " ".join(words)


def jaccard(a, b):
    x, y = (set(wide.shingles(t).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_estimates():
    """Long sets: all pairs well above the similarity are linked, none well below; short sets are exact."""
    for size in (20, 50, 150, 1000, 5000):
        base = " ".join(random.choices(WORDS, k=size))
        for _ in range(30):
            other = near_copy(base, random.choice((0.005, 0.01, 0.02, 0.04, 0.08)))
            texts, truth = [base, other], jaccard(base, other)
            sets = [wide.shingles(t) for t in texts]
            fps = np.array([wide.fingerprint(s) for s in sets]).T
            sizes = np.array([len(s) for s in sets])
            both = np.arange(2)
            found = len(wide.linked(fps, sizes, [s.tolist() for s in sets], both, both, 0.8)[0]) == 1
            if size <= 50:
                assert found == (truth >= 0.8)
            elif abs(truth - 0.8) > 0.1:
                assert found == (truth > 0.8), truth


def test_long_sets_near_the_similarity(spark):
    """Long texts a little below 0.8 stay apart, those at or a little above it are linked."""
    pairs, rows = [], []
    for i in range(80):
        base = " ".join(random.choices(WORDS, k=300))
        words, at = base.split(" "), 0
        while jaccard(base, " ".join(words)) > (0.83 if i % 2 else 0.79):  # a changed word costs up to five shingles
            words[at], at = "new", at + 7
        pairs.append((i, jaccard(base, " ".join(words))))
        rows += [(2 * i, base), (2 * i + 1, " ".join(words))]
    assert any(0.7 < j < 0.8 for _, j in pairs) and any(0.8 <= j < 0.85 for _, j in pairs)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in wide.near_duplicates(docs).collect()}
    assert [got[2 * i + 1] == 2 * i for i, _ in pairs] == [j >= 0.8 for _, j in pairs]


def test_the_filter_loses_nothing():
    apart = np.random.default_rng(1).integers(0, 20, (wide.SEGMENTS, 20_000)).astype(np.uint8)
    assert (wide.chained(apart, 150.0) | (apart.sum(axis=0) > 150)).all()


@pytest.mark.parametrize("block", [128, 8])
def test_groups_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(wide, "BLOCK", block)
    bases = [" ".join(random.choices(WORDS, k=random.choice((3, 30, 300)))) for _ in range(30)]
    hub = " ".join(random.choices(WORDS, k=400))
    texts = [*bases, *bases[:5], *[near_copy(b, 0.005) for b in bases], *[near_copy(hub, 0.004) for _ in range(40)], None, "", " \n", "A B", "a  b"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    got = {r.doc_id: r.component_id for r in wide.near_duplicates(docs).collect()}
    truth = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if jaccard(a, texts[j]) >= 0.8 and truth[i] != truth[j]:
                low, high = sorted((truth[i], truth[j]))
                truth = [low if x == high else x for x in truth]
    assert got == dict(enumerate(truth))


def test_hot_buckets_keep_their_components(spark, monkeypatch):
    """A chain of sets that meet in one bucket, though the first is linked with few of them."""
    monkeypatch.setattr(wide, "BLOCK", 4)
    rows = []
    for i in range(40):
        own = np.arange(100 + 3 * i, 130 + 3 * i, dtype=np.uint64)
        rows.append((i, 30, bytearray(wide.fingerprint(own).tobytes()), own.astype(np.int64).tolist(), [7]))
    sets = spark.createDataFrame(rows, "node long, n long, fp binary, few array<long>, keys array<long>")
    nodes = wide.connected_components(wide.links(sets)).collect()
    assert {r.node for r in nodes} == set(range(40)) and {r.root for r in nodes} == {0}


def test_hot_buckets_of_mixed_sets(spark, monkeypatch):
    """One bucket of near copies of a set, of sets at all distances from it with copies of their own, and of strangers: components as of all pairs."""
    monkeypatch.setattr(wide, "BLOCK", 8)
    rng = np.random.default_rng(9)
    base = np.arange(1000, 1060, dtype=np.uint64)
    sets = [base]
    for k in range(60):
        own = base.copy()
        out = rng.choice(60, rng.integers(0, 1 + k), replace=False)
        own[out] = rng.integers(10**6, 10**9, len(out)).astype(np.uint64)
        sets.append(np.sort(own))
        if k % 3 == 0:  # a near copy of this one
            near = own.copy()
            near[:2] = rng.integers(10**6, 10**9, 2).astype(np.uint64)
            sets.append(np.sort(near))
    sets = list({s.tobytes(): s for s in sets}.values())
    rows = [(i, len(s), bytearray(wide.fingerprint(s).tobytes()), s.astype(np.int64).tolist(), [7]) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "node long, n long, fp binary, few array<long>, keys array<long>")
    got = {r.node: r.root for r in wide.connected_components(wide.links(frame)).collect()}
    truth = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(np.intersect1d(a, sets[j]))
            if n >= 0.8 * (len(a) + len(sets[j]) - n) and truth[i] != truth[j]:
                low, high = sorted((truth[i], truth[j]))
                truth = [low if x == high else x for x in truth]
    assert [got.get(i, i) for i in range(len(sets))] == truth and len(set(truth)) > 10


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "A"), (3, None), (3, ""), (9, "a")], "doc_id long, text string")
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in wide.near_duplicates(docs).collect())
    assert rows == [(False, 3, 3), (False, 3, 3), (False, 9, 9), (True, 0, 9), (True, 0, 9)]
    assert wide.near_duplicates(docs.limit(0)).collect() == []
