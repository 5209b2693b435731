"""SimHash groups against brute force, and the pigeonring filter's promise."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import simhash
from quillon.llm.components import connected_components

random.seed(3)
WORDS = [f"w{i}" for i in range(400)]


def plain(text, width=3):
    words = [w for w in __import__("re").split(r"[ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    """doc -> smallest doc that links reach, by comparing all pairs."""
    near = {a: {b for b in fps if bin(fps[a] ^ fps[b]).count("1") <= 2} for a in fps}
    out = {}
    for a in sorted(fps):
        if a not in out:
            todo, seen = [a], {a}
            while todo:
                for b in near[todo.pop()] - seen:
                    seen.add(b)
                    todo.append(b)
            out |= dict.fromkeys(seen, a)
    return out


def texts():
    base = [" ".join(random.choices(WORDS, k=random.choice((5, 40, 300)))) for _ in range(60)]
    near = [b.replace(" w1", " w2", 1) + (" end" if i % 2 else "") for i, b in enumerate(base * 3)]
    return [None, "", " \t\n", "one", "One", "ÉÀ x", "a b", "a\x0bb\x1cc", *base, *near, *base[:5]]


def test_fingerprints():
    for text in texts():
        assert simhash.simhash(text) == plain(text)
    long = " ".join(random.choices(WORDS, k=30_000))
    parts = simhash.pieces.__defaults__
    simhash.pieces.__defaults__ = (1000,)
    try:
        assert simhash.simhash(long) == plain(long)
        assert simhash.simhash("  x  " * 600) == plain("  x  " * 600)
    finally:
        simhash.pieces.__defaults__ = parts


@pytest.mark.parametrize("bucket", [64, 2])
def test_groups_equal_brute_force(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, fp long, component_id string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: plain(t) for i, t in rows}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == groups(fps)


@pytest.mark.parametrize("bucket", [64, 3])
def test_links_of_clustered_fingerprints(spark, bucket, monkeypatch):
    """Many fingerprints around few centres: buckets overflow and chains of links matter."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket)
    rng = np.random.default_rng(5)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 6).tolist():
        for _ in range(60):
            x = centre
            for b in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                x ^= 1 << b
            fps.add(x if x < 1 << 63 else x - (1 << 64))
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = simhash.links(df)
    assert edges.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > 2).isEmpty()
    root = {r.node: r.root for r in connected_components(edges).collect()}
    unsigned = {x: x % (1 << 64) for x in fps}
    want = groups(unsigned)
    smallest = {}
    for x in fps:
        smallest.setdefault(want[x], set()).add(x)
    for members in smallest.values():
        assert {root.get(x, x) for x in members} == {min(members)}


@pytest.mark.parametrize("threshold,segments", [(0, 3), (1, 3), (1, 4), (2, 5), (2, 7)])
def test_pigeonring(spark, threshold, segments):
    """Every pair within the threshold has a start from which all chains keep their budgets."""
    equal, masks, budgets = simhash.ring(segments, threshold)
    for _ in range(300):
        diff = sum(1 << b for b in random.sample(range(64), threshold))
        assert any(all(bin(diff & masks[n][i]).count("1") <= budgets[n] for n in range(segments)) for i in range(segments))
    assert equal >= 1
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long"), 3)


def test_lower_thresholds(spark):
    fps = [0, 1, 3, 7, 1 << 62]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    pairs = lambda t: {tuple(sorted(r)) for r in simhash.links(df, t, 3).collect()}
    assert pairs(0) == set()
    assert pairs(1) == {(0, 1), (1, 3), (3, 7), (0, 1 << 62)}


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "q r s t u"), (9, None), (8, "")]
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=str) == sorted([(None, 3), (3, 3), (3, 3), (None, None), (9, 8), (8, 8)], key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(61), 0) | dict.fromkeys(range(100, 140), 100) | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
