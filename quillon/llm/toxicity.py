"""Toxic passages as maximum-scoring segments of token log-odds.

A token's score is its log-odds of standing in a toxic document, from document
counts smoothed by a chain of Dirichlet priors: the whole token's counts are
smoothed towards those of its first six bytes, these towards the first five,
then four, then the rate of all tokens; so a rare form takes after its stem.
Less a cost per token, scores of ordinary text have a negative mean, and a
linear-time scan finds all maximal-scoring segments (Ruzzo and Tompa, 1999).
How often a segment of a score comes about by chance in a text of n tokens
follows an extreme-value law, P = 1 - exp(-K n exp(-L s)) (Karlin and Altschul,
1990): L solves sum p(s) exp(L s) = 1 over token scores of clean documents, K
is fitted to their best segments. A logistic curve over the strongest segment
and the number of significant ones gives the probability of label 1.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import remainder, slices, stored

WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Lengths of a token that are counted, the whole one last, and hash classes of each.
STEMS, BITS = (4, 5, 6, None), 21
STRENGTH = 8.0
COST = 2.0
SIGNIFICANT = 0.01
#: Bound of the labelled rows that are learnt from.
SAMPLE = 100_000
CACHE = 200_000
#: Width and number of the classes of token scores that the background is counted in.
STEP, STEPS = 0.25, 160


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORDS).split()


def classes(token: bytes) -> list[int]:
    """The hash class of the token's beginning for each of STEMS, each in a range of its own; shorter tokens leave out those they lack."""
    return [(i << BITS) + (crc32(token[:n]) & ((1 << BITS) - 1)) for i, n in enumerate(STEMS) if n is None or len(token) > n]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, stop, score) of all maximal-scoring segments, in linear time."""
    up = np.flatnonzero(scores > 0)
    if not up.size:
        return []
    # from here on a run of positive scores is one step, and so is what lies between two runs
    starts = up[np.concatenate([[True], np.diff(up) > 1])]
    stops = up[np.concatenate([np.diff(up) > 1, [True]])] + 1
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    stack: list[list] = []  # [sum before, sum through, start, stop, index below with a smaller sum before]
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        left, right = float(sums[a]), float(sums[b])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append([left, right, a, b, j])
                break
            left, a = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, right - left) for left, right, a, b, _ in stack]


class Scores(dict):
    """Token to score; computed when first asked for, and forgotten when there are too many."""

    def __init__(self, places: np.ndarray, toxic: np.ndarray, all_: np.ndarray, rate: float):
        # memoryviews: single items of them are Python numbers
        self.places, self.toxic, self.all, self.rate = places.data, toxic.data, all_.data, rate

    def __missing__(self, token: bytes) -> float:
        if len(self) >= CACHE:
            self.clear()
        rate = self.rate
        for c in classes(token):
            i = bisect_left(self.places, c)
            if i < len(self.places) and self.places[i] == c:
                rate = (self.toxic[i] + STRENGTH * rate) / (self.all[i] + STRENGTH)
        score = self[token] = log(rate / (1 - rate)) - log(self.rate / (1 - self.rate)) - COST
        return score

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.float32, len(words))


@dataclass
class Model:
    places: np.ndarray
    toxic: np.ndarray
    all: np.ndarray
    rate: float
    law: tuple[float, float] = (1.0, 1.0)
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def scores(self) -> Scores:
        return Scores(self.places, self.toxic, self.all, self.rate)

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + x @ np.array([b, c]), -30, 30)))


def surprise(law: tuple[float, float], score: float | np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """-log10 of the chance of such a segment in n tokens of clean text; at most 300."""
    steep, k = law
    expected = k * np.maximum(n, 1) * np.exp(-np.minimum(steep * np.asarray(score, float), 690))
    return -np.log10(np.maximum(-np.expm1(-expected), 1e-300))


def features(law: tuple[float, float], found: list[float], n: int) -> tuple[float, float]:
    """Of the scores of a text's segments: how strong the strongest is, and how many are significant."""
    each = surprise(law, np.array(found), n) if found else np.zeros(1)
    return float(np.log1p(each.max())), float(np.log1p((each > -np.log10(SIGNIFICANT)).sum()))


def _logistic(x: np.ndarray, y: np.ndarray, weight: float = 1.0) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; slopes stay at 0 or above."""
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([1e-6, *[weight] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-8:
            break
    if (w[1:] < 0).any():
        w[1:] = np.maximum(w[1:], 0)
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic 0/1) that are not held out.

    `sample` bounds the labelled rows that are used (chosen by hash of the id); a
    quarter of them calibrates. Null labels or ids teach nothing, null texts are
    empty, and repeated rows count as often as they stand. Without labels of both
    kinds all scores are the rate of label 1, or 0 without any.
    """
    spark = docs.sparkSession
    own = remainder(F.col("doc_id"))
    marked = labels.where(F.col("toxic").isin(0, 1) & (own >= 0) & (own != 2)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = marked.count()
    if n > sample:
        chance = F.xxhash64("doc_id") / F.lit(float(1 << 64)) + 0.5
        marked = marked.where(chance < sample / n).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    marked = marked.withColumn("calibrates", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(4)) == 0)
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("text", "toxic", "calibrates")

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, list[int]] = {}
        size = len(STEMS) << BITS
        both = [np.zeros(size, np.int32), np.zeros(size, np.int32)]
        number = [0, 0]
        for batch in slices(batches, "text"):
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = set(tokens(text.as_py()))
                number[toxic] += len(own)
                found: set[int] = set()
                for token in own:
                    if (c := memory.get(token)) is None:
                        if len(memory) >= CACHE:
                            memory.clear()
                        c = memory[token] = classes(token)
                    found.update(c)
                both[toxic][np.fromiter(found, np.int64, len(found))] += 1
        seen = np.flatnonzero(both[0] | both[1])
        places = np.concatenate([seen, [-1]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(places, pa.int32()), pa.array(np.concatenate([both[1][seen], [number[1]]]), pa.int64()), pa.array(np.concatenate([both[0][seen], [number[0]]]), pa.int64())],
            ["place", "toxic", "clean"],
        )

    counts = rows.where("not calibrates").select("text", "toxic").mapInArrow(counted, "place int, toxic long, clean long")
    # one row for each hash class at most: bounded by len(STEMS) << BITS; a class seen once says nothing
    table = counts.groupBy("place").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic + clean > 1 or place < 0").toArrow()
    places, toxic, clean = (table.column(c).to_numpy().astype(np.int64) for c in table.column_names)
    total = places < 0
    a, b = int(toxic[total].sum()), int(clean[total].sum())
    if not a or not b:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.float32), 0.0, curve=(30.0 if a else -30.0, 0.0, 0.0))
    order = np.argsort(places)
    order = order[places[order] >= 0]
    model = Model(places[order].astype(np.int32), toxic[order].astype(np.float32), (toxic + clean)[order].astype(np.float32), a / (a + b))
    _calibrate(model, rows.where("calibrates").select("text", "toxic"))
    return model


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Fits the law and the curve to rows (text, toxic).

    Segments are found once and stay in the shared folder. The driver gets, for each text
    of the bounded sample, its length and best score, and then its two features.
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    def scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, background = pickle.loads(sent.value).scores(), np.zeros(STEPS, np.int64)
        names = ["toxic", "n", "best", "found", "background"]
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
        for batch in slices(batches, "text"):
            labels, sizes, found = batch.column(1).to_pylist(), [], []
            for text, toxic in zip(batch.column(0), labels, strict=True):
                got = scores.of(tokens(text.as_py()))
                sizes.append(len(got))
                found.append([s for _, _, s in segments(got)])
                if not toxic:
                    background += np.bincount(np.clip(np.round(got / STEP).astype(np.int64) + STEPS // 2, 0, STEPS - 1), minlength=STEPS)
            best = [max(x, default=0.0) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([labels, sizes, best, found, [None] * len(labels)], kinds, strict=True)], names)
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([None, None, None, None, background], kinds, strict=True)], names)

    got = stored(rows.mapInArrow(scanned, "toxic int, n long, best double, found array<double>, background array<long>"), "segments")
    background = np.zeros(STEPS)
    for r in got.where("background is not null").select(F.posexplode("background").alias("place", "n")).groupBy("place").agg(F.sum("n").alias("n")).collect():  # up to STEPS rows
        background[r.place] = r.n
    docs = got.where("toxic is not null")
    step = (np.arange(STEPS) - STEPS // 2) * STEP
    if background.sum() and (background * step).sum() < 0 and background[step > 0].any():
        share = background / background.sum()
        low, high = 1e-6, 1e-3
        while (share * np.exp(np.minimum(high * step, 600))).sum() < 1:
            high *= 2
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if (share * np.exp(np.minimum(middle * step, 600))).sum() < 1 else (low, middle)
        steep = high
        clean = docs.where("toxic = 0 and n > 0").agg(F.count("*").alias("k"), F.sum(F.col("n") * F.exp(-F.lit(float(steep)) * F.col("best"))).alias("n")).first()
        model.law = (float(steep), float(min((clean.k or 0) / max(1e-9, clean.n or 0), 1.0)))
    law = model.law

    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(law, found.as_py(), n) for found, n in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], ["toxic", "strongest", "number"])

    table = docs.select("toxic", "found", "n").mapInArrow(featured, "toxic int, strongest double, number double").toArrow()  # a quarter of the bounded sample
    y, x = table.column(0).to_numpy().astype(float), np.column_stack([table.column(k).to_numpy() for k in (1, 2)])
    if 0 < y.sum() < len(y):
        model.curve = _logistic(x, y)
    else:
        model.curve = (float(np.log(model.rate / (1 - model.rate))), 1.0, 0.5)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with toxicity (0 to 1) and passages: the significant segments as words start to stop, score and p-value.

    Null and empty texts have no passage and the score of a text without evidence.
    Only `text` is looked at. Columns of docs pass unchanged; clashing ones are replaced.
    """
    new = ["toxicity", "passages"]
    others = [c for c in docs.columns if c not in new]
    held = docs.select(F.struct(*[c for c in others if c != "text"] or [F.lit(0).alias("_")]).alias("_row"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value)
        scores = model.scores()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("p", pa.float64())]))
        for batch in slices(batches, "text"):
            x, passages = [], []
            for text in batch.column(1):
                words = tokens(text.as_py()) if model.rate else []
                got = segments(scores.of(words)) if words else []
                x.append(features(model.law, [s for _, _, s in got], len(words)))
                chances = 10.0 ** -surprise(model.law, np.array([s for _, _, s in got]), len(words)) if got else []
                passages.append([{"start": a, "stop": b, "score": s, "p": float(p)} for (a, b, s), p in zip(got, chances, strict=True) if p < SIGNIFICANT])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.probability(np.array(x))), pa.array(passages, kind)], ["_row", "text", *new])

    kind = held.schema["_row"].dataType.simpleString()
    out = held.mapInArrow(judged, f"_row {kind}, text string, toxicity double, passages array<struct<start:long,stop:long,score:double,p:double>>")
    return out.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in others], *new)
