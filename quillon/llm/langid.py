"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed byte n-grams, weighted by TF-IDF and
normalised. Document frequencies come from all documents that may be learnt
from. The centroids are clusters (spherical k-means) of a sample of each
language's vectors; the language of the centroid with the largest cosine is
predicted. A text whose largest cosine is below the language's floor for texts of
its length is far from everything learnt: rejected. Floors come from cosines of
texts to centroids that were learnt without them.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import handing_back, remainder, slices, stored

DIMS = 4096
GRAMS = (1, 2, 3)
CENTROIDS = 4
#: Bound of the sample: documents of a language that its centroids are clustered from.
SAMPLE = 500
SHARPNESS = 25.0
#: Lengths (log2) for which a language has a floor; between them floors change linearly.
KNOTS = np.arange(2, 14)
#: A floor is so much of the cosine that so few of the texts of about the length stay under.
SLACK, UNDER = 0.85, 0.002
#: The length (log2) from which on texts have one floor at most.
LONG = 8
#: Texts whose vectors a worker holds at once, and bytes of text whose n-grams it counts at once: with DIMS, each byte takes over 60 in arrays.
ROWS, SLICE_BYTES = 128, 256 << 10
LETTER = re.compile(r"[^\W\d_]")
RUN = re.compile(rb"  +")
PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text or ""))


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """For each text its number of n-grams in each of DIMS hash classes.

    Letters in lower case, all else as a space, runs of spaces as one, one at both ends.
    """
    plain = [b" " + RUN.sub(b" ", (t or "").lower().encode("utf-8", "replace").translate(PLAIN)).strip(b" ") + b" " for t in texts]
    out = np.zeros((len(texts), DIMS), np.float32)
    first = 0
    while first < len(plain):  # texts together, or a long text in parts
        last, size = first, 0
        while last < len(plain) and (last == first or size + len(plain[last]) <= SLICE_BYTES):
            size += len(plain[last])
            last += 1
        for at in range(0, size, SLICE_BYTES):
            data = b"".join(plain[first:last]) if size <= SLICE_BYTES else plain[first][at : at + SLICE_BYTES + max(GRAMS) - 1]
            codes = np.frombuffer(data, np.uint8).astype(np.uint32)
            sizes = [len(x) for x in plain[first:last]] if size <= SLICE_BYTES else [len(data)]
            row = np.repeat(np.arange(len(sizes), dtype=np.int64) * DIMS, sizes)
            gram = np.zeros_like(codes)
            for n in range(1, max(GRAMS) + 1):
                gram = (gram[: len(codes) - n + 1] << np.uint32(8)) | codes[n - 1 :]
                here = row[: len(gram)]
                if n not in GRAMS or not len(gram):
                    continue
                key = ((gram + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64) + here
                inside = here == row[n - 1 :]
                if size > SLICE_BYTES and at + SLICE_BYTES < size:
                    inside &= np.arange(len(key)) < SLICE_BYTES  # the rest belongs to the next part
                out[first:last] += np.bincount(key[inside], minlength=len(sizes) * DIMS).reshape(-1, DIMS)
        first = last
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def cluster(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Up to k centroids of unit vectors, by spherical k-means from farthest-first seeds."""
    centres = [0]
    best = vectors @ vectors[0]
    while len(centres) < min(k, len(vectors)) and best.min() < 1 - 1e-6:
        centres.append(int(best.argmin()))
        best = np.maximum(best, vectors @ vectors[centres[-1]])
    found = vectors[centres]
    for _ in range(rounds):
        own = (vectors @ found.T).argmax(1)
        found = _unit(np.stack([vectors[own == i].mean(0) if (own == i).any() else found[i] for i in range(len(found))]))
    return found


def _lengths(counts: np.ndarray) -> np.ndarray:
    """About log2 of the bytes that n-grams were counted in."""
    return np.log2(np.maximum(counts.sum(1) / len(GRAMS), 1))


def floors_of(lengths: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """A floor for each of KNOTS, from texts of half to twice the length; it never falls with the length.

    Between lengths with texts floors are interpolated; below all texts they fall with the square root of the
    length. Without texts nothing is rejected.
    """
    out = np.full(len(KNOTS), np.nan)
    for i, knot in enumerate(KNOTS):
        near = cosines[np.abs(lengths - knot) <= 1]
        if len(near):
            out[i] = SLACK * np.quantile(near, UNDER)
    known = np.flatnonzero(~np.isnan(out))
    if not len(known):
        return np.zeros(len(KNOTS))
    out = np.interp(KNOTS, KNOTS[known], out[known])
    out[: known[0]] *= 2.0 ** ((KNOTS[: known[0]] - KNOTS[known[0]]) / 2)
    if (long := lengths >= LONG).any():
        out = np.minimum(out, SLACK * np.quantile(cosines[long], UNDER))  # no higher where a few texts happen to be good
    return np.minimum.accumulate(out[::-1])[::-1]


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        return self.weigh(gram_counts(texts))

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
        """The language, how sure (0 to 1), and whether it is rejected."""
        counts = gram_counts(texts)
        cosines = self.weigh(counts) @ self.centroids.T if len(self.centroids) else np.zeros((len(texts), 0))
        by = np.stack([cosines[:, self.owner == i].max(1) for i in range(len(self.languages))], 1) if self.languages else cosines
        for text, row, length in zip(texts, by, _lengths(counts), strict=True):
            if not self.languages or not has_letter(text):
                yield "und", 0.0, True
                continue
            best = int(row.argmax())
            yield self.languages[best], float(1 / np.exp(SHARPNESS * (row - row[best])).sum()), bool(row[best] < np.interp(length, KNOTS, self.floors[best]))


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learns from text and lang of docs (doc_id, text, lang) that are not held out.

    Rows with a null lang, id or text teach nothing. `sample` bounds the documents
    of each language that are clustered; of equal rows (id and text) one is enough for
    that. Document frequencies count all.
    """
    spark = docs.sparkSession
    chance = (F.xxhash64("doc_id", "text") / F.lit(float(1 << 64)) + 0.5).alias("chance")
    taught = docs.where((remainder(F.col("doc_id")) >= 0) & (remainder(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in taught.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}  # a row for each language
    shares = spark.sparkContext.broadcast({lang: sample / n for lang, n in sizes.items()})

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, total, n, taken = shares.value, np.zeros(DIMS, np.int64), 0, set()
        names = ["lang", "chance", "places", "counts", "df", "n"]
        kinds = [pa.string(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.int64()), pa.int64()]
        for batch in slices(batches, "text", rows=ROWS):
            grams = gram_counts(batch.column(0).to_pylist())
            total += (grams > 0).sum(0)
            n += len(grams)
            langs, chances = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            chosen = []
            for i, (lang, c) in enumerate(zip(langs, chances, strict=True)):
                if c < share[lang] and (lang, c) not in taken:  # rows that repeat are one: the sample stays bounded
                    taken.add((lang, c))
                    chosen.append(i)
            if chosen:
                places = [np.flatnonzero(grams[i]) for i in chosen]
                rows = [[langs[i] for i in chosen], [chances[i] for i in chosen], places, [grams[i][p] for i, p in zip(chosen, places, strict=True)], [None] * len(chosen), [None] * len(chosen)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([None, None, None, None, total, n], kinds, strict=True)], names)

    schema = "lang string, chance double, places array<int>, counts array<float>, df array<long>, n long"
    seen = stored(taught.select("text", "lang", chance).mapInArrow(handing_back(counted), schema), "grams")
    df = np.zeros(DIMS)
    for r in seen.where("n is not null").select(F.posexplode("df").alias("place", "df")).groupBy("place").agg(F.sum("df").alias("df")).collect():
        df[r.place] = r.df
    total = sum(sizes.values())
    model = Model(list(sizes), np.zeros(0, np.int64), np.zeros((0, DIMS), np.float32), (np.log((total + 1) / (df + 1)) + 1).astype(np.float32), np.zeros((len(sizes), len(KNOTS))))
    owner, found, held = [], [], []
    for i, lang in enumerate(sizes):
        rows = seen.where(F.col("lang") == lang).select("chance", "places", "counts").dropDuplicates(["chance"]).orderBy("chance").limit(2 * sample).toArrow()
        counts = np.zeros((rows.num_rows, DIMS), np.float32)
        for k, (p, c) in enumerate(zip(rows.column(1), rows.column(2), strict=True)):
            counts[k, p.values.to_numpy()] = c.values.to_numpy()
        if not len(counts):
            continue
        vectors = model.weigh(counts)
        own = cluster(vectors, centroids)
        if len(vectors) > 1:  # each half by what the other teaches
            halves = [(vectors[k::2] @ cluster(vectors[1 - k :: 2], centroids).T).max(1) for k in (0, 1)]
            lengths = _lengths(counts)
            held.append((i, np.concatenate([lengths[0::2], lengths[1::2]]), np.concatenate(halves)))
        found.append(own)
        owner += [i] * len(own)
    if held:  # a language that has few texts of a length takes over what the others have, if it is lower
        every = floors_of(np.concatenate([x for _, x, _ in held]), np.concatenate([x for *_, x in held]))
        for i, lengths, cosines in held:
            model.floors[i] = np.minimum(floors_of(lengths, cosines), every)
    kept = sorted(set(owner))  # a language may have no sampled document
    model.languages, model.floors = [model.languages[i] for i in kept], model.floors[kept]
    model.owner = np.array([kept.index(i) for i in owner], np.int64)
    model.centroids = np.concatenate(found).astype(np.float32) if found else model.centroids
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1) and rejected.

    A text that is null or has no letter gets `und`, 0 and true; so does every
    text if no language was learnt. Ties go to the language first in order. Only
    `text` is looked at. Columns of docs pass unchanged; clashing ones are replaced.
    """
    new = ["lang_pred", "lang_score", "rejected"]
    others = [c for c in docs.columns if c not in new]
    held = docs.select(F.struct(*[c for c in others if c != "text"] or [F.lit(0).alias("_")]).alias("_row"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value)
        for batch in slices(batches, "text", rows=ROWS):
            got = list(zip(*model.predict(batch.column(1).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, k) for x, k in zip(got, (pa.string(), pa.float64(), pa.bool_()), strict=True))], ["_row", "text", *new])

    kind = held.schema["_row"].dataType.simpleString()
    out = held.mapInArrow(handing_back(judged), f"_row {kind}, text string, lang_pred string, lang_score double, rejected boolean")
    return out.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in others], *new)
