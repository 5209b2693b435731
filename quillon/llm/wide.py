"""Near-duplicates by the similarity of sets of word shingles, found by wide SimHash fingerprints.

A 64-bit fingerprint tells sets of Jaccard similarity 0.8 from others by no
radius that exact keys can serve: they differ in 10 bits. Here a fingerprint has
1024 bits, and two sets are worth comparing if the angle that its Hamming distance
estimates may stand for the similarity asked for (cosine and sizes give the
Jaccard similarity; ALLOWED standard deviations are added). All links are then
decided by the sets themselves. Sets of up to FEW shingles travel whole; of
the others only those that some pair needs are made again from their texts.

Candidates share a key: the least of four permuted hashes, in 16 bands, which
sets of similarity 0.8 miss with a chance of 0.0002. Pairs of a bucket pass the
pigeonring filter over 16 segments of 64 bits (see simhash.py) before the full
Hamming check, since with over 100 bits of radius no segment is equal for sure.

Only components are wanted, so a bucket of over BLOCK sets is not paired. All its
sets are compared with one of them, the centre, in blocks. What it links needs no more
comparison with each other. Of the rest, sets whose similarity to the centre may be as
low as the threshold allows for a neighbour of what it links (2 s - 1 for s: one
minus the similarity is a distance) are compared with all sets of the bucket; the others
are too far from all that the centre links, and are compared with the rest alone. So no
component falls apart, and a group of near copies costs as much as it has sets;
what is quadratic is the number of sets that share a bucket and are not linked to its
centre.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillon.llm.components import connected_components
from quillon.llm.shared import bounded, handing_back, pieces, redealt, slices, stored

SEGMENTS = 16
BITS = 64 * SEGMENTS
BANDS, BAND_ROWS = 16, 4
#: Sets of up to so many shingles travel with their fingerprints and are compared without them.
FEW = 64
#: Standard deviations by which the radius is widened: of pairs just similar enough, 3 in 100,000 lie beyond.
ALLOWED = 4.0
#: Sets that are compared with each other in one task at once.
BLOCK = 128
#: The longest chains of segments that the filter looks at.
CHAIN = 4
#: Rows, and bytes of them, from which on a Python worker goes through what it holds.
HELD, HELD_BYTES = 8192, 32 << 20

_GOLDEN = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a random-looking bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEPS = np.arange(1, SEGMENTS + 1, dtype=np.uint64) * np.uint64(_GOLDEN)
_MASKS = _mixed(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(_GOLDEN))
_FACTORS = _mixed(_MASKS) | np.uint64(1)
_TIES = np.unpackbits(_mixed(_STEPS).view(np.uint8))


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes, sorted, of the text's shingles of `width` words; of fewer words, the hash of all; of none, 0."""
    found, tail = [], []
    for words in pieces((text or "").encode("utf-8", "replace").lower()):
        words = tail + words
        parts = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
        tail = words[-(width - 1) :] if width > 1 else []
        found.append(np.unique(np.fromiter(map(xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts))))
    hashes = np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.empty(0, np.uint64)
    return hashes if len(hashes) else np.array([xxh64_intdigest(b" ".join(tail), seed) if tail else 0], np.uint64)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SEGMENTS words of 64 bits: a bit is 1 if over half the hashes, each mixed SEGMENTS ways, have it; halves follow a fixed pattern."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255):
        words = _mixed(hashes[at : at + 255, None] + _STEPS)
        counts += np.add.reduce(np.unpackbits(words.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    twice = 2 * counts
    return np.packbits((twice > len(hashes)) | ((twice == len(hashes)) & (_TIES == 1))).view(np.uint64)


def keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band, from the least values of the hashes under the band's permutations."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 4096):
        part = (hashes[at : at + 4096] ^ _MASKS[:, None]) * _FACTORS[:, None]
        least = np.minimum(least, part.min(axis=1))
    return np.array([xxh64_intdigest(least[i : i + BAND_ROWS].tobytes(), i) for i in range(0, len(least), BAND_ROWS)], np.uint64).view(np.int64)


def _whole(width: int, seed: int):
    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingles(t.as_py(), width, seed).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    return hashed


def _hashed(width: int, seed: int):
    names = ["doc_id", "mark", "node", "n", "fp", "few", "keys"]

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                own = shingles(text.as_py(), width, seed)
                node = np.array([xxh64_intdigest(own.tobytes())], np.uint64).view(np.int64)[0]
                rows.append((node, len(own), fingerprint(own).tobytes(), own.view(np.int64) if len(own) <= FEW else (), keys(own)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return hashed


def radius(similarity: float, a: np.ndarray | int = 1, b: np.ndarray | int = 1) -> np.ndarray:
    """Bits in which fingerprints of sets of a and b shingles that are worth comparing may differ; equal sizes have the widest radius."""
    cosine = np.minimum(similarity / (1 + similarity) * (a + b) / np.sqrt(np.multiply(a, b, dtype=np.float64)), 1)
    p = np.arccos(cosine) / math.pi
    return BITS * p + ALLOWED * np.sqrt(BITS * p * (1 - p))


def chained(apart: np.ndarray, threshold: float) -> np.ndarray:
    """Whether, of the distances by segment (first axis), chains from some segment stay within their share of the threshold."""
    out = np.zeros(apart.shape[1:], bool)
    share = threshold / len(apart)
    for start in range(len(apart)):
        total = apart[start].astype(np.uint16)
        ok = total <= share
        for n in range(2, CHAIN + 1):
            if not ok.any():
                break
            total += apart[(start + n - 1) % len(apart)]
            ok &= total <= n * share
        out |= ok
    return out


def candidates(fps: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows left x right, those worth comparing: all of two short sets, and those within the radius."""
    a, b = np.nonzero(np.minimum(sizes[left][:, None], sizes[right]) >= similarity * np.maximum(sizes[left][:, None], sizes[right]))
    a, b = left[a], right[b]
    keep = a != b if left is not right else a < b
    a, b = a[keep], b[keep]
    found = (sizes[a] <= FEW) & (sizes[b] <= FEW)
    wide = float(radius(similarity))
    rough = np.flatnonzero(~found)
    for at in range(0, len(rough), 1 << 15):
        part = rough[at : at + (1 << 15)]
        apart = np.bitwise_count(fps[:, a[part]] ^ fps[:, b[part]])
        ok = np.flatnonzero(chained(apart, wide))
        part, total = part[ok], apart[:, ok].sum(axis=0)
        found[part] = total <= radius(similarity, sizes[a[part]], sizes[b[part]])
    return a[found], b[found]


def _similar(sets: Sequence, similarity: float) -> Callable[[int, int], bool]:
    """Whether two of the sets are similar enough, exactly."""
    seen: dict[int, frozenset] = {}

    def similar(i: int, j: int) -> bool:
        if len(sets[i]) > FEW:
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        else:
            x, y = (seen.get(k) or seen.setdefault(k, frozenset(sets[k])) for k in (i, j))
            common = len(x & y)
        return common >= similarity * (len(sets[i]) + len(sets[j]) - common)

    return similar


def linked(fps: np.ndarray, sizes: np.ndarray, sets: Sequence, left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows left x right, those that are linked."""
    a, b = candidates(fps, sizes, left, right, similarity)
    found = np.fromiter(map(_similar(sets, similarity), a.tolist(), b.tolist()), bool, len(a))
    return a[found], b[found]


def _forest(a: np.ndarray, b: np.ndarray, similar: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Of the pairs those that are similar, without some that lie between rows already tied together."""
    root: dict[int, int] = {}

    def top(i: int) -> int:
        while (up := root.setdefault(i, i)) != i:
            root[i] = root[up]
            i = root[i]
        return i

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x2, y2 = top(x), top(y)
        if x2 != y2 and similar(x, y):
            root[max(x2, y2)] = min(x2, y2)
            out.append((x, y))
    return out


def _by_part(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows sorted by their first column, in tables of whole parts, with the ranges of parts of two rows or more."""
    held: list[pa.Table] = []

    def cut(table: pa.Table) -> np.ndarray:
        part = table.column(0).to_numpy()
        return np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))

    def ranges(table: pa.Table) -> tuple[pa.Table, list[tuple[int, int]]]:
        edges = cut(table).tolist()
        return table, [(s, e) for s, e in zip(edges[:-1], edges[1:], strict=True) if e - s > 1]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < HELD and sum(t.nbytes for t in held) < HELD_BYTES:
            continue
        table = pa.concat_tables(held)
        whole = int(cut(table)[-2])  # the last part may go on
        if whole:
            yield ranges(table.slice(0, whole))
        held = [table.slice(whole)]
    if held:
        yield ranges(pa.concat_tables(held))


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows to be compared: with each other for side 2, else across sides 0 and 1."""
    if side[0] == 2:
        every = np.arange(len(side))
        return every, every
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def _prints(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SEGMENTS).T


SIFTED = "part long, side int, node long, n long, fp binary"


def _sifter(similarity: float):
    """Of rows (part, side, node, n, fp, few) sorted by part, those in a pair of their part that is worth comparing.

    Pairs of two short sets are compared here, since their sets are at hand.
    """

    def sifted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ranges in _by_part(batches):
            side, sizes, fps = table.column(1).to_numpy(), table.column(3).to_numpy(), _prints(table.column(4))
            wanted = np.zeros(table.num_rows, bool)
            for s, e in ranges:
                a, b = candidates(fps[:, s:e], sizes[s:e], *_sides(side[s:e]), similarity)
                short = (sizes[s:e][a] <= FEW) & (sizes[s:e][b] <= FEW)
                if short.any():
                    similar = _similar(table.column(5).slice(s, e - s).to_pylist(), similarity)
                    ok = ~short
                    ok[short] = np.fromiter(map(similar, a[short].tolist(), b[short].tolist()), bool, int(short.sum()))
                    a, b = a[ok], b[ok]
                wanted[s + a] = wanted[s + b] = True
            yield from table.select(range(5)).filter(pa.array(wanted)).to_batches()

    return sifted


def _verifier(similarity: float):
    """Rows (part, side, node, n, fp, hashes) sorted by part to links (u, v): within a part for side 2, else across sides 0 and 1."""

    def verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ranges in _by_part(batches):
            side, node, sizes, fps = table.column(1).to_numpy(), table.column(2).to_numpy(), table.column(3).to_numpy(), _prints(table.column(4))
            us, vs = [], []
            for s, e in ranges:
                similar = _similar([x.values.to_numpy() for x in table.column(5).slice(s, e - s)], similarity)
                for x, y in _forest(*candidates(fps[:, s:e], sizes[s:e], *_sides(side[s:e]), similarity), similar):
                    us.append(node[s + x])
                    vs.append(node[s + y])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return verified


def links(sets: DataFrame, similarity: float = 0.8, whole: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(u, v): links between nodes of sets (node, n, fp, few, keys) that tie together what all links between them tie together.

    `whole` gives (node, hashes) of distinct nodes (node); without it all sets must be in `few`.
    """
    whole = whole or (lambda nodes: sets.join(nodes, "node", "left_semi").select("node", F.col("few").alias("hashes")))
    body = sets.select("node", "n", "fp", "few")
    entries = sets.select("node", F.explode("keys").alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("rows"), F.bit_xor("node").alias("x"), F.sum(F.hash("node").cast("long")).alias("s"), F.min("node").alias("centre")).where("rows > 1")
    # buckets of the same sets count once
    once = sizes.groupBy("rows", "x", "s", "centre").agg(F.min("key").alias("key")).select("key", "rows", "centre")
    met = stored(entries.join(redealt(once, "key"), "key"), "buckets")

    def sorted_parts(dealt: DataFrame) -> DataFrame:
        of = [c for c in dealt.columns if c not in ("node", "side")]
        ready = dealt.join(body, "node").withColumn("part", F.xxhash64(*of)).repartition("part").sortWithinPartitions("part")
        return ready.select("part", "side", "node", "n", "fp", "few")

    def check(dealt: DataFrame) -> DataFrame:
        """dealt: (node, side, and columns of the part), each part sorted into one task."""
        met = stored(sorted_parts(dealt).mapInArrow(_sifter(similarity), SIFTED), "candidates")
        ready = met.join(whole(met.select("node").distinct()), "node").repartition("part").sortWithinPartitions("part")
        return ready.select("part", "side", "node", "n", "fp", "hashes").mapInArrow(handing_back(_verifier(similarity)), "u long, v long")

    near = stored(check(met.where(F.col("rows") <= BLOCK).select("node", "key", F.lit(2).alias("side"))), "links")
    hot = met.where(F.col("rows") > BLOCK).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    if hot.isEmpty():
        return near
    block = lambda n, *salt: F.pmod(F.xxhash64("node", *salt), F.col(n)).cast("int")
    centres = hot.where("node = centre").select("node", "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"))
    around = centres.unionByName(hot.where("node <> centre").select("node", "key", block("blocks").alias("block"), F.lit(1).alias("side")))
    star = stored(check(around), "links")
    tied = star.select(F.col("u").alias("centre"), F.col("v").alias("node")).distinct()
    close = stored(sorted_parts(around).mapInArrow(_sifter(max(0.0, 2 * similarity - 1)), SIFTED).where("side = 1").select("part", "node").withColumn("close", F.lit(True)), "close")
    rest = hot.where("node <> centre").join(tied, ["centre", "node"], "left_anti").select("node", "key", "blocks").withColumn("part", F.xxhash64("key", block("blocks").alias("block")))
    rest = stored(rest.join(close, ["part", "node"], "left").select("node", "key", "blocks", F.coalesce("close", F.lit(False)).alias("close")), "rest")
    counts = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.ceil(F.count_if("close") / BLOCK).cast("int").alias("queries"))
    counts = bounded(stored(counts, "counts"))
    every = rest.join(counts, "key")
    # the rest with itself: of two blocks the lower is side 0; a block with itself side 2
    own = every.withColumn("own", block("parts", F.lit(1))).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = own.select("node", "key", F.lit(0).alias("kind"), F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), F.when(F.col("own") == F.col("with"), 2).when(F.col("own") > F.col("with"), 1).otherwise(0).alias("side"))
    # what is close to the centre with what the centre links
    asking = every.where("close").select("node", "key", F.lit(1).alias("kind"), block("queries", F.lit(1)).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"))
    asked = hot.join(counts.where("queries > 0"), "key").join(rest.select("node", "key"), ["node", "key"], "left_anti")
    asked = asked.select("node", "key", F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("queries") - 1)).alias("i"), block("blocks").alias("j"), F.lit(1).alias("side"))
    return near.union(star).union(stored(check(own.unionByName(asking).unionByName(asked)), "links"))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, mark, root, component_id): a row for each row of docs (doc_id, text).

    Linked are texts whose sets of shingles have the similarity or more; see the
    module. Words lie between ASCII white space, with A-Z in lower case. Texts
    without words, nulls included, are linked with each other. component_id is the
    smallest doc_id that links reach, itself included; null ids never name a
    component, and rows that reach nulls alone get null. root stands for the
    component, mark is xxhash64 of the text. Rows with one doc_id keep a row each.
    Other columns of docs are not read.
    """
    schema = "doc_id long, mark long, node long, n long, fp binary, few array<long>, keys array<long>"
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text")).mapInArrow(handing_back(_hashed(width, seed)), schema), "fingerprints")
    least = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.max(F.struct("doc_id", "mark")).alias("one"), *[F.first(c).alias(c) for c in ("n", "fp", "few", "keys")])
    least = stored(least, "distinct")

    def whole(nodes: DataFrame) -> DataFrame:
        """The sets of nodes, from a text of each."""
        wanted = least.join(nodes, "node", "left_semi").select("node", F.col("one.doc_id").alias("_id"), F.col("one.mark").alias("_mark"))
        wanted = bounded(stored(wanted, "wanted"))
        texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), "text").withColumn("_hash", F.xxhash64("text"))
        texts = texts.join(wanted, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_mark"))).select("node", "text")
        made = texts.mapInArrow(handing_back(_whole(width, seed)), "node long, hashes array<long>")
        return stored(made.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")

    nodes = connected_components(links(least, similarity, whole))
    named = least.select("node", "least").join(nodes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named, "named")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(redealt(smallest, "root"), "root").select("node", "root", "component_id")
    return rows.select("doc_id", "mark", "node").join(labels, "node").select("doc_id", "mark", "root", "component_id")
