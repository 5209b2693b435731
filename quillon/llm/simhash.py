"""SimHash near-duplicates, with candidates pruned by the pigeonring principle.

A 64-bit fingerprint is cut into m segments that lie on a ring. If two
fingerprints differ in at most t bits, there is a segment from which every
chain of l consecutive segments differs in at most l*t/m bits, for all l up to
m (Qin and Xiao, "Pigeonring", 2018). The budget of the first chains is below
one bit, so those segments are equal and serve as the key of a bucket; the
longer chains prune the pairs of a bucket before the full Hamming check. With
m = 5 and t = 2 the key has 25 or 26 bits and a fingerprint has 5 keys.

A bucket of over BUCKET_ROWS fingerprints is not paired: each of its
fingerprints is listed under itself and its 64 neighbours at one bit. Two
fingerprints share such a point if and only if they differ in at most 2 bits,
and a point has at most 65 members. So a fingerprint costs at most
m * BUCKET_ROWS / 2 comparisons and 65 rows, however large its group is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillon.llm.components import connected_components
from quillon.llm.shared import pieces, redealt, stored

BITS = 64
BUCKET_ROWS = 64


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of the text's word shingles, repeats included; 0 without words.

    Words lie between ASCII white space, with A-Z in lower case; a text of fewer
    words than `width` is one shingle. A bit is 1 if over half the hashes have it.
    """
    counts, total, tail = np.zeros(BITS, np.int64), 0, []
    for words in pieces((text or "").encode("utf-8", "replace").lower()):
        words = tail + words
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
        tail = words[-(width - 1) :] if width > 1 else []
        for at in range(0, len(shingles), 1 << 16):
            part = shingles[at : at + (1 << 16)]
            hashes = np.fromiter(map(xxh64_intdigest, part, repeat(seed)), np.uint64, len(part))
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(shingles)
    if not total:
        return xxh64_intdigest(b" ".join(tail), seed) if tail else 0
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, mark, fp): a row for each row of docs (doc_id, text); fp holds the 64 bits as a long, mark is xxhash64 of the text."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(x.as_py(), width, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "mark", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text")).mapInArrow(hashed, "doc_id long, mark long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring(segments: int, threshold: int) -> tuple[int, list[list[int]], list[int]]:
    """How many segments a key has; for each chain length, the bits of the chain from each segment; its budget."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    own = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [[sum(own[(i + k) % segments] for k in range(n)) for i in range(segments)] for n in range(1, segments + 1)]
    budgets = [n * threshold // segments for n in range(1, segments + 1)]
    return budgets.count(0), masks, budgets


def links(fps: DataFrame, threshold: int = 2, segments: int = 5) -> DataFrame:
    """(u, v): links between distinct fingerprints fp; all that are linked at up to `threshold` bits are connected by them."""
    if not 0 <= threshold <= 2 or segments <= threshold:
        raise ValueError("threshold must be 0, 1 or 2 and below the number of segments")
    equal, masks, budgets = ring(segments, threshold)
    fps = fps.select("fp")
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(_signed(m)) for m in masks[equal - 1]])).alias("start", "key"))
    sizes = keyed.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(keyed.join(redealt(sizes, "key"), ["start", "key"]).select("start", "key", "fp", (F.col("n") > BUCKET_ROWS).alias("hot")), "buckets")

    def allowed(x: Column) -> Column:
        ok = F.lit(True)
        for n in range(equal, segments):
            of = F.element_at(F.array(*[F.lit(_signed(m)) for m in masks[n]]), F.col("start") + 1)
            ok = ok & (F.bit_count(x.bitwiseAND(of)) <= budgets[n])
        return ok

    groups = met.where("not hot").groupBy("start", "key").agg(F.collect_list("fp").alias("g"))
    partners = F.transform(
        "g",
        lambda a, i: F.transform(
            F.filter(F.slice("g", i + 2, F.size("g")), lambda b: allowed(a.bitwiseXOR(b))),
            lambda b: F.struct(a.alias("u"), b.alias("v")),
        ),
    )
    near = groups.select(F.explode(F.flatten(partners)).alias("e")).select("e.u", "e.v")

    hot = met.where("hot").select("fp").distinct()
    points = hot.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))).alias("z"))
    balls = points.groupBy("z").agg(F.collect_list("fp").alias("g")).where(F.size("g") > 1)
    around = balls.select(F.array_min("g").alias("u"), F.explode("g").alias("v")).where("u <> v")
    around = around.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold)
    if threshold < 2:  # members of a ball may differ in 2 bits: star links alone would lose some
        pairs = F.transform("g", lambda a: F.transform(F.filter("g", lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= threshold)), lambda b: F.struct(a.alias("u"), b.alias("v"))))
        around = balls.select(F.explode(F.flatten(pairs)).alias("e")).select("e.u", "e.v")
    return near.union(around)


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, threshold: int = 2, segments: int = 5) -> DataFrame:
    """(doc_id, mark, fp, root, component_id): a row for each row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach, itself included. Rows
    with null or empty texts have fingerprint 0 and link like any other. A null
    doc_id never names a component; rows that reach nulls alone get null. root is
    the smallest fingerprint of the component, and mark is xxhash64 of the text. Rows
    with one doc_id keep a row each. Other columns of docs are not read.
    """
    rows = stored(fingerprints(docs, width, seed), "fingerprints")
    least = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    nodes = connected_components(links(least, threshold, segments))
    named = least.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named, "named")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(redealt(smallest, "root"), "root").select("fp", "root", "component_id")
    return rows.join(labels, "fp").select("doc_id", "mark", "fp", "root", "component_id")
