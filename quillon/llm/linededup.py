"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables.

A LineIndex has three tables. `refs` says in how many rows a document holds a
line's key; `counts` has for each key the number of documents and the largest
doc_id; `filters` has, for each shard of the keys, a cuckoo filter of the keys
that reach the document threshold. Inserting or deleting documents makes a new
index: only keys of those documents are counted anew, and only they enter or
leave the filters. Applying an index to documents brings each shard's lines to its
filter and looks up what that lets through in the exact counts, so the filters'
rare false positives change nothing. Filters are neither collected nor broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from quillon.llm.shared import bounded, handing_back, stored

BLANKS = " \t\n\r\x0b\x0c"
SEATS = 4
#: Most of a filter's seats that are taken when it is built; it is rebuilt larger above the second figure.
LOAD, FULL = 0.5, 0.9
#: Keys of a shard on average, above which shards are doubled.
SHARD_KEYS = 1 << 17
#: Lines that are asked of one copy of a filter at least, and about how many bytes a line's row has.
PART_LINES, LINE_BYTES = 8192, 32
REFS = "key binary, doc_id long, n long"
COUNTS = "key binary, documents long, holder long"
FILTERS = "shard int, used long, buckets long, bits binary"


def line_key(line: str, least: int) -> bytes | None:
    """16 bytes for the line without blanks at both ends and with A-Z in lower case; None below `least` code points."""
    line = line.strip(BLANKS)
    return xxh3_128_digest(line.encode("utf-8", "replace").lower()) if len(line) >= least else None


class Cuckoo:
    """Buckets of four 16-bit fingerprints; 0 marks an empty seat."""

    def __init__(self, bits: bytes | None, buckets: int):
        self.table = np.frombuffer(bits, np.uint16).reshape(-1, SEATS).copy() if bits else np.zeros((buckets, SEATS), np.uint16)
        self.mask = np.uint64(len(self.table) - 1)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: n x 2 uint64. The fingerprints and both buckets of each."""
        marks = (keys[:, 1] & np.uint64(0xFFFF)) | np.uint64(1)
        first = keys[:, 0] & self.mask
        return marks.astype(np.uint16), first, self.other(first, marks)

    def other(self, bucket: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return bucket ^ ((marks.astype(np.uint64) * np.uint64(0x5BD1E995)) & self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        marks, a, b = self.places(keys)
        return (self.table[a] == marks[:, None]).any(1) | (self.table[b] == marks[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if some key found no seat after 500 moves; the caller builds a larger filter then."""
        table, marks, a, b = self.table, *self.places(keys)
        for mark, here, there in zip(marks.tolist(), a.tolist(), b.tolist(), strict=True):
            for at in (here, there):
                if (free := np.flatnonzero(table[at] == 0)).size:
                    table[at, free[0]] = mark
                    break
            else:
                at = there
                for move in range(500):
                    seat = move % SEATS
                    mark, table[at, seat] = int(table[at, seat]), mark
                    at = int(self.other(np.array([at], np.uint64), np.array([mark], np.uint64))[0])
                    if (free := np.flatnonzero(table[at] == 0)).size:
                        table[at, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """The keys must have been inserted."""
        marks, a, b = self.places(keys)
        for mark, here, there in zip(marks.tolist(), a.tolist(), b.tolist(), strict=True):
            at = here if (self.table[here] == mark).any() else there
            seat = np.flatnonzero(self.table[at] == mark)
            if seat.size:
                self.table[at, seat[0]] = 0


def _numbers(keys: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def _refs(docs: DataFrame, least: int) -> DataFrame:
    """(key, doc_id, n): in how many rows the document holds the line."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = {k for line in (text.as_py() or "").split("\n") if len(line) >= least and (k := line_key(line, least))}
                keys += found
                owners += [doc] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(owners, pa.int64())], ["key", "doc_id"])

    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(handing_back(listed), "key binary, doc_id long")
    return lines.groupBy("key", "doc_id").agg(F.count("*").alias("n"))


def _built(keys: DataFrame) -> DataFrame:
    """A filter for each shard of keys (key, shard)."""

    def build(keys: pd.DataFrame) -> pd.DataFrame:
        add = _numbers(keys.key)
        buckets = 1 << max(4, int(len(add) / SEATS / LOAD)).bit_length()
        while not (table := Cuckoo(None, buckets)).insert(add):
            buckets *= 2
        return pd.DataFrame({"shard": [int(keys.shard.iloc[0])], "used": [len(add)], "buckets": [buckets], "bits": [table.table.tobytes()]})

    return keys.groupBy("shard").applyInPandas(build, FILTERS)


def _changed_filter(filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter with keys added and deleted; without bits if it must be built anew."""
    shard = int((filters if len(filters) else keys).shard.iloc[0])
    overfull = pd.DataFrame({"shard": [shard], "used": [0], "buckets": [0], "bits": [None]})
    if not len(filters):
        return overfull
    used, buckets = int(filters.used.iloc[0]), int(filters.buckets.iloc[0])
    if not len(keys):
        return filters[["shard", "used", "buckets", "bits"]]
    add, gone = _numbers(keys.key[keys["add"]]), _numbers(keys.key[~keys["add"]])
    used += len(add) - len(gone)
    table = Cuckoo(filters.bits.iloc[0], buckets)
    table.delete(gone)
    if used > buckets * SEATS * FULL or not table.insert(add):
        return overfull
    return pd.DataFrame({"shard": [shard], "used": [used], "buckets": [buckets], "bits": [table.table.tobytes()]})


def _let_through(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (shard, part, bits, key, doc_id, n), each part's filter before its lines, the lines that their filter may hold."""
    at, table = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        place = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in (0, 1)])
        heads = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
        edges = [0, *heads.tolist(), batch.num_rows]
        hit = np.zeros(batch.num_rows, bool)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a in heads:
                at, table, a = place[:, a], Cuckoo(batch.column(2)[a].as_py(), 0), a + 1
            if a < b:
                if at is None or (place[:, a:b] != at[:, None]).any():
                    raise ValueError("lines came without the filter of their shard")
                hit[a:b] = table.contains(_numbers(batch.column(3).slice(a, b - a).to_pylist()))
        yield batch.filter(pa.array(hit)).select([3, 4, 5])


@dataclass
class LineIndex:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    length: int = 40
    documents: int = 5
    shards: int = 64

    @classmethod
    def empty(cls, spark: SparkSession, length: int = 40, documents: int = 5, shards: int = 64) -> LineIndex:
        """Lines count from `length` code points, and repeat from `documents` documents."""
        tables = [spark.createDataFrame([], schema) for schema in (REFS, COUNTS, FILTERS)]
        return cls(*tables, length, documents, shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the rows of docs (doc_id, text). Null and empty texts hold no line that counts;
        rows with a null doc_id are together one document, below all others. Rows may repeat."""
        return self._changed(stored(_refs(docs, self.length), "lines"))

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index as if these rows had not been inserted."""
        return self._changed(stored(_refs(docs, self.length).withColumn("n", -F.col("n")), "lines"))

    def _changed(self, delta: DataFrame) -> LineIndex:
        if self.refs.isEmpty():
            refs = delta.where("n > 0")
        else:
            refs = stored(self.refs.unionByName(delta).groupBy("key", "doc_id").agg(F.sum("n").alias("n")).where("n > 0"), "refs")
        touched = delta.select("key").distinct()
        fresh = refs if self.counts.isEmpty() else refs.join(touched, "key", "left_semi")
        fresh = fresh.groupBy("key").agg(F.count("*").alias("documents"), F.max("doc_id").alias("holder"))
        kept = self.counts if self.counts.isEmpty() else self.counts.join(touched, "key", "left_anti")
        counts = stored(kept.unionByName(fresh), "counts")
        out = LineIndex(refs, counts, self.filters, self.length, self.documents, self.shards)
        out.filters = out._refiltered(counts, self)
        return out

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard")

    def _refiltered(self, counts: DataFrame, old: LineIndex) -> DataFrame:
        """The filters of the keys that repeat in counts: those of old, changed by the keys that crossed the threshold.

        All are built anew when keys outgrow the shards, and a shard alone when its
        filter would be too full or a key finds no seat.
        """
        often = F.col("documents") >= self.documents
        repeated = counts.where(often).select("key")
        # a shard's keys meet in one task: as many shards as keep them to about SHARD_KEYS
        number = repeated.count()
        while number > self.shards * SHARD_KEYS:
            self.shards *= 2
        now = repeated.select("key", self._shard())
        if self.shards != old.shards or old.filters.isEmpty():
            return stored(_built(now), "filters")
        before = old.counts.where(often).select("key", self._shard())
        change = now.join(before, ["key", "shard"], "left_anti").withColumn("add", F.lit(True))
        change = stored(change.unionByName(before.join(now, ["key", "shard"], "left_anti").withColumn("add", F.lit(False))), "crossing")
        changed = stored(old.filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(_changed_filter, FILTERS), "changed")
        overfull = changed.where("bits is null").select("shard")
        if overfull.isEmpty():
            return changed
        again = _built(now.join(bounded(overfull), "shard", "left_semi"))
        return stored(changed.where("bits is not null").unionByName(again), "filters")

    def hits(self, refs: DataFrame) -> DataFrame:
        """The rows of refs (key, doc_id, n) whose key the filters may hold.

        Lines meet the filter of their shard in parts of bounded size: a shard with
        many lines, of which one may be most, is dealt to several parts by doc_id,
        and each part gets a copy of the filter, sorted before its lines.
        """
        sharded = refs.select("key", "doc_id", "n", self._shard())
        # a copy of a filter is to be no larger than its part's lines
        weight = self.filters.select("shard", F.greatest(F.lit(PART_LINES), F.length("bits") / LINE_BYTES).alias("most"))
        parts = stored(sharded.groupBy("shard").agg(F.count("*").alias("lines")).join(weight, "shard").select("shard", F.ceil(F.col("lines") / F.col("most")).cast("int").alias("parts")), "parts")
        parts = bounded(parts)
        part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts")).cast("int")
        lines = sharded.join(parts, "shard").select("shard", part.alias("part"), F.lit(None).cast("binary").alias("bits"), "key", "doc_id", "n")
        nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("key", "binary"), ("doc_id", "long"), ("n", "long"))]
        copies = self.filters.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "bits", *nothing)
        dealt = lines.unionByName(copies).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("bits").isNull())
        return dealt.mapInArrow(handing_back(_let_through), REFS)

    def drops(self, refs: DataFrame) -> DataFrame:
        """(doc_id, drop): for each document that loses lines their keys."""
        often = self.counts.where(F.col("documents") >= self.documents).select("key", "holder")
        lost = self.hits(refs).join(often, "key").where(~F.col("doc_id").eqNullSafe(F.col("holder")))
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))

    def apply(self, docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
        """docs with column `text` cut and columns n_lines, n_dropped (long) and kept_sha256 added.

        A line whose key repeats stays only in the largest doc_id that holds it; the
        others lose it wherever it stands. Null texts become empty: one empty line.
        refs: (key, doc_id, n) of these docs, if at hand. Other columns pass
        unchanged; a clashing one of docs is replaced.
        """
        others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped", "kept_sha256")]
        drops = self.drops(_refs(docs, self.length) if refs is None else refs)
        held = docs.select(F.struct(*others).alias("_row"), "text", F.col("doc_id").cast("long").alias("_id"))
        joined = held.join(drops, F.col("_id").eqNullSafe(F.col("doc_id")), "left").select("_row", "text", "drop")
        least = self.length

        def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, lines, dropped, shas = [], [], [], []
                for text, drop in zip(batch.column(1), batch.column(2), strict=True):
                    text, gone, n = text.as_py() or "", drop.as_py(), 0
                    lines.append(text.count("\n") + 1)
                    if gone:
                        gone = set(gone)
                        kept = [x for x in text.split("\n") if len(x) < least or line_key(x, least) not in gone]
                        n, text = lines[-1] - len(kept), "\n".join(kept)
                    texts.append(text)
                    dropped.append(n)
                    shas.append(sha256(text.encode("utf-8", "replace")).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(shas, pa.string())],
                    ["_row", "text", "n_lines", "n_dropped", "kept_sha256"],
                )

        kind = joined.schema["_row"].dataType.simpleString()
        out = joined.mapInArrow(handing_back(cut), f"_row {kind}, text string, n_lines long, n_dropped long, kept_sha256 string")
        new = {c: F.col(c) for c in ("text", "n_lines", "n_dropped", "kept_sha256")} | {c: F.col("_row").getField(c) for c in others}
        order = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_sha256")] + ["n_lines", "n_dropped", "kept_sha256"]
        return out.select(*[new[c].alias(c) for c in order])
