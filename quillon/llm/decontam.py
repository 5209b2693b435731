"""Benchmark decontamination by suffix arrays over the training texts.

Each shard of training documents (a slice of an Arrow batch) is turned into one
string of word numbers and gets a suffix array. Every suffix of every test item
is binary-searched in it, which gives the places where the item's windows occur
and, from there, the longest verbatim matches. Words outside the test items get
number 0, which ends any match, so only stretches of the shard that are made of
test words and long enough for a window enter the array; nothing that could
match is left out.

The test items are dealt to blocks of bounded size by hash of their id. Each
block is made by an executor and is a broadcast variable that a worker loads,
uses and forgets. A pass over the training documents serves up to PASS_BLOCKS
blocks, so what is broadcast is bounded; more items take further passes, each of
which adds to what the one before has found. A block has a vocabulary of its
own, so a shard's suffix array is made anew for each block: it only holds the
stretches that are made of the block's words.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import handing_back, slices, stored

WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Text of test items, and of training documents, that a worker holds as arrays at once.
BLOCK_BYTES = 1 << 20
SHARD_BYTES = 4 << 20
#: Blocks that are broadcast for one pass over the documents: about 5 times BLOCK_BYTES each.
PASS_BLOCKS = 64
#: Words of test suffixes that are compared at once.
COMPARED = 1 << 20
LONGEST = ("item", "item_word", "doc_word", "words")
SPANS = "n_words long, n_hit long, spans array<struct<start:long,stop:long>>, items array<string>, n_items long, longest struct<item:string,item_word:long,doc_word:long,words:long>"


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other code points from U+0080, with A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").translate(WORDS).split()


class Tests:
    """The test items of a block, as arrays."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int):
        self.names = [name for name, _ in items]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in items for w in words), 1)}
        self.depth = max((len(words) for _, words in items), default=0)
        strings, windows = [], {}
        at = 0
        for i, (_, words) in enumerate(items):
            numbers = [self.vocabulary[w] for w in words]
            size = min(width, len(words))
            for k in range(len(words) - size + 1 if size else 0):
                window = windows.setdefault(tuple(numbers[k : k + size]), (at + k, set()))
                window[1].add(i)
            strings.append(np.array([*numbers, -1], np.int64))
            at += len(numbers) + 1
        self.string = np.concatenate([*strings, np.array([-1], np.int64)])
        self.starts = np.cumsum([0, *(len(s) for s in strings)])
        self.places = np.array([w[0] for w in windows.values()], np.int64)
        self.sizes = np.array([len(k) for k in windows], np.int64)
        self.owners = [sorted(w[1]) for w in windows.values()]

    def rows(self, places: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
        """The words at each place, cut after sizes, then `end`."""
        across = np.arange(int(sizes.max()) + 1 if sizes.size else 1)
        got = self.string[np.minimum(places[:, None] + across, len(self.string) - 1)]
        return np.where(across < sizes[:, None], got, end)


def suffix_array(string: np.ndarray, depth: int) -> np.ndarray:
    """The places of the non-zero words of the string, in order of their suffixes up to at least `depth` words.

    Prefix doubling: ranks by k words give ranks by 2k words.
    """
    _, rank = np.unique(string, return_inverse=True)
    rank, k = rank.astype(np.int64) + 1, 1
    top = int(rank.max(initial=0))
    while k < depth and top < len(string):
        after = np.zeros_like(rank)
        after[: len(rank) - k] = rank[k:]
        key = rank * (top + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank[order] = np.cumsum(new)
        top, k = int(new.sum()), 2 * k
    order = np.argsort(rank, kind="stable")
    return order[string[order] != 0]


def lower_bound(string: np.ndarray, suffixes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each row of wanted the number of suffixes below it, by binary search of all rows at once."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(suffixes), np.int64)
    padded = np.concatenate([string, np.zeros(wanted.shape[1], string.dtype)])
    across = np.arange(wanted.shape[1])
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        got, want = padded[suffixes[middle][:, None] + across], wanted[open_]
        differs = got != want
        first = differs.argmax(1)
        rows = np.arange(len(open_))
        below = differs[rows, first] & (got[rows, first] < want[rows, first])
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
    return low


def _expanded(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indexes of all ranges, and the numbers from first to last of each."""
    sizes = last - first
    index = np.repeat(np.arange(len(first)), sizes)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[index]


class Shard:
    """The words of some documents, one after another, and what was found in them; before: what a pass before has found in each."""

    def __init__(self, texts: list[str | None], before: list[dict | None] | None = None):
        self.words = [words_of(t) for t in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])  # a gap after each document
        self.edges = np.zeros(int(self.starts[-1]) + 1, np.int32)
        self.items: list[dict[tuple[int, int], str | None]] = [{} for _ in texts]
        self.longest: list[tuple[str | None, int, int, int] | None] = [None] * len(texts)
        self.unnamed = [0] * len(texts)
        for d, old in enumerate(before or ()):
            for span in old["spans"]:
                self.edges[self.starts[d] + span["start"]] += 1
                self.edges[self.starts[d] + span["stop"]] -= 1
            self.items[d] = {(-1, k): name for k, name in enumerate(old["items"])}
            self.unnamed[d] = old["n_items"] - len(old["items"])
            self.longest[d] = old["longest"] and tuple(old["longest"][k] for k in LONGEST)

    def search(self, tests: Tests, block: int) -> None:
        if not tests.places.size:
            return
        get, numbers = tests.vocabulary.get, np.zeros(len(self.edges), np.int64)
        for start, words in zip(self.starts.tolist(), self.words, strict=False):
            numbers[start : start + len(words)] = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        known = np.concatenate([[False], numbers != 0, [False]])
        begin, stop = np.flatnonzero(~known[:-1] & known[1:]), np.flatnonzero(known[:-1] & ~known[1:])
        long = stop - begin >= tests.sizes.min()
        keep = np.zeros(len(numbers) + 1, np.int8)
        np.add.at(keep, begin[long], 1)
        np.add.at(keep, np.minimum(stop[long] + 1, len(numbers)), -1)  # with the 0 after it
        places = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
        string = numbers[places]
        if not string.size:
            return
        suffixes = suffix_array(string, tests.depth)
        step = max(1, COMPARED // (int(tests.sizes.max()) + 1))
        for k in range(0, len(tests.places), step):
            part = tests.places[k : k + step], tests.sizes[k : k + step]
            low = lower_bound(string, suffixes, tests.rows(*part, -1))
            high = lower_bound(string, suffixes, tests.rows(*part, np.iinfo(np.int64).max))
            window, rank = _expanded(low, high)
            if window.size:
                self._hit(tests, block, string, places, window + k, suffixes[rank])

    def _hit(self, tests: Tests, block: int, string: np.ndarray, places: np.ndarray, window: np.ndarray, found: np.ndarray) -> None:
        at, size = places[found], tests.sizes[window]
        np.add.at(self.edges, at, 1)
        np.add.at(self.edges, at + size, -1)
        doc = np.searchsorted(self.starts, at, side="right") - 1
        for d, w in np.unique(np.stack([doc, window], 1), axis=0).tolist():
            self.items[d].update({(block, i): tests.names[i] for i in tests.owners[w]})
        self._extend(tests, string, found, window, doc, at)

    def _extend(self, tests: Tests, string: np.ndarray, found: np.ndarray, window: np.ndarray, doc: np.ndarray, at: np.ndarray) -> None:
        """The longest match from each window that occurs, for each document."""
        padded = np.concatenate([string, np.zeros(tests.depth + 1, string.dtype)])
        step = max(1, COMPARED // (tests.depth + 1))
        for k in range(0, len(found), step):
            part = slice(k, k + step)
            place = tests.places[window[part]]
            wanted = tests.rows(place, np.full(len(place), tests.depth), -1)
            # what follows the item's end is another item: -1 ends every item
            size = (padded[found[part][:, None] + np.arange(wanted.shape[1])] != wanted).argmax(1)
            order = np.lexsort((at[part], -size, doc[part]))
            _, first = np.unique(doc[part][order], return_index=True)
            for i in order[first].tolist():
                d, item = int(doc[part][i]), int(np.searchsorted(tests.starts, place[i], side="right") - 1)
                old = self.longest[d]
                if old is None or int(size[i]) > old[3]:
                    self.longest[d] = (tests.names[item], int(place[i] - tests.starts[item]), int(at[part][i] - self.starts[d]), int(size[i]))

    def found(self) -> Iterator[tuple]:
        hit = np.cumsum(self.edges) > 0
        for d, (start, size) in enumerate(zip(self.starts.tolist(), self.sizes.tolist(), strict=False)):
            own = hit[start : start + size]
            n = int(own.sum())
            steps = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))) if n else np.zeros(0, np.int64)
            names = {name if name is not None else key for key, name in self.items[d].items()}
            yield size, n, [{"start": a, "stop": b} for a, b in steps.reshape(-1, 2).tolist()], sorted(x for x in names if isinstance(x, str)), len(names) + self.unnamed[d], self.longest[d] and dict(zip(LONGEST, self.longest[d], strict=True))


def matches(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """docs with the verbatim matches of items (item_id, text) in each text.

    Added: n_words, n_hit (words inside any occurrence of a window of `width`
    consecutive item words, or of a whole shorter item), spans of hit words, the
    sorted item_ids as strings whose windows occur, n_items, and `longest`: the
    longest match with its item and the places of its first words. Texts that are
    null or without words have no match. Items without words are ignored; an item
    with a null id counts in n_items without a name; rows of one item_id are
    one item. Columns of docs pass unchanged; clashing ones are replaced.
    """
    spark = docs.sparkSession
    named = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    number = 1 + size // BLOCK_BYTES

    def built(rows: pd.DataFrame) -> pd.DataFrame:
        found = [(None if pd.isna(name) else name, w) for name, text in zip(rows.item_id, rows.text, strict=True) if (w := words_of(text))]
        return pd.DataFrame({"block": [rows.block.iloc[0]], "tests": [cloudpickle.dumps(Tests(found, width))]})

    dealt = named.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(number))).repartition(number, "block")
    new = ["n_words", "n_hit", "spans", "items", "n_items", "longest"]
    others = [c for c in docs.columns if c not in new]
    held = docs.select(F.struct(*[c for c in others if c != "text"] or [F.lit(0).alias("_")]).alias("_row"), "text")
    kind = held.schema["_row"].dataType.simpleString()
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.string()), pa.int64(), pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("words", pa.int64())])]

    def search(blocks: list, first: bool) -> Callable:
        def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            only = pickle.loads(blocks[0].value) if len(blocks) == 1 else None
            for batch in slices(batches, "text", SHARD_BYTES):
                shard = Shard(batch.column(1).to_pylist(), None if first else batch.select(new).to_pylist())
                for k, block in enumerate(blocks):
                    shard.search(only or pickle.loads(block.load_from_path(block._path)), k)
                got = list(zip(*shard.found(), strict=True))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, k) for x, k in zip(got, kinds, strict=True))], ["_row", "text", *new])

        return searched

    blocks, first = [], True
    for row in dealt.groupBy("block").applyInPandas(built, "block long, tests binary").select("tests").toLocalIterator():
        if len(blocks) == PASS_BLOCKS:
            held = stored(held.mapInArrow(handing_back(search(blocks, first)), f"_row {kind}, text string, {SPANS}"), "matches")
            for block in blocks:
                block.unpersist()
            blocks, first = [], False
        blocks.append(spark.sparkContext.broadcast(bytes(row.tests)))
    out = held.mapInArrow(handing_back(search(blocks, first)), f"_row {kind}, text string, {SPANS}")
    return out.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in others], *new)
