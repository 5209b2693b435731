"""Near-duplicate embeddings by cross-polytope hashing with multiprobe buckets.

Equal vectors of a label are one vector with a weight. A vector is rotated by
three rounds of random signs and a fast Hadamard transform; the coordinate of
largest magnitude, with its sign, is its hash (Andoni et al., 2015). A code of
a table joins the hashes of some rotations, the more the more vectors there are, so
that vectors with nothing in common don't fill buckets; a vector enters the
buckets of its likeliest codes. Pairs that meet in a bucket are verified by their
cosine in double precision.

Vectors within half the threshold's angle of the first vector of their bucket are
a group: any two of them are linked, so they need no comparison. A group enters
the buckets of its members once, with its mean direction and radius. Two
groups whose radii leave no doubt are linked, or not, as a whole; those in doubt
are compared member by member. So a group of near copies costs as much as it has rows.

A bucket of any size is cut into blocks, and each pair of blocks is a part of
bounded size of its own, so one task never needs a bucket together. A pair of single
vectors that meets in several buckets counts only where it meets first, which its codes
tell, so links are counted without a list of all pairs; parts give counts for their
vectors and a spanning forest of their links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import connected_components
from quillon.llm.shared import bounded, redealt, stored

THRESHOLD = 0.93
#: Share of pairs exactly at the threshold that may meet in no bucket.
MISSED = 0.0005
#: Vectors with nothing in common that a code may gather on average, beyond which another rotation is joined.
CROWD = 64
BLOCK = 128
#: Vectors of parts that a worker verifies at once.
HELD = 4096
#: Slack of bounds on angles, for rounding.
SLACK = 1e-6


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the width is a power of 2."""
    n, width = rows.shape
    step = 1
    while step < width:
        halves = rows.reshape(n, width // (2 * step), 2, step)
        rows = np.concatenate([halves[:, :, :1] + halves[:, :, 1:], halves[:, :, :1] - halves[:, :, 1:]], axis=2).reshape(n, width)
        step *= 2
    return rows


def rotations(vectors: int, width: int) -> int:
    """How many hashes of 2 * width values a code joins."""
    n = 2
    while vectors > CROWD * (2 * width) ** n:
        n += 1
    return n


def tables(width: int, joined: int) -> tuple[int, int]:
    """How many tables there are and how many codes of each a vector enters, so that at most MISSED are missed.

    The chance of a table falls with the width. Its line lies just below what random
    pairs at the threshold show: 0.88, 0.76, 0.67, 0.58, 0.53 for widths of 16, 64, 256, 1024, 2048.
    """
    chance = max(0.2, 1.04 - 0.05 * np.log2(width) - 0.03 * (joined - 2))
    return max(4, int(np.ceil(np.log(MISSED) / np.log(1 - min(chance, 0.9))))), 3 * 2 ** (joined - 2)


def codes(rows: np.ndarray, joined: int = 2, seed: int = 7) -> np.ndarray:
    """n x (tables * probes) longs: the codes of unit rows, likeliest first within each table."""
    n, d = rows.shape
    width = max(2, 1 << (d - 1).bit_length())
    number, probes = tables(width, joined)
    padded = np.zeros((n, width))
    padded[:, :d] = rows
    random = np.random.default_rng([seed, width])
    few = min(4, width)
    out = np.zeros((n, number * probes), np.int64)
    line = np.arange(n)[:, None]
    for t in range(number):
        joint, code = np.zeros((n, 1)), np.zeros((n, 1), np.int64)
        for _ in range(joined):
            turned = padded
            for _ in range(3):
                turned = hadamard(turned * random.choice([-1.0, 1.0], width)) / np.sqrt(width)
            size = np.abs(turned)
            top = np.argpartition(-size, few - 1, axis=1)[:, :few] if few < width else np.tile(np.arange(width), (n, 1))
            top = np.take_along_axis(top, np.argsort(-size[line, top], axis=1, kind="stable"), 1)
            loss = (size[line, top[:, :1]] - size[line, top]) ** 2
            joint = (joint[:, :, None] + loss[:, None, :]).reshape(n, -1)
            code = (code[:, :, None] * (2 * width) + (2 * top + (turned[line, top] < 0))[:, None, :]).reshape(n, -1)
        best = np.argsort(joint, axis=1, kind="stable")[:, :probes]
        code = code + t * (2 * width) ** joined
        out[:, t * probes : t * probes + best.shape[1]] = code[line, best]
        if best.shape[1] < probes:
            out[:, t * probes + best.shape[1] : (t + 1) * probes] = code[line, best[:, :1]]
    return out


def _matrix(column: pa.ListArray, chosen: np.ndarray) -> np.ndarray:
    part = column.take(pa.array(chosen))
    return part.flatten().to_numpy(zero_copy_only=False).reshape(len(chosen), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _by_width(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """The batches in parts of up to HELD rows whose vectors have one length, and that length."""
    for batch in batches:
        for at in range(0, batch.num_rows, HELD):
            part = batch.slice(at, HELD)
            dims = np.array([len(x) for x in part.column(column)], np.int64)
            for dim in np.unique(dims).tolist():
                yield part.take(pa.array(np.flatnonzero(dims == dim))), dim


def _rows(column: pa.ListArray) -> np.ndarray:
    """The vectors of a column, all of one length, as unit rows."""
    return _unit(_matrix(column, np.arange(len(column))))


def _coder(vectors: int):
    """(rep, label, vec) to (rep, label, dim, codes)."""

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, dim in _by_width(batches, 2):
            found = codes(_rows(part.column(2)), rotations(vectors, max(2, 1 << (dim - 1).bit_length())))
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.full(n, dim), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))],
                ["rep", "label", "dim", "codes"],
            )

    return coded


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit rows."""
    return np.arccos(np.clip((a * b).sum(axis=1), -1, 1))


def _near(limit: float):
    """Of rows (rep, lead, vec, centre), vectors of one length, those (rep, lead) at an angle of up to the limit."""

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in _by_width(batches, 2):
            yield part.select([0, 1]).filter(pa.array(_angles(_rows(part.column(2)), _rows(part.column(3))) <= limit))

    return near


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, vec) to (group, total): sums of unit vectors, of which a task gives few for each group."""
    held: dict[int, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["group", "total"])

    for part, _ in _by_width(batches, 1):
        groups, where = np.unique(part.column(0).to_numpy(), return_inverse=True)
        rows = _rows(part.column(1))
        sums = np.zeros((len(groups), rows.shape[1]))
        np.add.at(sums, where, rows)
        for group, total in zip(groups.tolist(), sums, strict=True):
            held[group] = held[group] + total if group in held else total
        if len(held) >= HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def _radii(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, vec, centre) to (group, radius): the largest angles, of a batch."""
    for part, _ in _by_width(batches, 1):
        groups, where = np.unique(part.column(0).to_numpy(), return_inverse=True)
        most = np.zeros(len(groups))
        np.maximum.at(most, where, _angles(_rows(part.column(1)), _rows(part.column(2))))
        yield pa.RecordBatch.from_arrays([pa.array(groups), pa.array(most)], ["group", "radius"])


def _verifier(threshold: float):
    """Rows sorted by part (part, side, code, rep, weight, radius, codes, vec) to (rep, links), (rep, other) and (rep, other, verdict).

    Single vectors have radius 0: they give counts and a forest. A pair with a group gives a
    verdict: 1, all of one are linked with all of the other, or 2, their members must tell.
    """
    most = np.arccos(threshold)

    def near(unit: np.ndarray, radius: np.ndarray, side: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a large part, and their cosines, that may be linked: within it for side 2, else across sides 0 and 1."""
        rows = np.arange(start, stop)
        left, right = (rows, rows) if side[start] == 2 else (rows[side[start:stop] == 0], rows[side[start:stop] == 1])
        cosine = unit[left] @ unit[right].T
        ok = np.arccos(np.clip(cosine, -1, 1)) - (radius[left][:, None] + radius[right]) <= most + SLACK
        if side[start] == 2:
            ok = np.triu(ok, 1)
        x, y = np.nonzero(ok)
        return left[x], right[y], cosine[x, y]

    def few(unit: np.ndarray, radius: np.ndarray, side: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same for many small parts at once."""
        sizes = stops - starts
        a = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        number = np.repeat(stops, sizes) - a - 1  # rows that follow in the part
        b = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number) + np.repeat(a + 1, number)
        a = np.repeat(a, number)
        keep = (side[a] == 2) | (side[a] != side[b])
        a, b = a[keep], b[keep]
        for at in range(0, len(a), 1 << 14):
            x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
            cosine = np.einsum("ij,ij->i", unit[x], unit[y])
            ok = np.arccos(np.clip(cosine, -1, 1)) - (radius[x] + radius[y]) <= most + SLACK
            yield x[ok], y[ok], cosine[ok]

    def first_here(a: np.ndarray, b: np.ndarray, codes: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Whether pairs of single vectors, rows a and b, meet in no lesser code than that of their part."""
        keep = np.ones(len(a), bool)
        for at in range(0, len(a), 1 << 15):
            x, y = codes[a[at : at + (1 << 15)]], codes[b[at : at + (1 << 15)]]
            first = np.full(len(x), np.iinfo(np.int64).max)
            for k in range(x.shape[1]):
                same = (x[:, k : k + 1] == y).any(1)
                first = np.where(same, np.minimum(first, x[:, k]), first)
            keep[at : at + (1 << 15)] = first == code[a[at : at + (1 << 15)]]
        return keep

    def forest(linked: np.ndarray) -> list[tuple[int, int]]:
        root: dict[int, int] = {}

        def top(i: int) -> int:
            while (up := root.setdefault(i, i)) != i:
                root[i] = root[up]
                i = root[i]
            return i

        out = []
        for a, b in linked.tolist():
            a2, b2 = top(a), top(b)
            if a2 != b2:
                root[max(a2, b2)] = min(a2, b2)
                out.append((a, b))
        return out

    def verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rep", "links", "other", "verdict"]
        held: pa.Table | None = None
        seen: set[tuple] = set()

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """Rows of whole parts; those of one length of vectors and number of codes are looked at together."""
            shape = pc.list_value_length(table.column(7)).to_numpy()
            for dim in np.unique(shape).tolist():
                if (out := of_width(table.filter(pa.array(shape == dim)) if (shape != dim).any() else table)) is not None:
                    yield out

        def of_width(table: pa.Table) -> pa.RecordBatch | None:
            part, side, code, reps, weights, radius = (table.column(k).to_numpy() for k in range(6))
            unit = _unit(table.column(7).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(reps), -1))
            sizes = pc.list_value_length(table.column(6)).to_numpy()
            own = np.zeros((len(reps), int(sizes.max())), np.int64)  # single vectors have equally many codes, groups none here
            own[sizes > 0] = table.column(6).combine_chunks().flatten().to_numpy().reshape(-1, own.shape[1]) if own.shape[1] else 0
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            starts, stops = edges[:-1], edges[1:]
            small = stops - starts <= 48
            found = list(few(unit, radius, side, starts[small], stops[small]))
            found += [near(unit, radius, side, x, y) for x, y in zip(starts[~small].tolist(), stops[~small].tolist(), strict=True)]
            a, b, cosine = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
            wide = radius[a] + radius[b]
            linked = np.stack([a, b], 1)[(wide == 0) & (cosine >= threshold)]
            linked = linked[first_here(linked[:, 0], linked[:, 1], own, code)]
            links, verdicts = np.zeros(len(reps), np.int64), []
            np.add.at(links, linked[:, 0], weights[linked[:, 1]])
            np.add.at(links, linked[:, 1], weights[linked[:, 0]])
            forests = [(int(reps[x]), int(reps[y])) for x, y in forest(linked)]
            sure = np.arccos(np.clip(cosine, -1, 1)) + wide <= most - SLACK
            for x, y, certain in zip(reps[a[wide > 0]].tolist(), reps[b[wide > 0]].tolist(), sure[wide > 0].tolist(), strict=True):
                key = (min(x, y), max(x, y), 1 if certain else 2)
                if key not in seen:
                    verdicts.append(key)
                    seen.add(key)
            if len(seen) > 1 << 20:
                seen.clear()
            some = np.flatnonzero(links)
            columns = [
                [*reps[some].tolist(), *[x for x, _ in forests], *[x for x, _, _ in verdicts]],
                [*links[some].tolist(), *[None] * (len(forests) + len(verdicts))],
                [*[None] * len(some), *[y for _, y in forests], *[y for _, y, _ in verdicts]],
                [*[None] * (len(some) + len(forests)), *[v for *_, v in verdicts]],
            ]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names) if columns[0] else None

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < HELD:
                continue
            part = held.column(0).to_numpy()
            whole = int(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))[-1])  # the last part may go on
            if whole:
                yield from work(held.slice(0, whole))
            held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from work(held)

    return verified


FOUND = "rep long, links long, other long, verdict long"


def _groups(reps: DataFrame, coded: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rep, group, n, total, weight) for each of reps, and (group, vec, radius) for groups of two or more.

    A group is named by its smallest rep; n counts its vectors, total their weights.
    """
    bucket = ["label", "dim", "code"]
    top = coded.select("rep", "label", "dim", F.get("codes", F.lit(0)).alias("code"))
    leads = top.groupBy(*bucket).agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = top.join(redealt(leads, "code"), bucket).where("rep <> lead").select("rep", "lead")
    near = near.join(reps.select("rep", "vec"), "rep").join(reps.select(F.col("rep").alias("lead"), F.col("vec").alias("centre")), "lead")
    led = near.select("rep", "lead", "vec", "centre").mapInArrow(_near(float(np.arccos(threshold)) / 2 - SLACK), "rep long, lead long")
    own = stored(reps.select("rep", "weight").join(led, "rep", "left").select("rep", "weight", F.coalesce("lead", "rep").alias("lead")), "led")
    sizes = own.groupBy("lead").agg(F.count("*").alias("n"), F.sum("weight").alias("total"), F.min("rep").alias("group"))
    members = stored(own.join(redealt(sizes, "lead"), "lead").select("rep", "group", "n", "total", "weight"), "members")
    inside = members.where("n > 1").select("rep", "group").join(reps.select("rep", "vec"), "rep").select("group", "vec")
    kind = reps.schema["vec"].dataType.simpleString()
    sums = inside.mapInArrow(_sums, "group long, total array<double>").groupBy("group").agg(F.collect_list("total").alias("totals"))
    added = F.reduce(F.slice("totals", 2, F.size("totals")), F.get("totals", F.lit(0)), lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q))
    centres = stored(sums.select("group", added.cast(kind).alias("centre")), "centres")
    radii = inside.join(centres, "group").select("group", "vec", "centre").mapInArrow(_radii, "group long, radius double").groupBy("group").agg(F.max("radius").alias("radius"))
    return members, stored(centres.join(radii, "group").select("group", F.col("centre").alias("vec"), "radius"), "groups")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id): a row for each row of vectors (vec_id, embedding array, label).

    Linked are rows of equal labels, not null, whose cosine in double precision is
    at least the threshold (above 0), among pairs that share a bucket. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing,
    nor do vectors of different lengths. n_links counts the other rows that are linked
    directly, rows that repeat included; component_id is the smallest vec_id that
    links reach, itself included, and null ids never name a component. Other
    columns are not read.
    """
    wide = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", wide.alias("vec"))
    usable = F.col("label").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    reps = rows.where(usable).groupBy("label", "vec").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()), "vectors")

    kind = reps.schema["label"].dataType.simpleString()
    most = reps.groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    coded = stored(reps.select("rep", "label", "vec").mapInArrow(_coder(most), f"rep long, label {kind}, dim int, codes array<long>"), "codes")
    members, groups = _groups(reps, coded, threshold)
    bucket = ["label", "dim", "code"]
    named = coded.join(members.select("rep", "group", "n"), "rep").select("group", "n", "label", "dim", F.explode(F.array_distinct("codes")).alias("code"))
    entries = named.where("n = 1").drop("n").union(named.where("n > 1").drop("n").distinct())
    sizes = entries.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    met = stored(entries.join(redealt(sizes, "code"), bucket).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), "met")
    block = F.pmod(F.xxhash64("group"), F.col("blocks")).cast("int")
    # block b meets every block: as the lower of the two it is side 0, as the higher side 1, with itself side 2
    dealt = met.withColumn("own", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "group", "label", "dim", "code", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), F.when(F.col("own") == F.col("with"), 2).when(F.col("own") > F.col("with"), 1).otherwise(0).alias("side")
    )
    singles = reps.join(coded.select("rep", "codes"), "rep").join(members.where("n = 1").select("rep"), "rep").select(F.col("rep").alias("group"), "weight", F.lit(0.0).alias("radius"), "codes", "vec")
    full = singles.union(groups.select("group", F.lit(0).cast("long"), F.greatest("radius", F.lit(SLACK)), F.array().cast("array<long>"), "vec"))
    columns = ["part", "side", "code", "rep", "weight", "radius", "codes", "vec"]
    ready = dealt.join(full, "group").withColumn("part", F.xxhash64("label", "dim", "code", "low", "high")).withColumnRenamed("group", "rep")
    found = stored(ready.select(*columns).repartition("part").sortWithinPartitions("part").mapInArrow(_verifier(threshold), FOUND), "links")

    # groups that are linked as a whole, and the members of those in doubt
    verdicts = stored(found.where("verdict is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"), "verdict").distinct(), "verdicts")
    sure = verdicts.where("verdict = 1").select("a", "b")
    totals = members.select("group", "n", "total").distinct()
    gained = stored(sure.union(sure.select("b", "a")).toDF("group", "other").join(totals.select(F.col("group").alias("other"), "total"), "other").groupBy("group").agg(F.sum("total").alias("gained")), "gained")
    blocks = totals.select("group", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    doubt = verdicts.where("verdict = 2").select("a", "b").join(blocks.toDF("a", "p"), "a").join(blocks.toDF("b", "q"), "b")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    asking = doubt.join(members.select(F.col("group").alias("a"), "rep"), "a").select("rep", "a", "b", block("p").alias("i"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("j"), F.lit(0).alias("side"))
    asked = doubt.join(members.select(F.col("group").alias("b"), "rep"), "b").select("rep", "a", "b", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"), block("q").alias("j"), F.lit(1).alias("side"))
    single = asking.unionByName(asked).withColumn("part", F.xxhash64("a", "b", "i", "j")).join(reps.select("rep", "weight", "vec"), "rep")
    single = single.select("part", "side", F.lit(0).cast("long").alias("code"), "rep", "weight", F.lit(0.0).alias("radius"), F.array(F.lit(0).cast("long")).alias("codes"), "vec")
    told = stored(single.repartition("part").sortWithinPartitions("part").mapInArrow(_verifier(threshold), FOUND), "links")

    both = found.where("verdict is null").union(told)
    ties = both.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v"))
    nodes = connected_components(ties.union(sure.toDF("u", "v")).union(members.where("rep <> group").select("rep", "group")))
    counts = both.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    named = members.join(bounded(gained), "group", "left").join(counts, "rep", "left").join(nodes.withColumnRenamed("node", "rep"), "rep", "left")
    links = F.coalesce("links", F.lit(0)) + F.coalesce("gained", F.lit(0)) + F.col("total") - 1
    named = named.select("rep", links.alias("n_links"), F.coalesce("root", "rep").alias("root")).join(reps.select("rep", "label", "vec", "least"), "rep")
    named = stored(named.select("label", "vec", "least", "n_links", "root"), "named")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(redealt(smallest, "root"), "root").select("label", "vec", "n_links", "component_id")
    linked = rows.where(usable).join(labels, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    return linked.union(rows.where(~usable).select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
