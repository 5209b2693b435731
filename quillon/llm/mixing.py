"""Mixing sources to target weights along a time-varying curriculum. Native DataFrame operations only.

Each source has a target number of words and a schedule: how its share of the
training words changes from time 0 to time 1. The schedule is integrated to
the cumulative demand for the source's words; a document lies at a range of
the source's running words, and inverting the demand at the middle of that
range gives the time at which it is read. The demands of all sources up to that
time add up to its training position, in words from the beginning of training.
Documents are read once for each time that the range, moved on by the source's
size, lies below the target.

Running words are summed in two levels: within (source, bucket), where buckets
deal even one source that has most rows to many tasks, and over the buckets of
a source. Sources, a row each, are ranked in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import bounded, stored

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
#: Knots (time, factor for each weight): between knots factors change linearly.
SCHEDULE = ((0.0, (1.5, 1.0, 0.5)), (0.5, (1.0, 1.2, 1.0)), (1.0, (0.5, 1.0, 1.5)))
BUCKET_ROWS = 4096
LEAST_BUCKETS = 64


def word_count(text: str | Column) -> Column:
    """The number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, kind, demands) of sizes (source, source_size); a row for each source.

    Sources in code point order, null last, take the weights in turn and share all
    words by them. A target stops at `cap` times its source's size, and what is over
    is shared again by weight until none is above: target = min(cap * size, weight *
    level), with the one level at which the targets add up to all words. `kind` is
    the index of the source's weight.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    kind = (F.row_number().over(every) - 1) % len(weights)
    ranked = sizes.withColumn("kind", kind)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("kind") + 1)).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", rest / F.sum("weight").over(after))
    # the first source in this order that is not stopped tells the level
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct((F.col("most") / F.col("weight")).alias("r"), "level"))).over(everything)
    target = F.least("most", F.coalesce(level.getField("level"), F.lit(float("inf"))) * F.col("weight"))
    goals = levels.select("source", "source_size", target.alias("target"), "kind")
    demands = F.array(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("target"))).over(everything), F.lit(0.0)) for k in range(len(weights))])
    return goals.withColumn("demands", demands)


def words_read(time: Column, demands: Column, schedule: Sequence = SCHEDULE) -> Column:
    """The words that sources of all kinds have given by the time: their schedules' integrals, with the demands as totals."""
    out = F.lit(0.0)
    for k in range(len(schedule[0][1])):
        knots = [(float(t), float(f[k])) for t, f in schedule]
        spans = list(zip(knots, knots[1:], strict=False))
        total = sum((t2 - t1) * (f1 + f2) / 2 for (t1, f1), (t2, f2) in spans)
        share = F.lit(0.0)
        for (t1, f1), (t2, f2) in spans:
            d = F.least(F.greatest(time - t1, F.lit(0.0)), F.lit(t2 - t1))
            share = share + d * f1 + d * d * ((f2 - f1) / (t2 - t1) / 2)
        out = out + F.get(demands, F.lit(k)) * share / total
    return out


def training_time(share: Column, kind: Column, schedule: Sequence = SCHEDULE) -> Column:
    """The time at which the given share (0 to 1) of a source's words has been read."""
    out = F.lit(None).cast("double")
    for k in range(len(schedule[0][1])):
        knots = [(float(t), float(f[k])) for t, f in schedule]
        areas = [(t2 - t1) * (f1 + f2) / 2 for (t1, f1), (t2, f2) in zip(knots, knots[1:], strict=False)]
        total, at = sum(areas), 0.0
        time = F.lit(knots[-1][0])
        pieces = []
        for (t1, f1), (t2, f2), area in zip(knots, knots[1:], areas, strict=False):
            # words read since t1: f1 * d + slope * d * d / 2, solved for d
            words, slope = share * F.lit(total) - F.lit(at), (f2 - f1) / (t2 - t1)
            root = F.sqrt(F.greatest(F.lit(f1 * f1) + F.lit(2 * slope) * words, F.lit(0.0)))
            pieces.append((F.lit(at + area), F.lit(t1) + F.greatest(words, F.lit(0.0)) * 2 / F.greatest(F.lit(f1) + root, F.lit(1e-300))))
            at += area
        for end, solved in reversed(pieces):
            time = F.when(share * F.lit(total) < end, solved).otherwise(time)
        out = F.when(kind == k, time).otherwise(out)
    return out


def assign(docs: DataFrame, size: str | None = None, weights: Sequence[float] = WEIGHTS, cap: int = CAP, schedule: Sequence = SCHEDULE) -> DataFrame:
    """docs (doc_id, source and text or a `size` column) with size, source_size, target, taken and positions.

    positions: the training position, in words, of each reading of the document, at
    most `cap`; taken = size times their number. The sum of taken over a source differs
    from its target by at most half the size of one document. Documents are taken in
    the order of a hash of their columns (maps aside), so reruns agree; equal rows
    are interchangeable. Null and empty texts have size 0 and are read as the
    running words at their place are. Null sources are one source; null ids are
    ids. Columns of docs pass unchanged; clashing ones are replaced.
    """
    new = ["size", "source_size", "target", "taken", "positions"]
    words = F.col(size) if size else word_count("text")
    kept = [c for c in docs.columns if c not in new]
    # docs' columns travel as one, so that their names meet none of those below
    hashed = [F.col(f.name) for f in docs.schema if f.name in kept and "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct(*kept).alias("_row"), words.alias("_size"), F.xxhash64(F.lit("mix"), *hashed).alias("_hash"))
    source, doc_id = F.col("_row").getField("source"), F.col("_row").getField("doc_id")
    buckets = max(LEAST_BUCKETS, docs.count() // BUCKET_ROWS)
    rows = rows.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    parts = stored(rows.groupBy(source.alias("_source"), "_bucket").agg(F.sum("_size").alias("_part")), "parts")
    goals = targets(parts.groupBy(F.col("_source").alias("source")).agg(F.sum("_part").alias("source_size")), weights, cap).withColumnRenamed("source", "_of")
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_part").over(before), F.lit(0)))
    parts = stored(parts.join(goals, F.col("_source").eqNullSafe(F.col("_of"))).select("_source", F.col("_bucket").alias("_b"), "_base", "source_size", "target", "kind", "demands"), "offsets")
    placed = rows.join(bounded(parts), source.eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    running = Window.partitionBy(source, "_bucket").orderBy("_hash", doc_id, "_size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("_base") + F.coalesce(F.sum("_size").over(running), F.lit(0)) + F.col("_size") / 2
    placed = placed.withColumn("_middle", middle)
    readings = F.filter(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda j: F.col("_middle") + j * F.col("source_size")), lambda m: m < F.col("target"))
    times = F.transform(readings, lambda m: training_time(m / F.col("target"), F.col("kind"), schedule))
    positions = F.transform(times, lambda t: words_read(t, F.col("demands"), schedule))
    read = placed.select("_row", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.size(readings)).alias("taken"), positions.alias("positions"))
    return read.select(*[F.col("_row").getField(c).alias(c) for c in kept], *new)


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The readings of docs as assign() places them, range-sorted: a row for each, with `position` instead of positions."""
    rows = assign(docs, **options)
    read = rows.select(*[c for c in rows.columns if c not in ("positions", "position")], F.explode("positions").alias("position"))
    return read.orderBy("position", "doc_id")
