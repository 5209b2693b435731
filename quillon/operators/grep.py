"""Content search by scan, or by scan of the files that a trigram index leaves.

`texts` has file_id, path, lang and text. Both strategies give the same rows: the
index only leaves out files that cannot match. Patterns are searched in lines.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.columns import path_filter, quoted, same_word
from quillon.functions.patterns import is_regex, number, required, trigrams, variants

SHOWN_BYTES = 200
#: Candidate files up to which a scan is told their numbers, which files of a sorted table can be skipped by.
TOLD = 1000


def lines(texts: DataFrame) -> DataFrame:
    """A row for each line: `line` from 1, `ln` its text, `byte_start` its place in bytes.

    Places are sums of lengths within a text, taken over Arrow arrays where the text is: nothing is shuffled.
    """
    others = [c for c in texts.columns if c != "text"]
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in others)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                split = pc.split_pattern(part.column(len(others)), "\n")
                of, texts_ = pc.list_parent_indices(split), pc.list_flatten(split)
                owner = of.to_numpy()
                sizes = pc.binary_length(texts_).to_numpy().astype(np.int64) + 1
                begins = np.cumsum(sizes) - sizes
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
                rank = np.cumsum(np.isin(np.arange(len(owner)), first)) - 1
                number = np.arange(len(owner)) - first[rank] + 1 if len(owner) else owner
                start = begins - begins[first][rank] if len(owner) else begins
                kept = [part.column(k).take(of) for k in range(len(others))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(number, pa.int64()), texts_, pa.array(start, pa.int64())], [*others, "line", "ln", "byte_start"])

    return texts.select(*others, "text").mapInArrow(cut, f"{kinds}, line long, ln string, byte_start long")


def grams_of(texts: DataFrame) -> DataFrame:
    """(g, file_id): the distinct byte trigrams of each text as numbers, by numpy over Arrow batches."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer((text.as_py() or "").encode("utf-8", "replace"), np.uint8).astype(np.int32)
                if len(data) < 3:
                    continue
                whole = (data[:-2] > 0) & (data[1:-1] > 0) & (data[2:] > 0)
                grams = np.unique((data[:-2] << 16 | data[1:-1] << 8 | data[2:])[whole])
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int32()), pa.array(np.full(len(grams), file), pa.int64())], ["g", "file_id"])

    return texts.select(F.col("file_id").cast("long").alias("file_id"), "text").mapInArrow(listed, "g int, file_id long")


def frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("g").agg(F.count("*").alias("files"))


def candidates(postings: DataFrame, literal: str, ignore_case: bool = False) -> DataFrame | None:
    """(file_id): files with all trigrams of the literal, in any case if asked; None if it is too short to tell.

    An index lists bytes, so with ignore_case a literal beyond ASCII cannot tell either.
    """
    grams = trigrams(literal.encode())
    if not grams or ignore_case and not literal.isascii():
        return None
    wanted = {number(v): k for k, gram in enumerate(grams) for v in (variants(gram) if ignore_case else [gram])}
    if len(wanted) < sum(len(variants(g)) if ignore_case else 1 for g in grams):
        return _of_each(postings, [{number(v) for v in variants(gram)} for gram in grams])
    place = F.element_at(F.create_map(*[x for g, k in wanted.items() for x in (F.lit(g), F.lit(k))]), F.col("g"))
    found = postings.where(F.col("g").isin(list(wanted)))
    if ignore_case:
        found = found.select("file_id", place.alias("g")).distinct()
    return found.groupBy("file_id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("file_id")


def _of_each(postings: DataFrame, groups: list[set[int]]) -> DataFrame:
    """Files that have a gram of every group, where groups may share grams."""
    holds = [F.max(F.col("g").isin(sorted(g)).cast("int")).alias(f"h{k}") for k, g in enumerate(groups)]
    found = postings.where(F.col("g").isin(sorted(set().union(*groups)))).groupBy("file_id").agg(*holds)
    return found.where(" and ".join(f"h{k} = 1" for k in range(len(groups)))).select("file_id")


def regex_candidates(postings: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame | None:
    """Files that hold what every match must hold; None if nothing is known of the matches."""
    out = None
    for group in required(pattern):
        sets = [candidates(postings, literal, ignore_case) for literal in group]
        if any(s is None for s in sets):
            continue
        one = sets[0]
        for other in sets[1:]:
            one = one.union(other)
        out = one.distinct() if out is None else out.join(one.distinct(), "file_id", "left_semi")
    return out


def explain(postings: DataFrame, literal: str) -> DataFrame:
    """(g, files) for each trigram of the literal, rarest first."""
    return frequencies(postings.where(F.col("g").isin([number(t) for t in trigrams(literal.encode())]))).orderBy("files", "g")


def search(
    texts: DataFrame,
    pattern: str,
    ignore_case: bool = False,
    regex: bool | None = None,
    lang: str | None = None,
    inside: str | None = None,
    outside: str | None = None,
    postings: DataFrame | None = None,
    per_file: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """(file_id, path, line, col, byte, shown): the matches that do not overlap, by path and place.

    A pattern with a regex's marks is one, unless `regex` says otherwise. Columns count
    bytes from 1; shown is the line, cut at 200 bytes. postings: a trigram index to
    narrow the files by. per_file and limit keep the first matches in order.
    """
    as_regex = is_regex(pattern) if regex is None else regex
    expression = ("(?i)" if ignore_case else "") + (pattern if as_regex else quoted(pattern))
    narrowed = texts.where(same_word("lang", lang) & path_filter(F.col("path"), inside, outside))
    if postings is not None:
        files = regex_candidates(postings, pattern, ignore_case) if as_regex else candidates(postings, pattern, ignore_case)
        if files is not None:
            told = [r.file_id for r in files.limit(TOLD + 1).collect()]
            narrowed = narrowed.where(F.col("file_id").isin(told)) if len(told) <= TOLD else narrowed.join(files, "file_id", "left_semi")
    plain = not as_regex and not ignore_case
    holds = F.col("text").contains(pattern) if plain else F.col("text").rlike(("(?m)" + expression))
    met = lines(narrowed.where(holds)).where(F.col("ln").contains(pattern) if plain else F.col("ln").rlike(expression))
    # the pieces around the matches: their lengths add up to the matches' places
    gaps = F.split("ln", expression, -1)
    hits = F.regexp_extract_all("ln", F.lit(f"({expression})"), F.lit(1))
    each = met.select("file_id", "path", "line", "byte_start", "ln", F.posexplode(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))).alias("k", "_piece"))
    each = each.select("file_id", "path", "line", "byte_start", "ln", "k", F.octet_length("_piece.gap").alias("gap"), F.octet_length("_piece.hit").alias("hit")).where("hit is not null")
    before = Window.partitionBy("file_id", "line").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("gap") + F.col("hit")).over(before), F.lit(0)) + F.col("gap")
    out = each.withColumn("_at", at).where("hit > 0").select("file_id", "path", "line", (F.col("_at") + 1).cast("long").alias("col"), (F.col("byte_start") + F.col("_at")).cast("long").alias("byte"), shown(F.col("ln")).alias("shown"))
    if per_file:
        first = F.row_number().over(Window.partitionBy("file_id").orderBy("byte"))
        out = out.withColumn("_k", first).where(F.col("_k") <= per_file).drop("_k")
    out = out.orderBy("path", "byte")
    return out.limit(limit) if limit else out


def shown(line: Column) -> Column:
    """The line, or as many whole characters as fit 200 bytes with a mark that it was cut."""
    cut = F.decode(F.substring(F.encode(line, "UTF-8"), 1, SHOWN_BYTES), "ISO-8859-1")
    # bytes of a character that was cut off at the end: a lead byte with too few bytes after it
    whole = F.regexp_replace(cut, "([\\u00C0-\\u00FF]|[\\u00E0-\\u00FF][\\u0080-\\u00BF]|[\\u00F0-\\u00FF][\\u0080-\\u00BF]{2})$", "")
    return F.when(F.octet_length(line) <= SHOWN_BYTES, line).otherwise(F.concat(F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8"), F.lit("…")))


def counts(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("hits"), F.count_distinct("file_id").alias("files"))
