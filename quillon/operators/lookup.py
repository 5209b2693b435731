"""Symbol lookup: exact, prefix, substring and fuzzy; paths and places in files.

`symbols` has the columns of the index plus `path`. Every result is in a total order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.columns import byte_levenshtein, path_filter, rank_score, same_word, subsequence

PLACE = ("path", "line", "col")


def ranked(symbols: DataFrame, limit: int | None) -> DataFrame:
    """With `score`; best first, then by path, line and column."""
    out = symbols.withColumn("score", rank_score()).orderBy(F.desc("score"), *PLACE, "name", "kind")
    return out.limit(limit) if limit else out


def one_package_each(symbols: DataFrame) -> DataFrame:
    """Of package symbols only the first of each name and language."""
    first = F.row_number().over(Window.partitionBy("kind", "name", "lang").orderBy(*PLACE))
    packages = symbols.where("kind = 'pkg'").withColumn("_first", first).where("_first = 1").drop("_first")
    return symbols.where("kind <> 'pkg'").unionByName(packages)


def definitions(
    symbols: DataFrame, name: str, lang: str | None = None, kind: str | None = None, inside: str | None = None, outside: str | None = None, limit: int = 100, every_package: bool = False
) -> DataFrame:
    found = symbols.where((F.col("name") == name) & same_word("lang", lang) & same_word("kind", kind) & path_filter(F.col("path"), inside, outside))
    return ranked(found if every_package else one_package_each(found), limit)


def by_prefix(symbols: DataFrame, prefix: str, inside: str | None = None, outside: str | None = None, limit: int = 50, first: int | None = None) -> DataFrame:
    """first: look only at so many rows in the order of names, as an index with a cap would; all by default."""
    found = symbols.where(F.col("name").startswith(prefix))
    if first:
        found = found.orderBy("name", *PLACE, "kind").limit(first)
    return ranked(found.where(path_filter(F.col("path"), inside, outside)), limit)


def substring_tier(name: Column, text: str) -> Column:
    """1: holds the text; 2: but for case; 3: holds its characters in order; null: none. Under 3 bytes: 1 for a prefix."""
    if len(text.encode()) < 3:
        return F.when(name.startswith(text), 1)
    low = text.lower()
    return F.when(name.contains(text), 1).when(F.lower(name).contains(low), 2).when(subsequence(name, text), 3)


def by_substring(symbols: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Holders of the text first, then but for case, then of its characters in order."""
    found = symbols.withColumn("tier", substring_tier(F.col("name"), text)).where("tier is not null")
    return found.orderBy("tier", "name", *PLACE, "kind").limit(limit)


def dictionary(symbols: DataFrame) -> DataFrame:
    """(name): each name once."""
    return symbols.select("name").distinct()


def fuzzy_score(name: Column, query: str) -> Column:
    """0 for the name itself, then prefixes and holders of the query by length, then others by edit distance."""
    n, q = F.octet_length(name), len(query.encode())
    distance = byte_levenshtein(name, F.lit(query))
    return F.when(name == query, 0).when(name.startswith(query), n - q).when(name.contains(query), n - q + 1).otherwise(distance + max(2 * q, 4)).cast("long")


def fuzzy(symbols: DataFrame, query: str, distance: int = 2, limit: int | None = 50, inside: str | None = None, outside: str | None = None) -> DataFrame:
    """Names that by_substring finds or that are within the byte edit distance, by fuzzy_score, rank and name.

    Scores are of distinct names, and symbols join them: one name is scored once.
    """
    names = dictionary(symbols)
    near = names.select("name", byte_levenshtein(F.col("name"), F.lit(query)).alias("distance"), fuzzy_score(F.col("name"), query).alias("fuzzy"), substring_tier(F.col("name"), query).alias("tier"))
    near = near.where((F.col("distance") <= distance) | F.col("tier").isNotNull()).drop("tier")
    found = symbols.where(path_filter(F.col("path"), inside, outside)).join(near, "name").withColumn("score", rank_score())
    found = found.orderBy("fuzzy", F.desc("score"), "name", *PLACE, "kind")
    return found.limit(limit) if limit else found


def did_you_mean(symbols: DataFrame, query: str) -> DataFrame:
    """Up to three names near a query of three bytes or more, nearest first."""
    size = len(query.encode())
    if size < 3:
        return symbols.select("name", F.lit(0).cast("long").alias("distance")).limit(0)
    names = fuzzy(symbols, query, 2, 32).select("name", "distance").distinct().where(F.octet_length("name") <= max(4 * size, 64))
    return names.orderBy("distance", F.abs(F.octet_length("name") - size), "name").limit(3)


def resolve_path(files: DataFrame, argument: str) -> DataFrame:
    """The file at this path, else the one with the shortest path that ends with it."""
    exact = F.col("path") == argument
    return files.where(exact | F.col("path").endswith("/" + argument)).orderBy(F.desc(exact), F.octet_length("path"), "file_id").limit(1)


def parse_place(text: str) -> tuple[str, int | None, int | None, int | None]:
    """(path, byte, line, column) of PATH@BYTE or PATH:LINE[:COLUMN]; ValueError for others."""
    if "@" in text:
        path, _, byte = text.rpartition("@")
        return path, int(byte), None, None
    m = re.fullmatch(r"(.+?):(\d+)(?::(\d+))?", text)
    if not m:
        raise ValueError(f"{text}: not PATH@BYTE, PATH:LINE or PATH:LINE:COLUMN")
    return m[1], None, int(m[2]), int(m[3] or 1)


def byte_of(lines: DataFrame, line: int, col: int = 1) -> DataFrame:
    """(file_id, byte) for lines (file_id, line, ln, byte_start): the column is cut to the line's length; no row past the end."""
    at = F.least(F.lit(col) - 1, F.octet_length("ln"))
    return lines.where(F.col("line") == line).select("file_id", (F.col("byte_start") + at).cast("long").alias("byte"))


def whereis(symbols: DataFrame, places: DataFrame, columns: Sequence[str] = ("name", "kind", "line", "span_start", "span_end")) -> DataFrame:
    """places (file_id, byte) with the columns of the symbol of the smallest span that holds the byte; of equal ones the one that starts later.

    Spans and places of a file pass by in the order of bytes, the spans that are
    open in a heap by size: as much work as there are rows, and no pairs.
    """
    kinds = {c: symbols.schema[c].dataType.simpleString() for c in columns}
    spans = symbols.select("file_id", F.col("span_start").cast("long").alias("at"), F.lit(0).alias("place"), F.col("span_end").cast("long").alias("until"), F.col("name").alias("_name"), F.col("kind").alias("_kind"), F.struct(*columns).alias("_own"))
    asked = places.select("file_id", F.col("byte").cast("long").alias("at")).distinct()
    asked = asked.select("file_id", "at", F.lit(1).alias("place"), *[F.lit(None).alias(c) for c in ("until", "_name", "_kind", "_own")])
    files = asked.select("file_id").distinct()
    both = spans.join(files, "file_id", "left_semi").unionByName(asked).repartition("file_id").sortWithinPartitions("file_id", "at", "place")

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, open_ = None, []
        for batch in batches:
            rows, own = [], batch.column(6)
            out: list = []
            for k, (of, at, place, until, name, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True)):
                if of != file:
                    file, open_ = of, []
                if not place:
                    heappush(open_, (until - at, -at, name, kind, until, id(batch), k, own[k]))
                    continue
                while open_ and open_[0][4] <= at:
                    heappop(open_)
                if open_:
                    rows.append((of, at))
                    out.append(open_[0][-1].as_py())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(out, own.type)], ["file_id", "byte", "own"])

    best = both.mapInArrow(found, "file_id long, byte long, own struct<" + ",".join(f"{c}:{t}" for c, t in kinds.items()) + ">")
    return best.select("file_id", "byte", "own.*")


def enclosed(found: DataFrame, symbols: DataFrame, column: str = "fqn_live") -> DataFrame:
    """found (file_id, byte, ...) with `fqn`: that column of the innermost symbol around each, null outside any."""
    around = whereis(symbols, found, (column,)).withColumnRenamed(column, "fqn")
    return found.join(around, ["file_id", "byte"], "left")


def enclosing_package(symbols: DataFrame) -> DataFrame:
    """(file_id, package): the first package symbol of each file."""
    return symbols.where("kind = 'pkg'").groupBy("file_id").agg(F.min_by("name", F.struct("line", "col")).alias("package"))


def narrow_hint(paths: list[str]) -> str:
    """The longest folder that all shown paths share."""
    parts = [p.split("/")[:-1] for p in paths]
    shared = []
    for level in zip(*parts, strict=False):
        if len(set(level)) > 1:
            break
        shared.append(level[0])
    return "/".join(shared)
