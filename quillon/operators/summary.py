"""Reports over files and symbols, owners, differences, and the query log."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.columns import quoted, rank_score


def outline(symbols: DataFrame, path: str, limit: int = 0) -> DataFrame:
    out = symbols.where(F.col("path") == path).orderBy("line", "col", "name")
    return out.limit(limit) if limit else out


def kinds(symbols: DataFrame, *by: str) -> DataFrame:
    return symbols.groupBy(*by, "kind").agg(F.count("*").alias("n"))


def languages(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("lang").agg(F.count("*").alias("n"))


def best_of_each(symbols: DataFrame, n: int = 3) -> DataFrame:
    """The n best-ranked symbols of each file, with `place` from 1."""
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc(rank_score()), "line", "col", "name"))
    return symbols.withColumn("place", place).where(F.col("place") <= n)


def first_lines(texts: DataFrame) -> DataFrame:
    """(file_id, path, first): the first line that is not blank, trimmed."""
    return texts.select("file_id", "path", F.regexp_extract("text", r"(?m)^[ \t\r]*([^ \t\r\n].*?)[ \t\r]*$", 1).alias("first"))


def coverage(files: DataFrame, symbols: DataFrame, inside: str = "") -> DataFrame:
    """(lang, files, bytes, symbols) of the files whose path holds the text; symbols are counted before they meet files."""
    part = files.where(F.col("path").contains(inside))
    per_file = symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    joined = part.join(per_file, "file_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum(F.coalesce("n", F.lit(0))).alias("symbols"))


def coverage_by_kind(symbols: DataFrame) -> DataFrame:
    """Symbols by language and kind, with a total (null kind) for each language and one for all."""
    return symbols.rollup("lang", "kind").agg(F.count("*").alias("n"))


def index_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(root_id, relpath, status) from the digests of two file tables: unchanged, changed, added or removed."""
    a = old.select("root_id", "relpath", F.col("digest").alias("_a"), F.lit(True).alias("_in_a"))
    b = new.select("root_id", "relpath", F.col("digest").alias("_b"), F.lit(True).alias("_in_b"))
    status = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    return a.join(b, ["root_id", "relpath"], "full_outer").select("root_id", "relpath", status.alias("status"))


def changed_symbols(files: DataFrame, symbols: DataFrame, changed: DataFrame, limit: int = 50) -> DataFrame:
    """(relpath, symbol_count) of the files among changed (root_id, relpath)."""
    met = files.join(changed, ["root_id", "relpath"], "left_semi")
    n = symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    return met.join(n, "file_id", "left").select("relpath", F.coalesce("n", F.lit(0)).cast("long").alias("symbol_count")).orderBy("relpath").limit(limit)


def ancestors(files: DataFrame) -> DataFrame:
    """(file_id, path, dir, depth) for every folder above each file; depth 1 is the nearest."""
    parts = F.split("path", "/")
    n = F.size(parts)
    each = files.select("file_id", "path", F.explode(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))).alias("depth"), parts.alias("_parts"))
    return each.select("file_id", "path", F.array_join(F.slice("_parts", 1, F.greatest(F.size("_parts") - F.col("depth"), F.lit(0))), "/").alias("dir"), "depth")


def owners(files: DataFrame, owners_files: DataFrame, mode: str = "nearest") -> DataFrame:
    """(file_id, path, depth, email): who owns each file, by owners_files (dir, emails, noparent, and maybe rules).

    From the nearest folder upwards; a folder that cuts its parents off is the last that
    counts. `nearest` keeps the first folder with emails, `all` every folder. rules (pattern,
    emails) add the emails of patterns that match a file's whole base name.
    """
    up = ancestors(files).join(owners_files, "dir")
    if "rules" in owners_files.columns:
        name = F.substring_index("path", "/", -1)
        own = F.flatten(F.transform(F.filter("rules", lambda r: F.rlike(name, r["pattern"])), lambda r: r["emails"]))
        up = up.withColumn("emails", F.array_distinct(F.concat("emails", own)))
    by_file = Window.partitionBy("file_id")
    last = F.min(F.when(F.col("noparent"), F.col("depth"))).over(by_file)
    seen = up.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("depth") <= F.col("_last")))
    if mode == "nearest":
        seen = seen.withColumn("_near", F.min(F.when(F.size("emails") > 0, F.col("depth"))).over(by_file)).where("depth = _near")
    return seen.select("file_id", "path", "depth", F.explode("emails").alias("email"))


def parse_owners(text: str) -> dict:
    """emails, per_file rules as they stand, noparent, and rules: (regular expression, emails) of rules that name emails."""
    out = {"emails": [], "per_file": [], "noparent": False, "rules": []}
    for line in (x.strip() for x in text.splitlines()):
        if line in ("set noparent", "noparent"):
            out["noparent"] = True
        elif line.startswith("per-file"):
            out["per_file"].append(line[8:].strip())
            globs, _, owners = line[8:].partition("=")
            if emails := [x.strip() for x in owners.split(",") if "@" in x]:
                out["rules"] += [(_glob(g.strip()), emails) for g in globs.split(",") if g.strip()]
        elif line.startswith("file:"):
            out["per_file"].append(line)
        elif "@" in line and " " not in line and not line.startswith("#"):
            out["emails"].append(line)
    return out


def _glob(pattern: str) -> str:
    """A Java regular expression for names that match a shell pattern of *, ? and [sets]."""
    parts = re.findall(r"\[[^\]]*\]|.", pattern)
    return "^" + "".join({"*": ".*", "?": "."}.get(x) or (x if len(x) > 1 else quoted(x)) for x in parts) + "$"


def slow_commands(log: DataFrame, share: float = 0.95) -> DataFrame:
    """(cmd, n, p95): exact interpolated percentile of elapsed_ms by command."""
    return log.groupBy("cmd").agg(F.count("*").alias("n"), F.percentile("elapsed_ms", share).alias("p95"))


def empty_results(log: DataFrame) -> DataFrame:
    return log.where("hits = 0").groupBy("cmd", "query").agg(F.count("*").alias("n"))


def per_day(log: DataFrame) -> DataFrame:
    day = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd")
    return log.groupBy(day.alias("day"), "cmd").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"))


def slowest(log: DataFrame, limit: int = 20) -> DataFrame:
    return log.orderBy(F.desc("elapsed_ms"), "ts", "cmd", "query").limit(limit)
