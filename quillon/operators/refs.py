"""Uses of names: lookup, formats, resolution, and which function encloses which use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.columns import path_filter, same_word
from quillon.functions.schema import FUNCTION_KINDS

PLACE = ("path", "line", "col")


def find(refs: DataFrame, name: str, kind: str | None = None, lang: str | None = None, scope: str | None = None, inside: str | None = None, outside: str | None = None, limit: int | None = None) -> DataFrame:
    """Uses of the name; scope: a segment that the use's scope must have. By path, line and column."""
    ok = (F.col("name") == name) & same_word("kind", kind) & same_word("lang", lang) & path_filter(F.col("path"), inside, outside)
    if scope:
        ok = ok & F.array_contains("scope_path", scope)
    out = refs.where(ok).orderBy(*PLACE)
    return out.limit(limit) if limit else out


def callers(refs: DataFrame, name: str, **options) -> DataFrame:
    return find(refs, name, kind="call", **options)


def paths(found: DataFrame, limit: int | None = None) -> DataFrame:
    out = found.select("path").distinct().orderBy("path")
    return out.limit(limit) if limit else out


def resolved(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs with resolved_to and resolution: the first symbol of that name in the use's language, else the first of all.

    Symbols come to one row for each name, and one for each name and language, before
    they meet the uses, so a common name does not multiply rows.
    """
    order = F.struct("path", "line", "col", "id")
    any_ = symbols.groupBy("name").agg(F.min_by("id", order).alias("_any"))
    own = symbols.groupBy("name", "lang").agg(F.min_by("id", order).alias("_own"))
    out = refs.drop("resolved_to").join(own, ["name", "lang"], "left").join(any_, "name", "left")
    how = F.when(F.col("_own").isNotNull(), "same_lang").when(F.col("_any").isNotNull(), "first")
    return out.withColumn("resolved_to", F.coalesce("_own", "_any")).withColumn("resolution", how).drop("_own", "_any")


def by_definition(found: DataFrame, symbols: DataFrame, limit: int = 50) -> DataFrame:
    """(def_id, def_path, def_line, n): uses counted by what they resolve to, most first, unresolved ones last."""
    counts = found.groupBy(F.col("resolved_to").alias("def_id")).agg(F.count("*").alias("n"))
    defs = symbols.select(F.col("id").alias("def_id"), F.col("path").alias("def_path"), F.col("line").alias("def_line"))
    return counts.join(defs, "def_id", "left").orderBy(F.col("def_id").isNull(), F.desc("n"), "def_id").limit(limit)


def annotation(path: Column, line: Column, scope: Column) -> Column:
    """` a/B.java:12 [scope]`: the last two segments of the path, the line and the scope."""
    short = F.array_join(F.slice(F.split(path, "/"), -2, 2), "/")
    return F.concat(F.when(path.contains("/"), short).otherwise(path), F.lit(":"), line.cast("string"), F.when(F.size(scope) > 0, F.concat(F.lit(" ["), F.array_join(scope, "::"), F.lit("]"))).otherwise(""))


def enclosing(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs with caller_id, caller and caller_line: the last function of the file that starts at or before the use.

    An as-of join: functions and uses of a file in one order, each use taking the last
    function seen. A window by file, so the rows of one file meet, not of one name.
    """
    functions = symbols.where(F.col("kind").isin(*FUNCTION_KINDS)).select("file_id", "byte_start", F.lit(0).alias("_use"), F.struct("id", "name", "line").alias("_fn"), F.lit(None).alias("_row"))
    kept = refs.columns
    uses = refs.select("file_id", "byte_start", F.lit(1).alias("_use"), F.lit(None).alias("_fn"), F.struct(*kept).alias("_row"))
    order = Window.partitionBy("file_id").orderBy("byte_start", "_use").rowsBetween(Window.unboundedPreceding, 0)
    both = functions.unionByName(uses).withColumn("_fn", F.last("_fn", ignorenulls=True).over(order)).where("_use = 1")
    return both.select("_row.*", F.col("_fn.id").alias("caller_id"), F.col("_fn.name").alias("caller"), F.col("_fn.line").alias("caller_line"))


def uses(refs: DataFrame, symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """What the definitions of a name use: the uses between a definition's start and the next function's, each once.

    One pass by file in the order of bytes: a use counts if no function started after the
    last definition of the name before it.
    """
    defines, function = F.col("name") == name, F.col("kind").isin(*FUNCTION_KINDS)
    files = symbols.where(defines).select("file_id").distinct()
    kept = refs.columns
    starts = symbols.where(defines | function).select("file_id", "byte_start", F.lit(0).alias("_use"), F.when(defines, F.col("byte_start")).alias("_def"), F.when(function, F.col("byte_start")).alias("_fn"), F.lit(None).alias("_row"))
    rows = refs.where(same_word("kind", kind)).select("file_id", "byte_start", F.lit(1).alias("_use"), F.lit(None).alias("_def"), F.lit(None).alias("_fn"), F.struct(*kept).alias("_row"))
    order = Window.partitionBy("file_id").orderBy("byte_start", "_use").rowsBetween(Window.unboundedPreceding, 0)
    both = starts.unionByName(rows).join(files, "file_id", "left_semi")
    both = both.withColumn("_def", F.max("_def").over(order)).withColumn("_fn", F.max("_fn").over(order))
    inside = both.where((F.col("_use") == 1) & (F.col("_def") >= F.coalesce("_fn", F.lit(-1))))
    return inside.select("_row.*").dropDuplicates(["file_id", "byte_start"])


def per_file(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(file_id, symbols, refs): how many definitions and uses each file with definitions has. Counted before they meet."""
    counts = refs.groupBy("file_id").agg(F.count("*").alias("refs"))
    own = symbols.groupBy("file_id").agg(F.count("*").alias("symbols"))
    return own.join(counts, "file_id", "left").select("file_id", "symbols", F.coalesce("refs", F.lit(0)).cast("long").alias("refs"))
