"""Keeping an index up to date: digests, tombstones, compaction, incremental merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.summary import index_diff


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def tombstones(files: DataFrame, argument: str, exact: bool = False) -> DataFrame:
    """(file_id): files whose path holds the argument, or is it."""
    return files.where(F.col("path") == argument if exact else F.col("path").contains(argument)).select("file_id")


def living(table: DataFrame, dead: DataFrame) -> DataFrame:
    """Rows of any table with file_id whose file has no tombstone."""
    return table.join(dead.select("file_id").distinct(), "file_id", "left_anti")


def merged(old_files: DataFrame, old_rows: DataFrame, new_files: DataFrame, extract) -> DataFrame:
    """Rows of an index after a change of files: those of unchanged files stay, changed and added files are extracted anew.

    extract gets the new files that must be read and returns their rows. Files are
    matched by root and relative path; new_files number changed files as new ones.
    """
    status = index_diff(old_files, new_files)
    gone = old_files.join(status.where("status in ('changed', 'removed')").select("root_id", "relpath"), ["root_id", "relpath"], "left_semi")
    todo = new_files.join(status.where("status in ('changed', 'added')").select("root_id", "relpath"), ["root_id", "relpath"], "left_semi")
    return living(old_rows, gone).unionByName(extract(todo).select(*old_rows.columns))


def duplicates(files: DataFrame) -> DataFrame:
    """(digest, copies, first): contents that several files have."""
    return files.groupBy("digest").agg(F.count("*").alias("copies"), F.min("path").alias("first")).where("copies > 1")
