"""A training corpus from the table documents, in five stages that each read what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontam, langid, linededup, mixing, wide
from quillon.llm.shared import bounded, redealt, stored

#: SQL cannot express language ID, SimHash groups and the mix: tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not rejected: their text has a letter and is not far from all languages learnt.

    Null texts go. Columns of docs stay as they are.
    """
    found = langid.predict(docs, langid.fit(docs.select("doc_id", "text", "lang")))
    return found.where(~F.col("rejected")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat across documents, but for the largest doc_id holding them.

    Documents that lose all their lines stay, with an empty text; n_chars follows the text.
    """
    index = linededup.LineIndex.empty(spark).insert(docs.select("doc_id", "text"))
    cut = index.apply(docs, index.refs)
    length = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in docs.columns else {}
    return cut.select(*[length.get(c, F.col(c)) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by sets of 5-word shingles of similarity 0.8 or more: the smallest doc_id.

    If rows of one group share that id, one of them stays. Texts without words are
    one group. A row with a null id stays only in a group of nothing else.
    """
    own = stored(wide.near_duplicates(docs.select("doc_id", "text")), "groups")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    keepers = own.where(first).groupBy("root").agg(F.min("mark").alias("chosen"), F.count("*").alias("rows"))
    judged = own.join(redealt(keepers, "root"), "root").withColumn("stays", first & (F.col("mark") == F.col("chosen")))
    gone = bounded(stored(judged.where("not stays").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct(), "gone"))
    same = docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_mark"])
    rows = docs.join(gone, same, "left_anti")
    again = stored(judged.where("stays and rows > 1").groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")), "again")
    if again.isEmpty():
        return rows
    same = rows["doc_id"].eqNullSafe(again["_id"]) & (F.xxhash64(rows["text"]) == again["_mark"])
    one = rows.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return rows.join(again, same, "left_anti").unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontam.matches(docs, items).where("n_hit = 0").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The readings of the mix in training order: columns of documents, with size, source_size, target, taken and position."""
    return mixing.training_order(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}
