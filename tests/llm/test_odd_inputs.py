"""Columns with clashing names and very long texts, for each operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontam, embeddings, langid, licenses, linededup, mixing, pii, simhash, toxicity, warc

#: Names that the operators use for helpers of their own, and some of their results.
HELPERS = {
    "op1": "fp mark node root least start key hot g u v component_id z",
    "op2": "kind start stop added _row spans _",
    "op3": "rep lead code codes dim group n total weight radius part side blocks own with low high a b links other verdict gained n_links component_id least root centre",
    "op4": "chance places counts df n _row score",
    "op5": "block tests item_word _row",
    "op6": "digest size first refers_to archive at sizes records n payload",
    "op7": "calibrates place toxic n best found background _row",
    "op8": "_row _size _hash _bucket _source _b _base _middle _part _of kind demands weight most level before",
    "op9": "key shard part bits drop holder documents n _id _row lines used buckets add",
    "op10": "_key _words stretches stretch parts band window hashes pairs n _at length",
}


def named(df, op):
    return df.select("*", *[F.lit(n).alias(n) for n in HELPERS[op].split() if n not in df.columns])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"word{i % 3} alpha beta gamma delta epsilon zeta" + (" write a@b.cd" if i == 1 else "") + ("\nA line that is long enough to be counted, surely." if i < 6 else ""), "en" if i % 2 else "de", f"s{i % 2}") for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def same(out, plain, op, key="doc_id"):
    """The rows of both by id agree, and the helpers' namesakes hold what they held."""
    got, want = ({r[key]: r for r in x.collect()} for x in (out, plain))
    assert set(got) == set(want)
    for i, r in want.items():
        assert all(got[i][c] == r[c] for c in plain.columns), (op, i)
        assert all(got[i][n] == n for n in HELPERS[op].split() if n in out.columns and n not in plain.columns)
    assert set(HELPERS[op].split()) <= set(out.columns) or op in ("op1", "op3", "op6")


def test_clashing_columns(spark, docs):
    same(simhash.near_duplicates(named(docs, "op1")), simhash.near_duplicates(docs), "op1")
    same(pii.find(named(docs, "op2")), pii.find(docs), "op2")
    model = langid.fit(named(docs, "op4"))
    same(langid.predict(named(docs, "op4"), model), langid.predict(docs, langid.fit(docs)), "op4")
    items = spark.createDataFrame([("x", "alpha beta gamma")], "item_id string, text string")
    same(decontam.matches(named(docs, "op5"), named(items, "op5")), decontam.matches(docs, items), "op5")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    same(toxicity.score(named(docs, "op7"), toxicity.fit(named(docs, "op7"), named(labels, "op7"))), toxicity.score(docs, toxicity.fit(docs, labels)), "op7")
    mixed = mixing.assign(named(docs, "op8"))
    assert mixed.count() == 12 and all(r[n] == n for r in mixed.collect() for n in HELPERS["op8"].split())
    empty = linededup.LineIndex.empty(spark)
    same(empty.insert(named(docs, "op9")).apply(named(docs, "op9")), empty.insert(docs).apply(docs), "op9")
    same(licenses.scan(named(docs, "op10")), licenses.scan(docs), "op10")
    rng = np.random.default_rng(0)
    vectors = spark.createDataFrame([(i, rng.normal(size=8).tolist() if i % 4 else [1.0] * 8, 1) for i in range(20)], "vec_id long, embedding array<double>, label int")
    same(embeddings.near_duplicates(named(vectors, "op3")), embeddings.near_duplicates(vectors), "op3", "vec_id")
    pages = spark.createDataFrame([(i, f"http://x/{i}", "y" * 1200 if i % 2 else "z") for i in range(6)], "page_id long, url string, html string")
    same(warc.read_records(warc.write_archives(named(pages, "op6"))), warc.read_records(warc.write_archives(pages)), "op6", "page_id")


def test_very_long_texts(spark):
    """Texts of some megabytes, with what is looked for at their end."""
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    long = " ".join(random.choices(vocabulary, k=700_000))
    item = " ".join(random.choices(vocabulary, k=14))
    line = "A line that is long enough to be counted, surely."
    tail = f" {item} then mail a (at) b (dot) org or 10.2.3.4 {licenses.TEMPLATES['MIT-text']} "
    rows = [(1, long + tail), (2, long + tail + "\n" + f"{line}\n" * 50_000)] + [(i, line) for i in range(3, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {r.doc_id: r.fp for r in simhash.near_duplicates(docs).collect()}
    assert bin((prints[1] ^ prints[3]) % (1 << 64)).count("1") > 2
    spans = {r.doc_id: {(s.kind, r.text[s.start : s.stop]) for s in r.found} for r in pii.find(docs.where("doc_id = 1")).collect()}
    assert spans[1] == {("email", "a (at) b (dot) org"), ("ip", "10.2.3.4")}
    found = {r.doc_id: r for r in decontam.matches(docs, spark.createDataFrame([("x", item)], "item_id string, text string")).collect()}
    assert [(found[i].n_hit, found[i].longest.words, found[i].longest.doc_word) for i in (1, 2)] == [(14, 14, 700_000)] * 2
    lines = {r.doc_id: r for r in linededup.LineIndex.empty(spark).insert(docs).apply(docs).collect()}
    assert lines[2].n_dropped == 50_000 and [lines[i].n_dropped for i in (3, 6, 7)] == [1, 1, 0]
    held = {r.doc_id: {x.license for x in r.licenses} for r in licenses.scan(docs).collect()}
    assert "MIT-text" in held[1] and "MIT-text" in held[2] and not held[3]
    mixed = {r.doc_id: r.size for r in mixing.assign(docs.withColumn("source", F.lit("s"))).collect()}
    assert mixed[1] == len((long + tail).split())
    quiet = [(100 + i, " ".join(random.choices(vocabulary, k=30)) + (" you vile creep" if i % 3 == 0 else "")) for i in range(600)]
    taught = spark.createDataFrame(quiet, "doc_id long, text string")
    model = toxicity.fit(taught, taught.select("doc_id", (F.col("doc_id") % 3 == 1).cast("int").alias("toxic")))
    scored = toxicity.score(spark.createDataFrame([(1, long + " you vile creep" * 8), (2, long)], "doc_id long, text string"), model).collect()
    assert [(p.start, p.stop) for p in scored[0].passages] == [(700_000, 700_024)] and not scored[1].passages
    pages = spark.createDataFrame([(1, "u", long), (2, "v", long)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.payload_bytes) for r in warc.read_records(warc.write_archives(pages)).collect()}
    assert got == {1: ("revisit", len(long)), 2: ("response", len(long))}
