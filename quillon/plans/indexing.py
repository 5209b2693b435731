"""Registered queries of extraction, indexing, module graphs and requests: over sources made from the documents, and over small fixed trees."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.graph import reach, shared_folder
from quillon.plans.samples import SAMPLES
from quillon.rpc import Server
from quillon.sources import modules, tree
from quillon.sources.corpus import Corpus
from quillon.sources.extract import extracted
from quillon.sources.tree import Index

Query = Callable[[SparkSession, str], DataFrame]

#: A tree of a few files, for requests and tables of an index.
TREE = {
    "a/Boat.java": "package port;\nclass Boat {\n  void leave() { cast(); }\n  void cast() { }\n}\n",
    "a/Ferry.java": "package port;\nclass Ferry extends Boat {\n  void cross() { leave(); }\n}\n",
    "b/Shuttle.java": "package port;\nclass Shuttle extends Ferry {\n  void hurry() { cross(); }\n}\n",
    "tests/FerryTest.java": "package port;\nclass FerryTest {\n  void cross() { new Ferry().cross(); }\n}\n",
    "OWNERS": "harbour@example.com\n",
    "a/OWNERS": "set noparent\nboats@example.com\nper-file F*.java = ferries@example.com\n",
    "node_modules/skipped.py": "def hidden(): pass\n",
    "broken.py": "def broken(:\n",
    "blob.ts": "x" * 100 + "\0" + "y" * 1500,
    "plain.unknown": "nothing\n",
}


def _folder(spark: SparkSession) -> str:
    at = shared_folder(spark)
    return f"{at if '://' in at else 'file://' + at.removeprefix('file:')}/trees/{uuid.uuid4().hex}"


def _unloaded(spark: SparkSession, files: DataFrame) -> str:
    folder = _folder(spark)
    tree.unload(files, folder).count()
    return folder


def _small(spark: SparkSession) -> tuple[str, Index]:
    rows = [(name, bytearray(text.encode())) for name, text in TREE.items()]
    root = _unloaded(spark, spark.createDataFrame(rows, "relpath string, content binary"))
    index = Index(spark, _folder(spark))
    index.build({root: "generic"})
    return root, index


def _values(columns: str, rows: list[tuple]) -> str:
    def text(x) -> str:
        return "null" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"select * from (values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) as t({columns})"


def _extractor(lang: str, text: str) -> Query:
    def run(spark: SparkSession, _: str) -> DataFrame:
        file = spark.createDataFrame([(0, "/x", lang, bytearray(text.encode()))], "file_id long, path string, lang string, content binary")
        return extracted(file).where("symbol is not null").select("symbol", "name", "kind", F.array_join("scope_path", "::").alias("scope"), "line")

    return run


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a Java file: written, walked, numbered, extracted, and read back from the index's tables."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(F.lit("  void m"), (i + 1).cast("string"), F.lit("() { call_"), (F.length(x) % 7).cast("string"), F.lit("(); }\n")))
    number = F.col("doc_id").cast("string")
    content = F.concat(F.lit("package docs;\nclass D"), number, F.lit(" {\n"), F.array_join(lines, ""), F.lit("}\n"))
    root = _unloaded(spark, Corpus(spark, sf_dir).table("documents").select(F.concat(F.lit("d/"), number, F.lit(".java")).alias("relpath"), F.encode(content, "UTF-8").alias("content")))
    index = Index(spark, _folder(spark))
    index.build({root: "generic"}, trigrams=False)
    kinds = index.table("symbols_by_file").groupBy("file_id").agg(F.count_if(F.col("kind") == "method").alias("methods"), F.count_if(F.col("kind") == "class").alias("classes"))
    calls = index.table("refs_by_file").groupBy("file_id").agg(F.count_if(F.col("kind") == "call").alias("calls"))
    return index.table("files").join(kinds, "file_id").join(calls, "file_id").select("file_id", "relpath", "lang", "size", "methods", "classes", "calls")


_INDEX_BUILD = """
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as ln, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
f as (select doc_id, count(*) as n, sum(strlen('  void m' || i || '() { call_' || length(ln) % 7 || '(); }') + 1) as body from l group by doc_id)
select row_number() over (order by 'd/' || doc_id || '.java') - 1 as file_id, 'd/' || doc_id || '.java' as relpath, 'Java' as lang,
       (body + strlen('package docs;' || 'class D' || doc_id || ' {' || '}') + 3)::bigint as size, n as methods, 1::bigint as classes, n as calls from f
"""


def walk_small(spark: SparkSession, _: str) -> DataFrame:
    """The walk of a tree: what is skipped, unknown or binary is left out."""
    root, _ = _small(spark)
    return tree.walk(spark, {root: "generic"}).select("root_id", "relpath", "lang", "size")


def walk_counts(spark: SparkSession, _: str) -> DataFrame:
    root, _ = _small(spark)
    return tree.count_by_kind(tree.listing(spark, {root: "generic"}))


def index_tables(spark: SparkSession, _: str) -> DataFrame:
    """Rows by table after a build, a change of the tree, a refresh, a tombstone and a compaction."""
    root, index = _small(spark)
    out = None

    def counted(step: str) -> DataFrame:
        rows = None
        for name in ("files", "contents", "symbols", "refs", "errors"):
            one = index.living(name).agg(F.lit(step).alias("step"), F.lit(name).alias("tab"), F.count("*").alias("n"))
            rows = one if rows is None else rows.unionByName(one)
        return rows

    changes = {"a/Ferry.java": "package port;\nclass Ferry extends Boat { void sink() { } void cross() { leave(); sink(); } }\n", "c/Raft.java": "class Raft { }\n"}
    for step, work in (
        ("build", lambda: None),
        ("refresh", lambda: (tree.unload(spark.createDataFrame([(k, bytearray(v.encode())) for k, v in changes.items()], "relpath string, content binary"), root).count(), index.refresh({root: "generic"}))),
        ("tombstone", lambda: index.tombstone("Shuttle")),
        ("compact", index.compact),
    ):
        work()
        rows = [tuple(r) for r in counted(step).collect()]  # five counts
        one = spark.createDataFrame([*rows, (step, "wrong", len(index.health()))], "step string, tab string, n long")
        out = one if out is None else out.unionByName(one)
    return out


_INDEX_TABLES = [
    *[("build", t, n) for t, n in (("files", 7), ("contents", 7), ("symbols", 17), ("refs", 7), ("errors", 1), ("wrong", 0))],
    *[("refresh", t, n) for t, n in (("files", 8), ("contents", 8), ("symbols", 19), ("refs", 8), ("errors", 1), ("wrong", 0))],
    *[("tombstone", t, n) for t, n in (("files", 7), ("contents", 7), ("symbols", 16), ("refs", 6), ("errors", 1), ("wrong", 0))],
    *[("compact", t, n) for t, n in (("files", 7), ("contents", 7), ("symbols", 16), ("refs", 6), ("errors", 1), ("wrong", 0))],
]

#: A request of each verb, and of its reply the number of rows and what the first says.
_REQUESTS = [
    ("def", {"name": "cross"}, "name", 2, "cross"),
    ("prefix", {"prefix": "Fer"}, "name", 2, "Ferry"),
    ("fuzzy", {"query": "Shutle"}, "name", 1, "Shuttle"),
    ("ref", {"name": "cross", "format": "count"}, "count", 1, "2"),
    ("callers", {"name": "leave"}, "kind", 1, "call"),
    ("subclasses", {"name": "Boat", "depth": 2}, "kind", 2, "class"),
    ("impact", {"name": "Ferry"}, "subclasses", 1, "1"),
    ("callgraph", {"name": "cast"}, "caller", 4, "leave"),
    ("uses", {"name": "leave"}, "name", 1, "cast"),
    ("grep", {"pattern": "leave", "fqn": True}, "fqn", 2, "port.Boat.leave"),
    ("outline", {"path": "a/Boat.java"}, "name", 4, "port"),
    ("tldr", {"path": "a/Boat.java"}, "first", 1, "package port;"),
    ("coverage", {"path": "/a/"}, "lang", 2, None),
    ("stats", {}, "files", 1, "7"),
    ("owner", {"path": "a/Ferry.java", "accumulate": True}, "email", 2, "boats@example.com"),
    ("whereis", {"path": "a/Ferry.java:3:18"}, "fqn_live", 1, "port.Ferry.cross"),
    ("nothing", {}, "code", 1, "-32601"),
]


def requests(spark: SparkSession, _: str) -> DataFrame:
    """Every verb through the server."""
    server, out = Server(_small(spark)[1]), []
    for verb, args, key, _, first in _REQUESTS:
        reply = next(server.request(json.dumps({"id": 1, "cmd": verb, "args": args})))
        rows = reply.get("result", reply.get("error"))
        rows = rows if isinstance(rows, list) else [rows]
        out.append((verb, len(rows), None if first is None else str(rows[0][key])))
    return spark.createDataFrame(out, "verb string, rows long, first string")


_CARGO = {"a/Cargo.toml": b'[package]\nname="a"\n[dependencies]\nb={path="../b"}\n', "b/Cargo.toml": b'[package]\nname="b"\n[dev-dependencies]\nc={path="../c"}\n', "c/Cargo.toml": b'[package]\nname="c"\n'}
_SOONG = json.dumps({"m": {"module_name": "m", "path": ["p"], "dependencies": ["n", "gone"]}, "n": {"module_name": "n", "path": ["p/q"], "dependencies": []}}).encode()
_GN = json.dumps({"targets": {"//a": {"deps": ["//b"], "sources": ["//x.cc"]}, "//b": {"public_deps": ["//c"], "sources": ["//x.cc", "//y.cc"]}, "//c": {}}}).encode()
_BAZEL = json.dumps({"target": [{"type": "RULE", "rule": {"name": "//p:a", "attribute": [{"name": "deps", "stringListValue": ["//p:b"]}, {"name": "srcs", "stringListValue": ["//p:x.cc"]}]}}, {"type": "RULE", "rule": {"name": "//p:b"}}]}).encode()
#: Module graphs of each build system, and what reaches what in them.
_GRAPHS = {
    "cargo": (lambda: modules.cargo(_CARGO, ["a/src/x.rs", "b/tests/y.rs", "b/z.rs", "c/src/w.rs"]), [("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "c")]),
    "soong": (lambda: modules.soong(_SOONG, ["p/a.c", "p/q/r/b.c", "z.c"]), [("m", "m"), ("m", "n"), ("n", "n")]),
    "kernel": (lambda: modules.kernel(["Makefile", "Kconfig", "fs/a.c", "mm/b.c", "LICENSES/c"]), [("fs", "fs"), ("fs", "mm"), ("mm", "fs"), ("mm", "mm")]),
    "gn": (lambda: modules.gn(_GN, ["x.cc", "y.cc"]), [("//a", "//a"), ("//a", "//b"), ("//a", "//c"), ("//b", "//b"), ("//b", "//c"), ("//c", "//c")]),
    "bazel": (lambda: modules.bazel(_BAZEL, ["p/x.cc"]), [("//p:a", "//p:a"), ("//p:a", "//p:b"), ("//p:b", "//p:b")]),
}


def _graph(made: Callable) -> Query:
    def run(spark: SparkSession, _: str) -> DataFrame:
        named, deps, _ = made().tables(spark)
        names = named.select("module_id", "name")
        closed = reach(named, deps)
        return closed.join(names.toDF("src", "of"), "src").join(names.toDF("dst", "reaches"), "dst").select("of", "reaches")

    return run


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f"extract_{lang.lower()}": _extractor(lang, text) for lang, text, *_ in SAMPLES}
    out |= {f"modules_{kind}": _graph(made) for kind, (made, _) in _GRAPHS.items()}
    return out | {"index_build": index_build, "walk_small": walk_small, "walk_counts": walk_counts, "index_tables": index_tables, "requests": requests}


def oracle_sql() -> dict[str, str]:
    out = {}
    for lang, _, definitions, uses in SAMPLES:
        rows = [(*r[:3], r[3], "d") for r in definitions] + [(*r[:3], r[3], "u") for r in uses]
        out[f"extract_{lang.lower()}"] = f"select s = 'd' as symbol, name, kind, scope, line from ({_values('name, kind, scope, line, s', rows)})"
    out |= {f"modules_{kind}": _values("of, reaches", pairs) for kind, (_, pairs) in _GRAPHS.items()}
    listed = [(k, "Java" if k.endswith(".java") else "Owners" if k.endswith("OWNERS") else "Python") for k in TREE if not k.startswith(("node_modules", "blob", "plain"))]
    return out | {
        "index_build": _INDEX_BUILD,
        "walk_small": _values("root_id, relpath, lang, size", [(0, k, lang, len(TREE[k].encode())) for k, lang in listed]),
        "walk_counts": _values("lang, files, bytes", [(kind, sum(x == kind for _, x in rows), sum(len(TREE[k].encode()) for k, x in rows if x == kind)) for rows in [[*listed, ("blob.ts", "TypeScript")]] for kind in ("Java", "Owners", "Python", "TypeScript")]),
        "index_tables": _values("step, tab, n", _INDEX_TABLES),
        "requests": _values("verb, rows, first", [(verb, n, first) for verb, _, _, n, first in _REQUESTS]),
    }
