"""Trees indexed from disk, and the questions asked of them."""

import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from quillon.operators import graph, grep, lookup, refs, summary
from quillon.rpc import QueryLog, Server, fitted, trimmed
from quillon.sources import modules
from quillon.sources.tree import Index, changed_since, count_by_kind, walk
from quillon.streaming.watch import bursts, watch

FILES = {
    "a/Boat.java": "package port;\nclass Boat {\n  void leave() { cast(); }\n  void cast() { }\n}\n",
    "a/Ferry.java": "package port;\nclass Ferry extends Boat {\n  void cross() { leave(); }\n}\n",
    "a/Shuttle.java": "package port;\nclass Shuttle extends Ferry {\n  void hurry() { cross(); }\n}\n",
    "tests/FerryTest.java": "package port;\nclass FerryTest {\n  void cross() { new Ferry().cross(); }\n}\n",
    "Android.bp": 'cc_library {\n name: "libport",\n srcs: ["a.c"],\n}\n',
    "port.rc": "service port /bin/port\n  class main\n",
    "bad.py": "def broken(:\n",
    "blob.ts": "x" * 100 + "\0" + "y" * 1500,
    "node_modules/skip.js.py": "def hidden(): pass\n",
    "README.unknown": "nothing\n",
    "note.md": "# Títle é\nleave in été\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return root


@pytest.fixture(scope="module")
def index(spark, tree, tmp_path_factory):
    out = Index(spark, str(tmp_path_factory.mktemp("index")))
    out.build({str(tree): "generic"})
    return out


def names(df, column="name"):
    return {r[column] for r in df.collect()}


def test_walk(spark, tree):
    found = walk(spark, {str(tree): "generic"})
    assert names(found, "relpath") == {f for f in FILES if not f.startswith(("node_modules", "README", "blob"))}
    assert {r.lang: r.files for r in count_by_kind(found).collect()} == {"Java": 4, "Soong": 1, "InitRc": 1, "Python": 1, "Markdown": 1}


def test_files_are_numbered_in_order(index):
    rows = index.table("files").orderBy("file_id").collect()
    assert [r.file_id for r in rows] == list(range(len(rows)))
    assert [r.relpath for r in rows] == sorted(r.relpath for r in rows)


def test_definitions_and_errors(index):
    symbols = index.living("symbols")
    assert {r.kind for r in lookup.definitions(symbols, "Ferry").collect()} == {"class"}
    first = lookup.definitions(symbols, "cross").collect()
    assert [r.path.rsplit("/", 2)[-2] for r in first] == ["a", "tests"]  # a test's path ranks lower
    assert names(lookup.definitions(symbols, "cross", outside="/tests/"), "path") == {first[0].path}
    assert lookup.definitions(symbols, "port", kind="PKG").count() == 1
    assert names(index.table("errors"), "reason").pop().startswith("SyntaxError")
    assert index.health() == []


def test_inheritance_and_calls(index):
    symbols, uses = index.living("symbols"), index.living("refs")
    assert names(graph.subclasses(uses, symbols, "Boat")) == {"Ferry"}
    assert names(graph.subclasses(uses, symbols, "Boat", 2)) == {"Ferry", "Shuttle"}
    assert {(r.level, r.callee, r.caller) for r in graph.callgraph(uses, symbols, "cast", 3).collect()} >= {(1, "cast", "leave"), (2, "leave", "cross"), (3, "cross", "hurry")}
    assert graph.callgraph(uses, symbols, "cast", 1).count() == 1
    assert names(refs.uses(uses, symbols, "leave", "call")) == {"cast"}
    touched = {r.path.rsplit("/", 1)[-1]: (r.callers, r.subclasses) for r in graph.impact(uses, symbols, "Ferry").collect()}
    assert touched == {"Shuttle.java": (0, 1)}
    assert all(r.resolved_to is None for r in uses.collect())


def test_resolution_and_formats(index):
    symbols, uses = index.living("symbols"), index.living("refs")
    resolved = refs.resolved(uses.where("name = 'cross'"), symbols)
    assert names(resolved, "resolution") == {"same_lang"}
    assert [r.n for r in refs.by_definition(resolved, symbols).collect()] == [2]
    assert [r.path.rsplit("/", 1)[-1] for r in refs.paths(refs.find(uses, "cross")).collect()] == ["Shuttle.java", "FerryTest.java"]


def test_whereis_and_places(index):
    server = Server(index)
    got = next(server.request({"id": 1, "cmd": "whereis", "args": {"path": "a/Ferry.java:3:17"}}))
    assert got["result"][0]["name"] == "cross"
    assert lookup.parse_place("a.b:3:4") == ("a.b", None, 3, 4)
    assert lookup.parse_place("x@12") == ("x", 12, None, None)
    with pytest.raises(ValueError):
        lookup.parse_place("plain")
    with pytest.raises(ValueError):
        lookup.parse_place("a@b.java:3")


def test_grep(index):
    texts, postings = index.texts(), index.table("trigrams")
    for pattern, options in (("leave", {}), ("le", {}), ("LEAVE", {"ignore_case": True}), ("l[e]ave|cast", {}), ("été", {}), ("ÉTÉ", {"ignore_case": True}), ("cross\\(\\)", {}), ("nowhere", {})):
        scan = grep.search(texts, pattern, **options).collect()
        assert scan == grep.search(texts, pattern, postings=postings, **options).collect(), pattern
    hit = grep.search(texts, "été").collect()[0]
    assert (hit.line, hit.col, hit.byte) == (2, 10, len("# Títle é\n".encode()) + 9)
    many = index.spark.createDataFrame([(0, "/x", "C", "ab é ab\n\nxab"), (1, "/y", "C", None), (2, "/z", "C", "")], "file_id long, path string, lang string, text string")
    assert [(r.line, r.col, r.byte) for r in grep.search(many, "ab").collect()] == [(1, 1, 0), (1, 7, 6), (3, 2, 11)]
    assert [(r.file_id, r.line, r.byte_start) for r in grep.lines(many).collect()] == [(0, 1, 0), (0, 2, 9), (0, 3, 10), (2, 1, 0)]
    assert grep.search(texts, "leave", per_file=1).count() == 3
    assert grep.counts(grep.search(texts, "cross")).first().files == 3


def test_long_lines_are_cut_between_characters(spark):
    texts = spark.createDataFrame([(0, "/x", "C", "é" * 150 + "needle")], "file_id long, path string, lang string, text string")
    assert grep.search(texts, "needle").first().shown == "é" * 100 + "…"
    assert grep.search(spark.createDataFrame([(0, "/x", "C", "a" + "é" * 150)], "file_id long, path string, lang string, text string"), "aé").first().shown == "a" + "é" * 99 + "…"


def test_refresh_diff_tombstone_compact(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    (root / "Alpha.java").write_text("class Alpha { void aMethod() { } }")
    (root / "Bravo.java").write_text("class Bravo { void bMethod() { } }")
    index = Index(spark, str(tmp_path / "i"))
    old = index.build({str(root): "generic"}, resolve=True)
    assert index.refresh({str(root): "generic"}) is None
    (root / "Alpha.java").write_text("class Alpha { void newAlpha() { } }")
    (root / "Charlie.java").write_text("class Charlie { void cMethod() { } }")
    (root / "Bravo.java").unlink()
    index.refresh({str(root): "generic"})
    assert {r.name for r in index.living("symbols").where("kind = 'method'").collect()} == {"newAlpha", "cMethod"}
    status = {r.relpath: r.status for r in summary.index_diff(index.table("files", old), index.table("files")).collect()}
    assert status == {"Alpha.java": "changed", "Bravo.java": "removed", "Charlie.java": "added"}
    assert index.tombstone("Charlie") == 1
    assert names(index.living("symbols")) == {"Alpha", "newAlpha"}
    assert "cMethod" in names(index.table("symbols"))
    index.compact()
    assert "cMethod" not in names(index.table("symbols"))
    assert index.health() == []


def test_watch(spark, tmp_path):
    first, second = tmp_path / "t", tmp_path / "u"
    for root, name in ((first, "A"), (second, "C")):
        root.mkdir()
        (root / f"{name}.java").write_text(f"class {name} {{ }}")
    roots = {str(first): "generic", str(second): "generic"}
    index = Index(spark, str(tmp_path / "i"))
    index.build(roots)
    for root, name in ((first, "B"), (second, "D")):
        (root / f"{name}.java").write_text(f"class {name} {{ }}")
        query = watch(spark, index, roots, str(tmp_path / "c"), once=True)
        assert query.awaitTermination(60)
        assert name in names(index.living("symbols"))
    assert names(index.living("symbols")) == {"A", "B", "C", "D"}


@pytest.mark.parametrize("files,size", [(300, 100_000), (2_000, 10_000)])
def test_no_file_is_lost(spark, tmp_path, files, size):
    """Trees above Spark's partition sizes: all files are numbered, from 0 without a gap, and in every table."""
    for i in range(files):
        (tmp_path / "t" / f"d{i % 7}").mkdir(parents=True, exist_ok=True)
        line = f"/* {i} */ class K{i} {{ void m{i}() {{ n(); }} }}\n"
        (tmp_path / "t" / f"d{i % 7}" / f"K{i}.java").write_text(line + "// words in a comment\n" * (size // 22))
    index = Index(spark, str(tmp_path / "i"))
    index.build({str(tmp_path / "t"): "generic"}, trigrams=False)
    assert index.table("files").count() == index.table("contents").count() == files
    assert sorted(r.file_id for r in index.table("files").select("file_id").collect()) == list(range(files))
    assert names(index.table("symbols").where("kind = 'class'")) == {f"K{i}" for i in range(files)}
    assert index.health() == []
    kept = index.manifest()["files"]
    broken = index.manifest() | {"files": kept + 1}
    index.publish(broken)
    assert index.health() == [f"{files} files in the tables, {files + 1} were found"]


def test_limit_references_skip_resume(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    for name in "DBCA":
        (root / f"{name}.java").write_text(f"class {name} {{ void f() {{ g(); }} }}")
    roots = {str(root): "generic"}
    index = Index(spark, str(tmp_path / "i"))
    index.build(roots, limit=2, references=False, skip=[f"{root}/B.java"])
    assert names(index.table("files"), "relpath") == {"A.java", "B.java"}
    assert names(index.living("symbols")) == {"A", "f"} and index.table("refs").count() == 0
    real, calls = index._write, []

    def failing(df, segment, name):
        calls.append(name)
        if name == "refs":
            raise RuntimeError("broken off")
        return real(df, segment, name)

    index._write = failing
    with pytest.raises(RuntimeError):
        index.build(roots)
    index._write = real
    assert names(index.living("symbols")) == {"A", "f"}  # readers still see the old version
    with pytest.raises(ValueError):
        index.build(roots, trigrams=False, resume=True)
    staged = json.loads(index._text("building"))["segment"]
    index.build(roots, resume=True)
    assert names(index.living("symbols")) == {"A", "B", "C", "D", "f"} and index.health() == []
    assert index.manifest()["tables"]["symbols"] == [f"{staged}/symbols"]


def test_refresh_reads_and_writes_what_changed(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    for i in range(20):
        (root / f"F{i:02}.java").write_text(f"class F{i:02} {{ }}")
    roots = {str(root): "generic"}
    index = Index(spark, str(tmp_path / "i"))
    index.build(roots)
    (root / "F03.java").write_text("class Changed { void x() { } }")
    (root / "F04.java").unlink()
    (root / "[odd] {name}.java").write_text("class Odd { }")
    index.refresh(roots)
    places = index.manifest()["tables"]["contents"]
    assert [spark.read.parquet(f"{index.folder}/{p}").count() for p in places] == [20, 2]
    assert names(index.living("symbols").where("kind = 'class'")) == {f"F{i:02}" for i in range(20) if i not in (3, 4)} | {"Changed", "Odd"}
    assert index.health() == [] and index.refresh(roots) is None
    (root / "F05.java").touch()  # a new time, the same content
    assert index.refresh(roots) is None
    before = {tuple(r) for r in index.living("symbols").select("name", "path").collect()}
    index.compact()
    assert len(index.manifest()["tables"]["contents"]) == 1 and index.health() == []
    assert {tuple(r) for r in index.living("symbols").select("name", "path").collect()} == before


def test_bursts(spark):
    rows = [("r", f"f{i}", t) for i, t in enumerate((0.0, 0.2, 0.4, 5.0))]
    events = spark.createDataFrame(rows, "root string, path string, t double").withColumn("ts", F.timestamp_millis((F.col("t") * 1000).cast("long")))
    assert sorted(r.files for r in bursts(events).collect()) == [1, 3]


def test_requests(index):
    server = Server(index)
    ask = lambda cmd, **args: next(server.request({"id": 7, "cmd": cmd, "args": args}))
    assert ask("def", name="Ferry")["result"][0]["name"] == "Ferry"
    assert {r["name"] for r in ask("prefix", name="Fe")["result"]} == {"Ferry", "FerryTest"}
    assert ask("fuzzy", name="Shutle")["result"][0]["name"] == "Shuttle"
    assert ask("ref", name="cross", format="count")["result"] == [{"count": 2}]
    assert ask("callers", name="cross")["result"][0]["kind"] == "call"
    assert ask("tldr", path="a/Ferry.java")["result"]["kinds"] == {"pkg": 1, "class": 1, "method": 1}
    assert [r["name"] for r in ask("outline", path="a/Ferry.java")["result"]] == ["port", "Ferry", "cross"]
    assert ask("coverage", path="/a/")["result"][0]["files"] == 3
    assert ask("stats")["result"]["files"] == 8
    assert ask("grep", pattern="libport")["result"][0]["line"] == 2
    assert ask("nope")["error"]["code"] == -32601
    assert ask("outline", path="none")["error"]["code"] == -32602
    assert next(server.request("{"))["error"]["code"] == -32700
    out = list(server.request({"id": 1, "cmd": "def", "args": {"name": "cross"}, "stream": True}))
    assert out[-1] == {"id": 1, "done": True, "shown": 2}
    assert len(list(server.serve([json.dumps({"id": 1, "cmd": "stats"}), ""]))) == 1
    assert [x["cmd"] for x in server.log][:2] == ["def", "prefix"]


def test_budget():
    rows = [{"name": "a", "snippet": "x" * 100}, {"name": "b", "snippet": "y" * 100}]
    assert trimmed(rows, 1000) == rows
    assert trimmed(rows, 60) == [{"name": "a"}, {"name": "b"}]
    assert trimmed(rows, 20) == [{"name": "a"}]
    assert trimmed(rows, 1) == []


def test_owners():
    got = summary.parse_owners("# c\na@x\nset noparent\nper-file *.c = b@x\nfile:/O\nnot an @ email\n")
    assert got == {"emails": ["a@x"], "per_file": ["*.c = b@x", "file:/O"], "noparent": True, "rules": [("^.*\\.c$", ["b@x"])]}


def test_module_graphs(spark):
    cargo = modules.cargo({"a/Cargo.toml": b'[package]\nname="a"\n[dependencies]\nb={path="../b"}\n', "b/Cargo.toml": b'[package]\nname="b"\n'}, ["a/src/x.rs", "b/tests/y.rs", "b/z.rs"])
    assert (cargo.names, cargo.deps, cargo.files) == ({"a": 0, "b": 1}, {(0, 1)}, {"a/src/x.rs": 0, "b/tests/y.rs": 1})
    soong = modules.soong(json.dumps({"m": {"module_name": "m", "path": ["p"], "dependencies": ["n"]}, "n": {"module_name": "n", "path": ["p/q"], "dependencies": []}}).encode(), ["p/a.c", "p/q/r/b.c", "z.c"])
    assert (soong.deps, soong.files) == ({(0, 1)}, {"p/a.c": 0, "p/q/r/b.c": 1})
    kernel = modules.kernel(["fs/a.c", "mm/b.c", "c.c", "Makefile", "Kconfig", "LICENSES/x.c"])
    for other in (["fs/a.c"], ["Makefile", "Kconfig", "x/y.c"]):
        with pytest.raises(ValueError):
            modules.kernel(other)
    assert (kernel.deps, kernel.files) == ({(0, 1), (1, 0)}, {"fs/a.c": 0, "mm/b.c": 1})
    gn = modules.gn(json.dumps({"targets": {"//a": {"deps": ["//b"], "sources": ["//x.cc"]}, "//b": {"sources": ["//x.cc", "//y.cc"]}}}).encode(), ["x.cc", "y.cc"])
    assert (gn.deps, gn.files) == ({(0, 1)}, {"x.cc": 0, "y.cc": 1})
    bazel = modules.bazel(json.dumps({"target": [{"type": "RULE", "rule": {"name": "//p:a", "attribute": [{"name": "deps", "stringListValue": ["//p:b"]}, {"name": "srcs", "stringListValue": ["//p:x.cc"]}]}}, {"type": "RULE", "rule": {"name": "//p:b"}}]}).encode(), ["p/x.cc"])
    assert (bazel.deps, bazel.files) == ({(0, 1)}, {"p/x.cc": 0})
    _, deps, files = cargo.tables(spark)
    assert deps.count() == 1 and files.count() == 2
    _, deps, _ = modules.load(spark, b'{"modules": [{"id": 0, "name": "a"}, {"id": 1, "name": "b"}], "deps": [[0, 1]], "files": [{"path": "x", "module_id": 0}]}')
    assert [tuple(r) for r in deps.collect()] == [(0, 1)]


def test_reach(spark):
    ids = spark.createDataFrame([(i,) for i in range(4)], "module_id long")
    chain = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 3), (3, 9)], "src long, dst long")
    got = {tuple(r) for r in graph.reach(ids, chain).collect()}
    assert got == {(a, b) for a in range(4) for b in range(a, 4)}
    cycle = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    assert {tuple(r) for r in graph.reach(ids, cycle).collect()} == {(a, b) for a in range(3) for b in range(3)} | {(3, 3)}


def plain_reach(n, edges):
    next_ = {a: {b for x, b in edges if x == a and b < n} for a in range(n)}
    out = set()
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            more = next_[todo.pop()] - seen
            seen |= more
            todo += more
        out |= {(a, b) for b in seen}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_reach_of_cyclic_graphs(spark, monkeypatch, seed):
    """Rings that lead into rings, rings with chords, chains between, loops, repeats and unknown modules."""
    monkeypatch.setattr(graph, "BLOCK", 3)
    monkeypatch.setattr(graph, "TASK_ROWS", 100)
    rng = random.Random(seed)
    n = 60
    at = rng.sample(range(n), n)
    rings = [at[0:13], at[13:20], at[20:22], at[22:40]]
    edges = [(r[i - 1], r[i]) for r in rings for i in range(len(r))]
    edges += [(rings[0][3], at[40]), (at[40], at[41]), (at[41], rings[1][2]), (rings[1][5], rings[2][0]), (at[50], rings[3][4]), (rings[3][1], rings[3][9])]
    edges += [(at[i], at[i + 1]) for i in range(42, 49)] + [(at[55], at[55]), (at[56], 99), (98, at[56])]
    edges += [(rng.randrange(n), rng.randrange(n)) for _ in range(6 * seed)] + edges[:5]
    got = graph.reach(spark.createDataFrame([(i,) for i in range(n)], "module_id long"), spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == plain_reach(n, edges)


def test_reach_of_a_ring_keeps_no_pairs(spark, monkeypatch):
    """All that is written between the rounds grows with the modules, not with the pairs or their cube."""
    kept = []

    def counting(cut):
        def counted(*tables):
            out = cut(*tables)
            kept.append(out.count())
            return out

        return counted

    monkeypatch.setattr(graph, "cut", counting(graph.cut))
    monkeypatch.setattr(graph, "stored", counting(graph.stored))
    n = 300
    ids = spark.range(n).withColumnRenamed("id", "module_id")
    ring = ids.selectExpr("module_id as src", f"(module_id + 7) % {n} as dst")
    got = graph.reach(ids, ring)
    assert (got.count(), got.distinct().count()) == (n * n, n * n)
    assert max(kept) <= n


def test_ends_of_the_paths_of_a_chain(spark):
    n = 40
    chain = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src long, dst long")
    got = sorted(tuple(r) for r in graph.doubled(chain).collect())
    assert got == [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_narrow_hint():
    assert lookup.narrow_hint(["/a/b/c.x", "/a/b/d/e.x"]) == "/a/b"
    assert lookup.narrow_hint([]) == ""


def test_module_graph_of_an_index(spark, tmp_path):
    root = tmp_path / "t"
    for crate, target in (("a", "b"), ("b", None), ("c", None)):
        (root / crate / "src").mkdir(parents=True)
        (root / crate / "Cargo.toml").write_text(f'[package]\nname = "{crate}"\n' + (f'[dependencies]\n{target} = {{ path = "../{target}" }}\n' if target else ""))
        (root / crate / "src" / "lib.rs").write_text("fn probe() {}\n" if crate == "b" else "fn run() { probe(); }\n")
    (root / "OWNERS").write_text("top@x\n")
    (root / "a" / "OWNERS").write_text("a@x\nper-file *.rs, x?.c = rust@x\nper-file *.c = c@x\n")
    (root / "b" / "OWNERS").write_text("set noparent\nb@x\n")
    index = Index(spark, str(tmp_path / "i"))
    index.build({str(root): "generic"})
    assert index.modules() is None
    server = Server(index)
    ask = lambda cmd, **args: next(server.request({"id": 7, "cmd": cmd, "args": args}))["result"]
    crates = lambda rows: {r["path"].split("/")[-3] for r in rows}
    assert crates(ask("callers", name="probe", reachable=True)) == {"a", "c"}  # no graph: no filter
    assert index.attach(*modules.of_index(index, "cargo", str(root)).tables(spark)) == 3
    assert crates(ask("callers", name="probe")) == {"a", "c"}
    assert crates(ask("callers", name="probe", reachable=True)) == crates(ask("callgraph", name="probe", reachable=True)) == {"a"}
    assert crates(ask("callgraph", name="probe", not_in="/a/")) == {"c"}
    assert crates(ask("impact", name="probe", reachable=True)) == {"a"}
    (root / "c" / "src" / "lib.rs").write_text("fn run() { probe(); probe(); }\n")
    index.refresh({str(root): "generic"})
    assert crates(ask("callers", name="probe", reachable=True)) == {"a"}
    index.compact()
    assert crates(ask("callers", name="probe", reachable=True)) == {"a"}
    emails = lambda **args: [r["email"] for r in ask("owner", **args)]
    assert emails(path="a/src/lib.rs") == ["a@x", "rust@x"]
    assert emails(path="a/src/lib.rs", accumulate=True) == ["a@x", "rust@x", "top@x"]
    assert emails(path="a/Cargo.toml") == ["a@x"]
    assert emails(path="b/src/lib.rs", accumulate=True) == ["b@x"]
    assert emails(path="c/src/lib.rs") == ["top@x"]
    assert index.warm() > 0
    with pytest.raises(ValueError):
        modules.of_index(index, "gn", str(root))
    (root / "project.json").write_text('{"targets": {"//a": {"sources": ["//a/src/lib.rs"]}}}')
    assert modules.of_index(index, "gn", str(root)).files == {"a/src/lib.rs": 0}


def test_changes_by_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    assert changed_since(spark, str(tmp_path), "HEAD").isEmpty()
    git("init")
    for text in ("one", "two"):
        (tmp_path / "été a.py").write_text(text)
        git("add", "-A")
        git("commit", "-m", text)
    assert [tuple(r) for r in changed_since(spark, str(tmp_path), "HEAD~1", 3).collect()] == [(3, "été a.py")]


def test_query_log_is_moved_when_it_is_full(tmp_path):
    log = QueryLog(str(tmp_path / "d" / "q.log"), max_bytes=30)  # a line has 23
    for n in range(3):
        log.append({"cmd": "def", "n": n})
    lines = lambda name: [json.loads(x)["n"] for x in (tmp_path / "d" / name).read_text().splitlines()]
    assert (lines("q.log.1"), lines("q.log")) == ([0, 1], [2])


def test_rows_of_a_stream_are_cut_each():
    row = {"name": "a", "snippet": "x" * 100, "scope_path": ["s"]}
    assert fitted(row, 1000) == row
    assert fitted(row, 60) == {"name": "a", "scope_path": ["s"]}
    assert fitted(row, 1) == {"name": "a"}
