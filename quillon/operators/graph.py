"""Inheritance, call graphs and reachability, as rounds of joins.

A round's rows are cut from their lineage by checkpoint(), into the folder that
the session names in spark.checkpoint.dir.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.columns import path_filter
from quillon.operators.refs import callers, enclosing

#: Modules of a block, and pairs that a task writes out, about.
BLOCK, TASK_ROWS = 512, 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; in local mode without one a folder of this machine is set."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The same rows from Parquet files in the shared folder, and the files of the table before are deleted.

    For rounds without a bound: a checkpoint carries on estimates of its size, and these
    multiply in the joins of each round.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if before is not None:
        discard(before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored table."""
    context = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def inherits(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(parent, id, name, path, line, kind): the symbols that say they inherit from a name.

    The use's last scope segment names the child and the rest is the child's own
    scope; the child is the symbol of that name and scope in the same file.
    """
    child = refs.where((F.col("kind") == "inherit") & (F.size("scope_path") > 0)).select(
        F.col("name").alias("parent"), "file_id", F.element_at("scope_path", -1).alias("name"), F.slice("scope_path", 1, F.size("scope_path") - 1).alias("scope_path")
    )
    return child.join(symbols, ["file_id", "name", "scope_path"]).select("parent", "id", "name", "path", "line", "kind").distinct()


def subclasses(refs: DataFrame, symbols: DataFrame, name: str, depth: int = 0) -> DataFrame:
    """Children of the name, and with a depth theirs in so many further rounds, each once with its first `level`."""
    edges = cut(inherits(refs, symbols))
    level = edges.where(F.col("parent") == name).drop("parent").distinct().withColumn("level", F.lit(0))
    found = cut(level)
    frontier = found
    for k in range(1, depth + 1):
        names = frontier.select(F.col("name").alias("parent")).distinct()
        frontier = edges.join(names, "parent", "left_semi").drop("parent").distinct().join(found, "id", "left_anti").withColumn("level", F.lit(k))
        frontier = cut(frontier)
        if frontier.isEmpty():
            break
        found = cut(found.unionByName(frontier))
    return found


def call_edges(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(callee, caller_id, caller, path, call_sites, first_line): calls counted by the function they stand in."""
    inside = enclosing(refs.where("kind = 'call'"), symbols)
    leaf = F.when(F.size("scope_path") > 0, F.try_element_at("scope_path", F.lit(-1))).otherwise(F.lit("<unknown>"))
    return inside.groupBy(F.col("name").alias("callee"), "caller_id", F.coalesce("caller", leaf).alias("caller"), "path").agg(F.count("*").alias("call_sites"), F.min("line").alias("first_line"))


def callgraph(refs: DataFrame, symbols: DataFrame, name: str, depth: int = 3, max_nodes: int = 200, inside: str | None = None, outside: str | None = None) -> DataFrame:
    """(level, callee, caller, caller_id, path, call_sites, trail): who calls the name, who calls those, and so on.

    Rows stand for the steps of call chains. A chain ends at a caller that is in it
    already and at calls outside any function. Paths are filtered on every level. max_nodes
    bounds the whole result, in the order of level, path, first line and caller, so that
    the cut is the same in each run.
    """
    edges = cut(call_edges(refs.where(path_filter(F.col("path"), inside, outside)), symbols))
    level = edges.where(F.col("callee") == name).withColumn("trail", F.array(F.coalesce("caller_id", F.lit("")))).withColumn("level", F.lit(1))
    out, frontier = level, level
    for k in range(2, depth + 1):
        known = frontier.where("caller_id is not null").select(F.col("caller").alias("callee"), F.col("trail").alias("_trail"))
        step = edges.join(known, "callee").where(F.col("caller_id").isNull() | ~F.array_contains("_trail", F.col("caller_id")))
        frontier = step.withColumn("trail", F.concat("_trail", F.array(F.coalesce("caller_id", F.lit(""))))).drop("_trail").withColumn("level", F.lit(k))
        frontier = cut(frontier.orderBy("path", "first_line", "caller", "trail").limit(max_nodes))
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier)
    order = ("level", "path", "first_line", "caller", "callee", "trail")
    return out.orderBy(*order).limit(max_nodes)


def impact(refs: DataFrame, symbols: DataFrame, name: str, depth: int = 2, every: DataFrame | None = None) -> DataFrame:
    """(path, callers, subclasses): the files that a change of the name touches. Subclasses come from `every`, if refs leave some out."""
    called = callers(refs, name).groupBy("path").agg(F.count("*").alias("callers"))
    derived = subclasses(refs if every is None else every, symbols, name, depth).groupBy("path").agg(F.count("*").alias("subclasses"))
    both = called.join(derived, "path", "full_outer")
    return both.select("path", F.coalesce("callers", F.lit(0)).cast("long").alias("callers"), F.coalesce("subclasses", F.lit(0)).cast("long").alias("subclasses"))


def reach(modules: DataFrame, deps: DataFrame) -> DataFrame:
    """(src, dst): the reflexive transitive closure of deps (src, dst) over modules (module_id).

    Modules on common cycles reach the same ones, so the closure is made between groups
    of them and their pairs are written out last, without a shuffle of the pairs. Edges
    from or to unknown modules are ignored.
    """
    ids = modules.select("module_id").distinct()
    edges = deps.where("src <> dst").select("src", "dst").distinct()
    edges = cut(edges.join(ids, edges["src"] == ids["module_id"], "left_semi").join(ids, edges["dst"] == ids["module_id"], "left_semi"))
    found = cycles(edges)
    if found is None:
        closed = doubled(edges)
    else:
        owner = cut(ids.where("module_id is not null").join(found, "module_id", "left").select("module_id", F.coalesce("root", "module_id").alias("root")))
        tied = edges.join(owner.toDF("src", "a"), "src").join(owner.toDF("dst", "b"), "dst").where("a <> b")
        within = found.select(F.col("root").alias("src"), F.col("root").alias("dst")).distinct()
        closed = expanded(doubled(tied.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()).union(within), owner)
    return closed.where("src <> dst").union(ids.select(F.col("module_id").alias("src"), F.col("module_id").alias("dst")))


def cycles(edges: DataFrame) -> DataFrame | None:
    """(module_id, root): the modules on cycles but the smallest of each group, which is its root; None if there are none.

    Of each group that is left, some module's smallest module upstream and downstream are
    the same: these are a whole group. Other groups lie in one class of both each.
    """
    found, left, n = None, edges, edges.count()
    while n:
        before, left = n, stored(_trimmed(left), left)
        n = left.count()
        if n == 0 or 2 * n <= before:
            continue
        ends = _ends(left)
        group = ends.where("up = down and up <> id").select(F.col("id").alias("module_id"), F.col("up").alias("root"))
        if not group.isEmpty():
            found = cut(group if found is None else found.union(group))
        rest = ends.where("up <> down").select("id", F.struct("up", "down"))
        left = stored(left.join(rest.toDF("src", "a"), "src").join(rest.toDF("dst", "b"), "dst").where("a = b").select("src", "dst"), left)
        discard(ends)
        n = left.count()
    discard(left)
    return found


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges that follow some edge and are followed by some: others are on no cycle."""
    starts, stops = edges.select(F.col("src").alias("dst")), edges.select(F.col("dst").alias("src"))
    return edges.join(stops, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst")


def _ends(edges: DataFrame) -> DataFrame:
    """(id, up, down), stored: each module's smallest module upstream and downstream, itself included.

    In a round each asks its neighbours, those that it knows as smallest, and one on a
    path either way that is twice as far as in the round before.
    """
    near = edges.select(F.col("dst").alias("id"), F.col("src").alias("key"), F.lit("in").alias("as")).union(edges.select("src", "dst", F.lit("out")))
    of = lambda column, *kinds: F.when(F.col("as").isin(*kinds), F.col(column))
    known = near.groupBy("id").agg(F.min(of("key", "in")).alias("before"), F.min(of("key", "out")).alias("after"))
    known = stored(known.select("id", F.col("id").alias("up"), F.col("id").alias("down"), F.coalesce("before", "id").alias("before"), F.coalesce("after", "id").alias("after")))
    while True:
        far = known.select("id", F.inline(F.array(*(F.struct(F.col(c).alias("key"), F.lit(c).alias("as")) for c in ("up", "down", "before", "after")))))
        told = near.union(far).join(known.withColumnRenamed("id", "key"), "key").groupBy("id")
        told = told.agg(
            F.min(of("up", "in", "up", "before")).alias("up"),
            F.min(of("down", "out", "down", "after")).alias("down"),
            F.min(of("before", "before")).alias("before"),
            F.min(of("after", "after")).alias("after"),
            F.min(of("key", "up")).alias("_up"),
            F.min(of("key", "down")).alias("_down"),
        )
        known = stored(told, known)
        if known.where("up <> _up or down <> _down").isEmpty():
            return known


def doubled(edges: DataFrame) -> DataFrame:
    """(src, dst): the ends of all paths of edges (src, dst).

    Known pairs are joined with those at the largest distance known, so a chain of n
    edges takes about log2(n) rounds and each of its pairs is made once.
    """
    known, far = cut(edges.select("src", "dst", F.lit(1).alias("d"))), 1
    while True:
        last = known.where(F.col("d") == far)
        if last.isEmpty():
            return known.select("src", "dst")
        step = known.alias("a").join(last.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst", (F.col("a.d") + far).alias("d"))
        known = cut(known.union(step).groupBy("src", "dst").agg(F.min("d").alias("d")))
        far *= 2


def expanded(pairs: DataFrame, owner: DataFrame) -> DataFrame:
    """(src, dst) of modules for pairs (src, dst) of roots, by owner (module_id, root): blocks of members are dealt out and multiplied where they are."""
    sizes = cut(owner.groupBy("root").agg(F.count("*").alias("n")))
    block = F.pmod(F.xxhash64("module_id"), F.ceil(F.col("n") / BLOCK).cast("long"))
    blocks = cut(owner.join(sizes, "root").groupBy("root", block.alias("block")).agg(F.collect_list("module_id").alias("ids")))
    pairs = cut(pairs)
    rows = pairs.join(sizes.toDF("src", "a"), "src").join(sizes.toDF("dst", "b"), "dst").agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0]
    dealt = pairs.join(blocks.toDF("src", "i", "srcs"), "src").join(blocks.toDF("dst", "j", "dsts"), "dst").repartition(int(rows / TASK_ROWS) + 1, "src", "i", "dst", "j")
    return dealt.select("dsts", F.explode("srcs").alias("src")).select("src", F.explode("dsts").alias("dst"))


def reachable(found: DataFrame, name: str, symbols: DataFrame, file_module: DataFrame, closure: DataFrame) -> DataFrame:
    """The uses whose module reaches some module that defines the name.

    Uses in files without a module pass; if no definition has a module, all pass.
    """
    last = Window.partitionBy("file_id").orderBy(F.desc("module_id"))
    owner = file_module.withColumn("_k", F.row_number().over(last)).where("_k = 1").select("file_id", "module_id")
    defining = symbols.where(F.col("name") == name).select("file_id").distinct().join(owner, "file_id").select(F.col("module_id").alias("dst")).distinct()
    if defining.isEmpty():
        return found
    allowed = closure.join(defining, "dst", "left_semi").select(F.col("src").alias("module_id")).distinct().withColumn("_ok", F.lit(True))
    out = found.join(owner, "file_id", "left").join(allowed, "module_id", "left")
    return out.where("module_id is null or _ok").drop("module_id", "_ok")
