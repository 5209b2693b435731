"""Source trees: walk, classify, extract, and an index of Parquet tables that is swapped in whole."""

from __future__ import annotations

import json
import re
import subprocess
import uuid
from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.columns import classify, fqn_index, fqn_live, looks_binary, symbol_id
from quillon.functions.schema import SKIPPED
from quillon.operators import graph, grep, lookup, maintain, refs, summary
from quillon.sources.extract import extracted

MAX_BYTES = 100 << 20
#: Tables with a file_id. Symbols and uses are kept in two orders: by name, and by file.
TABLES = ("files", "contents", "symbols", "refs", "symbols_by_file", "refs_by_file", "trigrams", "errors")
#: Tables of an attached module graph; they name files by root and relative path, so a new version can take them over.
GRAPH = ("modules", "module_deps", "module_files", "module_reach")
#: Changed files up to which a refresh reads them one by one instead of the whole trees.
DIRECT = 10_000
#: Bytes of text that a task extracts from, about.
TASK_BYTES = 4 << 20


def listing(spark: SparkSession, roots: dict[str, str], max_bytes: int = MAX_BYTES, content: bool = False, only: list[str] | None = None) -> DataFrame:
    """(root_id, relpath, path, lang, size, mtime) of the files below roots (path to profile) that have a kind, and `content` if asked.

    Without it no file is opened. Directories that the profile skips and files above the limit
    are left out. only: full paths to list instead of the whole trees.
    """
    out = None
    for root_id, (root, profile) in enumerate(roots.items()):
        base = root.split("://")[-1].removeprefix("file:").rstrip("/")
        own, reader = None, spark.read.format("binaryFile")
        if only is not None:  # those that have gone meanwhile are left out
            places = [(p, spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/").removesuffix(base) + p)) for p in only if p.startswith(base + "/")]
            conf = spark.sparkContext._jsc.hadoopConfiguration()
            own = [root.rstrip("/").removesuffix(base) + re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p, place in places if place.getFileSystem(conf).exists(place)]
            if not own:
                continue
        found = reader.option("recursiveFileLookup", True).load(root) if own is None else reader.load(own)
        # paths come with a scheme: what follows the root's own path is relative
        tail = F.regexp_replace(F.col("path"), "^[a-z]+:(//)?", "")
        relpath = tail.substr(F.lit(len(base) + 2), F.length(tail))
        skipped = F.lit(False)
        for name in SKIPPED[profile]:
            skipped = skipped | F.contains(F.concat(F.lit("/"), relpath), F.lit(f"/{name}/"))
        path = F.concat(F.lit(base + "/"), relpath)
        rows = found.where(~skipped).select(F.lit(root_id).alias("root_id"), relpath.alias("relpath"), path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *["content"] * content)
        rows = capped(rows, max_bytes).withColumn("lang", classify(F.col("path"))).where("lang is not null")
        rows = rows.select("root_id", "relpath", "path", "lang", "size", "mtime", *["content"] * content)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], "root_id int, relpath string, path string, lang string, size long, mtime timestamp" + ", content binary" * content)
    return out


def walk(spark: SparkSession, roots: dict[str, str], max_bytes: int = MAX_BYTES, limit: int | None = None, only: list[str] | None = None) -> DataFrame:
    """(root_id, relpath, path, lang, size, mtime, content) of the text files below roots: what listing() has, without files that look binary.

    limit: so many files of each root at most, the first by relative path.
    """
    rows = listing(spark, roots, max_bytes, content=True, only=only)
    rows = rows.where((F.col("size") <= 1024) | ~looks_binary(F.col("content")))
    return limited(rows, limit) if limit else rows


def capped(files: DataFrame, max_bytes: int) -> DataFrame:
    """Files up to the size; a scan of a tree doesn't open the others."""
    return files.where(F.col("size") <= max_bytes)


def limited(files: DataFrame, limit: int) -> DataFrame:
    """The first files of each root by relative path. Their names are cut to the limit before contents meet them."""
    names = files.select("root_id", "relpath")
    first = F.row_number().over(Window.partitionBy("root_id").orderBy("relpath"))
    kept = names.withColumn("_k", first).where(F.col("_k") <= limit).drop("_k")
    return files.join(kept, ["root_id", "relpath"], "left_semi")


def unload(files: DataFrame, folder: str) -> DataFrame:
    """Writes each row of files (relpath, content binary) as a file below the folder, which all executors see; (relpath, size) as written."""

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{base}/{name}"
                if (parent := path.rsplit("/", 1)[0]) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(path) as out:
                    out.write(content or b"")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["relpath", "size"])

    return files.select("relpath", "content").mapInArrow(written, "relpath string, size long")


def changed_since(spark: SparkSession, root: str, commit: str, root_id: int = 0) -> DataFrame:
    """(root_id, relpath): files that git says differ between a commit and HEAD; none if the root is no work tree."""
    done = subprocess.run(["git", "-C", root, "diff", "--name-only", "--relative", "-z", f"{commit}..HEAD", "--"], capture_output=True, check=False)
    names = done.stdout.decode("utf-8", "replace").split("\0") if done.returncode == 0 else []
    return spark.createDataFrame([(root_id, n) for n in names if n], "root_id int, relpath string")


def count_by_kind(walked: DataFrame) -> DataFrame:
    return walked.groupBy("lang").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def in_order(walked: DataFrame) -> DataFrame:
    """walked, range-sorted by root and relative path, with `_place`: the range and the place in it. To be written, then numbered()."""
    return walked.repartitionByRange("root_id", "relpath").sortWithinPartitions("root_id", "relpath").withColumn("_place", F.monotonically_increasing_id())


def numbered(ranged: DataFrame, first: int = 0) -> DataFrame:
    """With file_id instead of _place: the number of the file among all, from `first`, by root and relative path.

    ranged must be a written table of in_order(): the places of two runs of a sort need not agree.
    """
    part, at = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + first).drop("_n")
    return ranged.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("file_id", F.col("_before") + at).drop("_place", "_part", "_before")


class Index:
    """The tables of an index below a folder.

    Rows lie in segments: folders with a table each that never change. A version is a
    manifest that lists each table's segments and the files that no longer count, and
    `current` names the version that readers see. A refresh adds a segment of what
    changed; compaction writes one segment without the dead.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def version(self) -> str | None:
        text = self._text("current")
        return text.strip() if text else None

    def _file(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _text(self, name: str) -> str | None:
        """The content of a small file, None if there is none."""
        fs, path = self._file(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        """Replaces a small file in one step: readers see the old or the new content."""
        jvm = self.spark._jvm
        fs, fresh = self._file(f"{name}-{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(fs.makeQualified(fresh), fs.makeQualified(self._file(name)[1]), options)

    def manifest(self, version: str | None = None) -> dict:
        text = self._text(f"{version or self.version()}/manifest.json")
        if text is None:
            raise ValueError(f"{self.folder}: no such version of an index")
        return json.loads(text)

    def table(self, name: str, version: str | None = None) -> DataFrame:
        own = self.manifest(version)
        df = self.spark.read.parquet(*[f"{self.folder}/{p}" for p in own["tables"][name]])
        return maintain.living(df, self.spark.read.parquet(f"{self.folder}/{own['dead']}")) if own["dead"] and name in TABLES else df

    def has(self, name: str) -> bool:
        return self.version() is not None and bool(self.manifest()["tables"].get(name))

    def tombstoned(self) -> DataFrame:
        own = self.manifest()["tombstones"]
        return self.spark.read.parquet(f"{self.folder}/{own}") if own else self.spark.createDataFrame([], "file_id long")

    def postings(self) -> DataFrame | None:
        """The trigram index, if this version has one."""
        return self.table("trigrams") if self.has("trigrams") else None

    def attach(self, modules: DataFrame, deps: DataFrame, files: DataFrame, root_id: int = 0) -> int:
        """Keeps a module graph, with its closure, beside the tables: modules (module_id, name), deps (src, dst) and files (relpath, module_id) of a root. The number of modules."""
        tables = (modules, deps, files.select(F.lit(root_id).alias("root_id"), "relpath", "module_id"), graph.reach(modules, deps))
        segment, own = self._segment(), self.manifest()
        for name, df in zip(GRAPH, tables, strict=True):
            own["tables"][name] = [self._write(df, segment, name)]
        self.publish(own)
        return self.table("modules").count()

    def modules(self) -> tuple[DataFrame, DataFrame] | None:
        """(file_id, module_id) and the closure (src, dst) of the attached module graph, if there is one."""
        if not self.has("module_reach"):
            return None
        files = self.living("files").select("file_id", "root_id", "relpath")
        return files.join(self.table("module_files"), ["root_id", "relpath"]).select("file_id", "module_id"), self.table("module_reach")

    def owners(self, argument: str, mode: str = "nearest") -> DataFrame:
        """(path, depth, email): who owns a file, by the OWNERS files of the folders above it and their rules for single files."""
        file = lookup.resolve_path(self.living("files"), argument)
        above = [str(p) for row in file.collect() for p in PurePosixPath(row.path).parents]
        found = self.texts().where(F.col("path").isin([f"{p.rstrip('/')}/OWNERS" for p in above])).collect()
        rows = [(r.path.rsplit("/", 1)[0], *(parsed[k] for k in ("emails", "noparent", "rules"))) for r in found for parsed in [summary.parse_owners(r.text)]]
        named = self.spark.createDataFrame(rows, "dir string, emails array<string>, noparent boolean, rules array<struct<pattern:string,emails:array<string>>>")
        return summary.owners(file, named, mode).select("path", "depth", "email").orderBy("depth", "email")

    def warm(self) -> int:
        """Caches the tables that questions read most; the number of definitions and uses."""
        return sum(self.table(name).cache().count() for name in ("symbols", "refs"))

    def living(self, name: str) -> DataFrame:
        table = self.table(name)
        return maintain.living(table, self.tombstoned()) if self.manifest()["tombstones"] else table

    def texts(self, live: bool = False) -> DataFrame:
        """(file_id, path, lang, text). live: as the files are now; those that are gone keep no row."""
        if live:
            files = self.living("files").select("file_id", "path", "lang")
            paths = [r.path for r in files.select("path").toLocalIterator()]
            now = listing(self.spark, self.roots(), content=True, only=paths if len(paths) <= DIRECT else None)
            return files.join(now.select("path", "content"), "path").select("file_id", "path", "lang", F.decode("content", "UTF-8").alias("text"))
        return self.living("contents").select("file_id", "path", "lang", F.decode("content", "UTF-8").alias("text"))

    def live_text(self, path: str) -> str | None:
        """What one indexed file holds now; None if it is gone."""
        fs, place = self._file("")
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(place):
            return None
        stream = fs.open(place)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8", "replace")
        finally:
            stream.close()

    def roots(self) -> dict[str, str]:
        return self.manifest()["roots"]

    def publish(self, manifest: dict) -> str:
        """Points readers to a new version with this manifest; they see the old one until then."""
        version = f"v-{uuid.uuid4().hex}"
        fs, folder = self._file(version)
        fs.mkdirs(folder)
        self._put(f"{version}/manifest.json", json.dumps(manifest))
        self._put("current", version + "\n")
        return version

    @staticmethod
    def _segment() -> str:
        return f"s-{uuid.uuid4().hex}"

    def _write(self, df: DataFrame, segment: str, name: str) -> str:
        """Writes a table of a segment, unless a run that was broken off has written it whole."""
        fs, done = self._file(f"{segment}/{name}/_SUCCESS")
        if not fs.exists(done):
            df.write.mode("overwrite").parquet(f"{self.folder}/{segment}/{name}")
        return f"{segment}/{name}"

    def _read(self, segment: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{segment}/{name}")

    def build(self, roots: dict[str, str], resolve: bool = False, trigrams: bool = True, max_bytes: int = MAX_BYTES, limit: int | None = None, references: bool = True, skip: Iterable[str] = (), resume: bool = False) -> str:
        """Indexes the trees from scratch.

        limit: files of each root. references: whether uses are kept. skip: paths that
        are listed and searched but not extracted from, as those that broke a run before.
        resume: goes on with the tables of a run that was broken off; ValueError if it
        had other arguments.
        """
        asked = {"roots": roots, "resolve": resolve, "trigrams": trigrams, "max_bytes": max_bytes, "limit": limit, "references": references}
        begun = json.loads(self._text("building") or "{}") if resume else {}
        if begun and begun["asked"] != asked:
            raise ValueError(f"the run that was broken off was asked for {begun['asked']}")
        segment = begun.get("segment") or self._segment()
        self._put("building", json.dumps({"segment": segment, "asked": asked}))
        walked = walk(self.spark, roots, max_bytes, limit).withColumn("digest", maintain.digest(F.col("content")))
        tables = self._tables(walked, segment, 0, trigrams, references, skip)
        if resolve:
            tables |= self._resolved(self._read(segment, "symbols"), self._read(segment, "refs_by_file"))
        version = self.publish({"tables": {n: [p] for n, p in tables.items()}, "dead": None, "tombstones": None, "files": self._read(segment, "staged").count(), "roots": roots})
        self._delete("building")
        self._delete(f"{segment}/staged")
        return version

    def refresh(self, roots: dict[str, str], resolve: bool = False, trigrams: bool = True, max_bytes: int = MAX_BYTES) -> str | None:
        """A new version after changes in the trees. None without changes.

        Files of the same size and time are taken to be unchanged and are not opened; the
        others are read, and those whose digest is new are indexed in a segment of
        their own. All that is written follows the change, but for uses if they are to be resolved.
        """
        own, old = self.manifest(), self.table("files").select("root_id", "relpath", "file_id", "size", "mtime", "digest")
        now = listing(self.spark, roots, max_bytes)
        keys = ["root_id", "relpath"]
        before = old.select(*keys, F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
        maybe = graph.cut(now.join(before, keys, "left").where(~(F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime")))).select(*keys, "path"))
        n = maybe.count()
        only = [r.path for r in maybe.collect()] if n <= DIRECT else None
        read = walk(self.spark, roots, max_bytes, only=only).withColumn("digest", maintain.digest(F.col("content")))
        if only is None:
            read = read.join(maybe.select(*keys), keys, "left_semi")
        segment = self._segment()
        digests = old.select(*keys, F.col("digest").alias("_digest"))
        fresh = read.join(digests, keys, "left").where(~F.col("digest").eqNullSafe(F.col("_digest"))).drop("_digest")
        self._write(in_order(fresh), segment, "staged")
        staged = self._read(segment, "staged")
        gone = old.join(now.select(*keys), keys, "left_anti").select("file_id").union(old.join(staged.select(*keys), keys, "left_semi").select("file_id"))
        # a file that was text and is binary now
        binary = maybe.join(old.select(*keys, "file_id"), keys).join(read.select(*keys), keys, "left_anti").select("file_id")
        self._write(gone.union(binary).distinct(), segment, "dead")
        dead = self._read(segment, "dead")
        added, lost = staged.count(), dead.count()
        if not added and not lost:
            self._delete(segment)
            return None
        if own["dead"]:
            all_dead = dead.union(self.spark.read.parquet(f"{self.folder}/{own['dead']}")).distinct()
            own["dead"] = self._write(all_dead, segment, "all_dead")
        else:
            own["dead"] = f"{segment}/dead"
        tables = self._tables(None, segment, self._last() + 1, trigrams and self.has("trigrams"), True, ())
        for name, path in tables.items():
            own["tables"][name] = [*own["tables"].get(name, []), path]
        own["files"] += added - lost
        own["roots"] = roots
        version = self.publish(own)
        if resolve:
            own["tables"] |= {n: [p] for n, p in self._resolved(self.table("symbols"), self.table("refs_by_file")).items()}
            version = self.publish(own)
        self._delete(f"{segment}/staged")
        return version

    def _last(self) -> int:
        """The largest number that a file ever had in this index's segments."""
        own = self.manifest()["tables"]["files"]
        return self.spark.read.parquet(*[f"{self.folder}/{p}" for p in own]).agg(F.coalesce(F.max("file_id"), F.lit(-1))).first()[0]

    def _delete(self, name: str) -> None:
        fs, path = self._file(name)
        fs.delete(path, True)

    def _tables(self, walked: DataFrame | None, segment: str, first: int, trigrams: bool, references: bool, skip: Iterable[str]) -> dict[str, str]:
        """Writes the tables of a segment; their places. walked: None if the staged files are there."""
        if walked is not None:
            self._write(in_order(walked), segment, "staged")
        files = numbered(self._read(segment, "staged"), first)
        out = {"contents": self._write(files.select("file_id", "path", "lang", "content"), segment, "contents"), "files": self._write(files.drop("content"), segment, "files")}
        size = self._read(segment, "files").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        tasks = max(self.spark.sparkContext.defaultParallelism, size // TASK_BYTES)
        held = self._read(segment, "contents")
        skip = list(skip)
        if skip:
            held = held.withColumn("lang", F.when(F.col("path").isin(skip), F.lit("skipped")).otherwise(F.col("lang")))
        self._write(extracted(held.repartition(tasks, "file_id")), segment, "rows")
        rows = self._read(segment, "rows")
        out["symbols_by_file"] = self._write(self._symbols(rows.where("symbol")).repartitionByRange("file_id", "byte_start").sortWithinPartitions("file_id", "byte_start"), segment, "symbols_by_file")
        uses = rows.where("not symbol").select("name", "kind", "file_id", "path", "byte_start", "byte_end", "line", "col", "scope_path", "lang", F.lit(None).cast("string").alias("resolved_to"))
        uses = uses if references else uses.limit(0)
        out["refs_by_file"] = self._write(uses.repartitionByRange("file_id", "byte_start").sortWithinPartitions("file_id", "byte_start"), segment, "refs_by_file")
        for name in ("symbols", "refs"):  # a common name spans several ranges
            out[name] = self._write(self._read(segment, f"{name}_by_file").repartitionByRange("name", "file_id", "byte_start").sortWithinPartitions("name", "file_id", "byte_start"), segment, name)
        out["errors"] = self._write(rows.where("reason is not null").select("file_id", "path", "reason"), segment, "errors")
        if trigrams:
            texts = self._read(segment, "contents").select("file_id", F.decode("content", "UTF-8").alias("text"))
            out["trigrams"] = self._write(grep.grams_of(texts).repartitionByRange("g", "file_id").sortWithinPartitions("g", "file_id"), segment, "trigrams")
        self._delete(f"{segment}/rows")
        return out

    def _resolved(self, symbols: DataFrame, uses: DataFrame) -> dict[str, str]:
        """Writes the uses, tied to symbols, in both orders; their places."""
        segment = self._segment()
        known = refs.resolved(uses, symbols).select(*uses.columns)
        by_file = self._write(known.repartitionByRange("file_id", "byte_start").sortWithinPartitions("file_id", "byte_start"), segment, "refs_by_file")
        by_name = self._read(segment, "refs_by_file").repartitionByRange("name", "file_id", "byte_start").sortWithinPartitions("name", "file_id", "byte_start")
        return {"refs_by_file": by_file, "refs": self._write(by_name, segment, "refs")}

    @staticmethod
    def _symbols(rows: DataFrame) -> DataFrame:
        package = lookup.enclosing_package(rows)
        named = rows.join(package, "file_id", "left")
        identity = symbol_id(F.col("path"), F.col("kind"), F.array_join("scope_path", "\x00"), F.col("name"), F.col("line").cast("string"))
        return named.select(
            identity.alias("id"), "name", fqn_index(F.col("scope_path"), F.col("name")).alias("fqn_index"), fqn_live(F.col("package"), F.col("scope_path"), F.col("name"), F.col("lang")).alias("fqn_live"),
            "kind", "file_id", "path", "byte_start", "byte_end", "span_start", "span_end", "line", "col", "scope_path", "lang",
        )

    def tombstone(self, argument: str, exact: bool = False) -> int:
        """Marks the files whose path holds the argument; the number of files marked so far."""
        marked = maintain.tombstones(self.table("files"), argument, exact).union(self.tombstoned()).distinct()
        own = self.manifest()
        own["tombstones"] = self._write(marked, self._segment(), "tombstones")
        self.publish(own)
        return self.tombstoned().count()

    def compact(self) -> str:
        """A new version in one segment, without the rows of files that are dead or have a tombstone."""
        own, segment = self.manifest(), self._segment()
        order = {"symbols": ("name", "file_id", "byte_start"), "refs": ("name", "file_id", "byte_start"), "trigrams": ("g", "file_id")}
        for name in filter(self.has, TABLES):
            by = order.get(name, ("file_id",))
            own["tables"][name] = [self._write(self.living(name).repartitionByRange(*by).sortWithinPartitions(*by), segment, name)]
        own |= {"dead": None, "tombstones": None, "files": self._read(segment, "files").count()}
        return self.publish(own)

    def health(self) -> list[str]:
        """What is wrong with the current version: nothing, if the list is empty."""
        if self.version() is None:
            return ["no current version"]
        wrong = [f"table {name} is missing" for name in TABLES if name != "trigrams" and not self.has(name)]
        if wrong:
            return wrong
        files = self.table("files")
        counts = files.agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("ids")).first()
        if counts.n != self.manifest()["files"]:
            wrong.append(f"{counts.n} files in the tables, {self.manifest()['files']} were found")
        if counts.ids != counts.n:
            wrong.append(f"{counts.n} files have {counts.ids} numbers")
        if (n := self.table("contents").count()) != counts.n:
            wrong.append(f"{n} contents of {counts.n} files")
        for name in ("symbols", "refs"):
            if not self.table(name).join(files, "file_id", "left_anti").isEmpty():
                wrong.append(f"{name} of unknown files")
            if self.table(name).count() != self.table(f"{name}_by_file").count():
                wrong.append(f"{name} by name and by file differ")
        return wrong
