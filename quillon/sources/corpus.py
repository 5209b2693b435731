"""Text tables read as a code index, so that the operators run on data without source trees.

A document is a file. A line that starts with a capitalised word defines that word:
a class on the first line, a method on every third line, else a function. Later words of
four letters or more are uses. A package symbol per file names its source. The star
schema's regions, nations, customers and suppliers inherit and depend downwards.

Definitions, uses and trigrams are written once for a folder, in the orders that an
index keeps them in, and questions read those tables: what they ask for is pushed down
to the files' statistics.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.columns import classify, symbol_id
from quillon.operators.graph import shared_folder
from quillon.operators.grep import grams_of, lines

#: The orders of the tables that are kept.
ORDERS = {
    "symbols": ("name", "file_id", "byte_start"),
    "refs": ("name", "file_id", "byte_start"),
    "symbols_by_file": ("file_id", "byte_start"),
    "refs_by_file": ("file_id", "byte_start"),
    "trigrams": ("g", "file_id"),
}


class Corpus:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def kept(self, name: str) -> DataFrame:
        """A table of ORDERS, written below the shared folder when it is first asked for; again if the documents have changed."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        source = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/documents.parquet")
        system = source.getFileSystem(conf)
        status = system.listStatus(source)
        stamp = sorted((f.getPath().toString(), f.getModificationTime(), f.getLen()) for f in status)
        at = f"{shared_folder(self.spark)}/corpus-{sha256(repr(stamp).encode()).hexdigest()[:16]}/{name}"
        done = jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not done.getFileSystem(conf).exists(done):
            by = ORDERS[name]
            made = {"symbols": lambda: self.kept("symbols_by_file"), "refs": lambda: self.kept("refs_by_file"), "symbols_by_file": self._symbols, "refs_by_file": self._refs, "trigrams": lambda: grams_of(self.texts())}[name]()
            made.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def symbols(self) -> DataFrame:
        return self.kept("symbols")

    def refs(self) -> DataFrame:
        return self.kept("refs")

    def trigrams(self) -> DataFrame:
        return self.kept("trigrams")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def texts(self) -> DataFrame:
        path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return self.table("documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), "lang", "text")

    def files(self) -> DataFrame:
        size = F.octet_length("text").cast("long")
        return self.texts().select("file_id", F.lit(0).alias("root_id"), F.expr("substr(path, 2)").alias("relpath"), "path", "lang", size.alias("size"), F.sha2("text", 256).alias("digest"))

    def lines(self) -> DataFrame:
        return lines(self.texts())

    def _symbols(self) -> DataFrame:
        name = F.lower(F.regexp_extract("ln", "^([A-Z][a-z]+)", 1))
        kind = F.when(F.col("line") == 1, "class").when(F.col("line") % 3 == 0, "method").otherwise("fn")
        source = F.split("path", "/")[1]
        found = self.lines().withColumn("name", name).where("name <> ''").withColumn("kind", kind)
        scope = F.when(F.col("kind") == "method", F.array(source)).otherwise(F.array().cast("array<string>"))
        found = found.select("file_id", "path", "lang", "line", F.lit(1).cast("long").alias("col"), "byte_start", (F.col("byte_start") + F.octet_length("ln")).alias("byte_end"), "name", "kind", scope.alias("scope_path"))
        package = self.texts().select("file_id", "path", "lang", F.lit(0).cast("long").alias("line"), F.lit(1).cast("long").alias("col"), F.lit(0).cast("long").alias("byte_start"), F.lit(0).cast("long").alias("byte_end"), source.alias("name"), F.lit("pkg").alias("kind"), F.array().cast("array<string>").alias("scope_path"))
        both = found.unionByName(package)
        spans = both.withColumn("span_start", F.col("byte_start")).withColumn("span_end", F.col("byte_end"))
        return spans.withColumn("id", symbol_id(F.col("path"), F.col("kind"), F.col("name"), F.col("line").cast("string")))

    def _refs(self) -> DataFrame:
        words = self.lines().select("file_id", "path", "lang", "line", "byte_start", F.posexplode(F.split("ln", " ")).alias("k", "w")).where("k > 0")
        named = words.withColumn("name", F.regexp_extract("w", "^([a-z]+)[.,]?$", 1)).where("length(name) >= 4")
        kind = F.when(F.col("k") % 5 == 0, "type").otherwise("call")
        return named.select("file_id", "path", "lang", "line", (F.col("k") + 1).cast("long").alias("col"), (F.col("byte_start") + F.col("k")).alias("byte_start"), "name", kind.alias("kind"), F.array(F.split("path", "/")[1], F.col("lang")).alias("scope_path"))

    def class_symbols(self) -> DataFrame:
        """Regions, nations and suppliers as classes, in files by table."""
        region = self.table("region").select(F.lit(1).cast("long").alias("file_id"), F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("name"), F.col("r_regionkey").cast("long").alias("line"))
        nation = self.table("nation").select(F.lit(2).cast("long"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), F.col("n_nationkey").cast("long"))
        supplier = self.table("supplier").select(F.lit(3).cast("long"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.col("s_suppkey").cast("long"))
        every = region.union(nation).union(supplier)
        path = F.concat(F.lit("/star/"), F.col("file_id").cast("string"), F.lit(".java"))
        return every.select("file_id", "name", "line", path.alias("path"), F.lit("class").alias("kind"), F.array().cast("array<string>").alias("scope_path"), F.lit("Java").alias("lang"), F.lit(1).cast("long").alias("col"), (F.col("line") * 10).alias("byte_start"), F.concat(F.lit("id"), "name").alias("id"))

    def class_refs(self) -> DataFrame:
        """A nation inherits from its region, a supplier from its nation."""
        nation = self.table("nation").select(F.lit(2).cast("long").alias("file_id"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("name"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("child"), F.col("n_nationkey").cast("long").alias("line"))
        supplier = self.table("supplier").select(F.lit(3).cast("long"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.col("s_suppkey").cast("long"))
        path = F.concat(F.lit("/star/"), F.col("file_id").cast("string"), F.lit(".java"))
        return nation.union(supplier).select("file_id", "name", F.lit("inherit").alias("kind"), "line", F.lit(1).cast("long").alias("col"), (F.col("line") * 10).alias("byte_start"), F.array("child").alias("scope_path"), F.lit("Java").alias("lang"), path.alias("path"))

    def modules(self) -> DataFrame:
        """Regions 0.., nations 100.., customers 1000.."""
        region = self.table("region").select(F.col("r_regionkey").cast("long").alias("module_id"))
        nation = self.table("nation").select((F.col("n_nationkey") + 100).cast("long"))
        return region.union(nation).union(self.table("customer").select((F.col("c_custkey") + 1000).cast("long")))

    def deps(self) -> DataFrame:
        nation = self.table("nation").select((F.col("n_nationkey") + 100).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
        return nation.union(self.table("customer").select((F.col("c_custkey") + 1000).cast("long"), (F.col("c_nationkey") + 100).cast("long")))

    def cyclic_deps(self) -> DataFrame:
        """Customers' modules in rings, one for each nation: from each to the next by key, and from the last to the first."""
        ring = Window.partitionBy("c_nationkey").orderBy("c_custkey")
        every = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        following = F.coalesce(F.lead("c_custkey").over(ring), F.first("c_custkey").over(every))
        return self.table("customer").select((F.col("c_custkey") + 1000).cast("long").alias("src"), (following + 1000).cast("long").alias("dst"))

    def cyclic_modules(self) -> DataFrame:
        return self.table("customer").select((F.col("c_custkey") + 1000).cast("long").alias("module_id"))

    def file_module(self) -> DataFrame:
        """Files go to customers' modules by number; every seventh file to none."""
        n = F.col("file_id")
        return self.texts().where(n % 7 != 0).select("file_id", (1000 + 1 + n % 100).cast("long").alias("module_id"))

    def pages(self) -> DataFrame:
        path = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)
        return self.table("pages").select(F.col("page_id").alias("file_id"), path.alias("path"), "url", "html")

    def log(self) -> DataFrame:
        events = self.table("events")
        hits = (F.col("event_id") % 4).cast("long")
        return events.select(F.unix_timestamp("ts").alias("ts"), F.col("event_type").alias("cmd"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("query"), hits.alias("hits"), F.floor(F.col("value") * 10).cast("long").alias("elapsed_ms"))

    def owners(self) -> DataFrame:
        """Owners of folders: each source's folder has one, languages of some sources cut it off, the root has one."""
        source = self.table("documents").select("source").distinct()
        tops = source.select(F.concat(F.lit("/"), "source").alias("dir"), F.array(F.concat("source", F.lit("@example.com"))).alias("emails"), F.lit(False).alias("noparent"))
        subs = self.table("documents").select("source", "lang").distinct()
        subs = subs.select(F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("dir"), F.when(F.col("lang") == "fr", F.array(F.concat("lang", F.lit("@example.com")))).otherwise(F.array().cast("array<string>")).alias("emails"), (F.col("lang") == "de").alias("noparent"))
        root = self.spark.createDataFrame([("", ["root@example.com"], False)], "dir string, emails array<string>, noparent boolean")
        return tops.unionByName(subs).unionByName(root)


def classified(files: DataFrame) -> DataFrame:
    return files.withColumn("lang", classify(F.col("path")))
