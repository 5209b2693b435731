"""The registered queries: each operator over the text tables, with SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import columns as c
from quillon.operators import graph, grep, lookup, maintain, refs, summary
from quillon.plans import indexing
from quillon.rpc import trimmed
from quillon.sources import tree
from quillon.sources.corpus import Corpus
from quillon.sources.extract import extracted
from quillon.streaming.watch import bursts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

BASE = """
texts as (select doc_id as file_id, '/' || source || '/' || lang || '/' || doc_id || '.txt' as path, lang, source, text from documents),
files as (select file_id, substr(path, 2) as relpath, path, lang, strlen(text)::bigint as size, sha256(text) as digest from texts),
lines0 as (select file_id, path, lang, source, unnest(string_split(text, chr(10))) as ln, generate_subscripts(string_split(text, chr(10)), 1)::bigint as line from texts),
lines as (select *, (sum(strlen(ln) + 1) over (partition by file_id order by line) - strlen(ln) - 1)::bigint as byte_start from lines0),
syms0 as (select file_id, path, lang, source, line, 1::bigint as col, byte_start, (byte_start + strlen(ln))::bigint as byte_end,
    lower(regexp_extract(ln, '^([A-Z][a-z]+)', 1)) as name, case when line = 1 then 'class' when line % 3 = 0 then 'method' else 'fn' end as kind from lines),
syms1 as (select *, case when kind = 'method' then [source] else []::varchar[] end as scope_path from syms0 where name <> ''
    union all select file_id, path, lang, source, 0, 1, 0, 0, source, 'pkg', []::varchar[] from texts),
symbols as (select *, substr(sha256(path || '|' || kind || '|' || name || '|' || line), 1, 16) as id,
    (case kind when 'class' then 100 when 'pkg' then 70 else 90 end - 3 * least(len(scope_path), 10))::bigint as score from syms1),
words as (select file_id, path, lang, source, line, byte_start, unnest(string_split(ln, ' ')) as w, generate_subscripts(string_split(ln, ' '), 1)::bigint - 1 as k from lines),
refs as (select file_id, path, lang, source, line, k + 1 as col, byte_start + k as byte_start, regexp_extract(w, '^([a-z]+)[.,]?$', 1) as name, case when k % 5 = 0 then 'type' else 'call' end as kind, k
    from words where k > 0 and length(regexp_extract(w, '^([a-z]+)[.,]?$', 1)) >= 4)
"""
ORDER = "score desc, path, line, col, name, kind"


def query(sql: str | None = None, base: bool = True, recursive: bool = False) -> Callable[[Callable], Callable]:
    """Registers a function of a Corpus under its name, with SQL after the common table expressions."""

    def register(f: Callable[[Corpus], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = lambda spark, folder: f(Corpus(spark, folder))
        if sql:
            _SQL[f.__name__] = (f"with {'recursive ' if recursive else ''}{BASE}" if base else "") + sql
        return f

    return register


def queries() -> dict[str, Query]:
    return _QUERIES | indexing.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | indexing.oracle_sql()


SHOWN = ("path", "line", "name", "kind", "score")

# Symbol lookup


@query(f"select path, line, name, kind, score from symbols where name = 'the' order by {ORDER} limit 100")
def def_exact(k: Corpus) -> DataFrame:
    return lookup.definitions(k.symbols(), "the").select(*SHOWN)


@query(f"select path, line, name, kind, score from symbols where name = 'der' and lang = 'de' and kind = 'method' order by {ORDER} limit 100")
def def_lang_kind_filter(k: Corpus) -> DataFrame:
    return lookup.definitions(k.symbols(), "der", lang="DE", kind="Method").select(*SHOWN)


@query(f"select path, line, name, kind, score from symbols where name = 'the' and path like '%/src1%' and path not like '%/src11/%' order by {ORDER} limit 50")
def def_path_in_notin(k: Corpus) -> DataFrame:
    return lookup.definitions(k.symbols(), "the", inside="/src1", outside="/src11/", limit=50).select(*SHOWN)


@query("select path, line, name, kind, score from (select *, row_number() over (partition by name, lang order by path, line, col) as r from symbols where name = 'src3' and kind = 'pkg') where r = 1")
def def_pkg_dedupe(k: Corpus) -> DataFrame:
    return lookup.definitions(k.symbols(), "src3").select(*SHOWN)


@query("select kind, score, count(*) as n from symbols group by kind, score")
def rank_tiers(k: Corpus) -> DataFrame:
    return k.symbols().groupBy("kind", c.rank_score().alias("score")).agg(F.count("*").alias("n"))


_PLACES = {0: "/A/Tests/x.java", 1: "/a/sample/x.java", 2: "/a/gen/x_pb2.py", 3: "/a/b/c/d/e/f/g/h/x.c", 4: "/x.c", 5: "/a/Generated/tests/examples/x.pb.cc", 6: "/a/b/c/d/e/f/g/h/i/j/k/l/m/n/o/p/q/x.c"}
_PLACES_SQL = "case doc_id % 7 " + " ".join(f"when {n} then '{p}'" for n, p in _PLACES.items()) + " end"


@query(
    f"""select path, (case when lower(path) like '%/test/%' or lower(path) like '%/tests/%' or lower(path) like '%/testing/%' then 25 else 0 end
      + case when lower(path) like '%/sample%' or lower(path) like '%/example%' then 15 else 0 end
      + case when contains(lower(path), '/generated/') or contains(lower(path), '/gen/') or contains(lower(path), '.pb.') or contains(lower(path), '_pb2.') then 20 else 0 end
      + least(greatest(length(path) - length(replace(path, '/', '')) - 6, 0), 8))::bigint as penalty, count(*) as n from (select {_PLACES_SQL} as path from documents) group by path""",
    base=False,
)
def rank_paths(k: Corpus) -> DataFrame:
    path = F.expr(_PLACES_SQL)
    return k.table("documents").select(path.alias("path")).groupBy("path", c.path_penalty(F.col("path")).cast("long").alias("penalty")).agg(F.count("*").alias("n"))


@query(f"select path, line, name, kind, score from symbols where starts_with(name, 'th') order by {ORDER} limit 50")
def prefix_topk(k: Corpus) -> DataFrame:
    return lookup.by_prefix(k.symbols(), "th").select(*SHOWN)


@query(f"select path, line, name, kind, score from (select * from symbols where starts_with(name, 'en') order by name, path, line, col, kind limit 160) where path like '%/de/%' order by {ORDER} limit 20")
def prefix_overfetch8(k: Corpus) -> DataFrame:
    return lookup.by_prefix(k.symbols(), "en", inside="/de/", limit=20, first=160).select(*SHOWN)


def _tiered(text: str) -> str:
    low = text.lower()
    like = "%" + "%".join(low) + "%"
    return f"(select *, (case when contains(name, '{text}') then 1 when contains(lower(name), '{low}') then 2 when lower(name) like '{like}' then 3 end)::integer as tier from symbols)"


@query(f"select path, line, name, kind, tier from {_tiered('erin')} where tier is not null order by tier, name, path, line, col, kind limit 50")
def substring_cs(k: Corpus) -> DataFrame:
    return lookup.by_substring(k.symbols(), "erin").select("path", "line", "name", "kind", "tier")


@query(f"select path, line, name, kind, tier from {_tiered('EriN')} where tier is not null order by tier, name, path, line, col, kind limit 50")
def substring_ci_upper(k: Corpus) -> DataFrame:
    return lookup.by_substring(k.symbols(), "EriN").select("path", "line", "name", "kind", "tier")


@query("select name, count(*) as n from symbols where lower(name) like '%t%n%d%r%' group by name")
def subsequence(k: Corpus) -> DataFrame:
    return k.symbols().where(c.subsequence(F.col("name"), "TnDr")).groupBy("name").agg(F.count("*").alias("n"))


_FUZZY = """select *, levenshtein(name, '{q}')::bigint as distance, (case when name = '{q}' then 0 when starts_with(name, '{q}') then strlen(name) - {n}
  when contains(name, '{q}') then strlen(name) - {n} + 1 else levenshtein(name, '{q}') + {m} end)::bigint as fuzzy from symbols
  where levenshtein(name, '{q}') <= 2 or contains(name, '{q}') or lower(name) like '{like}'"""


def _fuzzy(q: str) -> str:
    return _FUZZY.format(q=q, n=len(q), m=max(2 * len(q), 4), like="%" + "%".join(q) + "%")


@query(f"select path, line, name, kind, score, distance, fuzzy from ({_fuzzy('then')}) order by fuzzy, score desc, name, path, line, col, kind limit 50")
def fuzzy_ranked(k: Corpus) -> DataFrame:
    return lookup.fuzzy(k.symbols(), "then").select(*SHOWN, "distance", "fuzzy")


@query(f"select distinct name, distance, fuzzy from ({_fuzzy('ander')})")
def fuzzy_score(k: Corpus) -> DataFrame:
    return lookup.fuzzy(k.symbols(), "ander", limit=None).select("name", "distance", "fuzzy").distinct()


@query("select distinct w, levenshtein(w, 'été')::bigint as distance from (select unnest(string_split(ln, ' ')) as w from lines) where not regexp_full_match(w, '[ -~]*')")
def levenshtein_bytes(k: Corpus) -> DataFrame:
    words = k.lines().select(F.explode(F.split("ln", " ")).alias("w")).where(~F.col("w").rlike("^[ -~]*$")).distinct()
    return words.select("w", c.byte_levenshtein(F.col("w"), F.lit("été")).alias("distance"))


@query(f"select name, distance from (select distinct name, distance from (select * from ({_fuzzy('thenn')}) order by fuzzy, score desc, name, path, line, col, kind limit 32)) order by distance, abs(strlen(name) - 5), name limit 3")
def did_you_mean(k: Corpus) -> DataFrame:
    return lookup.did_you_mean(k.symbols(), "thenn")


@query("select file_id, path from files where path like '%/en/10.txt' or path like '%/de/10.txt' or path like '%/fr/10.txt' or path like '%/es/10.txt' or path like '%/10.txt' order by strlen(path), file_id limit 1")
def resolve_path_suffix(k: Corpus) -> DataFrame:
    return lookup.resolve_path(k.files(), "10.txt").select("file_id", "path")


_PLACES_IN = "select file_id, least(17 * (1 + file_id % 9), size)::bigint as byte from files"


@query(
    f"""select p.file_id, p.byte, s.name, s.kind, s.line, s.byte_start as span_start, s.byte_end as span_end from ({_PLACES_IN}) p join symbols s on s.file_id = p.file_id and p.byte >= s.byte_start and p.byte < s.byte_end
    qualify row_number() over (partition by p.file_id order by s.byte_end - s.byte_start, -s.byte_start, s.name, s.kind) = 1"""
)
def whereis_innermost(k: Corpus) -> DataFrame:
    places = k.files().select("file_id", F.least(17 * (1 + F.col("file_id") % 9), F.col("size")).alias("byte"))
    return lookup.whereis(k.kept("symbols_by_file"), places)


@query("select file_id, byte_start + least(11, strlen(ln))::bigint as byte from lines where line = 2")
def line_col_to_byte(k: Corpus) -> DataFrame:
    return lookup.byte_of(k.lines(), 2, 12)


# Uses


@query("select path, line, col, kind from refs where name = 'with' order by path, line, col limit 200")
def ref_exact(k: Corpus) -> DataFrame:
    return refs.find(k.refs(), "with", limit=200).select("path", "line", "col", "kind")


@query("select path, line, col, kind from refs where name = 'that' and (source = 'src4' or lang = 'src4') and path not like '%/fr/%' order by path, line, col")
def ref_scope_segment(k: Corpus) -> DataFrame:
    return refs.find(k.refs(), "that", scope="src4", outside="/fr/").select("path", "line", "col", "kind")


@query("select path, line, col from refs where name = 'that' and kind = 'call' order by path, line, col limit 100")
def callers_kind(k: Corpus) -> DataFrame:
    return refs.callers(k.refs(), "that", limit=100).select("path", "line", "col")


@query("select count(*) as n from refs where name = 'that'")
def ref_count(k: Corpus) -> DataFrame:
    return refs.find(k.refs(), "that").agg(F.count("*").alias("n"))


_RESOLVE = """, anyd as (select name, arg_min(id, (path, line, col, id)) as d from symbols group by name),
ownd as (select name, lang, arg_min(id, (path, line, col, id)) as d from symbols group by name, lang),
res as (select r.*, coalesce(o.d, a.d) as resolved_to, case when o.d is not null then 'same_lang' when a.d is not null then 'first' end as resolution
  from refs r left join ownd o on o.name = r.name and o.lang = r.lang left join anyd a on a.name = r.name)"""


@query(f"{_RESOLVE} select resolved_to as def_id, s.path as def_path, s.line as def_line, count(*) as n from res left join symbols s on s.id = resolved_to where res.name in ('that', 'ther', 'zzzz') group by 1, 2, 3")
def ref_by_def(k: Corpus) -> DataFrame:
    found = k.refs().where(F.col("name").isin("that", "ther", "zzzz"))
    return refs.by_definition(refs.resolved(found, k.symbols()), k.symbols())


@query("select distinct path from refs where name = 'this' order by path limit 100")
def ref_paths(k: Corpus) -> DataFrame:
    return refs.paths(refs.find(k.refs(), "this"), 100)


@query(f"{_RESOLVE} select resolution, resolved_to, count(*) as n from res group by 1, 2")
def resolve_layer1(k: Corpus) -> DataFrame:
    return refs.resolved(k.refs(), k.symbols()).groupBy("resolution", "resolved_to").agg(F.count("*").alias("n"))


_USES = """, defs as (select id, file_id, byte_start as s from symbols where name = 'the'),
ends as (select d.id, d.s, min(f.byte_start) as e from defs d join symbols f on f.file_id = d.file_id and f.kind in ('fn', 'method', 'ctor') and f.byte_start > d.s group by 1, 2),
body as (select d.file_id, d.s, coalesce(e, 2147483647) as e from defs d left join ends using (id, s)),
used as (select distinct r.file_id, r.byte_start, r.path, r.line, r.col, r.name, r.kind from refs r join body b on b.file_id = r.file_id and r.byte_start >= b.s and r.byte_start < b.e)"""


@query(f"{_USES} select path, line, col, name, kind from used")
def uses_range_join(k: Corpus) -> DataFrame:
    return refs.uses(k.kept("refs_by_file"), k.kept("symbols_by_file"), "the").select("path", "line", "col", "name", "kind")


@query(f"{_USES} select name, count(*) as n from used where kind = 'type' group by name")
def uses_kind(k: Corpus) -> DataFrame:
    return refs.uses(k.kept("refs_by_file"), k.kept("symbols_by_file"), "the", kind="type").groupBy("name").agg(F.count("*").alias("n"))


_ENCLOSED = """, fns as (select * from symbols where kind in ('fn', 'method', 'ctor')),
inside as (select r.*, f.id as caller_id, f.name as caller, f.line as caller_line from refs r asof left join fns f on r.file_id = f.file_id and r.byte_start >= f.byte_start)"""


@query(f"{_ENCLOSED} select caller, name, count(*) as n, min(caller_line) as first_line from inside group by caller, name")
def enclosing_asof(k: Corpus) -> DataFrame:
    return refs.enclosing(k.kept("refs_by_file"), k.kept("symbols_by_file")).groupBy("caller", "name").agg(F.count("*").alias("n"), F.min("caller_line").alias("first_line"))


@query("select file_id, count(*) as symbols, (select count(*) from refs r where r.file_id = s.file_id) as refs from symbols s group by file_id")
def symbols_per_file(k: Corpus) -> DataFrame:
    return refs.per_file(k.kept("symbols_by_file"), k.kept("refs_by_file"))


@query("select split_part(path, '/', 3) || '/' || split_part(path, '/', 4) || ':' || line || case when len(scope_path) > 0 then ' [' || array_to_string(scope_path, '::') || ']' else '' end as note, name from symbols where name = 'der'")
def def_annotation(k: Corpus) -> DataFrame:
    found = k.symbols().where("name = 'der'")
    return found.select(refs.annotation(F.col("path"), F.col("line"), F.col("scope_path")).alias("note"), "name")


# Graphs

_STAR = """with recursive cls as (select 1 as f, 'R' || r_regionkey as name from region union all select 2, 'N' || n_nationkey from nation union all select 3, 'S' || s_suppkey from supplier),
inh as (select 'R' || n_regionkey as parent, 'N' || n_nationkey as name from nation union all select 'N' || s_nationkey, 'S' || s_suppkey from supplier)"""


@query(f"{_STAR} select name, 0 as level from inh where parent = 'R1'", base=False)
def subclasses_direct(k: Corpus) -> DataFrame:
    return graph.subclasses(k.class_refs(), k.class_symbols(), "R1").select("name", "level")


@query(f"{_STAR}, t as (select name, 0 as level from inh where parent = 'R2' union select i.name, t.level + 1 from inh i join t on i.parent = t.name where t.level < 2) select name, min(level) as level from t group by name", base=False)
def subclasses_transitive(k: Corpus) -> DataFrame:
    return graph.subclasses(k.class_refs(), k.class_symbols(), "R2", 2).select("name", "level")


_EDGES = f"""{_ENCLOSED}, edge as (select name as callee, caller_id, coalesce(caller, lang) as caller, path, count(*) as call_sites, min(line) as first_line from inside where kind = 'call' group by 1, 2, 3, 4)"""


@query(f"{_EDGES} select callee, caller, sum(call_sites)::bigint as call_sites, count(*) as files from edge group by 1, 2")
def call_edges(k: Corpus) -> DataFrame:
    return graph.call_edges(k.refs(), k.symbols()).groupBy("callee", "caller").agg(F.sum("call_sites").alias("call_sites"), F.count("*").alias("files"))


@query(
    f"""{_EDGES}, l1 as (select 1 as level, *, [coalesce(caller_id, '')] as trail from edge where callee = 'worthless'),
    l2 as (select 2 as level, e.*, list_append(l1.trail, coalesce(e.caller_id, '')) as trail from edge e join l1 on e.callee = l1.caller and l1.caller_id is not null where e.caller_id is null or not list_contains(l1.trail, e.caller_id)),
    cut as (select * from l2 order by path, first_line, caller, trail limit 200)
    select level, callee, caller, path, call_sites from (select * from l1 union all select * from cut) order by level, path, first_line, caller, callee, trail limit 200"""
)
def callgraph_levels(k: Corpus) -> DataFrame:
    return graph.callgraph(k.refs(), k.symbols(), "worthless", depth=2).select("level", "callee", "caller", "path", "call_sites")


@query(
    f"""{_STAR}, t as (select name, 0 as level from inh where parent = 'N3' union select i.name, t.level + 1 from inh i join t on i.parent = t.name where t.level < 2)
    select '/star/3.java' as path, 0::bigint as callers, count(distinct name) as subclasses from t having count(*) > 0""",
    base=False,
)
def impact_files(k: Corpus) -> DataFrame:
    return graph.impact(k.class_refs(), k.class_symbols(), "N3")


@query("select path, count(*) as callers, 0::bigint as subclasses from refs where name = 'stupid' and kind = 'call' group by path")
def impact_callers(k: Corpus) -> DataFrame:
    return graph.impact(k.refs(), k.symbols(), "stupid")


_REACH = """with recursive m as (select r_regionkey::bigint as id from region union all select 100 + n_nationkey from nation union all select 1000 + c_custkey from customer),
d as (select 100 + n_nationkey::bigint as src, n_regionkey::bigint as dst from nation union all select 1000 + c_custkey, 100 + c_nationkey from customer),
reach(src, dst) as (select id, id from m union select reach.src, d.dst from reach join d on reach.dst = d.src)"""


@query(f"{_REACH} select src, dst from reach", base=False)
def reach_closure(k: Corpus) -> DataFrame:
    return graph.reach(k.modules(), k.deps())


@query("select 1000 + a.c_custkey as src, 1000 + b.c_custkey as dst from customer a join customer b using (c_nationkey)", base=False)
def reach_cycle(k: Corpus) -> DataFrame:
    return graph.reach(k.cyclic_modules(), k.cyclic_deps())


_OWNER = "fm as (select doc_id as file_id, 1001 + doc_id % 100 as module_id from documents where doc_id % 7 <> 0)"


@query(
    f""", {_OWNER}, d as (select 100 + n_nationkey::bigint as src, n_regionkey::bigint as dst from nation union all select 1000 + c_custkey, 100 + c_nationkey from customer),
    mods as (select r_regionkey::bigint as id from region union all select 100 + n_nationkey from nation union all select 1000 + c_custkey from customer),
    reach(src, dst) as (select id, id from mods union select reach.src, d.dst from reach join d on reach.dst = d.src),
    target as (select distinct module_id from symbols join fm using (file_id) where name = 'thin'),
    ok as (select distinct src from reach where dst in (select module_id from target))
    select r.path, r.line, r.col from refs r left join fm using (file_id) where r.name = 'thin' and (module_id is null or module_id in (select src from ok))""",
    recursive=True,
)
def reachable_filter(k: Corpus) -> DataFrame:
    symbols = k.symbols()
    found = refs.find(k.refs(), "thin")
    return graph.reachable(found, "thin", symbols, k.file_module(), graph.reach(k.modules(), k.deps())).select("path", "line", "col")


@query(f", {_OWNER} select count(*) as n from refs r left join fm using (file_id) where r.name = 'stupid' and module_id is null")
def unattributed_pass(k: Corpus) -> DataFrame:
    owner = k.file_module()
    found = graph.reachable(refs.find(k.refs(), "stupid"), "stupid", k.symbols(), owner, graph.reach(k.modules(), k.deps()))
    return found.join(owner, "file_id", "left_anti").agg(F.count("*").alias("n"))


# Content search

_GRAMS = """, bytes as (select file_id, unnest(b) as x, generate_subscripts(b, 1) as i from (select file_id, regexp_extract_all(hex(encode(text)), '..') as b from texts)),
three as (select file_id, x, lead(x, 1) over w as y, lead(x, 2) over w as z from bytes window w as (partition by file_id order by i)),
grams as (select distinct file_id, ('0x' || x || y || z)::integer as g, x || y || z as t from three where z is not null and x <> '00' and y <> '00' and z <> '00')"""


@query(f"{_GRAMS} select count(*) as postings, count(distinct g) as grams, sum(g)::bigint as total from grams")
def trigram_postings(k: Corpus) -> DataFrame:
    return grep.grams_of(k.texts()).agg(F.count("*").alias("postings"), F.count_distinct("g").alias("grams"), F.sum(F.col("g").cast("long")).alias("total"))


@query(f"{_GRAMS} select g, count(*) as files from grams group by g having count(*) >= 50")
def trigram_df(k: Corpus) -> DataFrame:
    return grep.frequencies(k.trigrams()).where("files >= 50")


_PIECES = """, hit as (select file_id, path, line, ln, byte_start, string_split(ln, '{p}') as g from lines where contains(ln, '{p}')),
hits as (select *, unnest(range(1, len(g))) as i from hit),
found as (select file_id, path, line, ln, (list_sum(list_transform(g[1:i], lambda x: strlen(x))) + (i - 1) * strlen('{p}'))::bigint as pos, byte_start from hits)"""
_FOUND = " select path, line, pos + 1 as col, byte_start + pos as byte from found order by path, byte"


@query(_PIECES.format(p="retitioning") + _FOUND)
def grep_literal(k: Corpus) -> DataFrame:
    return grep.search(k.texts(), "retitioning").select("path", "line", "col", "byte")


@query(_PIECES.format(p="erention") + _FOUND)
def grep_trigram_strategy(k: Corpus) -> DataFrame:
    return grep.search(k.texts(), "erention", postings=k.trigrams()).select("path", "line", "col", "byte")


@query("select path, line, count(*) as n from (select path, line, unnest(regexp_extract_all(ln, '(?i)retition')) from lines) group by path, line")
def grep_ci(k: Corpus) -> DataFrame:
    return grep.search(k.texts(), "ReTition", ignore_case=True, postings=k.trigrams()).groupBy("path", "line").agg(F.count("*").alias("n"))


@query("select path, line, count(*) as n from (select path, line, unnest(regexp_extract_all(ln, 'th(er|an)tion[a-z]+')) from lines) group by path, line")
def grep_regex(k: Corpus) -> DataFrame:
    return grep.search(k.texts(), "th(?:er|an)tion[a-z]+", postings=k.trigrams()).groupBy("path", "line").agg(F.count("*").alias("n"))


def _hex(text: str) -> str:
    grams = {text.encode()[i : i + 3].hex().upper() for i in range(len(text) - 2)}
    return ", ".join(f"'{g}'" for g in sorted(grams))


@query(f"{_GRAMS} select file_id from grams where t in ({_hex('erention')}) group by file_id having count(*) = 6")
def grep_candidates(k: Corpus) -> DataFrame:
    return grep.candidates(k.trigrams(), "erention")


@query(_PIECES.format(p="Apache License") + " select path, line, pos + 1 as col, ln as shown from found where strlen(ln) <= 200")
def grep_locate(k: Corpus) -> DataFrame:
    return grep.search(k.texts(), "Apache License").where(~F.col("shown").endswith("…")).select("path", "line", "col", "shown")


@query(_PIECES.format(p="with") + " select count(*) as hits, count(distinct file_id) as files from found")
def grep_count(k: Corpus) -> DataFrame:
    return grep.counts(grep.search(k.texts(), "with"))


@query(_PIECES.format(p="heit") + " select path, line, pos + 1 as col from found where path like '%/de/%' and path not like '%/src2%'")
def grep_lang_in(k: Corpus) -> DataFrame:
    return grep.search(k.texts(), "heit", lang="DE", inside="/src", outside="/src2").select("path", "line", "col")


@query(f"{_GRAMS} select g, count(*) as files from grams where t in ({_hex('retition')}) group by g")
def grep_explain(k: Corpus) -> DataFrame:
    return grep.explain(k.trigrams(), "retition")


@query(_PIECES.format(p="tion") + " select path, line, pos + 1 as col from (select *, row_number() over (partition by file_id order by byte_start + pos) as r from found) where r <= 16 order by path, line, col limit 2000")
def grep_cap16(k: Corpus) -> DataFrame:
    return grep.search(k.texts(), "tion", per_file=16, limit=2000).select("path", "line", "col")


@query(_PIECES.format(p="token =") + ", b as (select path, byte_start + pos as byte, file_id from found) select b.path, b.byte, s.name as fqn from b left join symbols s on s.file_id = b.file_id and b.byte >= s.byte_start and b.byte < s.byte_end")
def grep_enclosing(k: Corpus) -> DataFrame:
    found = grep.search(k.texts(), "token =").select("file_id", "path", "byte")
    return lookup.enclosed(found, k.kept("symbols_by_file"), "name").select("path", "byte", "fqn")


# Reports


@query("select line, col, name, kind from symbols where path = (select path from files where path like '%/4.txt' order by strlen(path), file_id limit 1) order by line, col, name")
def outline(k: Corpus) -> DataFrame:
    path = lookup.resolve_path(k.files(), "4.txt").first().path
    return summary.outline(k.kept("symbols_by_file"), path).select("line", "col", "name", "kind")


@query("select file_id, kind, count(*) as n from symbols group by file_id, kind")
def tldr_kinds(k: Corpus) -> DataFrame:
    return summary.kinds(k.symbols(), "file_id")


@query("select file_id, name, kind, place from (select *, row_number() over (partition by file_id order by score desc, line, col, name)::integer as place from symbols) where place <= 3")
def tldr_top3(k: Corpus) -> DataFrame:
    return summary.best_of_each(k.symbols()).select("file_id", "name", "kind", "place")


@query("select file_id, path, coalesce(regexp_extract(text, '(?m)^[ \\t\\r]*([^ \\t\\r\\n].*?)[ \\t\\r]*$', 1), '') as first from texts")
def tldr_first_line(k: Corpus) -> DataFrame:
    return summary.first_lines(k.texts())


@query("select f.lang, count(*) as files, sum(size)::bigint as bytes, sum((select count(*) from symbols s where s.file_id = f.file_id))::bigint as symbols from files f where path like '%/src1%' group by f.lang")
def coverage_lang(k: Corpus) -> DataFrame:
    return summary.coverage(k.files(), k.symbols(), "/src1")


@query("select lang, kind, count(*) as n from symbols group by rollup (lang, kind)")
def coverage_by_kind(k: Corpus) -> DataFrame:
    return summary.coverage_by_kind(k.symbols())


@query("select lang, count(*) as n from symbols group by lang")
def stats_lang(k: Corpus) -> DataFrame:
    return summary.languages(k.symbols())


@query("select kind, count(*) as n from symbols group by kind")
def stats_kind(k: Corpus) -> DataFrame:
    return summary.kinds(k.symbols())


_DIFF = """, a as (select relpath, digest from files where file_id % 10 <> 0), b as (select relpath, case when file_id % 10 = 1 then 'x' else digest end as digest from files where file_id % 10 <> 2),
st as (select coalesce(a.relpath, b.relpath) as relpath, case when a.relpath is null then 'added' when b.relpath is null then 'removed' when a.digest = b.digest then 'unchanged' else 'changed' end as status from a full join b on a.relpath = b.relpath)"""


def _two(k: Corpus) -> tuple[DataFrame, DataFrame]:
    files = k.files()
    changed = F.when(F.col("file_id") % 10 == 1, "x").otherwise(F.col("digest"))
    return files.where("file_id % 10 <> 0"), files.where("file_id % 10 <> 2").withColumn("digest", changed)


@query(f"{_DIFF} select relpath, status from st")
def index_diff(k: Corpus) -> DataFrame:
    return summary.index_diff(*_two(k)).select("relpath", "status")


@query(f"{_DIFF} select relpath, (select count(*) from symbols s where s.file_id = f.file_id) as symbol_count from files f where relpath in (select relpath from st where status in ('changed', 'added')) order by relpath limit 50")
def diff_changed(k: Corpus) -> DataFrame:
    changed = summary.index_diff(*_two(k)).where("status in ('changed', 'added')").select("root_id", "relpath")
    return summary.changed_symbols(k.files(), k.symbols(), changed)


@query(f"{_DIFF} select status, count(*) as n from st group by status")
def index_diff_counts(k: Corpus) -> DataFrame:
    return summary.index_diff(*_two(k)).groupBy("status").agg(F.count("*").alias("n"))


_OWNERS = """, ow as (select distinct '/' || source as dir, source || '@example.com' as email, false as np from texts union all select distinct '/' || source || '/' || lang, case when lang = 'fr' then 'fr@example.com' end, lang = 'de' from texts union all select '', 'root@example.com', false),
up as (select file_id, path, unnest(['/' || source || '/' || lang, '/' || source, '']) as dir, unnest([1, 2, 3]) as depth from texts),
met as (select up.*, email, np, min(case when np then depth end) over (partition by file_id) as stop from up join ow using (dir)),
seen as (select * from met where stop is null or depth <= stop)"""


@query(f"{_OWNERS} select file_id, depth, email from (select *, min(case when email is not null then depth end) over (partition by file_id) as near from seen) where depth = near")
def owners_climb(k: Corpus) -> DataFrame:
    return summary.owners(k.files(), k.owners()).select("file_id", "depth", "email")


@query(f"{_OWNERS} select email, count(distinct file_id) as files from seen where email is not null group by email")
def owners_accumulate(k: Corpus) -> DataFrame:
    return summary.owners(k.files(), k.owners(), "all").groupBy("email").agg(F.count_distinct("file_id").alias("files"))


_LOG = "with log as (select floor(epoch(ts))::bigint as ts, event_type as cmd, 'u' || user_id as query, event_id % 4 as hits, floor(value * 10)::bigint as elapsed_ms from events)"


@query(f"{_LOG} select cmd, count(*) as n, round(quantile_cont(elapsed_ms, 0.95), 6) as p95 from log group by cmd", base=False)
def querylog_p95(k: Corpus) -> DataFrame:
    return summary.slow_commands(k.log()).withColumn("p95", F.round("p95", 6))


@query(f"{_LOG} select cmd, query, count(*) as n from log where hits = 0 group by cmd, query", base=False)
def querylog_empty(k: Corpus) -> DataFrame:
    return summary.empty_results(k.log())


@query(f"{_LOG} select strftime(to_timestamp(ts) at time zone 'UTC', '%Y-%m-%d') as day, cmd, count(*) as n, sum(hits)::bigint as hits from log group by 1, 2", base=False)
def querylog_per_day(k: Corpus) -> DataFrame:
    return summary.per_day(k.log())


@query(f"{_LOG} select ts, cmd, query, elapsed_ms from log order by elapsed_ms desc, ts, cmd, query limit 20", base=False)
def querylog_slowest(k: Corpus) -> DataFrame:
    return summary.slowest(k.log()).select("ts", "cmd", "query", "elapsed_ms")


# Maintenance


@query("select kind, count(*) as n from symbols where path not like '%/src7/%' group by kind")
def tombstone_antijoin(k: Corpus) -> DataFrame:
    return summary.kinds(maintain.living(k.symbols(), maintain.tombstones(k.files(), "/src7/")))


@query("select file_id, path, size from files where path not like '%/es/%'")
def compact(k: Corpus) -> DataFrame:
    return maintain.living(k.files(), maintain.tombstones(k.files(), "/es/")).select("file_id", "path", "size")


@query("select case when file_id % 10 in (0, 1) then 'read' else 'kept' end as how, kind, count(*) as n from symbols where file_id % 10 <> 2 group by 1, 2")
def incremental_merge(k: Corpus) -> DataFrame:
    old, new = _two(k)
    rows = k.kept("symbols_by_file").select("file_id", "kind", F.lit("kept").alias("how"))

    def extract(todo: DataFrame) -> DataFrame:
        return rows.join(todo.select("file_id"), "file_id", "left_semi").withColumn("how", F.lit("read"))

    return maintain.merged(old, rows.join(old.select("file_id"), "file_id", "left_semi"), new, extract).groupBy("how", "kind").agg(F.count("*").alias("n"))


@query("select digest, count(*) as copies, min(path) as first from files group by digest having count(*) > 1")
def digest_dupes(k: Corpus) -> DataFrame:
    return maintain.duplicates(k.files())


# Scalars

_MANGLE = "replace(replace(replace(replace(replace(x, '_', '_1'), ';', '_2'), '[', '_3'), '$', '_00024'), '.', '_')"


@query(f"select x, {_MANGLE} as mangled from (select distinct name || '_a$' || lang || '.[' || kind || ';' as x from symbols)")
def jni_mangle(k: Corpus) -> DataFrame:
    text = F.concat("name", F.lit("_a$"), "lang", F.lit(".["), "kind", F.lit(";"))
    return k.symbols().select(text.alias("x")).distinct().select("x", c.jni_mangle(F.col("x"), package=True).alias("mangled"))


@query("select id, case when len(scope_path) > 0 then array_to_string(scope_path, '::') || '::' || name end as fqn_index, array_to_string(list_concat([source], list_concat(scope_path, [name])), '.') as fqn_live from symbols where kind <> 'pkg'")
def fqn_build(k: Corpus) -> DataFrame:
    rows = k.symbols().where("kind <> 'pkg'").withColumn("package", F.split("path", "/")[1])
    return rows.select("id", c.fqn_index(F.col("scope_path"), F.col("name")).alias("fqn_index"), c.fqn_live(F.col("package"), F.col("scope_path"), F.col("name"), F.col("lang")).alias("fqn_live"))


_NAMES = ["Android.bp", "a.PY", "b.c++", "Kconfig.debug", "Makefile", "x.S", "api/current.txt", "plain.txt", "noext", "OWNERS", "m.Proto", "AndroidManifest.xml", "t.tsx", "Kconfigs"]
_NAME_SQL = "case page_id % 14 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(_NAMES)) + " end"


@query(
    f"""select path, case regexp_extract(path, '[^/]*$') when 'Android.bp' then 'Soong' when 'a.PY' then 'Python' when 'b.c++' then 'Cpp' when 'Kconfig.debug' then 'Kconfig' when 'Makefile' then 'Makefile'
    when 'x.S' then 'Assembly' when 'current.txt' then 'ApiTxt' when 'OWNERS' then 'Owners' when 'm.Proto' then 'Proto' when 'AndroidManifest.xml' then 'Manifest' when 't.tsx' then 'TypeScript' end as lang, count(*) as n
    from (select regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) || '/' || {_NAME_SQL} as path from pages) group by 1, 2""",
    base=False,
)
def classify_path(k: Corpus) -> DataFrame:
    named = k.table("pages").select(F.concat(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1), F.lit("/"), F.expr(_NAME_SQL)).alias("path"))
    return named.groupBy("path", c.classify(F.col("path")).alias("lang")).agg(F.count("*").alias("n"))


@query("select file_id, file_id % 5 in (0, 1) as odd from texts")
def binary_sniff(k: Corpus) -> DataFrame:
    n = F.col("file_id") % 5
    content = F.when(n == 0, F.concat(F.lit("a\x00"), "text")).when(n == 1, F.concat(F.repeat(F.lit("\x01"), F.lit(60)), "text")).otherwise(F.col("text"))
    return k.texts().select("file_id", c.looks_binary(F.encode(content, "UTF-8")).alias("odd"))


@query("select page_id as file_id, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?(-->|$)', '', 'gs'), '\\s(?:id|class|name)\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)) as name from pages", base=False)
def html_ids(k: Corpus) -> DataFrame:
    files = k.pages().select("file_id", "path", F.lit("Html").alias("lang"), F.encode("html", "UTF-8").alias("content"))
    return extracted(files).where("symbol").select("file_id", "name")


@query(", names as (select distinct name from symbols) select length(name)::bigint as size, count(*) as n, min(name) as first, max(name) as last from names group by 1")
def name_dictionary(k: Corpus) -> DataFrame:
    return lookup.dictionary(k.symbols()).groupBy(F.length("name").cast("long").alias("size")).agg(F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


@query("select lang, count(*) as n from files where size <= 4000 group by lang")
def size_cap(k: Corpus) -> DataFrame:
    return tree.capped(k.files(), 4000).groupBy("lang").agg(F.count("*").alias("n"))


@query("select path from files order by relpath limit 25")
def limit_per_root(k: Corpus) -> DataFrame:
    return tree.limited(k.files(), 25).select("path")


# What SQL needs windows for: answers cut to a budget, and bursts of a stream


@query(
    f"""select path, line, name, kind, score from (
      select *, 2 + sum(strlen(path) + strlen(name) + strlen(kind) + strlen(line::varchar) + strlen(score::varchar) + 57) over (order by place) + 2 * (place - 1) as size
      from (select *, row_number() over (order by {ORDER}) as place from symbols where name = 'the' order by {ORDER} limit 100)) where size <= 4000"""
)
def budget_trim(k: Corpus) -> DataFrame:
    found = lookup.definitions(k.symbols(), "the").select(*SHOWN)
    rows = trimmed([r.asDict() for r in found.collect()], 4000)  # a page of 100 rows
    return k.spark.createDataFrame([tuple(r[c] for c in SHOWN) for r in rows], found.schema)


@query(
    """select root, files, count(*) as bursts from (
      select root, n, count(*) as files from (
        select *, sum(begins) over (partition by root order by ts, event_id) as n from (
          select event_type as root, ts, event_id, case when ts < lag(ts) over (partition by event_type order by ts, event_id) + interval 10 minutes then 0 else 1 end as begins from events))
      group by root, n) group by root, files""",
    base=False,
)
def watch_stream(k: Corpus) -> DataFrame:
    schema = k.table("events").schema
    events = k.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(k.folder)
    found = bursts(events.select(F.col("event_type").alias("root"), F.col("ts").cast("timestamp").alias("ts")), "10 minutes")
    at = f"{graph.shared_folder(k.spark)}/watched-{uuid.uuid4().hex}"
    writer = found.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state")
    writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/bursts")).trigger(availableNow=True).start().awaitTermination()
    return k.spark.read.schema(found.schema).parquet(f"{at}/bursts").groupBy("root", "files").agg(F.count("*").alias("bursts"))
