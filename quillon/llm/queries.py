"""The operators over the whole test tables, and SQL for those results that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontam, embeddings, langid, licenses, linededup, mixing, pii, simhash, toxicity, warc
from quillon.llm.shared import remainder, spread


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))


def _is(kind: str) -> Callable:
    return lambda span: span["kind"] == kind


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents", "doc_id", "text"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("found", lambda s: ~s["added"])
    counts = [F.size(F.filter("found", _is(kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "rejected")


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return warc.read_records(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels", "doc_id", "toxic"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.stored(_table(spark, sf_dir, "documents", "doc_id", "source", "text").select("doc_id", "source", mixing.word_count("text").alias("size"), F.xxhash64("text").alias("mark")), "sizes")
    dealt = mixing.assign(sized, size="size").select("doc_id", "size", "source_size", "target", "taken", "positions")
    # by the first reading; documents that are not read come last
    return dealt.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    index = linededup.LineIndex.empty(spark).insert(docs)
    return index.apply(docs, index.refs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents", "doc_id", "text"))
    names = F.array_join(F.transform("licenses", lambda x: x["license"]), ",")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), names.alias("licenses"), F.coalesce(F.array_max(F.transform("licenses", lambda x: x["containment"])), F.lit(0.0)).alias("containment"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_simhash, op2_pii, op3_embeddings, op4_langid, op5_decontam, op6_warc, op7_toxicity, op8_mixing, op9_linededup, op10_licenses)
    return {f.__name__: f for f in named}


_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_OP3 = """
with recursive v as (
  select vec_id, label, embedding::double[] as e,
         label is not null and len(embedding) > 0 and list_bool_and([x is not null and isfinite(x) for x in embedding]) and list_bool_or([x <> 0 for x in embedding]) as ok
  from embeddings),
l as (select a.vec_id as u, b.vec_id as v from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
      where a.ok and b.ok and list_cosine_similarity(a.e, b.e) >= 0.93),
r(u, v) as (select vec_id, vec_id from v union select r.u, l.v from r join l on r.v = l.u),
c as (select u, min(v) as component_id from r group by u),
n as (select u, count(*) as n_links from l group by u)
select v.vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, v.vec_id = component_id as kept
from v join c on c.u = v.vec_id left join n on n.u = v.vec_id
"""

_OP5 = f"""
with iw as (select item_id, regexp_extract_all({_ASCII.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where text is not null),
win as (select distinct item_id, len(w) as n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') as g, least(10, len(w)) as size
        from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from iw where len(w) > 0)),
dw as (select doc_id, regexp_extract_all({_ASCII.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
sizes as (select distinct size from win),
pos as (select doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') as g
        from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as k from dw, sizes where len(w) >= size)),
hit as (select pos.doc_id, pos.k, pos.size, win.item_id from pos join win on pos.g = win.g and pos.size = win.size),
n as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, unnest(range(k, k + size)) as p from (select distinct doc_id, k, size from hit)) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id::varchar as item_id from hit) group by doc_id)
select dw.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join n using (doc_id) left join i using (doc_id)
"""

_OP6 = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select payload_digest, max(page_id) as first from p where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
       case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
       case when first <> page_id then first end as refers_to
from p left join m using (payload_digest)
"""

_OP9 = f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, {_ASCII.format(f"trim(line, {_BLANKS})")} as key from l),
often as (select key, max(doc_id) as holder from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
kept as (select k.*, often.key is not null and k.doc_id <> often.holder as gone from k left join often on k.key = often.key)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from kept group by doc_id
"""

_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(licenses.TEMPLATES.items()))
_SPLIT = f"list_filter(regexp_split_to_array({_ASCII.format('{}')}, '[^0-9a-z]+'), lambda x: x <> '')"
_OP10 = f"""
with t as (select license, {_SPLIT.format("notice")} as w from (values {_VALUES}) as x(license, notice)),
ts as (select distinct license, array_to_string(w[k:k + 4], ' ') as s from (select license, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from t)),
tn as (select license, count(*) as n from ts group by license),
d as (select doc_id, {_SPLIT.format("coalesce(text, '')")} as w from documents),
ds as (select distinct doc_id, array_to_string(w[k:k + 4], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as k from d where len(w) >= 5)),
m as (select doc_id, license, count(*) / max(n) as c from ds join ts using (s) join tn using (license) group by doc_id, license having count(*) / max(n) >= 0.8)
select d.doc_id, count(license)::bigint as n_licenses, coalesce(string_agg(license, ',' order by license), '') as licenses, coalesce(max(c), 0)::double as containment
from d left join m using (doc_id) group by d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_embeddings": _OP3, "op5_decontam": _OP5, "op6_warc": _OP6, "op9_linededup": _OP9, "op10_licenses": _OP10}
