"""Operators on whole tables: line dedup, decontamination, embeddings, archives, mixing, the pipeline."""

import hashlib
import io
import random
import zipfile
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import decontam, embeddings, langid, linededup, mixing, queries, warc

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels".split()


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ran = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in ran.description]
    want = sorted(map(repr, ran.fetchall()))
    got = queries.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == want


LINE = "This line is long enough to be counted, number {}."


def brute_lines(rows, least=40, documents=5):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\r\x0b\x0c"))
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(-1 if doc is None else doc)
    often = {k: max(v) for k, v in holders.items() if len(v) >= documents}
    return ["\n".join(x for x in (t or "").split("\n") if often.get(key(x), -1 if d is None else d) == (-1 if d is None else d)) for d, t in rows]


def line_rows():
    random.seed(2)
    rows = [(i % 37, "\n".join(random.choice(("", " \t", "short", LINE.format(random.randrange(12)), "  " + LINE.format(random.randrange(12)).upper())) for _ in range(random.randrange(9)))) for i in range(60)]
    return [*rows, (None, LINE.format(1)), (None, "\n" + LINE.format(2)), (50, None), (51, ""), (52, LINE.format(1) + "\n" + LINE.format(1))]


def kept(df):
    return sorted(((str(r.doc_id), r.text, r.kept_sha256) for r in df.collect()))


def expected(rows):
    return sorted((str(d), t, hashlib.sha256(t.encode()).hexdigest()) for (d, _), t in zip(rows, brute_lines(rows), strict=True))


def test_lines_equal_brute_force(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_lines int")
    index = linededup.LineIndex.empty(spark).insert(docs)
    out = index.apply(docs)
    assert kept(out) == expected(rows)
    assert [r.n_lines for r in out.where("doc_id = 51").collect()] == [1]
    empty = docs.limit(0)
    assert linededup.LineIndex.empty(spark).insert(empty).apply(empty).count() == 0


def test_deleting_undoes_inserting(spark):
    rows = line_rows()
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    first, second = rows[:40], rows[40:]
    one = linededup.LineIndex.empty(spark).insert(frame(first))
    both = one.insert(frame(second))
    assert kept(both.apply(frame(rows))) == expected(rows)
    back = both.delete(frame(second))
    assert kept(back.apply(frame(first))) == expected(first)
    assert {tuple(r) for r in back.counts.collect()} == {tuple(r) for r in one.counts.collect()}
    held = {r.shard: r.used for r in back.filters.collect()}
    assert sum(held.values()) == back.counts.where("documents >= 5").count()


def test_cuckoo():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, (3000, 2)).astype(np.uint64)
    table = linededup.Cuckoo(None, 1024)
    assert table.insert(keys) and table.contains(keys).all()
    assert table.contains(rng.integers(0, 1 << 63, (20000, 2)).astype(np.uint64)).mean() < 0.001
    table.delete(keys[:1000])
    assert table.contains(keys[1000:]).all() and table.contains(keys[:1000]).mean() < 0.01
    assert not linededup.Cuckoo(None, 16).insert(keys)


def test_filters_grow_and_are_rebuilt(spark, monkeypatch):
    """Shards double with the keys, and a filter without a free seat is built anew from the counts."""
    monkeypatch.setattr(linededup, "SHARD_KEYS", 8)
    rows = [(d, "\n".join(LINE.format(f"{k}-{d // 10}") for k in range(40))) for d in range(60)]
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    index = linededup.LineIndex.empty(spark, shards=2).insert(frame(rows[:10]))
    assert index.shards >= 5
    first = index.shards
    for k in range(10, 60, 10):
        index = index.insert(frame(rows[k : k + 10]))
    assert index.shards > first
    monkeypatch.setattr(linededup, "SHARD_KEYS", 1 << 17)
    assert kept(index.apply(frame(rows))) == expected(rows)
    tiny = linededup.LineIndex.empty(spark, shards=1).insert(frame(rows[:10]))
    used = tiny.filters.first()
    crammed = spark.createDataFrame([(0, used.used, 1, bytearray(b"\1\0" * 4))], linededup.FILTERS)  # all seats taken
    tiny.filters = crammed
    grown = tiny.insert(frame(rows[10:20]))
    assert grown.filters.first().buckets > 1
    assert kept(grown.apply(frame(rows[:20]))) == expected(rows[:20])


def test_hot_shards_are_split(spark, monkeypatch):
    monkeypatch.setattr(linededup, "PART_LINES", 4)
    monkeypatch.setattr(linededup, "LINE_BYTES", 1 << 20)
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(linededup.LineIndex.empty(spark, shards=2).insert(docs).apply(docs)) == expected(rows)


def brute_matches(text, items, width=10):
    words = decontam.words_of(text)
    hit, found, longest = set(), set(), 0
    for name, item in items:
        own = decontam.words_of(item)
        size = min(width, len(own))
        for k in range(len(own) - size + 1 if size else 0):
            for p in range(len(words) - size + 1):
                if words[p : p + size] == own[k : k + size]:
                    hit |= set(range(p, p + size))
                    found.add(name)
                    n = size
                    while p + n < len(words) and k + n < len(own) and words[p + n] == own[k + n]:
                        n += 1
                    longest = max(longest, n)
    return len(words), len(hit), sorted(found), longest


@pytest.mark.parametrize("block,number", [(1 << 20, 64), (200, 64), (200, 2)])
def test_matches_equal_brute_force(spark, block, number, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam, "PASS_BLOCKS", number)
    monkeypatch.setattr(decontam, "COMPARED", 64)
    random.seed(4)
    vocabulary = ["a", "b", "c", "dd", "é", "E"]
    say = lambda n: " ".join(random.choices(vocabulary, k=n))
    items = [(str(i), say(random.choice((1, 3, 10, 12, 30)))) for i in range(14)] + [("3", say(11)), ("99", None), ("98", "..")]
    items = [i for i in items if not i[1] or len(i[1].split()) != 1] + [("7", "zz")]
    some = [t for _, t in items if t]
    texts = [None, "", "zz", say(5), *(say(random.randrange(60)) + " x " + random.choice(some) + " " + say(3) if random.random() < 0.7 else say(80) for _ in range(40))]
    docs = spark.createDataFrame([(i if i % 9 else None, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    out = decontam.matches(docs, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert [r.text for r in out] == texts
    for r in out:
        n, hit, found, longest = brute_matches(r.text, items)
        assert (r.n_words, r.n_hit, r["items"], r.n_items, r.longest.words if r.longest else 0) == (n, hit, found, len(found), longest)
        assert sum(s.stop - s.start for s in r.spans) == hit
        if r.longest:
            words, own = decontam.words_of(r.text), [decontam.words_of(t) for name, t in items if name == r.longest["item"]]
            part = words[r.longest.doc_word : r.longest.doc_word + longest]
            assert any(o[r.longest.item_word : r.longest.item_word + longest] == part for o in own)


def test_no_items_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontam.matches(docs, items).collect()] == [0]
    assert decontam.matches(docs.limit(0), items).count() == 0
    unnamed = spark.createDataFrame([(None, "a b")], "item_id long, text string")
    assert [(r.n_hit, r.n_items, r["items"]) for r in decontam.matches(docs, unnamed).collect()] == [(2, 1, [])]


def brute_links(rows, threshold=0.93):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    near = defaultdict(set)
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows):
            if i != j and a is not None and a == b and ok(v) and ok(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    near[i].add(j)
    out = []
    for i, (own, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((own, len(near[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [128, 4])
def test_embeddings_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(size=16) * 0.08 * (i % 5)).astype(np.float32).tolist(), i % 2) for i in range(120)]
    rows += [(200 + i, rows[3][1], rows[3][2]) for i in range(5)] + [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, rows[0][1], None), (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (307, [], 1), (3, rows[3][1], rows[3][2]), (None, rows[5][1], rows[5][2]), (308, [1.0], 0), (309, [3.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, component_id string")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=str)
    assert got == brute_links(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim,joined", [(64, 2), (64, 3), (384, 2), (768, 2)])
def test_recall_at_the_threshold(dim, joined):
    rng = np.random.default_rng(1)
    x, z = rng.normal(size=(2, 1000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    a, b = embeddings.codes(x, joined), embeddings.codes(y, joined)
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]) > 0.995
    assert embeddings.rotations(1000, 64) == 2 and embeddings.rotations(10**8, 64) == 3


@pytest.mark.parametrize("block", [128, 8])
def test_groups_of_near_copies(spark, block, monkeypatch):
    """Tight groups, loose ones whose members must be compared, and vectors at their rims."""
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(5, 64))
    rows = [(i, (centres[i % 5] + rng.normal(size=64) * (0.05, 0.1, 0.16, 0.2, 0.27)[i % 5]).tolist(), 0) for i in range(250)]
    rows += [(300 + i, (centres[0] + rng.normal(size=64) * 0.35).tolist(), 0) for i in range(40)] + [(400 + i, rows[5 * i][1], 0) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, want = ({r[0]: r[1:] for r in x} for x in (map(tuple, embeddings.near_duplicates(df).collect()), brute_links(rows)))
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}
    lost = sum(want[i][0] - got[i][0] for i in want)
    assert all(got[i][0] <= want[i][0] for i in want) and lost <= 0.002 * sum(n for n, _ in want.values())
    reps = embeddings.stored(df.select(F.col("vec_id").alias("rep"), "label", F.col("embedding").alias("vec"), F.lit(1).cast("long").alias("weight")), "reps")
    coded = embeddings.stored(reps.select("rep", "label", "vec").mapInArrow(embeddings._coder(300), "rep long, label int, dim int, codes array<long>"), "codes")
    _, groups = embeddings._groups(reps, coded, 0.93)
    assert groups.count() >= 2 and groups.where("radius > 0.37").isEmpty()


def test_archives(spark, tmp_path):
    big = "ü" * 700
    rows = [(1, "http://a/x y\n", big), (2, None, big), (3, "http://b", None), (None, "u", big), (5, "v", "small"), (6, "w", "small"), (2, "z", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/archives")
    got = warc.read_records(manifest).collect()
    found = sorted(((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(str(i), "revisit" if h == big and i != 2 else "response", 2 if h == big and i != 2 else None, len((h or "").encode()), sha(h)) for i, _, h in rows]
    assert found == sorted(want, key=str)
    assert {r.payload.decode() for r in got if r.page_id == 5} == {"small"} and all(r.payload is None for r in got if r.record_type == "revisit")
    archive = manifest.first().archive.removeprefix("file://")
    with zipfile.ZipFile(archive) as z:  # other readers can open it
        assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX]
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


def test_foreign_and_broken_archives():
    def opened(data):
        file = io.BytesIO(data)
        file.size = lambda: len(data)
        return file

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a/b", b"x" * 10)
        z.writestr("c", b"y" * 3, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"[6:]
    raw = out.getvalue()
    found = warc.directory(opened(raw))
    at, size = warc.stored_member(found, "a/b")
    assert raw[at : at + size] == b"x" * 10
    for name in ("c", "d"):
        with pytest.raises(ValueError):
            warc.stored_member(found, name)
    for broken in (b"", b"nothing here", raw[:-30] + raw[-22:]):
        with pytest.raises(ValueError):
            warc.directory(opened(broken))
    good = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None)
    for bad in (good[:-6], good.replace(b"abc", b"abd"), b"junk"):
        with pytest.raises(ValueError):
            warc.parse(bad)


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
        rest -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mix(spark):
    random.seed(6)
    rows = [(random.choice((None, i)), random.choice(("b", "a", "é", None, "zz", "a")) if i < 380 else "tiny", random.choice((None, "", "x y", "w " * random.randrange(60)))) for i in range(400)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, source string, text string, size int")
    out = mixing.assign(docs).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.assign(docs.repartition(7)).collect()))
    assert all(r.size == len((r.text or "").split()) for r in out)
    sizes = defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
    goal = brute_targets(sizes)
    for source in sizes:
        own = [r for r in out if r.source == source]
        assert {r.source_size for r in own} == {sizes[source]}
        assert own[0].target == pytest.approx(goal[source])
        assert abs(sum(r.taken for r in own) - goal[source]) <= max(r.size for r in own)
    total = sum(goal.values())
    assert all(r.taken <= 3 * r.size and r.taken == r.size * len(r.positions) and all(0 <= p <= total * (1 + 1e-9) for p in r.positions) for r in out)
    empty = docs.limit(0)
    assert mixing.assign(empty).count() == 0
    assert [r.taken for r in mixing.assign(spark.createDataFrame([(1, "a", None)], "doc_id long, source string, text string")).collect()] == [0]


def test_op8_returns_the_training_order(spark):
    out = queries.op8_mixing(spark, SF).collect()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.taken == r.size * len(r.positions) and list(r.positions) == sorted(r.positions) for r in out)
    keys = [(not r.positions, r.positions[0] if r.positions else 0, r.doc_id) for r in out]
    assert keys == sorted(keys) and {len(r.positions) for r in out} > {0}


def test_op8_plan_keeps_its_method(spark):
    """The inversion of the demand (a square root) and the range sort are in the plan that runs."""
    plan = queries.op8_mixing(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "SQRT" in plan.upper()
    physical = queries.op8_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(" in physical


def test_positions_equal_a_brute_force_integration(spark):
    """Each source's readings in their order; its demand is integrated in small steps and inverted, and all demands up to then are added."""
    out = queries.op8_mixing(spark, SF).collect()
    sizes = defaultdict(int)
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in out:
        sizes[docs[r.doc_id]] += r.size
    goal = brute_targets(sizes)
    kinds = {s: i % 3 for i, s in enumerate(sorted((s for s in goal if s is not None), key=lambda s: s.encode()))}
    if None in goal:
        kinds[None] = len(kinds) % 3
    knots = np.linspace(0, 1, 20_001)
    integral = []
    for k in range(3):
        factors = np.interp(knots, [t for t, _ in mixing.SCHEDULE], [f[k] for _, f in mixing.SCHEDULE])
        area = np.concatenate([[0], np.cumsum((factors[1:] + factors[:-1]) / 2)])
        integral.append(area / area[-1])
    demand = sum(goal[s] * integral[kinds[s]] for s in goal)
    want = []
    for s in goal:
        readings = sorted((p, r.size) for r in out if docs[r.doc_id] == s for p in r.positions)
        before = np.cumsum([0, *[n for _, n in readings]])[:-1]
        for (p, n), at in zip(readings, before, strict=True):
            want.append((p, np.interp(np.interp((at + n / 2) / goal[s], integral[kinds[s]], knots), knots, demand)))
    assert np.allclose([p for p, _ in want], [w for _, w in want], rtol=1e-5, atol=1.0)
    assert max(p for p, _ in want) <= sum(sizes.values()) * (1 + 1e-9)


def test_rows_of_one_id_are_dealt_apart(spark):
    """Null ids, a third of all rows or more, fall into many buckets and are mixed all the same."""
    docs = spark.createDataFrame([(None, "a", f"w{i} " * (1 + i % 5)) for i in range(600)] + [(i, "b", "x y") for i in range(300)], "doc_id long, source string, text string")
    out = mixing.assign(docs).collect()
    assert abs(sum(r.taken for r in out if r.source == "a") - next(r.target for r in out if r.source == "a")) <= 5
    assert len({r.positions[0] for r in out if r.doc_id is None and r.positions}) > 500


def test_training_time_inverts_the_schedule(spark):
    knots = np.linspace(0, 1, 2001)
    for kind in range(3):
        factors = np.interp(knots, [t for t, _ in mixing.SCHEDULE], [f[kind] for _, f in mixing.SCHEDULE])
        demand = np.concatenate([[0], np.cumsum((factors[1:] + factors[:-1]) / 2)])
        demand /= demand[-1]
        shares = [0.0, 0.1, 0.35, 0.5, 0.77, 0.999]
        got = spark.createDataFrame([(x,) for x in shares], "x double").select(mixing.training_time(F.col("x"), F.lit(kind)).alias("t")).collect()
        assert [r.t for r in got] == pytest.approx(np.interp(shares, demand, knots), abs=1e-3)


def test_stages_on_odd_rows(spark):
    base = "The quick brown fox jumps over the lazy dog near the river bank while many people watch it from afar today"
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, base, "en"), (1, base, "en"), (2, base, "en"), (3, item + " and more", "en"), (4, "", None), (5, None, "en"), (None, base + " x y z", None), (None, "Ganz andere Worte stehen hier in diesem Satz", "de"), (9, "123 456", "en")]
    docs = spark.createDataFrame([(d, t, lang, "s", None, "q") for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string")
    near = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in near if r.text == base) == ["1"] and len([r for r in near if r.text in (None, "")]) == 1
    assert any(r.text and r.text.startswith("Ganz") for r in near)
    clean = corpus_pipeline.decontamination(spark, docs, SF)
    assert 3 not in {r.doc_id for r in clean.collect()} and clean.count() == 8 and clean.columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, docs, SF)
        out.collect()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
    lines = corpus_pipeline.line_dedup(spark, docs, SF).collect()
    assert all(r.n_chars == len(r.text) for r in lines)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    assert [r.position for r in out] == sorted(r.position for r in out)
    assert {r.doc_id for r in out} <= {r.doc_id for r in docs.collect()} and len({r.doc_id for r in out}) > 100


def plain_pipeline(rows, items, model):
    """The five stages in plain Python over rows (doc_id, text, source): what is left, and how often each is read."""
    rejected = [r for _, _, r in model.predict([t for _, t, _ in rows])]
    rows = [r for r, gone in zip(rows, rejected, strict=True) if not gone]
    rows = [(d, t, s) for (d, _, s), t in zip(rows, brute_lines([(d, t) for d, t, _ in rows]), strict=True)]
    parts = []
    for _, text, _ in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
        parts.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)})
    root = list(range(len(rows)))
    for i, a in enumerate(parts):
        for j in range(i):
            if root[i] != root[j] and (min(len(a), len(parts[j])) >= 0.8 * max(len(a), len(parts[j]))) and len(a & parts[j]) >= 0.8 * len(a | parts[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    groups = defaultdict(list)
    for i, r in enumerate(root):
        groups[r].append(rows[i])
    rows = [min(group, key=lambda r: r[0]) for group in groups.values()]
    windows = defaultdict(set)
    for text in items:
        own = decontam.words_of(text)
        size = min(10, len(own))
        windows[size] |= {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if size else set()
    clean = []
    for r in rows:
        words = decontam.words_of(r[1])
        if not any(tuple(words[k : k + size]) in found for size, found in windows.items() for k in range(len(words) - size + 1)):
            clean.append(r)
    sizes = defaultdict(int)
    for _, text, source in clean:
        sizes[source] += len(text.encode().split())
    return clean, sizes, brute_targets(sizes)


def test_pipeline_equals_plain_stages(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    item = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text and len(r.text.split()) >= 12]
    line = "This very line stands in many of the documents of this test, unchanged."
    rows = [r.asDict() for r in base if len(r.text or "") < 6000]
    next_id = 1 + max(r["doc_id"] for r in rows)
    long = [r for r in rows if len((r["text"] or "").split()) > 120]
    for k, r in enumerate(long[:40]):
        words = r["text"].split(" ")
        if k % 4 == 1:
            words[50] = "changed"
        elif k % 4 == 2:
            words = words[: len(words) // 2]
        elif k % 4 == 3:
            words[30:30] = item[k % len(item)].split()
        rows.append(r | {"doc_id": next_id + k, "text": " ".join(words) + (f"\n{line}" if k % 3 else "")})
    noise = np.random.default_rng(2)
    for k in range(6):
        rows.append(long[k] | {"doc_id": next_id + 100 + k, "text": "".join(noise.choice(list("bcdfghjklmnpqrstvwxz   "), 700)), "lang": None})
    folder = tmp_path / "tables"
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(folder)).collect()
    model = langid.fit(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang"))
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text]
    clean, sizes, goal = plain_pipeline([(r["doc_id"], r["text"], r["source"]) for r in rows], items, model)
    texts = {d: t for d, t, _ in clean}
    assert len(rows) - len(clean) > 30
    read = defaultdict(int)
    for r in out:
        assert texts[r.doc_id] == r.text and r.size == len(r.text.split()) and r.n_chars == len(r.text)
        read[r.doc_id] += 1
    for source, target in goal.items():
        own = [(d, t) for d, t, s in clean if s == source]
        largest = max((len(t.split()) for _, t in own), default=0)
        assert abs(sum(read[d] * len(t.split()) for d, t in own) - target) <= largest
        times = {read[d] for d, t in own if t.split()}
        assert max(times) - min(times) <= 1 and max(times) <= 3  # whole rounds, and one more for some
    assert [(r.position, r.doc_id) for r in out] == sorted((r.position, r.doc_id) for r in out)


def test_clashing_names(spark):
    """Extra columns named as the operators' own helpers pass unchanged."""
    names = "kind key n fp mark root component_id _id _mark _row _hash _size _bucket _source _b _base _middle _part _of first label least again rows chosen level most".split()
    docs = spark.createDataFrame([(i, f"word{i % 3} alpha beta gamma delta epsilon zeta", "en", f"s{i % 2}", 9) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(n).alias(n) for n in names])
    mixed = mixing.assign(docs).collect()
    assert len(mixed) == 9 and {r.size for r in mixed} == {7} and all(r[n] == n for r in mixed for n in names)
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 1, 2] and all(r[n] == n for r in kept for n in names)
