"""Operators on single texts: PII, languages, toxicity, licenses."""

import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import langid, licenses, pii, queries, toxicity

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SF = "/root/testdata/sf0.001"


def brute(text):
    digits = lambda s: [int(c) for c in s if c.isdigit()]

    def luhn(s):
        d = digits(s)[::-1]
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if luhn(m[0])]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


ODD = [
    "a@b.c@d.e", "a@@b.c", "x.y+z%@w-w.co.uk.", "é@b.c a@b..c a@b.c.", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.255", "4111 1111-1111 1111", "4111111111111111 5", "1 2 3", "+1 (2) 3", "+1 (743) 555-3824...",
    "+12345678901234567", "++49 30 123456", "@a.b", "a@b", "1.2.3", "4" * 40, "+1" + "(" * 50, "a" * 500 + "@", "1234-5678 9012-3452", "",
]


def test_plain_spans_equal_the_patterns():
    for text in [*ODD, " ".join(ODD), "\n".join(ODD * 3)]:
        assert pii.plain_spans(text) == brute(text)


DISGUISED = [
    ("write jane [dot] doe (at) example (dot) com now", "email", "jane [dot] doe (at) example (dot) com"),
    ("mail john.doe AT example DOT com please", "email", "john.doe AT example DOT com"),
    ("call plus one five five five one two three four five six seven today", "phone", "plus one five five five one two three four five six seven"),
    ("ip one nine two dot one six eight dot zero dot one ok", "ip", "one nine two dot one six eight dot zero dot one"),
    ("at 192[.]168[.]0[.]1 now", "ip", "192[.]168[.]0[.]1"),
    ("pay 4111 1111 1111 one one one one", "card", "4111 1111 1111 one one one one"),
    ("сall ｊａｎｅ@еxample.com", "email", "ｊａｎｅ@еxample.com"),
    ("hide a​lice@exam​ple.com", "email", "a​lice@exam​ple.com"),
    ("ring +1 (555) O12-3456 ok", "phone", "+1 (555) O12-3456"),
    ("+49 ３０ １２３４５６", "phone", "+49 ３０ １２３４５６"),
    ("joe @ example.com", "email", "joe @ example.com"),
    ("ask john_smith at example dot com soon", "email", "john_smith at example dot com"),
    ("ask john at my-host dot com soon", "email", "john at my-host dot com"),
    ("ask a.b at mail dot my-host dot com soon", "email", "a.b at mail dot my-host dot com"),
    ("ask john_smith_at_my-host_dot_com soon", "email", "john_smith_at_my-host_dot_com"),
    ("ask john-smith-at-example-dot-com soon", "email", "john-smith-at-example-dot-com"),
]


@pytest.mark.parametrize("text,kind,part", DISGUISED)
def test_disguises_map_back(text, kind, part):
    base, added = pii.detector()(text)
    assert base == []
    assert [(k, text[a:b]) for k, a, b in added] == [(kind, part)]


SPELLED = dict(zip("0123456789", "zero one two three four five six seven eight nine".split(), strict=True)) | {"+": "plus", ".": "dot"}
DISGUISES = {
    "brackets": lambda s: s.replace("@", " [at] ").replace(".", " [dot] "),
    "words": lambda s: s.replace("@", " at ").replace(".", " dot "),
    "capitals": lambda s: s.replace("@", " AT ").replace(".", " DOT "),
    "spelled": lambda s: " ".join(SPELLED.get(c, c) for c in s if c != " "),
    "look-alikes": lambda s: s.translate(str.maketrans("aeopc", "аеорс")),
    "full width": lambda s: "".join(chr(ord(c) + 0xFEE0) if c.isalnum() else c for c in s),
    "invisible": lambda s: s[:2] + "\u200b" + s[2:5] + "\u200d" + s[5:],
    "letters": lambda s: s.replace("0", "O").replace("1", "l"),
}
USED = {"email": "brackets words capitals look-alikes invisible", "ip": "brackets words spelled letters", "card": "spelled invisible letters", "phone": "spelled invisible"}


@pytest.mark.parametrize("kind,way", [(k, w) for k, ways in USED.items() for w in re.findall("look-alikes|full width|[a-z]+", ways)] + [(k, "full width") for k in USED])
def test_recall_by_disguise(kind, way):
    """Made-up identifiers, found with exactly their span."""
    rng = np.random.default_rng(3)
    word, digits = lambda: str(rng.choice("alpha river stone quiet maple".split())), lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def made():
        if kind == "email":
            return f"{word()}{rng.choice(['.', '_', '-'])}{word()}@{word()}.{rng.choice(['com', 'org', 'co.uk'])}"
        if kind == "ip":
            return ".".join(map(str, rng.integers(0, 256, 4)))
        if kind == "phone":
            return f"+{rng.integers(1, 99)} {digits(3)} {digits(3)} {digits(4)}"
        start = digits(15)
        whole = start + next(str(c) for c in range(10) if pii.luhn(start + str(c)))
        return " ".join(whole[i : i + 4] for i in range(0, 16, 4))

    hit = n = 0
    while n < 100:
        shown = DISGUISES[way](plain := made())
        if shown == plain:
            continue
        n += 1
        text = f"please note {shown} for later, thanks"
        hit += any(k == kind and text[a:b] == shown for part in pii.detector()(text) for k, a, b in part)
    assert hit >= (80 if (kind, way) == ("ip", "letters") else 98), hit


def test_plain_spans_stay_and_clean_texts_have_none():
    text = "bob@x.org, +1 555 123 4567 and eve (at) y (dot) net"
    base, added = pii.detector()(text)
    assert base == brute(text) and [k for k, _, _ in added] == ["email"]
    for clean in ("look at the dot com boom of nineteen", "one two three", "é à ü at noon. six sept", "version 1.2 (at) home"):
        assert pii.detector()(clean) == ([], [])


def test_pii_rows(spark):
    rows = [(1, None, "x"), (None, "", "y"), (3, "a@b.cd x (at) y (dot) zz", None), (3, "a@b.cd x (at) y (dot) zz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    out = pii.find(docs).collect()
    assert [len(r.found) for r in out] == [0, 0, 2, 2] and out[0].text is None
    assert [r.text for r in pii.mask(docs).collect()][2] == "[email] [email]"
    assert pii.find(docs.limit(0)).count() == 0


def test_op2_digests(spark):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op2_pii(spark, SF).collect():
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(docs[r.doc_id] or ""))
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len([s for s in r.spans.split(",") if s])


def test_gram_counts_of_long_texts(monkeypatch):
    text = "Ab é c1d " * 400
    whole = langid.gram_counts([text, "x", None, text])
    monkeypatch.setattr(langid, "SLICE_BYTES", 100)
    assert (langid.gram_counts([text, "x", None, text]) == whole).all()
    plain = f" {' '.join(text.lower().replace('1', ' ').split())} ".encode()
    assert whole[0].sum() == sum(len(plain) - n + 1 for n in langid.GRAMS)


def test_languages_are_told_in_little_memory():
    """A worker's arrays for a batch and for a long text; two workers share an executor with the JVM."""
    model = langid.Model(["a"], np.zeros(4, np.int64), np.ones((4, langid.DIMS), np.float32), np.ones(langid.DIMS, np.float32), np.zeros((1, len(langid.KNOTS))))
    for texts in (["some words of a text " * 100] * langid.ROWS, ["ab " * 700_000]):
        tracemalloc.start()
        list(model.predict(texts))
        assert tracemalloc.get_traced_memory()[1] < 30e6
        tracemalloc.stop()


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op4_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 150 and np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "12 34 !?", "q"), (None, "Der die und das Haus", None), (5, "ж" * 400, "")], "doc_id long, text string, lang_pred string")
    got = langid.predict(odd, model).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and [r.rejected for r in got] == [True, True, True, False, True]
    assert langid.predict(docs, model).where("rejected").count() <= 2


def test_languages_equal_a_plain_reading(spark):
    """Predictions, scores, rejections and document frequencies against n-grams counted one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", F.substring("text", 1, 400).alias("text"), "lang").orderBy("doc_id").collect()
    rows += [rows[3], rows[5]]
    frame = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string")
    model = langid.fit(frame)

    def grams(text):
        plain = b" " + b" ".join(bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in (text or "").lower().encode()).split()) + b" "
        out = {}
        for n in (1, 2, 3):
            for i in range(len(plain) - n + 1):
                value = int.from_bytes(plain[i : i + n], "big")
                place = ((value + n) * 2654435761 % (1 << 32)) >> 20
                out[place] = out.get(place, 0) + 1
        return out

    taught = [r for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    assert model.languages == sorted({r.lang for r in taught})
    seen = {}
    for r in taught:
        for place in grams(r.text):
            seen[place] = seen.get(place, 0) + 1
    idf = [np.log((len(taught) + 1) / (seen.get(place, 0) + 1)) + 1 for place in range(4096)]
    assert np.allclose(model.idf, idf)
    for r in langid.predict(frame.limit(60), model).collect():
        own = grams(r.text)
        size = np.sqrt(sum((np.log1p(n) * idf[p]) ** 2 for p, n in own.items()))
        cosines = [(sum(np.log1p(n) * idf[p] * float(c[p]) for p, n in own.items()) / size, model.languages[o]) for c, o in zip(model.centroids, model.owner, strict=True)]
        best = {lang: max(c for c, x in cosines if x == lang) for lang in model.languages}
        top = max(best.values())
        if not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.lang_score, r.rejected) == ("und", 0.0, True)
            continue
        if sorted(best.values())[-2] < top - 1e-5:
            assert r.lang_pred == max(best, key=best.get)
        assert abs(r.lang_score - 1 / sum(np.exp(25 * (c - top)) for c in best.values())) < 1e-3
        floor = np.interp(np.log2(max(1, sum(own.values()) / 3)), langid.KNOTS, model.floors[model.languages.index(r.lang_pred)])
        assert abs(top - floor) < 1e-5 or r.rejected == (top < floor)


FINNISH = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
TURKISH = "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler."


def test_far_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.fit(docs)
    rng = np.random.default_rng(3)
    drawn = lambda letters: "".join(rng.choice(list(letters), 600))
    code = 'for (int i = 0; i < n; i++) { x[i] = malloc(sizeof(struct foo_bar)); if (!x[i]) goto err; printk(KERN_ERR "%d", ret); }\n' * 5
    far = [drawn("abcdefghijklmnopqrstuvwxyz     "), drawn("bcdfghjklmnpqrstvwxz   "), drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), code, FINNISH * 2, TURKISH * 2]
    assert [r for _, _, r in model.predict(far)] == [True] * len(far)
    clean = ["Der die und das Haus", "And the", "El agua de la casa", "La maison et le chat"]
    assert [r for _, _, r in model.predict(clean)] == [False] * len(clean)
    rejected = langid.predict(docs.select("doc_id", "text"), model).where("rejected and text rlike '[a-z]'").count()
    assert rejected <= 0.003 * docs.count(), rejected


def test_languages_without_teachers(spark):
    nothing = spark.createDataFrame([(1, "abc", None), (2, None, "en"), (None, "abc", "en")], "doc_id long, text string, lang string")
    model = langid.fit(nothing)
    assert {r.lang_pred for r in langid.predict(nothing, model).collect()} == {"und"}
    assert langid.predict(nothing.limit(0), langid.fit(nothing.limit(0))).count() == 0


def slow_segments(scores):
    """All maximal-scoring segments by definition: the best one, then the same on either side of it."""
    best = max(((sum(scores[a:b]), a - b, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    total, _, a, b = best
    # the shortest among equals: a maximal segment has no part of sum 0 at its ends
    return slow_segments(scores[:a]) + [(a, b, total)] + [(x + b, y + b, s) for x, y, s in slow_segments(scores[b:])]


def test_segments():
    rng = np.random.default_rng(1)
    for _ in range(300):
        scores = np.round(rng.normal(-0.3, 1, rng.integers(0, 18)), 3)
        got, want = toxicity.segments(scores), slow_segments(scores.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    out = queries.op7_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in out)
    assert hit / sum(r.toxic for r in out) > 0.85 and hit / sum(r.predicted for r in out) > 0.85
    assert all(0 <= r.score <= 1 for r in out)


def test_toxicity_passages_and_odd_rows(spark):
    bad = "you vile creep"
    rows = [(i, f"some quiet words number {i} about rivers and hills" + (f" then {bad} again" if i % 3 == 0 else "")) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(None, f"the river. {bad}! hills", "p"), (2, None, None), (2, "", None), (4, "quiet hills", None)], "doc_id long, text string, passages string")
    got = toxicity.score(odd, model).collect()
    assert got[0].toxicity > 0.5 and [(p.start, p.stop) for p in got[0].passages] == [(2, 5)]
    assert all(r.toxicity < 0.3 and not r.passages for r in got[1:])
    for none in (labels.limit(0), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert {round(r.toxicity, 6) for r in toxicity.score(odd, toxicity.fit(docs, none)).collect()} == {0.0}
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_licenses(spark):
    rows = [
        (1, "é tz.\nLicensed under the APACHE license -- version 2.0\nmore", "x"), (2, None, ""), (None, "", ""), (4, "released under the mit license", None),
        (5, " ".join(licenses.TEMPLATES["MIT"].split()[:26]) + " the of to", None), (6, "licensed under the moon of the license", None), (4, "released under the mit license", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    got = sorted((str(r.doc_id), tuple(x.license for x in r.licenses)) for r in licenses.scan(docs).collect())
    assert got == sorted([("1", ("Apache-2.0",)), ("2", ()), ("None", ()), ("4", ("MIT-short",)), ("4", ("MIT-short",)), ("5", ("MIT",)), ("6", ())])
    assert licenses.scan(docs.limit(0)).count() == 0


def contained(text, template):
    split = lambda t: [w for w in re.split("[^0-9a-z]+", "".join(c.lower() if c.isascii() else c for c in t)) if w]
    parts = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = parts(split(template))
    return len(want & parts(split(text))) / len(want)


def test_licenses_equal_exact_containment(spark):
    """Whole texts and notices, broken by strange words, cut, reordered and between other words: nothing of 0.8 or more is missed."""
    rng = np.random.default_rng(5)
    noise = lambda n: " ".join(f"zq{rng.integers(10**6)}" for _ in range(n))
    rows = []
    for name in sorted(licenses.TEMPLATES):
        for kind in range(6):
            words = licenses.TEMPLATES[name].split()
            n = len(words)
            if kind == 1:  # strange words in between, about as many as 0.8 bears
                for at in sorted(rng.choice(n, max(1, n // 24), replace=False).tolist(), reverse=True):
                    words.insert(at, noise(1))
            elif kind == 2:  # changed words
                for at in rng.choice(n, max(1, n // 30), replace=False).tolist():
                    words[at] = noise(1)
            elif kind == 3:  # cut at the end
                words = words[: max(5, int(n * rng.uniform(0.7, 1)))]
            elif kind == 4:  # parts in another order
                cuts = sorted(rng.choice(n, max(1, n // 40), replace=False).tolist())
                parts = [words[a:b] for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
                words = [w for k in rng.permutation(len(parts)) for w in parts[k]]
            elif kind == 5:  # of two lengths of lines, as comments
                words = [w for k, w in enumerate(words) for w in ([w] if k % 9 else ["\n# ", w])]
            rows.append((len(rows), f"{noise(20)} {' '.join(words)} {noise(7)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: {x.license: x.containment for x in r.licenses} for r in licenses.scan(docs).collect()}
    want = {d: {n: c for n, t in licenses.TEMPLATES.items() if (c := contained(text, t)) >= 0.8} for d, text in rows}
    total = sum(len(x) for x in want.values())
    lost = {d: set(want[d]) - set(got[d]) for d in want if set(want[d]) - set(got[d])}
    assert total > 150 and sum(map(len, lost.values())) <= 0.005 * total, lost
    assert all(got[d][n] == pytest.approx(want[d][n]) for d in got for n in got[d])


def test_bands_promise_retrieval():
    assert licenses.bands(0.8) > 0.999 and licenses.bands(1 / 3) > 0.999
    with pytest.raises(ValueError):
        licenses.bands(0.05)
