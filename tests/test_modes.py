"""Alignment modes, normalisers, replies and senses against plain Python."""

import json
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.functions import text
from glossweave.functions.scores import P
from glossweave.operators import adapters, align, modes, sense


def units(spark, lists):
    return spark.createDataFrame([(w, i, t) for w, x in lists.items() for i, t in enumerate(x)], "work string, unit_index int, unit_text string")


def editions(r, n_works=3):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "tau", "the", "of"]
    a, b = {}, {}
    for k in range(n_works):
        lines = [" ".join(r.choice(words) + str(r.randrange(30)) for _ in range(r.randint(3, 7))) for _ in range(r.randint(20, 60))]
        a[f"w{k}"] = lines
        b[f"w{k}"] = [x if r.random() < 0.6 else " ".join(w for w in x.split() if r.random() < 0.8) or "none" for x in lines if r.random() < 0.9]
    return a, b


def grams(t):
    p = f"  {t.lower()}  "
    return {p[i : i + 3] for i in range(len(p) - 2)}


def plain_matches(a, b, score, back=None):
    """Mutual best in the band with margins, and a longest rising chain's length."""
    n, m = len(a), len(b)
    size = max(P.min_band, round(P.band_ratio * max(n, m)))

    def best(k, n_from, n_to, f):
        c = round(k / n_from * n_to)
        s = sorted(((-f(k, x), x) for x in range(max(0, c - size), min(n_to, c + size + 1))))
        return s[0][1] if s and (len(s) == 1 or s[1][0] - s[0][0] >= P.margin) else None

    ab = [best(i, n, m, score) for i in range(n)]
    ba = [best(j, m, n, lambda j, i: (back or score)(i, j)) for j in range(m)]
    return [(i, j) for i, j in enumerate(ab) if j is not None and ba[j] == i]


def longest(js):
    best = []
    for k, j in enumerate(js):
        best.append(1 + max((best[x] for x in range(k) if js[x] < j), default=0))
    return max(best, default=0)


@pytest.mark.parametrize("chunk", [512, 7])
def test_lexical_anchors_against_plain_python(spark, monkeypatch, chunk):
    monkeypatch.setattr(align, "CHUNK", chunk)
    a, b = editions(random.Random(3))
    b["only"] = ["x"]
    ua, ub = units(spark, a), units(spark, b)
    got = {}
    for r in align.mutual_best(align.lexical_top(ua, ub, "work"), "work").collect():
        got.setdefault(r["work"], set()).add((r["i"], r["j"]))
    chain = {}
    for r in modes.anchors("algorithmic", ua, ub, "work").orderBy("i").collect():
        chain.setdefault(r["work"], []).append((r["i"], r["j"], r["score"]))
    for w in a:
        ga, gb = [grams(t) for t in a[w]], [grams(t) for t in b[w]]
        dice = lambda i, j: 2 * len(ga[i] & gb[j]) / (len(ga[i]) + len(gb[j]))  # noqa: B023, E731
        want = plain_matches(a[w], b[w], dice)
        assert got.get(w, set()) == set(want)
        own = chain[w]
        assert [j for _, j, _ in own] == sorted({j for _, j, _ in own}) and len(own) == longest([j for _, j in want]) and {(i, j) for i, j, _ in own} <= set(want)
        assert all(s == pytest.approx(dice(i, j)) for i, j, s in own)


def test_judged_anchors_use_both_directions(spark):
    ua, ub = units(spark, {"w": ["a"] * 6}), units(spark, {"w": ["b"] * 6})
    r = random.Random(4)
    s = {(i, j): (round(r.random(), 2), round(r.random(), 2)) for i in range(6) for j in range(6) if r.random() < 0.9}
    told = spark.createDataFrame([("w", i, j, x, y) for (i, j), (x, y) in s.items()], "work string, i int, j int, score_ab double, score_ba double")
    got = {(x["i"], x["j"]) for x in modes.anchors("llm_judge", ua, ub, "work", told).collect()}
    want = plain_matches(["a"] * 6, ["b"] * 6, lambda i, j: s.get((i, j), (0, 0))[0], lambda i, j: s.get((i, j), (0, 0))[1])
    assert got <= set(want) and len(got) == longest([j for _, j in want])
    with pytest.raises(ValueError, match="unknown mode"):
        modes.anchors("other", ua, ub, "work")


def test_hybrid_pairs(spark):
    """Anchors by vectors, a gap filled by a reply, a repeated and an invented pair, links, a review, numbers."""
    a = ["One  two three", "Second line here", "a gap of ﬁrst", "more gap", "The end"]
    b = ["one, two, three", "the second line", "gap one", "gap two", "gap three", "the end"]
    e = np.eye(6)
    va = [e[0], e[1], (e[2] + e[3]) / 2, (e[2] + e[3]) / 2, e[4]]
    vb = [e[0], e[1], (e[2] + e[3]) / 2, (e[2] + e[3]) / 2, (e[2] + e[3]) / 2, e[4]]
    frame = lambda x, v: spark.createDataFrame([("w", i, t, w.tolist()) for i, (t, w) in enumerate(zip(x, v, strict=True))], "work string, unit_index int, unit_text string, vector array<double>")
    ua, ub = frame(a, va), frame(b, vb)
    found = modes.anchors("hybrid", ua, ub, "work")
    assert sorted((r["i"], r["j"]) for r in found.collect()) == [(0, 0), (1, 1), (4, 5)]
    asked = modes.requests("hybrid", ua, ub, "work", found).collect()
    assert [(r["block"], r["i_from"], r["i_to"], r["j_from"], r["j_to"]) for r in asked] == [(0, 2, 4, 2, 5)]
    assert asked[0]["prompt"] == "SOURCE:\n0. a gap of ﬁrst\n1. more gap\n\nTARGET:\n0. gap one\n1. gap two\n2. gap three"
    block = json.dumps([{"source_text": " a gap of ﬁrst ", "target_text": "gap one", "sentence_confidence": "0.7", "citation": "c1"}, {"source_text": "a gap of first", "target_text": "GAP ONE"}, {"source_text": "invented", "target_text": "gap two"}, {"source_text": "more gap The END", "target_text": "gap two gap three", "sentence_confidence": "true"}])
    link = json.dumps({"source_span": "two", "target_span": "TWO", "source_lemma": "two", "source_upos": "num", "source_upos_confidence": 2, "target_upos": "bad", "target_ner": "per", "sense_gloss": " the number "})
    replies = {
        "blocks": spark.createDataFrame([("w", 0, f"Here it is:\n```json\n{block}\n```")], "work string, block int, reply string"),
        "links": spark.createDataFrame([("w", 0, 0, f"[{link}, " + '{"source_span": "nowhere", "target_span": "two"}]'), ("w", 1, 1, "no reply")], "work string, i int, j int, reply string"),
        "reviews": spark.createDataFrame([("w", (4, 1, 0), '{"source_text": "The end", "target_text": "end", "citation": "c9"}'), ("w", (1, 1, 0), '{"source_text": "", "target_text": "x"}')], "work string, seq struct<i:int,kind:int,k:int>, reply string"),
    }
    got = modes.align_pairs("hybrid", ua, ub, "work", replies, review=True, models=("m", "e")).orderBy("pair_no").collect()
    assert [(r["pair_no"], r["source_text"], r["target_text"], r["citation"], r["sentence_method"]) for r in got] == [
        (0, a[0], b[0], None, "embedding:e"), (1, a[1], b[1], None, "embedding:e"), (2, "a gap of ﬁrst", "gap one", "c1", "llm:m"), (3, "more gap The END", "gap two gap three", None, "llm:m"), (4, "The end", "end", "c9", "embedding:e"),
    ]
    assert [r["sentence_confidence"] for r in got][2:4] == [0.7, None]
    (x,) = got[0]["alignment_links"]
    assert (x["source_idx"], x["target_idx"], x["source_lemma"], x["source_upos"], x["source_upos_confidence"], x["target_upos"], x["target_ner"], x["source_ner"]) == ([1], [2], "two", "NUM", 1.0, "X", "PER", "O")
    assert x["sense_gloss"] == "the number" and tuple(x["sense_hint"]) == ("two", "NUM") and x["source_lemma_confidence"] is None and got[1]["alignment_links"] == []
    tools = spark.createDataFrame([("source", a[0], [("One", "one", "NUM", "f", "x"), ("two", "twain", "NUM", None, "nummod")])], "side string, text string, tags array<struct<text:string,lemma:string,upos:string,feats:string,deprel:string>>")
    (x,) = modes.align_pairs("hybrid", ua, ub, "work", replies, tools=tools).where("pair_no = 0").first()["alignment_links"]
    assert (x["source_lemma"], x["source_deprel"], x["source_feats"], x["source_feats_confidence"], x["target_upos"]) == ("twain", "nummod", None, 1.0, "X")


def test_algorithmic_pairs_and_records(spark):
    a, b = {"w": ["alpha beta", "gamma delta", "omega"]}, {"w": ["alpha betas", "gamma deltas", "omegas"]}
    x = modes.align_pairs("algorithmic", units(spark, a), units(spark, b), "work")
    side = "struct<lang_code:string,year:int,work:string,author:string>"
    e = spark.createDataFrame([("w", "The Work!", ("ang", -490, "w", "x"), ("eng", 1900, "w", "y"))], f"work string, title string, source {side}, target {side}")
    got = modes.records(x, e, "work", "2020-01-01").orderBy("pair_id").collect()
    assert [r["pair_id"] for r in got] == [f"the_work_-490x1900_{i:05d}" for i in range(3)] and got[0]["metadata"]["ingested_at"] == "2020-01-01" and got[0]["source_tokens"] == ["alpha", "beta"]


def test_tool_tag_needs_exactly_one(spark):
    tags = "array<struct<text:string,lemma:string,upos:string,feats:string,deprel:string>>"
    d = spark.createDataFrame([([("A", "l1", "X", None, None), ("b", "l2", "X", None, None), ("a", "l3", "X", None, None)], s) for s in (" B ", "a", "", "c")], f"tags {tags}, span string")
    assert [r["t"] and r["t"]["lemma"] for r in d.select(modes.tool_tag(F.col("tags"), F.col("span")).alias("t")).collect()] == ["l2", None, None, None]


def test_normalisers_differ(spark):
    texts = [" Ａ ﬁ  x\tY ", "ǅ½", None, "", "Straße\n\n x"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(text.nfkc_key(F.col("t")).alias("k"), text.nfkc_words(F.col("t")).alias("w"), text.collapse(F.col("t")).alias("c")).collect()
    for t, r in zip(texts, d, strict=True):
        if t is None:
            assert r["k"] is None and r["w"] is None
            continue
        n = unicodedata.normalize("NFKC", t)
        assert r["k"] == n.strip().lower() and r["w"] == " ".join(n.split()).lower()
    assert d[0]["c"] != d[0]["w"]


def test_replies(spark):
    cases = {
        "```json\n[1, 2]\n```": ("[1, 2]", False), "Sure:\n{\"a\": \"x\ty\"} and more": ('{"a": "x\\ty"}', True), '[{"a": 1}, {"a": "un': ('[{"a": 1}, {"a": "un', True),
        "[1, 2": ("[1, 2", True), "": ("", True), "[1] [2]": ("[1]", False), "[1, x, 2]": ("[1, x, 2]", False),
    }
    d = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.first_value(F.col("t")).alias("v"), text.cut_off(F.col("t")).alias("c")).collect()
    for r in d:
        value, cut = cases[r["t"]]
        assert r["v"] == value
        if not r["t"].startswith("Sure"):
            assert r["c"] == cut, r["t"]
    attempts = spark.createDataFrame([(1, 0, '[{"a": 1}, {"a"'), (1, 1, '[{"a": 2}]'), (2, 0, "no")], "key int, attempt int, reply string")
    assert [(r["key"], r["attempt"], r["items"][0]["a"]) for r in adapters.first_good(attempts, ["key"], "array<struct<a:int>>").collect()] == [(1, 1, 2)]


def test_notes_and_messages(spark):
    rows = [("n", "c", False), ("", "c", False), ("n", "c", True), ("n", None, False), (None, "", None)]
    d = spark.createDataFrame(rows, "n string, c string, ok boolean").select(text.annotation_note(F.col("n"), F.col("c"), F.col("ok")).alias("x")).collect()
    assert [r["x"] for r in d] == ["n — self-check: c", "self-check: c", "n", "n", ""]
    m = spark.createDataFrame([("Usage Limit Reached.",), ("HTTP 529",), ("fine",), (None,)], "m string").select(text.is_limit_message(F.col("m")).alias("x")).collect()
    assert [r["x"] for r in m] == [True, True, False, False]
    s = spark.createDataFrame([("A--b c",), ("!!",), ("",)], "t string").select(text.dash_slug(F.col("t")).alias("d"), text.word_slug(F.col("t"), "work").alias("w")).collect()
    assert [tuple(r) for r in s] == [("A-b-c", "a_b_c"), ("unknown", "work"), ("unknown", "work")]
    n = spark.createDataFrame([(["a", "b"],)], "x array<string>").select(text.numbered_lines(F.col("x")).alias("y")).first()["y"]
    assert n == "0. a\n1. b"


def test_links_of_a_page_are_decided(spark):
    links = spark.createDataFrame([("p", i, f"u{i}", "t", "c") for i in range(17)] + [("q", 0, "v", "t", "c")], "page string, place int, url string, text string, context string")
    good = json.dumps([{"decision": "follow" if i % 2 else "odd", "category": "old_text_candidate", "reasoning": str(i)} for i in range(15)])
    replies = [("p", 0, 0, "[]"), ("p", 0, 1, good), ("p", 1, 0, "[1]"), ("q", 0, 0, '{"decision": "candidate", "category": "none"}')]
    got = {r["url"]: (r["decision"], r["category"]) for r in adapters.link_decisions(links, spark.createDataFrame(replies, "page string, batch int, attempt int, reply string")).collect()}
    assert got["u1"] == ("follow", "old_text_candidate") and got["u0"][0] == "uncertain" and got["u15"] == ("uncertain", None) and got["v"] == ("candidate", None) and len(got) == 18


def test_years_and_names(spark):
    r = spark.createDataFrame([(1, 0, "no idea"), (1, 1, "```json\n1390\n```"), (1, 2, "1400"), (2, 0, "null"), (2, 1, "5"), (3, 0, "x"), (3, 5, "1300"), (4, 0, '{"year": -490}')], "key int, attempt int, reply string")
    assert {x["key"]: x["year"] for x in adapters.composition_year(r, ["key"]).collect()} == {1: 1390, 2: None, 3: None, 4: -490}
    names = spark.createDataFrame([(1, '{"lang_code": "ang", "year": -5, "title": " T ", "author": "A", "source": "S"}')], "key int, reply string")
    assert tuple(adapters.naming(names, ["key"]).first()) == (1, "ang", -5, "T", "A", "S")
    with pytest.raises(Exception, match="lacks a field"):
        adapters.naming(names.withColumn("reply", F.lit('{"lang_code": "ang"}')), ["key"]).collect()


def test_translate(spark):
    tokens = [("s", 0, "Anna", "PROPN", "PER", "Anna"), ("s", 1, "sees", "VERB", "O", "see"), ("s", 2, "the", "DET", "O", "the"), ("s", 3, "phone", "NOUN", None, "")]
    t = spark.createDataFrame(tokens, "seq string, position int, token string, upos string, ner string, lemma string")
    found = spark.createDataFrame([("see", "sihþ", "c1", 0.9), ("Anna", "never", "", 0.8)], "term string, span string, citation string, confidence double")
    reply = lambda x: spark.createDataFrame([("s", x)], "seq string, reply string")
    s, notes = adapters.translate(t, found, reply('{"sentence": "d"}'), reply('{"sentence": "Anna sihþ", "approved": "false", "note": "odd"}'))
    assert tuple(s.first()) == ("s", "Anna sihþ", False)
    got = {r["position"]: (r["span"], r["form"], r["status"], r["note"]) for r in notes.collect()}
    assert got[0][:3] == ("Anna", "Anna", "name-passthrough") and got[1] == ("sees", "sihþ", "attested", "attested via c1 lookup (confidence 0.90) — self-check: odd")
    assert got[3][:3] == ("phone", "phone", "anachronism-passthrough") and set(got) == {0, 1, 3}
    with pytest.raises(Exception, match="bad reply"):
        adapters.translate(t, found, reply("no"), reply("{}"))[0].collect()


# --- senses ----------------------------------------------------------------------------------------------------------


def test_nearest_sense_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(sense, "BLOCK_BYTES", 2000)
    g = np.random.default_rng(1)
    x, y = np.round(g.normal(size=(30, 4)), 1), np.round(g.normal(size=(60, 4)), 1)
    gl = [(i, "nv"[i % 2], v.tolist()) for i, v in enumerate(x)] + [(90, "n", None), (91, None, [0.0] * 4), (92, "z", [0.0] * 4)]
    se = [(f"en:w.{i:02d}", "nva"[i % 3], v.tolist()) for i, v in enumerate(y)] + [("en:a", "n", y[0].tolist()), ("en:null", "n", None)]
    glosses, senses = spark.createDataFrame(gl, "gloss_id int, pos string, vector array<double>").repartition(3), spark.createDataFrame(se, "sense_id string, pos string, vector array<double>")
    got = {r["gloss_id"]: (r["sense_id"], round(r["similarity"], 9)) for r in sense.nearest_sense(glosses, senses).collect()}
    want = {}
    for i, pos, v in gl:
        c = sorted((-round(float(np.dot(v, w)), 9), s) for s, p, w in se if w is not None and v is not None and p == pos)
        if c:
            want[i] = (c[0][1], -c[0][0])
    assert got == want
    assert sense.nearest_sense(glosses, senses.where("false")).count() == 0 and sense.nearest_sense(glosses.where("false"), senses).count() == 0


def test_resolve_against_plain_python(spark):
    g = np.random.default_rng(7)
    unit = lambda n: [(v / np.linalg.norm(v)).tolist() for v in g.normal(size=(n, 3))]
    tags = ["NOUN", "propn", "VERB", "ADJ", "DET", "ADV", "X"]
    gl = [(i, f"Lemma {i % 4}" if i % 9 else None, tags[i % 7], v) for i, v in enumerate(unit(90))]
    inv = [(f"w{i}.n.01", "nvar"[i % 4], v) for i, v in enumerate(unit(8))]
    old = [(f"minted:lemma_{i}.n.{i + 3:02d}", "NOUN", v) for i, v in enumerate(unit(3))] + [("other:lemma_1.v.07", "VERB", unit(1)[0])]
    got = sense.resolve(spark.createDataFrame(gl, "gloss_id int, lemma string, upos string, vector array<double>").repartition(3), spark.createDataFrame(inv, "sense_id string, pos string, vector array<double>"), spark.createDataFrame(old, "sense_id string, upos string, vector array<double>"), threshold=0.9)
    got = {r["gloss_id"]: (r["sense_id"], r["origin"]) for r in got.collect()}
    pool = [(s, u, np.array(v)) for s, u, v in old]
    last = {}
    for s, *_ in old:
        if s.startswith("minted:"):
            stem, n = s[7:].rsplit(".", 1)
            last[stem] = max(last.get(stem, 0), int(n))
    want, origin = {}, {}
    for i, lemma, upos, v in gl:
        wn = sense.INVENTORY_POS.get(upos.upper())
        best, name, kind = -2.0, None, None
        if wn:
            for s, p, w in inv:
                if p == wn and np.dot(v, w) > best:
                    best, name, kind = np.dot(v, w), f"en:{s}", "inventory"
            for s, u, w in pool:
                if u == upos.upper() and np.dot(v, w) > best:
                    best, name, kind = np.dot(v, w), s, "minted"
        if name is not None and best >= 0.9:
            want[i], origin[i] = name, kind
            continue
        stem = ("unknown" if lemma is None else lemma.lower().replace(" ", "_")) + "." + (wn or "x")
        last[stem] = last.get(stem, 0) + 1
        want[i], origin[i] = f"minted:{stem}.{last[stem]:02d}", "new"
        if wn:
            pool.append((want[i], upos.upper(), np.array(v)))
    assert got == {i: (want[i], origin[i]) for i in want}
    assert set(origin.values()) == {"inventory", "minted", "new"}
