import pytest
from pyspark.sql import functions as F

from glossweave.operators import adapters, align, catalog, contrib, evaluate, sense
from glossweave.operators.index import shards_between, with_shards
from glossweave.sources import corpus_files

def test_alignment(spark):
    u = lambda x: spark.createDataFrame([("w", i, t) for i, t in enumerate(x)], "work string, unit_index int, unit_text string")
    m = align.monotone(align.mutual_best(align.lexical_scores(u(["alpha beta", "gamma delta", "omega"]), u(["alpha betas", "gamma deltas", "omegas"]), "work"), "work"), "work")
    assert sorted((r["i"], r["j"]) for r in m.collect()) == [(0, 0), (1, 1), (2, 2)]
    m = align.mutual_best(align.lexical_scores(u(["abc"]), u(["xyz", "zyx"]), "work"), "work")
    assert m.count() == 0


def test_gaps_and_blocks(spark):
    sizes = spark.createDataFrame([("w", 5, 6)], "work string, n_a int, n_b int")
    anchors = spark.createDataFrame([("w", 1, 2, 1.0), ("w", 2, 3, 1.0)], "work string, i int, j int, score double")
    assert sorted(tuple(r)[1:] for r in align.gaps(anchors, sizes, "work").collect()) == [(0, 1, 0, 2), (3, 5, 4, 6)]
    big = spark.createDataFrame([("w", 100, 50), ("v", 0, 3)], "work string, n_a int, n_b int")
    assert sorted(tuple(r)[1:] for r in align.blocks(big, "work").collect()) == [(0, 40, 0, 20), (34, 74, 17, 37), (68, 100, 34, 50)]


def test_pack(spark):
    t = spark.createDataFrame([("aa\n\nbb\n\n \n\ncccccccccccc",), (None,)], "t string").select(align.pack_paragraphs("t", F.lit(8)).alias("x"))
    assert [r["x"] for r in t.collect()] == [["aa\n\nbb", "cccccccccccc"], []]


def contribution(**changes):
    """A valid contribution, with fields changed: keys are paths, a value of None takes the field away."""
    import copy
    import json

    base = {"doc_type": "attestation", "origin": {"lang_code": "ang", "tokens": [{"surface": "lēoht", "alt": [], "class": "common", "gap": False}, {"surface": None, "gap": True}, {"surface": "bēam"}]}, "target": {"lang_code": "eng", "text": "ray of light"},
            "metadata": {"date": {"year": 1000, "precision": "circa"}, "location": None, "source": "src", "author": None, "contributor": "c", "license": "cc", "validation": {"status": "validated"}}}
    doc = copy.deepcopy(base)
    for path, value in changes.items():
        *to, last = path.split("__")
        at = doc
        for k in to:
            at = at[k]
        if value is None:
            del at[last]
        else:
            at[last] = value
    return json.dumps(doc).replace('"<null>"', "null")


def test_contribution_rules(spark):
    """Each rule of the schema, broken once."""
    cases = {
        "valid": (contribution(), []),
        "free text": (contribution(origin={"lang_code": "ang", "text": "t"}), []),
        "no target": (contribution(target="<null>"), []),
        "note": (contribution(doc_type="grammar_note", origin={"lang_code": "ang", "text": "t"}, target="<null>"), []),
        "pending": (contribution(metadata__validation__status="pending", metadata__date={"year": -490}), []),
        "type": (contribution(doc_type="gloss"), ["doc_type"]),
        "no type": (contribution(doc_type=None), ["doc_type"]),
        "language": (contribution(origin__lang_code=None), ["origin"]),
        "both": (contribution(origin__text="t"), ["tokens_or_text"]),
        "neither": (contribution(origin__tokens=None), ["tokens_or_text"]),
        "class": (contribution(origin__tokens=[{"surface": "a", "class": "word"}]), ["token_class"]),
        "target's text": (contribution(target__text=None), ["target"]),
        "note's text": (contribution(doc_type="grammar_note", target="<null>"), ["grammar_note_text"]),
        "note's target": (contribution(doc_type="grammar_note", origin={"lang_code": "ang", "text": "t"}), ["grammar_note_target"]),
        "year": (contribution(metadata__date={"precision": "exact"}), ["year"]),
        "precision": (contribution(metadata__date__precision="about"), ["precision"]),
        "source": (contribution(metadata__source=None), ["source"]),
        "contributor": (contribution(metadata__contributor=None), ["contributor"]),
        "license": (contribution(metadata__license=None), ["license"]),
        "status": (contribution(metadata__validation__status="submitted"), ["status"]),
        "no key": (contribution(target=None), ["no_target"]),
        "extra": (contribution(metadata__more=1), ["extra"]),
        "token's extra": (contribution(origin__tokens=[{"surface": "a", "pos": "x"}]), ["extra"]),
        "no object": ("[1]", ["doc_type", "origin", "tokens_or_text", "year", "source", "contributor", "license", "status", "no_target"]),
    }
    d = contrib.read_json(spark.createDataFrame([(k, j) for k, (j, _) in cases.items()], "name string, json string"), "json")
    assert {r["name"]: r["violations"] for r in contrib.violations(d).collect()} == {k: v for k, (_, v) in cases.items()}
    with pytest.raises(Exception, match="invalid contribution"):
        contrib.require_valid(d).collect()


def test_attestation_rows(spark, tmp_path):
    docs = [contribution(), contribution(doc_type="grammar_note", origin={"lang_code": "ang", "text": "t"}, target="<null>"), contribution(target="<null>"), contribution(origin={"lang_code": "ang", "text": "t"}),
            contribution(metadata__validation__status="proofread"), contribution(origin__tokens=[{"surface": "Ælfred", "class": "name"}, {"surface": "x", "gap": True}], metadata__date={"year": -5})]
    d = spark.createDataFrame([(j,) for j in docs], "json string")
    tags = spark.createDataFrame([("ang", "lēoht bēam", 0, ".", "PUNCT", "O", None), ("ang", "lēoht bēam", 2, "beam", "NOUN", "MISC", "s.n.01"), ("ang", "lēoht bēam", 1, "leoht", "NOUN", None, "s.n.02")], "iso_code string, form string, position int, lemma string, upos string, ner string, sense_id string")
    ranges = contrib.build_relational_index(d, str(tmp_path / "r"), tags=tags)
    assert [tuple(r) for r in ranges.collect()] == [("ang", -5, 1000, 2)]
    got = spark.read.parquet(str(tmp_path / "r"))
    assert sorted((r["form"], r["lemma"], r["sense_id"], r["ner"], r["iso_code"], r["year_from"], r["year_to"]) for r in got.collect()) == [("lēoht bēam", "leoht", "s.n.02", "O", "ang", -5, 1000), ("Ælfred", "Ælfred", "name:Ælfred", "PER", "ang", -5, 1000)]
    assert shards_between(got, -10, -5).count() == 2 and shards_between(got, 1001, None).count() == 0


def test_shards_before_christ(spark):
    p = spark.createDataFrame([(("grc", -490), ("eng", 1914)), (("grc", -300), ("eng", 1990))], "source struct<lang_code:string,year:int>, target struct<lang_code:string,year:int>")
    x = with_shards(p)
    assert {(r["lang_a"], r["year_from"], r["year_to"]) for r in x.collect()} == {("grc", -490, 1990)}
    assert corpus_files.overlapping(x, -500, -480).count() == 2 and corpus_files.overlapping(x, 1991, None).count() == 0
    assert corpus_files.with_reversed(x, "eng", "grc").count() == 2


def test_missing_sources_are_empty(spark, tmp_path):
    assert corpus_files.read_parquet(spark, str(tmp_path / "none"), "a int").count() == 0
    assert corpus_files.read_jsonl(spark, str(tmp_path / "none"), "a int").count() == 0


def test_judged(spark):
    q = spark.createDataFrame([("s", 1, 1), ("s", 2, 1), ("s", 3, 1)], "stage string, key int, n_expected int")
    r = spark.createDataFrame([("s", 1, '```json\n{"a": 1}\n```'), ("s", 2, '[{"a": 1}, {"a": 2}]')], "stage string, key int, reply string")
    assert {x["key"] for x in adapters.judged(q, r, "array<struct<a:int>>", "drop").collect()} == {1}
    assert {x["key"]: x["items"] is None for x in adapters.judged(q, r, "array<struct<a:int>>", "keep").collect()} == {1: False, 2: True, 3: True}
    with pytest.raises(Exception, match="bad reply"):
        adapters.judged(q, r, "array<struct<a:int>>").collect()


def test_mint_reuses(spark):
    g = spark.createDataFrame([(1, "Wer gild", "n", [1.0, 0.0]), (2, "other", "n", [0.9, 0.1]), (3, "third", "n", [0.0, 1.0])], "gloss_id int, lemma string, pos string, vector array<double>")
    m = spark.createDataFrame([("minted:third.n.04", "n", [-1.0, 0.0])], "sense_id string, pos string, vector array<double>")
    got = {r["gloss_id"]: (r["sense_id"], r["is_new"]) for r in sense.mint(g, m).collect()}
    assert got == {1: ("minted:wer_gild.n.01", True), 2: ("minted:wer_gild.n.01", False), 3: ("minted:third.n.05", True)}


def test_crawl_stops_at_documents_and_depth(spark, tmp_path):
    e = spark.createDataFrame([("a", "b"), ("b", "c.txt"), ("c.txt", "d"), ("b", "a"), ("b", "e"), ("e", "f")], "src string, dst string")
    got = catalog.crawl(spark.createDataFrame([("a",)], "url string"), e, F.col("url").endswith(".txt"), str(tmp_path), max_depth=2)
    assert {(r["url"], r["depth"]) for r in got.collect()} == {("a", 0), ("b", 1), ("c.txt", 2), ("e", 2)}


def test_separation_and_overlap(spark):
    s = spark.createDataFrame([("m", True, 0.9), ("m", True, None), ("m", False, 0.6)], "k string, positive boolean, score double")
    r = evaluate.separation(s, "k").first()
    assert (r["positive_min"], r["negative_max"], r["cleanly_separated"], r["accuracy"], r["missing"]) == (0.9, 0.6, True, 0.5, 1)
    a, b = (spark.createDataFrame([(x,) for x in t], "u string") for t in ("abc", "bcd"))
    assert tuple(evaluate.overlap(a, b, ["u"]).first()) == (3, 3, 2, 2 / 3, 2 / 3)


def test_embedder_is_stable(spark):
    v = spark.createDataFrame([("abc",), ("abc",), ("",)], "t string").select(adapters.hashed_trigrams(F.col("t")).alias("v")).collect()
    assert v[0]["v"] == v[1]["v"] and sum(x * x for x in v[0]["v"]) == pytest.approx(1, abs=1e-5) and not any(v[2]["v"])
