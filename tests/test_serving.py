"""The stored index, lookup and search against plain Python; nearest vectors at their edges."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.operators import retrieval, serve
from glossweave.operators.index import build_index, discover_pairs, read_index, shards_between

SIDE = "struct<lang_code:string,year:int>"
LINK = "array<struct<source_idx:array<int>,target_idx:array<int>," + ",".join(f"{s}_{t}:string" for s in ("source", "target") for t in ("upos", "ner", "lemma")) + ">>"
TOKEN = re.compile(r"[\w]+|[^\w\s]")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def pairs_of(r, n):
    stems = ["beam", "beams", "boem", "light", "lēoht", "leoht", "größe", "Grösse", "sir", "Sir,", "þe", "the", "aaaa", "tión"]
    out = []
    for i in range(n):
        s, t = (" ".join(r.choice(stems) for _ in range(r.randint(0, 9))) for _ in range(2))
        links = [([k], [k % 3, k % 2], "NOUN" if k % 2 else None, "PER" if k % 3 else "O", f"l{k}", "VERB", None, f"m{k}") for k in range(0, 4, r.randint(1, 3))]
        a = r.choice([("ang", 900 + i % 50), ("enm", 1300 + i % 90), ("eng", -10)])
        b = ("eng", 1990 + i % 5)
        out.append((i, f"p{i}", a, b, s, t, None if i % 3 else f"c{i}", None if i % 4 == 0 else i / 100, links))
    return out


@pytest.fixture(scope="module")
def rows():
    return pairs_of(random.Random(1), 120)


@pytest.fixture(scope="module")
def vectors(rows):
    g = np.random.default_rng(2)
    some = np.round(g.normal(size=(40, 6)), 2)
    return {(i, s): some[(2 * i + s) % 40].tolist() for i, *_ in rows for s in (0, 1)}


@pytest.fixture(scope="module")
def index(spark, rows, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    d = spark.createDataFrame(rows, f"row_index long, pair_id string, source {SIDE}, target {SIDE}, source_text string, target_text string, citation string, sentence_confidence double, alignment_links {LINK}")
    v = spark.createDataFrame([(i, s, x) for (i, s), x in vectors.items()], "row_index long, side int, embedding array<double>")
    build_index(d, path, vectors=v)
    return read_index(spark, path)


def grams(t):
    p = f"  {t.lower()}  "
    return {p[i : i + 3] for i in range(len(p) - 2)}


def plain_lookup(rows, query, lang, target, upos, ner):
    """One query as one would write it for one shard after the other."""
    shards = {}
    for r in rows:
        shards.setdefault((r[2][0], r[3][0]), []).append(r)
    key, side = ((lang, target), 0) if (lang, target) in shards else ((target, lang), 1)
    out = []
    for r in shards.get(key, []):
        own, other = (r[4], r[5]) if side == 0 else (r[5], r[4])
        own_t, other_t = TOKEN.findall(own), TOKEN.findall(other)
        hit = set()
        for k, t in enumerate(own_t):
            a, b = grams(query), grams(t)
            n = len(query) + max(0, len(b) - 2)
            if a & b and 2 * len(a & b) / (len(a) + len(b)) >= 0.5 * (1 - math.exp(-n / 10)) and levenshtein(query.lower(), t.lower()) <= round(2 * (1 - math.exp(-(len(query) + len(t)) / 4.5))):
                hit.add(k)
        if hit:
            link = next((x for x in r[8] if hit & set(x[side])), None)
            span = None if link is None else " ".join(other_t[i] for i in link[1 - side] if i < len(other_t))
            tags = (None,) * 3 if link is None else link[2:5] if side == 0 else link[5:8]
            rank = sum(1 if got is None else 2 if got != asked else 0 for asked, got in ((upos, tags[0]), (ner, tags[1])) if asked)
            out.append((rank, r[0], sorted(hit), span, tags, r[6] or "", r[7] or 0.0))
    return sorted(out, key=lambda x: x[:2])


def test_lookup_against_plain_python(spark, index, rows):
    asked = [(1, "beam", "ang", "eng", None, None), (2, "grösse", "eng", "enm", "VERB", ""), (3, "tion", "enm", "eng", "NOUN", "PER"), (4, "sir", "eng", "eng", "", None), (5, "zzzz", "ang", "eng", None, None), (6, "the", "fro", "eng", None, None)]
    q = spark.createDataFrame(asked, "query_id int, query string, lang string, target_lang string, upos string, ner string")
    got = {}
    for r in retrieval.lookup(q, index).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["row_index"], r["matched"], r["span"], (r["matched_upos"], r["matched_ner"], r["matched_lemma"]), r["citation"], r["confidence"]))
    for i, *rest in asked:
        assert got.get(i, []) == [x[1:] for x in plain_lookup(rows, *rest)]
    assert got[1] and got[2] and got[3] and got[4]
    same = spark.createDataFrame([(1, "sir", "eng", "eng")], "query_id int, query string, lang string, target_lang string")
    either = {(r["row_index"], r["side"]) for r in retrieval.lookup(same, index, both_sides=True).collect()}
    assert {i for i, s in either if s == 0} == {x[1] for x in plain_lookup(rows, "sir", "eng", "eng", None, None)} and any(s for _, s in either)
    by = retrieval.client_lookup(retrieval.lookup(q, index)).where("query_id = 1").orderBy("place").collect()
    assert [r["confidence"] for r in by] == sorted((r["confidence"] for r in by), reverse=True) and [r["place"] for r in by] == list(range(len(by)))


@pytest.mark.parametrize("compat", [False, True])
def test_search_against_plain_python(spark, index, rows, vectors, compat):
    asked = [(1, "beam of lēoht the", "ang", 950, 30, None, None), (2, "sir, the light", "eng", 1991, None, "VERB", None), (3, "größe", "eng", None, 3, None, ""), (4, "þe", "enm", 1350, 1000, "NOUN", "PER"), (5, "the", "fro", 1000, 10, None, None)]
    g = np.random.default_rng(5)
    query_vectors = {i: np.round(g.normal(size=6), 2).tolist() for i, *_ in asked}
    q = spark.createDataFrame([(*x, query_vectors[x[0]]) for x in asked], "query_id int, query string, lang string, year int, window int, upos string, ner string, query_vector array<double>")
    from dataclasses import replace

    p = replace(retrieval.P, candidates=12)
    got = {}
    for r in retrieval.search(q, index, now=2025, top=7, compat=compat, p=p).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    shards = {}
    for r in rows:
        shards.setdefault((r[2][0], r[3][0]), []).append(r)
    for i, text, lang, year, window, upos, ner in asked:
        hits = []
        for key, own in sorted(shards.items()):
            near = [(r, s) for r in own for s in (0, 1) if compat or r[2 + s][0] == lang]
            if compat and lang not in key:
                continue
            score = lambda x: round(float(np.dot(query_vectors[i], vectors[x[0][0], x[1]])), 9)  # noqa: B023, E731
            near = sorted(near, key=lambda x: (-score(x), x[0][0], x[1]))[:12]  # noqa: B023
            hits += [(key, r, s, score((r, s))) for r, s in near if r[2 + s][0] == lang and (year is None or window is None or abs(r[2 + s][1] - year) <= window)]
        scored = []
        for key, r, s, ip in hits:
            a, b = grams(text), grams(r[4 + s])
            docs = [TOKEN.findall(x[4 + s]) for x in shards[key]]
            bm = 0.0
            tokens = [t.lower() for t in TOKEN.findall(r[4 + s])]
            for term in set(text.lower().split()):
                df, tf = sum(term in [t.lower() for t in d] for d in docs), tokens.count(term)
                mean = sum(map(len, docs)) / len(docs)
                if tf:
                    bm += max(0.0, math.log((len(docs) - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / mean))
            link = next((x for x in r[8] if (not upos or x[2 + 3 * s] == upos) and (not ner or x[3 + 3 * s] == ner)), None) if upos or ner else None
            scored.append([key, r[0], s, ip, 2 * len(a & b) / (len(a) + len(b)), bm, link])
        norm = lambda x, c: 1.0 if max(y[c] for y in scored) == min(y[c] for y in scored) else (x[c] - min(y[c] for y in scored)) / (max(y[c] for y in scored) - min(y[c] for y in scored))  # noqa: B023, E731
        w = math.exp(-max(0, 2025 - year) / 200) if year is not None else None
        total = [((x[3] if w is None else w * norm(x, 3) + (1 - w) * (0.5 * norm(x, 4) + 0.5 * norm(x, 5))) + (0.1 if x[6] else 0), x) for x in scored]
        want = sorted(total, key=lambda t: (-round(t[0], 9), t[1][0], t[1][1], t[1][2]))[:7]
        have = got.get(i, [])
        assert [round(r["score"], 7) for r in have] == [round(t, 7) for t, _ in want]
        assert {(r["lang_a"], r["row_index"], r["side"]) for r in have if r["score"] > want[-1][0] + 1e-9} == {(x[0][0], x[1], x[2]) for t, x in want if t > want[-1][0] + 1e-9}
        for r in have:
            x = next(x for _, x in total if x[1] == r["row_index"] and x[2] == r["side"])
            assert r["bm"] == pytest.approx(x[5]) and r["ng"] == pytest.approx(x[4])
            assert (r["upos"], r["ner"]) == ((x[6][2 + 3 * x[2]], x[6][3 + 3 * x[2]]) if x[6] else (None, None))
    assert got[1] and got[2] and got[3] and 5 not in got


def test_shards_of_the_index(spark, index, rows, tmp_path):
    assert {(r["lang_a"], r["lang_b"]) for r in discover_pairs(index, "eng").collect()} == {("ang", "eng"), ("enm", "eng"), ("eng", "eng")}
    assert discover_pairs(index, "enm").count() == 1
    assert shards_between(index.stats, None, 0).select("lang_a").distinct().collect()[0]["lang_a"] == "eng"
    assert index.pairs.count() == len(rows) and index.sides.count() == 2 * len(rows)
    none = read_index(spark, str(tmp_path / "nowhere"))
    assert none.pairs.count() == none.grams.count() == none.vectors.count() == 0
    q = spark.createDataFrame([(1, "beam", "ang", "eng")], "query_id int, query string, lang string, target_lang string")
    assert retrieval.lookup(q, none).count() == 0
    with pytest.raises(ValueError, match="no pairs"):
        build_index(index.pairs.drop("lang_a", "lang_b", "year_from", "year_to").where("false"), str(tmp_path / "empty"))


def test_nearest_edges(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.6, 0.8]) for i in range(40)] + [(99, None)], "vec_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "query_id string, query_vector array<double>")
    got = [(r["query_id"], r["vec_id"], r["rank"]) for r in serve.nearest(q, v, 3).orderBy("rank").collect()]
    assert got == [("a", 1, 1), ("a", 3, 2), ("a", 5, 3)]
    assert serve.nearest(q.where("false"), v, 3).count() == 0 and serve.nearest(q, v.where("false"), 3).count() == 0
    by = serve.nearest(q, v.withColumn("g", F.col("vec_id") % 4), 2, by=("g",)).collect()
    assert {(r["g"], r["vec_id"]) for r in by if r["vec_id"] != 99} == {(0, 0), (0, 4), (1, 1), (1, 5), (2, 2), (2, 6), (3, 3), (3, 7)}


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(serve, "BLOCK_BYTES", 200)
    g = np.random.default_rng(3)
    x = np.round(g.normal(size=(50, 4)), 3)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    q = v.where("vec_id < 12").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = {(r["query_id"], r["vec_id"]) for r in serve.nearest(q, v, 5).collect()}
    want = {(i, j) for i in range(12) for j in sorted(range(50), key=lambda j: (-round(float(x[i] @ x[j]), 9), j))[:5]}  # noqa: B023
    assert got == want
