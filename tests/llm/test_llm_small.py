"""Operators of the llm folder on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from glossweave.llm import bpe, common, decontaminate, fertility, jaccard_join, lm_score, quality, substring_dedup, token_counts, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}x{'é' if r.random() < 0.1 else ''}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    texts = [None, "", " \n", "one", "One two three", "one two THREE", prose(r, 30_000)]
    for _ in range(12):
        base = prose(r, r.randint(20, 300)).split()
        texts.append(" ".join(base))
        for share in (0.0, 0.01, 0.03, 0.2):
            w = list(base)
            for _ in range(int(share * len(w))):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(w))
    passage = prose(r, 60)
    texts += [prose(r, 40) + "\n" + passage + " " + prose(r, 50) for _ in range(6)]
    texts += ["same " * 90, "a b " * 60]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[8])  # a repeated row
    rows.append((None, rows[9][1], None, None, None))
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        sets.setdefault(i, shingles(t))
    root = {i: i for i in sets if i is not None}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(root)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("hot", [32, 2])
def test_jaccard_join(docs, corpus, monkeypatch, hot):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    want = brute_components(corpus)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [want[9][1]]


def test_jaccard_large_group(spark):
    """Near copies of one text of which few are near the least one: links between the others aren't lost."""
    r = random.Random(9)
    base = prose(r, 120).split()
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"m{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_parity_bounds_difference():
    g = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(g.integers(0, 400, g.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        x = jaccard_join.folded([jaccard_join.dense_sketch(a), jaccard_join.dense_sketch(b)])
        assert np.bitwise_count(x[0] ^ x[1]).sum() <= len(np.setxor1d(a, b))


def test_folded_part_of_a_sketch():
    g = np.random.default_rng(12)
    for n in (1, 3, 64, 65, 700, 40_000):
        a = g.integers(0, 1 << 63, n, np.uint64)
        b = np.concatenate((a[n // 10 :], g.integers(0, 1 << 63, n // 7, np.uint64)))
        whole = [jaccard_join.dense_sketch(x) for x in (a, b)]
        parts = [jaccard_join.packed(x) for x in whole]
        assert [jaccard_join.unpacked(*x) for x in parts] == whole and [len(c) * 4 for c, _ in parts] == [len(c) + len(r) for c, r in parts]
        x, y = (jaccard_join.folded(z) for z in ([c for c, _ in parts], whole))
        assert np.bitwise_count(x[0] ^ x[1]).sum() <= np.bitwise_count(y[0] ^ y[1]).sum() <= len(np.setxor1d(a, b))


def test_rows_not_asked_for_stay(spark):
    """Of texts that no candidate pair needs nearly none go on to a join, and of the others all."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).union(spark.createDataFrame([(None, "y")], "doc_id long, text string"))
    ids = spark.range(0, 20_000, 20)
    got = [r["doc_id"] for r in jaccard_join._likely(docs, "doc_id", ids.union(ids)).collect()]
    assert len(got) == len(set(got)) < 1100 and set(range(0, 20_000, 20)) <= set(got)
    names = docs.select(F.col("doc_id").cast("string").alias("doc_id"))
    assert jaccard_join._likely(names, "doc_id", names.where("doc_id < 'b'").limit(0)).count() == 0
    assert jaccard_join._likely(names, "doc_id", names).count() >= 20_000


def test_a_full_bitmap_loses_no_row(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BITS", 64)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"))
    assert jaccard_join._likely(docs, "doc_id", docs).count() == 2000


def brute_repeats(rows, width):
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    seen = {}
    for w in words:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in words:
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("wide", "local", "group", "hold"), [(1000, 64, 16 << 20, 64 << 20), (1, 64, 16 << 20, 1), (3, 2, 1, 1), (1000, 1, 1, 64 << 20), (1000, 64, 1, 1)])
def test_substring_dedup(docs, corpus, monkeypatch, wide, local, group, hold):
    for name, value in (("WIDE", wide), ("LOCAL", local), ("GROUP", group), ("HOLD", hold)):
        monkeypatch.setattr(substring_dedup, name, value)
    got = substring_dedup.substring_dedup(docs, with_text=True).collect()
    want = [(r[0], *x) for r, x in zip(corpus, brute_repeats(corpus, 35), strict=True)]
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted((w[0] or -1, *w[1:]) for w in want)
    for r in got:
        if r["n_removed"] == 0 and r["doc_id"] is not None:
            assert r["kept_text"] == corpus[r["doc_id"]][1]
        assert hashlib.sha256(" ".join(WORD.findall(r["kept_text"] or "")).encode()).hexdigest() == r["kept_sha256"]


def test_automaton_counts():
    r = random.Random(2)
    for _ in range(200):
        seqs = [[r.randrange(3) for _ in range(r.randint(1, 12))] for _ in range(r.randint(1, 4))]
        times = [r.randint(1, 2) for _ in seqs]
        auto = substring_dedup.Automaton(seqs, times)

        def starts(x, seqs=seqs, times=times):
            return sum(t for s, t in zip(seqs, times, strict=True) for i in range(len(s) - len(x) + 1) if s[i : i + len(x)] == x)

        for s in seqs:
            want = [max([n for n in range(1, i + 2) if starts(s[i + 1 - n : i + 1]) >= 2], default=0) for i in range(len(s))]
            assert auto.matches(s) == want


def test_bpe_and_counts(docs, corpus):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(bpe.FILE)
    lib = Tokenizer.from_file(path)
    r = random.Random(3)
    odd = ["".join(r.choice(" \n\tab'sé漢😀<|endoftext|>½ \x1c") for _ in range(r.randint(0, 30))) for _ in range(300)]
    rows = [(i, t, None, None, None) for i, t in enumerate([*odd, "<|endoftext|>x", None, "z" * 5000])]
    spark = docs.sparkSession
    d = spark.createDataFrame(rows, DOCS)
    got = {x["doc_id"]: x for x in bpe.bpe_columns(d, path).collect()}
    import sentencepiece

    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    counts = {x["doc_id"]: x for x in token_counts.token_counts(d, public_tokenizers.path(token_counts.MODEL)).collect()}
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == lib.decode(ids, skip_special_tokens=False)
        assert counts[i]["n_tokens"] == len(piece.encode(t or "")) and counts[i]["n_bytes"] == len((t or "").encode())


def test_fertility_base(docs, corpus):
    got = sorted((r["doc_id"] or -1, r["n_words"], r["base_failed"], r["kept"]) for r in fertility.quality_rules(docs, {"piece": public_tokenizers.path(token_counts.MODEL)}).collect())
    assert len(got) == len(corpus)
    assert all(not k for _, n, _, k in got if n < 50)

    def brute(t):
        w = WORD.findall(t or "")
        seen, dup, at = set(), 0, {}
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 3)})]

    r = random.Random(5)
    texts = [None, ""] + ["".join(r.choice(["a", "b ", "é", "\n", "#", " ", "x y z ", "\x85"]) for _ in range(r.randint(0, 50))) for _ in range(500)]
    assert fertility.base_counts([t.encode() if t is not None else None for t in texts]).tolist() == [brute(t) for t in texts]


def test_leaks(spark):
    r = random.Random(6)
    items = [(i, prose(r, r.randint(15, 55), 3000)) for i in range(40)] + [(40, None), (41, "two words")]
    rows, planted = [], set()
    for i in range(200):
        k = r.randrange(40)
        w = items[k][1].split()
        for _ in range(r.randint(0, len(w) // 6)):
            p = r.randrange(len(w))
            w[p : p + r.randint(0, 1)] = [f"e{r.randrange(10**6)}"] * r.randint(0, 1)
        rows.append((i, prose(r, r.randint(0, 80), 3000) + " " + " ".join(w) + " " + prose(r, r.randint(0, 80), 3000), None, None, None))
        planted.add((i, k))
    rows += [(i, prose(r, 200, 3000), None, None, None) for i in range(200, 300)] + [(300, None, None, None, None), (301, "", None, None, None)]
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.find_leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id int, text string")).collect()}

    def distance(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    near = {(d, k) for d, k in planted if min(distance(items[k][1].split(), rows[d][1].split()[a : a + n]) for a in range(80) for n in [len(items[k][1].split())]) <= len(items[k][1].split()) // 5}
    assert len(near - set(got)) <= 0.05 * len(near) and set(got) <= planted
    for (d, k), x in got.items():
        assert x["distance"] == distance(items[k][1].split(), rows[d][1].split()[x["first_word"] : x["end_word"]])


def test_warc_round_trip(spark, tmp_path):
    big = "<p>x</p>" * 40
    rows = [(3, "http://a", big), (1, "http://b", big), (2, "u\r\nX: y", "small"), (4, None, "small"), (5, "http://c", None), (6, "http://d", ""), (7, "e", "é" * 200_000)] + [(i, f"http://h/{i}", f"<html>{i}" + "text of a page " * (i % 30)) for i in range(10, 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "warc")
    names = warc.write_archives(pages, folder)
    got = {r["page_id"]: r for r in warc.read_archives(names, folder).collect()}
    assert len(got) == len(rows)
    assert got[3]["record_type"] == "revisit" and got[3]["refers_to"] == 1 and got[1]["record_type"] == "response"
    assert got[2]["record_type"] == got[4]["record_type"] == "response" and got[5]["payload_bytes"] == 0
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i]["payload_digest"] == hashlib.sha256(data).hexdigest() and got[i]["payload_bytes"] == len(data)
        if got[i]["record_type"] == "response":
            assert bytes(got[i]["payload"]) == data
    import struct

    for f in (tmp_path / "warc").glob("*.zst"):
        assert struct.unpack("<I", f.read_bytes()[:4])[0] == warc.SKIPPABLE


def test_empty_tables(spark, none):
    path = public_tokenizers.path(token_counts.MODEL)
    assert jaccard_join.near_duplicates(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert bpe.bpe_columns(none, public_tokenizers.path(bpe.FILE)).count() == 0
    assert token_counts.token_counts(none, path).count() == 0
    assert fertility.quality_rules(none, {"piece": path}).count() == 0
    assert decontaminate.find_leaks(none, spark.createDataFrame([], "item_id int, text string")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(none, toxicity.train(none, labels, ["toxic"])).count() == 0
    assert quality.score(none, quality.train(none, labels)).count() == 0
    assert lm_score.score(none, lm_score.train(none, labels)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = common.shared_dir(spark)
    assert warc.read_archives(warc.write_archives(pages, folder), folder).count() == 0


def test_toxicity_chain(spark):
    r = random.Random(7)
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, prose(r, 40, 200) + ("".join(f" vile{r.choice('abcdefgh')}{r.choice('xyz')}" for _ in range(r.randint(1, 5))) if bad else ""), int(bad)))
    d = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, t) for i, _, t in rows if i < 400], "doc_id long, toxic int")
    chain = toxicity.train(d, lab, ["toxic"])
    assert chain.names == ["term", "dense", "toxic"]
    got = {x["doc_id"]: x["rejected"] for x in toxicity.score(d, chain).collect()}
    held = [(bool(t), got[i]) for i, _, t in rows if i >= 400]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5)], "doc_id long, text string, rejected double")
    assert [x["rejected"] for x in toxicity.score(odd, chain).collect()] == [False, False]
    with pytest.raises(ValueError, match="clash"):
        toxicity.score(odd, chain, carry=("rejected",))


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    x = quality.score(d, quality.train(d, lab)).join(lab, "doc_id").where("held_out").select("score", "quality").toPandas()
    pos, neg = x.score[x.quality == 1].to_numpy(), x.score[x.quality == 0].to_numpy()
    assert (pos[:, None] > neg[None]).mean() > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, quality.train(d, lab)).collect())


def test_lm_score_against_counts(spark, docs, corpus):
    import math
    from collections import Counter

    target = spark.createDataFrame([(i,) for i in range(7, 40)], "doc_id long")
    model = lm_score.train(docs, target)
    got = {}
    for r in lm_score.score(docs, model).collect():
        got[r["doc_id"]] = r
    uni, bi, ctx = ([Counter(), Counter()] for _ in range(3))
    for i, t, *_ in corpus:
        w = (t or "").encode().lower().split()
        for m in (0, 1) if i is not None and 7 <= i < 40 else (0,):
            uni[m].update(w)
            bi[m].update(zip([None, *w], w, strict=False))
            ctx[m].update(x for x, _ in zip([None, *w], w, strict=False))
    size = len(uni[0]) + 2
    kept = {}
    for (v, w), c in bi[0].items():
        if c > 1:
            kept.setdefault(v, []).append(w)
    for i, t, *_ in corpus[:30]:
        w = (t or "").encode().lower().split()
        assert got[i]["n_tokens"] == len(w)
        for m, name in ((0, "background_loss"), (1, "target_loss")):
            loss = 0.0
            for a, b in zip([None, *w], w, strict=False):
                c = max(1, ctx[m][a])
                rest = 1 - 0.6 * sum(bi[m][a, x] for x in kept.get(a, ())) / c
                p = rest * (uni[m][b] + 0.5) / (sum(uni[m].values()) + 0.5 * size) + (0.6 * bi[m][a, b] / c if b in kept.get(a, ()) else 0)
                loss -= math.log(p)
            assert got[i][name] == pytest.approx(loss / len(w) if w else 0.0, abs=1e-9)


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = {x["node"]: x["root"] for x in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: top(i) for i in root if any(i in e and e[0] != e[1] for e in edges)}


def test_words_match_plain_python():
    r = random.Random(10)
    texts = [None, b"", b" ", b"a", b" a", b"a "] + ["".join(r.choice("ab é\n\t\x0b\x1c\x85漢") for _ in range(r.randint(0, 40))).encode() for _ in range(300)] + [b"x" * 3_000_000 + b" y"]
    w = common.Words(texts)
    seen = {}
    for i, t in enumerate(texts):
        want = (t or b"").split()
        own = w.of(i)
        assert len(own) == len(want)
        for h, x in zip(own.tolist(), want, strict=True):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
    assert F is not None


def test_lm_score_keeps_all_words_and_pairs(spark):
    """More words and more repeated pairs than fixed model sizes of 65,000 and 300,000 would hold; documents that were not counted."""
    import math

    words = [f"v{i}" for i in range(70_000)]
    texts = [" ".join(words[i] for i in (random.Random(s).sample(range(70_000), 70_000))) for s in range(5)]
    rows = [(s * 2 + k, t) for s, t in enumerate(texts) for k in range(2)]
    d = spark.createDataFrame([*rows, (50, "rare pair"), (51, "rare pair")], "doc_id long, text string")
    model = lm_score.train(d, spark.createDataFrame([(50,)], "doc_id long"))
    got = {r["doc_id"]: r for r in lm_score.score(d, model).collect()}
    assert len(got) == len(rows) + 2
    total, size = 700_004, 70_004
    begin = 0.4 * 2.5 / (total + 0.5 * size) + 0.6 * 2 / 12
    pair = 0.4 * 2.5 / (total + 0.5 * size) + 0.6
    assert got[50]["background_loss"] == pytest.approx(-(math.log(begin) + math.log(pair)) / 2, abs=1e-9)
    first, single = 0.4 * 10.5 / (total + 0.5 * size), 0.4 * 10.5 / (total + 0.5 * size)
    near = got[0]["background_loss"] * 70_000
    # each pair of the shuffled texts occurs in both copies of its text; a pair shared between texts is rare
    assert near == pytest.approx(-(math.log(first + 0.6 * 2 / 12) + 69_999 * math.log(single + 0.6 * 2 / 10)), rel=1e-3)
    other = spark.createDataFrame([(7, "rare pair"), (8, "never seen"), (9, None)], "doc_id long, text string")
    new = {r["doc_id"]: r for r in lm_score.score(other, model).collect()}
    assert set(new) == {7, 8, 9} and new[9]["n_tokens"] == 0
    assert new[7]["background_loss"] == pytest.approx(got[50]["background_loss"], abs=1e-9)
    assert new[8]["background_loss"] == pytest.approx(-(math.log(0.4 * 0.5 / (total + 0.5 * size)) + math.log(0.5 / (total + 0.5 * size))) / 2, abs=1e-9)
