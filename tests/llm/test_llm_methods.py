"""The operators' methods against plain versions of them: measures, risks, bands, folds, edit search by length, links of random corpora."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from glossweave.llm import bpe, common, decontaminate, fertility, jaccard_join, linear, lm_score, quality, substring_dedup, token_counts, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATHS = {v: public_tokenizers.path(f) for v, f in fertility.VOCABULARIES.items()}


def some_words(r, n, vocabulary):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# --- decontamination -------------------------------------------------------------------------------------------------


def near_run(item, words, most):
    """The least edit distance of the item to any run of the words, by the table of all prefixes; None if above most."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row) if min(row) <= most else None


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 8, 10, 15, 20, 35, 60, 120, 200])
def test_leaks_by_length_against_all_runs(size):
    """All (text, item) pairs with a run within the allowed edits; 0.99 of them or more are found, and nothing else."""
    r = random.Random(size)
    items = [some_words(r, size, 4000) for _ in range(25)]
    texts = []
    for k in range(25):
        for _ in range(4):
            w = list(items[k])
            for _ in range(size // 5):
                p = r.randrange(len(w))
                w[p : p + r.randint(0, 1)] = [f"e{r.randrange(10**6)}"] * r.randint(0, 1) or w[p : p + 1]
            texts.append(some_words(r, 20, 4000) + w + some_words(r, 20, 4000))
    known = decontaminate.Items(list(range(25)), [" ".join(x).encode() for x in items])
    got = {(d, k): dist for d, k, dist, *_ in known.leaks(common.Words([" ".join(t).encode() for t in texts]))}
    want = {(d, k): n for d, t in enumerate(texts) for k, item in enumerate(items) if (n := near_run(item, t, size // 5)) is not None}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and len(want) >= 100
    assert all(got[x] >= want[x] for x in got)


def test_leaks_in_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    items = spark.createDataFrame([(i, f"item{i} has these {i} words here") for i in range(20)] + [(20, None), (21, ""), (22, "solo")], "item_id int, text string")
    docs = [(i, f"before ITEM{i} has these {i} words here after", 7) for i in range(20)] + [(20, None, 7), (21, "", 7), (22, "a solo b solo", 7), (22, "a solo b solo", 7), (None, "solo", 7)]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id int, text string, distance int"), items).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in got if r["distance"] == 0) == sorted([(-1, 22), (22, 22), (22, 22), *((i, i) if i else (-1, 0) for i in range(20))])
    assert next(r for r in got if r["doc_id"] == 22)["first_word"] == 1  # the first of equally near runs
    with pytest.raises(ValueError, match="clash"):
        decontaminate.find_leaks(spark.createDataFrame(docs, "item_id int, text string, x int"), items, key="item_id")


# --- Jaccard join ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_of_random_templates(spark, monkeypatch, seed):
    """Many short texts of a few templates: blocks are few and common, and no link may be lost."""
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "SHARE", 3)
    monkeypatch.setattr(jaccard_join, "HOLD", 400)
    monkeypatch.setattr(jaccard_join, "HELD_MEMBERS", 4)
    r = random.Random(seed)
    rows = []
    for t in range(4):
        base = some_words(r, r.choice([8, 12, 20, 40]), 60)
        for _ in range(45):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                p = r.randrange(len(w) + 1)
                w[p : p + r.randint(0, 1)] = [f"n{r.randrange(30)}"] * r.randint(0, 1)
            rows.append((len(rows), " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def shingles(t):
        w = t.split()
        return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert got == {i: top(i) for i in range(len(rows))}


def test_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "other words that stand alone here")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


# --- quality ---------------------------------------------------------------------------------------------------------


def plain_measures(text):
    w = [x.encode() for x in WORD.findall(text)]
    n = len(w)
    if not n:
        return [0.0] * len(quality.NAMES)
    total = sum(map(len, w))
    data = text.encode()
    count = lambda chars: sum(data.count(bytes([c])) for c in chars) / total
    lines = [x for x in text.split("\n") if WORD.search(x)]
    share = lambda x: 1 - len(set(x)) / len(x) if x else 0.0
    return [
        math.log(n), total / n, sum(len(x) > 14 for x in w) / n, count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(b"0123456789"), count(b"#*$%&|<>@^~_=+\\{}[]"), count(b".,;:?'\"-()"), count(b"!"),
        math.log(n / len(lines)), share(lines), (1 - len(set(w)) / n) / math.sqrt(math.log(n + 2)), max(Counter(w).values()) / n, share(list(zip(w, w[1:]))), share(list(zip(w, w[1:], w[2:]))),
        sum(a == b for a, b in zip(w, w[1:])) / n, sum(c >= 0x80 for c in data) / total,
    ]


def test_quality_measures_against_plain_python():
    r = random.Random(3)
    texts = ["", "one", "é é é", "a\n\na\nb"] + [" ".join(r.choice(["Ab", "cd!", "12", "é", "x\n", "#", "a.b", "verylongwordindeed"]) for _ in range(r.randint(1, 60))) for _ in range(200)]
    got = quality.measures([None, *(t.encode() for t in texts)])
    assert np.allclose(got, [[0.0] * len(quality.NAMES), *map(plain_measures, texts)], atol=1e-12)


def test_pu_gradient_is_that_of_the_risk():
    g = np.random.default_rng(2)
    p, u = (np.concatenate((g.normal(size=(60, 4)) + s, np.ones((60, 1))), axis=1) for s in (0.5, 0.0))
    for prior in (0.2, 0.9):
        for _ in range(20):
            w = g.normal(size=5)
            plus, minus = linear.pu_risk(w, p, u, prior)
            risk = (lambda v: sum(linear.pu_risk(v, p, u, prior))) if minus >= 0 else (lambda v: -linear.pu_risk(v, p, u, prior)[1])  # noqa: B023
            want = [(risk(w + d) - risk(w - d)) / 2e-6 for d in np.eye(5) * 1e-6]
            assert np.allclose(linear.pu_gradient(w, p, u, prior), want, atol=1e-5)
            assert plus >= 0


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_from_positives_and_unlabelled(share):
    g = np.random.default_rng(4)
    n = 4000
    good = lambda k: (g.normal(size=(k, 6)) + 1.5 > 0).astype(float)
    bad = lambda k: (g.normal(size=(k, 6)) - 1.5 > 0).astype(float)
    u = np.concatenate((good(int(n * share)), bad(n - int(n * share))))
    assert abs(quality.class_prior(good(n), g.permutation(u)) - share) < 0.06


def test_quantiles_cover_all_rows(spark):
    r = random.Random(5)
    texts = [" ".join(some_words(r, r.randint(1, 200), 50)) for _ in range(400)]
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    cuts = quality.quantile_cuts(d)
    x = quality.measures([t.encode() for t in texts])
    for k in range(len(quality.NAMES)):
        for q, c in zip(quality.QUANTILES, cuts[k], strict=True):
            want = np.quantile(x[:, k], q, method="inverted_cdf")
            assert want <= c <= want * 1.005 + 1e-30


def test_prior_on_the_test_tables(spark):
    sf = "/root/testdata/sf0.1"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    *_, prior = quality.train(d, lab)
    assert abs(prior - lab.agg(F.avg("quality")).first()[0]) < 0.05


def test_quality_null_ids(spark):
    rows = [(None, "a b c", 1.0), (1, None, 1.0), (1, None, 1.0)]
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    d = spark.createDataFrame(rows, "doc_id long, text string, h double")
    got = quality.score(d, quality.train(d, labels)).collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got) and not any(r["held_out"] for r in got if r["doc_id"] is None)
    with pytest.raises(ValueError, match="clash"):
        quality.score(d.withColumnRenamed("doc_id", "score"), (np.zeros((16, 12)), np.zeros(193), 0.5), key="score")


# --- fertility rules -------------------------------------------------------------------------------------------------


def test_fertility_against_the_libraries():
    import base64

    import sentencepiece
    import tiktoken

    piece = sentencepiece.SentencePieceProcessor(model_file=PATHS["piece"])
    with open(PATHS["byte"], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = {v: i for i, v in ranks.items()}

    def bare(i):
        try:
            own[i].decode()
        except UnicodeDecodeError:
            return True
        return False

    r = random.Random(6)
    texts = [None, "", "  "] + ["".join(r.choice(["der ", "Größe ", "漢字", "x", "\n", "😀 ", "the ", "ſ", "y" * 70 + " ", *["\xa0", "▁", "\x85 ", " \u3000", "\xff"] * (k % 3 == 0)]) for _ in range(r.randint(1, 40))) for k in range(150)]
    words = common.Words([t.encode() if t is not None else None for t in texts])
    for name, ids_of, is_byte in (("piece", lambda w: piece.encode(w), lambda i: piece.is_byte(i)), ("byte", lambda w: lib.encode_ordinary(" " + w), bare)):
        got = fertility.fertility(words, fertility.Vocabulary(PATHS[name]))
        for row, t in zip(got, texts, strict=True):
            ids = [i for w in WORD.findall(t or "") for i in ids_of(w)]
            n = len(ids)
            want = (n, sum(map(is_byte, ids)), -sum(c / n * math.log2(c / n) for c in Counter(ids).values()) if n else 0.0)
            assert row == pytest.approx(want, abs=1e-9)


def test_bands_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(fertility, "MIN_ROWS", 8)
    r = random.Random(7)
    rows = [(i, " ".join(some_words(r, r.randint(60, 120), 500)), r.choice(["en", "de", "xx" if i < 5 else "en", None])) for i in range(120)]
    rows += [(200, " ".join("qzxjkvw" * 3 for _ in range(80)), "en"), (201, None, "en"), (202, "", None), (203, " ".join(f"ÿþ{i}\x01\x02" for i in range(90)), "zz"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(120)], "doc_id long")
    got = [x.asDict() for x in fertility.quality_rules(docs, PATHS, trusted).collect()]
    assert len(got) == len(rows)
    lang = {(i, t): g for i, t, g in rows}
    by_id = {}
    for x in got:
        by_id[x["doc_id"]] = x
    values = {}
    name_of = {i: g for i, _, g in rows}
    length = lambda x: int(math.floor(math.log2(max(x["n_words"], 1))))
    for x in got:
        if x["doc_id"] < 120 and not x["base_failed"]:
            for level, name in ((0, name_of[x["doc_id"]]), (1, "LATIN"), (2, "*")):
                for m in [f"{m}_{v}" for v in PATHS for m in fertility.MARGINS]:
                    values.setdefault((level, name, length(x), m), []).append(round(x[m] * 512) / 512)
    values = {k: sorted(v) for k, v in values.items() if k[1] is not None and len(v) >= 8}
    at = lambda v, q: next(x for i, x in enumerate(v) if i + 1 >= q * len(v))
    for x in got:
        why = ["base"] if x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"] else []
        script = "LATIN" if x["n_words"] else "*"
        for v in PATHS:
            for m, margin in fertility.MARGINS.items():
                own = None
                for k, n in ((0, name_of[x["doc_id"]]), (1, script), (2, "*")):
                    if lengths := sorted(c for a, b, c, d in values if (a, b, d) == (k, n, f"{m}_{v}")):
                        at_length = max((c for c in lengths if c <= length(x)), default=lengths[0])
                        own = None if m == "entropy" and at_length > length(x) else values[k, n, at_length, f"{m}_{v}"]
                        break
                if own:
                    low, mid, high = (at(own, q) for q in (0.25, 0.5, 0.75))
                    wide = max((high - low) / 1.349 * fertility.SPREADS, margin * mid if m == "chars_per_token" else margin)
                    y = x[f"{m}_{v}"]
                    if (y < mid - wide and m != "byte_share") or (y > mid + wide and m != "entropy"):
                        why.append(f"{m}_{v}")
        assert x["reasons"] == why and x["kept"] == (not why)
    assert not by_id[200]["kept"] and not by_id[201]["kept"] and lang


def test_trusted_text_is_rarely_rejected(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    x = fertility.op6_fertility_rules(spark, sf).join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in x}
    assert kept[1] > 0.995


# --- toxicity --------------------------------------------------------------------------------------------------------


def test_held_rows_shape_nothing():
    """Changing the held fold's flags and features changes neither the model of the other rows nor its labels."""
    r = random.Random(8)
    features = [np.unique(np.array([r.randrange(300) for _ in range(20)] + [1000 + r.randrange(4)] * (i % 3 == 0), np.int32)) for i in range(300)]
    flags = np.array([[int(i % 3 == 0)] for i in range(300)])
    fold = np.arange(300) % 4

    def sample(features, flags):
        return toxicity.Sample(np.concatenate(([0], np.cumsum([len(f) for f in features]))), np.concatenate(features), flags, fold)

    other = [np.unique(np.array([5000 + i % 7], np.int32)) if fold[i] == 2 else f for i, f in enumerate(features)]
    turned = np.where(fold[:, None] == 2, 1 - flags, flags)
    odds = np.zeros((300, 0))
    for k in range(3):
        a, b = (toxicity.fit_one(x, k, 2, odds) for x in (sample(features, flags), sample(other, turned)))
        assert np.array_equal(a[0], b[0]) and np.allclose(a[1], b[1])
    keep = np.flatnonzero(fold != 2)
    assert np.array_equal(sample(features, flags).labels(keep), sample(other, turned).labels(keep))
    # and against counts in plain Python
    toxic = {i for i in keep.tolist() if flags[i, 0]}
    n, n1 = Counter(), Counter()
    for i in keep.tolist():
        n.update(features[i].tolist())
        n1.update(features[i].tolist() if i in toxic else [])
    telling = {f for f in n if n[f] >= 3 and n1[f] >= 0.95 * n[f]}
    hits = [len(telling & set(features[i].tolist())) for i in keep.tolist()]
    want = [[int(i in toxic and h >= 1), int(i in toxic and h >= 3), int(i in toxic)] for i, h in zip(keep.tolist(), hits, strict=True)]
    assert sample(features, flags).labels(keep).astype(int).tolist() == want


def test_fit_holds_little_beside_its_sample(monkeypatch):
    """Fits share an executor with the JVM: beside the sample's features a fit holds a small multiple of them, and chunks change no result."""
    g = np.random.default_rng(11)
    rows, each = 6000, 1000
    col = (np.arange(each) * 2000 + g.integers(0, 5, (rows, each))).astype(np.int32).ravel()
    flags = (g.random((rows, 1)) < 0.1).astype(int)
    x = toxicity.Sample(np.arange(rows + 1) * each, col, flags, np.arange(rows) % 4)
    tracemalloc.start()
    toxicity.fit_one(x, 2, 0, np.zeros((rows, 2)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * col.nbytes
    few = toxicity.Sample(x.at[:301], x.col[: 300 * each], x.flags[:300], x.fold[:300])
    want = toxicity.fit_one(few, 2, 0, np.zeros((300, 2)))
    for module in (toxicity, linear):
        monkeypatch.setattr(module, "CHUNK", 3333)
    for a, b in zip(want, toxicity.fit_one(few, 2, 0, np.zeros((300, 2))), strict=True):
        assert np.array_equal(a, b)


def test_logistic_reaches_the_minimum():
    g = np.random.default_rng(9)
    rows = [np.sort(g.choice(30, 6, replace=False)) for _ in range(400)]
    y = np.array([float(3 in r or (5 in r and 7 not in r)) for r in rows])
    x = linear.Rows(np.arange(401) * 6, np.concatenate(rows), 30, np.ones((400, 1)))
    w = linear.logistic(x, y, ridge=1e-2, steps=400)
    dense = np.zeros((400, 31))
    for i, r in enumerate(rows):
        dense[i, r] = 1
    dense[:, 30] = 1
    gradient = dense.T @ (linear.sigmoid(dense @ w) - y) / 400 + 1e-2 * np.append(w[:30], 0)
    assert np.abs(gradient).max() < 1e-3
    assert np.allclose(x.dot(w), dense @ w) and np.allclose(x.back(y), dense.T @ y)


def test_tasks_and_driver_fit_the_same_chain(spark):
    r = random.Random(10)
    rows = [(i, " ".join(some_words(r, 30, 200)) + (f" vile{r.randrange(3)}" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = toxicity.train(d.drop("toxic"), d, ["toxic"])
    h = {x["doc_id"]: x["h"] for x in d.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    rows.sort(key=lambda x: h[x[0]])
    features = toxicity.Features()
    again = toxicity.fit([features.of(t) for _, t, _ in rows], np.array([[y] for *_, y in rows]), ["toxic"], np.array([h[i] % toxicity.FOLDS for i, *_ in rows]))
    assert chain.names == again.names and chain.threshold == pytest.approx(again.threshold)
    assert [set(w) for w in chain.weights] == [set(w) for w in again.weights] and chain.constant == pytest.approx(again.constant)


# --- WARC ------------------------------------------------------------------------------------------------------------


def test_warc_repeated_pages_and_headers(spark, tmp_path):
    big = "<p>x</p>" * 40
    rows = [(1, "http://a", big), (1, "http://a", big), (2, "http://b", big), (None, "http://c", big)] + [(i, f"http://h/{i}", f"page {i} " * 30) for i in range(10, 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    names = warc.write_archives(pages, str(tmp_path / "w"))
    got = [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(names, str(tmp_path / "w")).collect()]
    assert sorted(x for x in got if x[0] is not None and x[0] < 10) == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert (None, "revisit", 1) in got and len(got) == len(rows)
    ids, kinds = [], Counter()
    for r in names.collect():
        with open(tmp_path / "w" / r["name"], "rb") as f:
            records = [warc.parse(x) for x in warc.read_archive(f)]
        assert records[0][0]["WARC-Type"] == "warcinfo" and len(records) == r["records"] + 1
        for h, block in records:
            ids.append(h["WARC-Record-ID"])
            kinds[h["WARC-Type"]] += 1
            assert h["Content-Type"] in ("application/warc-fields", "application/http; msgtype=response") and int(h["Content-Length"]) == len(block)
            assert h["WARC-Type"] == "warcinfo" or block.startswith(b"HTTP/1.1 200 OK\r\n")
            if h["WARC-Type"] == "revisit":
                target = h["WARC-Refers-To"]
    assert target in ids and len(set(ids)) == len(ids) and kinds["warcinfo"] >= 1


def test_archives_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    out = warc.Writer(str(tmp_path), "2020-01-01T00:00:00Z")
    for i in range(60):
        out.add(i, f"http://h/{i}", f"{i:064x}", b"page " * 60, None)
    done = out.close()
    assert len(done) > 3 and sum(n for _, n, _ in done) == 60
    for name, n, size in done:
        assert (tmp_path / name).stat().st_size == size
        with open(tmp_path / name, "rb") as f:
            assert len(list(warc.read_archive(f))) == n + 1


def test_dictionary_sample_is_spread():
    records = [bytes([i]) * 20_000 for i in range(250)]
    got = warc.spread(records)
    assert sum(map(len, got)) <= warc.TRAIN_BYTES and {r[0] for r in got} >= {0, 246} and len(got) >= 80


# --- all -------------------------------------------------------------------------------------------------------------


def test_clashing_names(spark):
    """Unread columns may have any name; kept ones may not have those of results."""
    d = spark.createDataFrame([(1, "a b", 1, 2, "z", "y")], "doc_id long, text string, rid int, n_words int, spans string, c0 string")
    path = public_tokenizers.path(bpe.FILE)
    assert substring_dedup.substring_dedup(d, carry=("rid", "spans", "c0")).collect()[0].asDict() == {"doc_id": 1, "rid": 1, "spans": "z", "c0": "y", "n_words": 2, "n_removed": 0, "kept_sha256": "c8687a08aa5d6ed2044328fa6a697ab8e96dc34291e8c2034ae8c38e6fcc6d65"}
    assert bpe.bpe_columns(d, path, carry=("c0", "rid")).columns == ["doc_id", "c0", "rid", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    model = public_tokenizers.path(token_counts.MODEL)
    for make in (
        lambda: substring_dedup.substring_dedup(d, carry=("n_words",)),
        lambda: bpe.bpe_columns(d.withColumn("n_tokens", F.lit(1)), path, carry=("n_tokens",)),
        lambda: token_counts.token_counts(d.withColumnRenamed("doc_id", "n_bytes"), model, key="n_bytes"),
        lambda: fertility.quality_rules(d.withColumnRenamed("doc_id", "Kept"), PATHS, key="Kept", lang=None),
        lambda: lm_score.score(d.withColumnRenamed("doc_id", "score"), lm_score.train(d, d), key="score"),
        lambda: jaccard_join.near_duplicates(d.withColumnRenamed("doc_id", "class_id"), key="class_id"),
    ):
        with pytest.raises(ValueError, match="clash"):
            make()


def test_long_rows_come_in_small_batches(spark):
    common.tuned(spark)
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    d = spark.range(60, numPartitions=1).select(F.repeat(F.lit("x"), 500_000).alias("text"))
    assert max(r["n"] for r in d.mapInArrow(sizes, "n long").collect()) < 3 * common.BATCH_BYTES


def test_long_cuts_are_not_remembered():
    memo = token_counts.PieceMemo(public_tokenizers.path(token_counts.MODEL))
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    texts = ["x" * 5000 + " short", "y" * 100]
    assert [sum(x) for x in memo.of(texts)] == [len(lib.encode(t)) for t in texts]
    assert max(map(len, memo.memo)) <= token_counts.SHORT


def test_stashes_are_deleted(spark):
    import os

    a = common.stash(spark.range(3).toDF("x"))
    path = a._glossweave_path.removeprefix("file:")
    assert os.path.isdir(path)
    common.clear_stashes()
    assert not os.path.isdir(path) and not common._STASHED
