"""The pipeline's stages on the smallest tables, and on odd rows."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from glossweave.llm import registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_columns_and_filter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"rejected": F.lit(1), "row": F.lit("x"), "kept_text": F.lit("y"), "n": F.lit(2)})
    names = docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    toxic, clean = ({r["doc_id"] for r in labels if r["toxic"] == x} for x in (1, 0))
    before = {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k + 1 == len(corpus_pipeline.STAGES):
            assert {r["doc_id"] for r in out.collect()} == before
            break
        assert out.columns == names
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = {r["doc_id"] for r in docs.collect()}
        assert after <= before
        if name == "toxicity":
            assert not after & toxic and clean <= after
        if name == "substring_dedup":
            assert after == before
        before = after


def test_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (None, "some words here", "en", "s", 15), (4, "a b c", None, None, 5)]
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        got = out.collect()
        if name == "near_duplicates":
            assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 2, 3]
        else:
            assert len(got) == len(rows)
        empty = stage(spark, docs.where("false"), sf)
        assert empty.count() == 0


def test_registry_names():
    q = registry.queries()
    assert set(registry.oracle_sql()) <= set(q) and "pipeline" in q
    assert {int(k[2:].split("_")[0]) for k in q if k.startswith("op")} == set(range(1, 11))


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() <= spark.read.parquet(f"{sf}/documents.parquet").count()


@pytest.mark.parametrize("name", ["op1_decontaminate", "op6_fertility_rules"])
def test_queries_give_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_same_id_other_text(spark, sf):
    """Rows that share an id and not the text are documents of their own."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a + " x", "en", "s", 1), (None, b, "en", "s", 1), (1, a, "en", "s", 1)]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), sf).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(1, a), (1, b)]


def test_run_against_plain_python(spark, tmp_path):
    """All stages on a small corpus with cases of each: toxic rows, copies, shared passages, benchmark passages."""
    import hashlib
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(12)
    words = lambda n: [f"w{r.randrange(2000)}" for _ in range(n)]
    passage, items = words(60), [words(25) for _ in range(6)]
    docs, labels = [], []
    for i in range(400):
        w = words(r.randint(80, 160))
        kind = i % 10
        if kind == 1:
            w += [f"vile{r.randrange(6)}" for _ in range(4)]
        elif kind == 2 and i > 20:
            w = docs[i - 10][1].split()
            w[r.randrange(len(w))] = "other"
        elif kind == 3:
            w[40:40] = passage
        elif kind == 4:
            w[10:10] = items[r.randrange(6)]
        docs.append((i, " ".join(w), "en", "s", len(" ".join(w))))
        labels.append((i, 1, int(kind == 1)))
    spark.createDataFrame(docs, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x["doc_id"]: x["ids_sha256"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [(i, t.split()) for i, t, *_ in docs if i % 10 != 1]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in left}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    left = [(i, w) for i, w in left if top(i) == i]
    seen = {}
    for _, w in left:
        for k in range(len(w) - 34):
            seen[tuple(w[k : k + 35])] = seen.get(tuple(w[k : k + 35]), 0) + 1
    cut = []
    for i, w in left:
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        cut.append((i, [x for k, x in enumerate(w) if k not in gone]))
    leaks = {i for i, w in cut for x in items if any(w[k : k + 25] == x for k in range(len(w)))}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: hashlib.sha256(",".join(map(str, lib.encode(" ".join(w), add_special_tokens=False).ids)).encode()).hexdigest() for i, w in cut if i not in leaks}
    assert len(want) < len(left) < 360
    assert got == want
