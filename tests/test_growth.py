"""Work that grows with the rows, not with their square: how many rows the joins of a plan made."""

from pyspark.sql import functions as F

from glossweave.operators import catalog
from glossweave.sources import corpus_files


def joined(df):
    """The rows of df, and the most that any join of its plan made."""
    rows = df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        m = node.metrics().get("numOutputRows")
        if "Join" in name and m.isDefined():
            most = max(most, m.get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


def test_work_folders_of_one_title(spark):
    new = spark.range(300).select(F.concat(F.lit("f"), "id").alias("name"), F.lit("The Title!").alias("title"), F.when(F.col("id") % 3 == 0, "Ada B.").when(F.col("id") % 3 == 1, "ada b").otherwise("Zed").alias("author"))
    folders = spark.range(300).select(F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("folder"), F.lit("the title").alias("title"), F.when(F.col("id") > 4, "Dr. Ada B").alias("author"))
    rows, most = joined(catalog.match_work(new, folders))
    assert {(r["name"], r["folder"]) for r in rows} == {(f"f{i}", None if i % 3 == 2 else "w005") for i in range(300)} and len(rows) == 300
    assert most <= 600


def test_slots_of_one_kind(spark):
    old = spark.range(300).select("id", F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "Ada B.").when(F.col("id") % 3 == 1, "Zed").alias("author"))
    new = spark.range(1000, 1300).select("id", F.lit("en").alias("lang"), F.lit("Dr. Ada B").alias("author"))
    df = catalog.overwrite_slots(old, new, ["lang"])
    rows, most = joined(df)
    assert sorted(r["id"] for r in rows) == [i for i in range(300) if i % 3] + list(range(1000, 1300))
    # authors are compared before, among distinct ones, not within the join of the rows
    assert most <= 600 and not any("LeftAnti" in x and "Contains(" in x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n"))


def test_file_pairs_of_a_large_work(spark, monkeypatch):
    monkeypatch.setattr(corpus_files, "PAIR_BLOCK", 7)
    f = spark.createDataFrame([(w, y % 4, f"n{y:02}") for w, n in ((1, 40), (2, 1), (3, 15)) for y in range(n)], "work int, year int, name string")
    rows, most = joined(corpus_files.file_pairs(f))
    want = {(w, a, m, b, n) for w, k in ((1, 40), (2, 1), (3, 15)) for a, m in ((y % 4, f"n{y:02}") for y in range(k)) for b, n in ((y % 4, f"n{y:02}") for y in range(k)) if (a, m) < (b, n)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) and rows[0].asDict().keys() == {"work", "year", "name", "year_b", "name_b"}
    plan = corpus_files.file_pairs(f)._jdf.queryExecution().optimizedPlan().toString()
    # a work's pairs are dealt by two blocks, not by the work alone
    assert "block_b" in plan


def test_lookup_of_common_words(spark, tmp_path):
    from glossweave.operators import retrieval
    from glossweave.operators.index import build_index

    side = lambda c: F.struct(F.lit(c).alias("lang_code"), F.lit(1900).alias("year"))
    links = F.array().cast("array<struct<source_idx:array<int>,target_idx:array<int>," + ",".join(f"{s}_{t}:string" for s in ("source", "target") for t in ("upos", "ner", "lemma")) + ">>")
    pairs = spark.range(200).select(F.col("id").alias("row_index"), F.concat(F.lit("p"), "id").alias("pair_id"), side("ang").alias("source"), side("eng").alias("target"), F.lit("the sun the moon").alias("source_text"), F.lit("x").alias("target_text"), links.alias("alignment_links"))
    index = build_index(pairs, str(tmp_path / "i"))
    # grams are stored for each different token; a posting for each place is a view
    assert index.words.count() == 4 and index.places.count() == 800
    assert index.grams.where("ngram = 'the'").count() == 400 and index.grams.count() == 200 * (2 * 5 + 5 + 6 + 3)
    q = spark.range(50).select(F.col("id").alias("query_id"), F.lit("the").alias("query"), F.lit("ang").alias("lang"), F.lit("eng").alias("target_lang"))
    rows, most = joined(retrieval.lookup_native(q, index))
    assert rows == [] and most <= 500
    rows, most = joined(retrieval.lookup(q, index))
    # all 50 ask the same: 200 rows are answered once, and stand for each at the end
    assert len(rows) == 10_000 and {tuple(r["matched"]) for r in rows} == {(0, 2)} and sorted(r["place"] for r in rows if r["query_id"] == 7) == list(range(200))
    assert retrieval.candidates(q, index).count() == 50 * 400


def test_nearest_holds_few_similarities(spark, monkeypatch):
    import numpy as np

    from glossweave.operators import serve

    monkeypatch.setattr(serve, "CELLS", 64, raising=False)
    g = np.random.default_rng(7)
    x = np.round(g.normal(size=(300, 4)), 1)
    v = spark.createDataFrame([(i, i % 2, r.tolist()) for i, r in enumerate(x)], "vec_id long, g long, embedding array<double>")
    q = v.where("vec_id < 40").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "g")
    got = {(r["query_id"], r["vec_id"]) for r in serve.nearest(q, v, 5, by=("g",), on="g").collect()}
    want = {(i, j) for i in range(40) for j in sorted(range(i % 2, 300, 2), key=lambda j: (-round(float(x[i] @ x[j]), 9), j))[:5]}  # noqa: B023
    assert got == want


def test_bm25_of_common_terms(spark, tmp_path):
    from glossweave.operators import retrieval
    from glossweave.operators.index import build_index

    side = lambda c: F.struct(F.lit(c).alias("lang_code"), F.lit(1900).alias("year"))
    pairs = spark.range(200).select(F.col("id").alias("row_index"), F.concat(F.lit("p"), "id").alias("pair_id"), side("ang").alias("source"), side("eng").alias("target"), F.concat(F.lit("the sun "), F.when(F.col("id") % 50 == 3, "moon").otherwise("")).alias("source_text"), F.lit("the").alias("target_text"))
    index = build_index(pairs, str(tmp_path / "i"))
    q = spark.range(30).select(F.col("id").alias("query_id"), F.lit("The sun moon").alias("query"), F.lit("ang").alias("lang"))
    rows, most = joined(retrieval.bm25(q, index))
    # every query meets every row, but no term of a pair is a row of a join
    assert len(rows) == 6000 and most <= 600
    best = {r["row_index"] for r in rows if r["bm25"] == max(x["bm25"] for x in rows)}
    assert best == {3, 53, 103, 153}
    few = retrieval.bm25(q, index, top=4).collect()
    assert best <= {r["row_index"] for r in few if r["query_id"] == 5}


def test_costly_steps_of_one_small_file(spark, sf):
    from glossweave.plans import queries

    for name in ("library_records", "catalogue_names"):
        df = queries.QUERIES[name](spark, sf)
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name
