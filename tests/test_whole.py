"""Queries that do their whole job: all items, all words, all tokens."""

from glossweave.plans import queries as q


def saved(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_verbatim_all_items(spark, tmp_path):
    long = "One two three four five six seven eight nine ten eleven"
    items = [(0, "alpha beta gamma"), (55, long), (70, "x"), (71, "two words"), (99, None)]
    docs = [(1, f"so  {long.upper()}\nend"), (2, "alpha beta delta"), (3, "xalpha\tbeta gammay"), (4, None), (5, long[:-7]), (6, "a two  Words b")]
    d = saved(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in q.verify_verbatim(spark, d).collect()}
    flat = lambda t: " ".join((t or "").lower().split())
    assert got == {(i, k) for i, t in docs for k, p in items if p and flat(p) in flat(t)}
    assert {(1, 55), (3, 0), (6, 71)} <= got and (2, 0) not in got


def test_contributions_of_all_words(spark, tmp_path):
    text = "Eins zwei drei vier fünf Ende sechs"
    docs = [(1, text, "de", "s"), (2, "Ea Eb Ec Ed five", "de", "s"), (3, "x", "de", "s")]
    d = saved(spark, tmp_path, documents=(docs, "doc_id long, text string, lang string, source string"))
    got = {r["attestation_year"]: r["form"] for r in q.contribution_rows(spark, d).collect()}
    assert got == {1001: "zwei drei vier fünf sechs", 1002: "five"}
    assert [tuple(r) for r in q.relational_partition_ranges(spark, d).collect()] == [("de", 1001, 1002, 2)]
    assert q._contributions(spark, d).where("doc_id = 1").selectExpr("size(origin.tokens) AS n").first()["n"] == 7


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_all_tokens_compared_and_tagged(spark, tmp_path):
    talk = [(1, 0, "user", "the tión größe, tion 12"), (1, 1, "assistant", "ande ändé grösse. Ande 13")]
    d = saved(spark, tmp_path, conversations=(talk, "conv_id long, turn long, role string, text string"))
    a, b = ["the", "tión", "größe", ",", "tion", "12"], ["ande", "ändé", "grösse", ".", "Ande", "13"]
    got = {r["token_index"]: r["distance"] for r in q.edit_distance_pairs(spark, d).collect()}
    assert got == {i: levenshtein(x.lower(), y.lower()) for i, (x, y) in enumerate(zip(a, b, strict=True))}
    assert sorted(r["token"] for r in q.classify_resolve(spark, d).collect()) == sorted(a + b)
