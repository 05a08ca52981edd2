import pytest
from pyspark.sql import functions as F

from glossweave.operators import catalog, evaluate
from glossweave.sources import catalogue, pages

CTS = """<ti:work xmlns:ti="http://example.org/cts" xml:lang="grc"><ti:title xml:lang="lat">Carmina</ti:title><ti:title xml:lang="eng">Songs</ti:title>
<ti:edition urn="u1"><ti:label>L</ti:label></ti:edition><ti:edition/><ti:translation urn="u2" xml:lang="ger"><ti:description>D &mdash;</ti:description></ti:translation></ti:work>"""


def test_entries():
    got = catalogue.work_entries(CTS)
    assert [(e["title"], e["role"], e["urn"], e["lang"], e["label"], e["description"]) for e in got] == [("Songs", "edition", "u1", "grc", "L", ""), ("Songs", "translation", "u2", "deu", "", "D —")]
    assert catalogue.work_entries("<x/>") == [] and catalogue.work_entries("<broken") == [] and catalogue.work_entries(None) == []


@pytest.mark.parametrize(
    "text,name",
    [("Edited by Nora Field, Leeds: Moss", "Nora Field"), ("Quill, P.R., editor. Oslo: Birk", "Quill, P.R."), ("Translated by A. B.;", "A. B."), ("nothing", None), ("", None)],
)
def test_role_name(spark, text, name):
    assert spark.createDataFrame([(text,)], "t string").select(catalogue.role_name(F.col("t")).alias("x")).first()["x"] == name


def test_provenance(spark):
    d = spark.createDataFrame([("A (Gpt 4, 2023) AI draft", ""), ("ai draft", "made 2024"), ("plain (X, 1999)", "")], "l string, d string")
    assert [r["x"] and tuple(r["x"]) for r in d.select(catalogue.draft_provenance(F.col("l"), F.col("d")).alias("x")).collect()] == [("Gpt 4", 2023), ("AI", 2024), None]


def test_record():
    html = "<a class='featured-format-link' type='text/plain; charset=utf-8' href='/e/1.txt'>t</a><a class='x' type='text/plain' href='/no'>n</a><table id='bibrec'><tr><th>Author</th><td>A <b>B</b></td></tr><tr><th>Other</th><td>z</td></tr></table>"
    assert pages.library_record("http://h", html) == (["http://h/e/1.txt"], "Author: A B")
    assert pages.library_record("http://h", None) == ([], None)


def test_tei_header(spark):
    x = "<TEI><teiHeader><titleStmt><author>Au</author><editor role='translator'>Tr</editor><editor>Ed</editor></titleStmt><sourceDesc><biblStruct><monogr><imprint><date>1890-1914</date></imprint></monogr></biblStruct></sourceDesc></teiHeader><text><body><p>a <note>n</note>b</p></body></text></TEI>"
    h = spark.createDataFrame([(x,), ("<broken",)], "x string").select(catalogue.tei_header("x").alias("h")).select("h.*").collect()
    assert tuple(h[0]) == ("Tr", "Ed", "Au", "1890-1914") and tuple(h[1]) == (None,) * 4
    assert pages.tei_lines(x) == ["a b"]


def test_paths_and_folders(spark):
    p = spark.createDataFrame([("data/a/b/__cts__.xml",), ("data/a/__cts__.xml",), ("data/a/b/c/__cts__.xml",)], "path string")
    assert [r["path"] for r in catalogue.catalogue_paths(p).collect()] == ["data/a/b/__cts__.xml"]
    folders = spark.createDataFrame([("f1", 1400), ("f2", 1500)], "folder string, oldest_year int")
    new = spark.createDataFrame([("f1", 1300, "n1"), ("f1", 1350, "n0"), ("f2", 1500, "n2")], "folder string, year int, name string")
    assert [tuple(r) for r in catalog.rename_to_oldest(folders, new).collect()] == [("f1", "n1")]
    with pytest.raises(Exception, match="folder exists"):
        catalog.rename_to_oldest(folders, new.withColumn("name", F.lit("f2"))).collect()


def test_sections_need_all_labels(spark):
    c = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "doc_id int, chunk_index int, chunk string")
    lab = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "x")], "doc_id int, chunk_index int, section string")
    assert {r["section"]: r["text"] for r in catalog.sections(c, lab).collect()} == {"x": "a\n\nc", "y": "b"}
    with pytest.raises(Exception, match="labels don't match"):
        catalog.sections(c, lab.limit(2)).collect()


def test_markdown():
    assert evaluate.markdown("T", {"a": 0.5, "b": {"c": 2}}) == "## T\n\n- a: 0.5000\n- b:\n  - c: 2\n"


def test_role_name_finds_each_step_once(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(catalogue.role_name(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    # the words are split once, not anew within the functions of the lists made of them
    assert plan.count("split(") == 1
    long = " ".join(f"word{i}" for i in range(3000))
    d = spark.createDataFrame([(f"{long} Edited by Nora Field, Leeds: {long}",), (f"{long}. Quill, P.R., editor. {long}",)], "t string")
    assert [r["x"] for r in d.select(catalogue.role_name(F.col("t")).alias("x")).collect()] == ["Nora Field", "Quill, P.R."]
