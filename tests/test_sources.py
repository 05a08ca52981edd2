"""Pages, files, names, folders, memos and crawls on small cases."""

import html
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from glossweave.operators import acquire, adapters, catalog, evaluate
from glossweave.sources import catalogue, corpus_files, pages


class Plain(HTMLParser):
    """Texts outside furniture of well-formed pages, by a stack of open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in pages.VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        assert self.stack.pop() == tag

    def handle_data(self, data):
        if not set(self.stack) & set(pages.CHROME):
            self.out.append("\n" if not data.strip() and "\n" in data else " " if not data.strip() else data)


def test_text_of_wellformed_pages():
    r = random.Random(1)

    def element(depth):
        tag = r.choice(["p", "div", "b", "li", "nav", "header", "footer", "span", "em"])
        inner = "".join(element(depth - 1) if depth and r.random() < 0.6 else r.choice(["x ", html.escape("a<b & c"), " ", "\n ", "&eacute;&#233;&mdash;", "<br>", "<!-- no -->"]) for _ in range(r.randint(0, 4)))
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(300):
        page = "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body>" + "".join(element(3) for _ in range(3)) + "</body></html>"
        p = Plain()
        p.feed(page.replace("<!-- no -->", ""))
        p.close()
        # without comments texts on either side of one are one; the pages have them between elements or texts
        if "<!--" not in page:
            assert pages.text_of(page) == "\n".join(p.out)


def test_entities_and_broken_markup(spark):
    cases = {
        "<p>caf&eacute; &#233; &mdash; x&nbsp;y &amp;lt; &#x41;": "café é — x\xa0y &lt; A",
        "<p>one<p>two</div></p>": "one\ntwo",
        "a<script>if (a<b) x()</script>b<STYLE>p</STYLE>c": "a\nb\nc",
        "<nav>menu<div>more</nav>text": "text",
        "<ul><li>a<li>b</ul>": "a\nb",
        "x &unknown; &lt y": "x &unknown; < y",
        None: "",
        "": "",
    }
    d = spark.createDataFrame([(k,) for k in cases], "h string").select("h", pages.visible_text(F.coalesce("h", F.lit(""))).alias("t")).collect()
    assert {r["h"]: r["t"] for r in d} == cases


def test_links():
    page = """<nav><a href="/menu">menu</a></nav><header><p><a href=/h>h</a></p></header>
    <ul><li>A <i>hint</i> (<a href=" /one ">one<b>two</b></a>) after<li><a href="/one">again</a></ul>
    <p>para <a href="JavaScript:void(0)">js</a> <a href="#x">x</a> <a href="">e</a> <a name="n">n</a> <a href="two.txt"><img src=q></a></p>
    <a href="http://other/x?a=1&amp;b=2">free</a> <a href="/none"><img></a><table><tr><td><a href="/row">r</a></td><td>cell</td></tr></table><a href="http://[bad">bad</a>"""
    assert pages.links("http://h/d/p", page) == [
        ("http://h/one", "one two", "A hint ( one two ) after again"), ("http://h/d/two.txt", "", "para js x e n"), ("http://other/x?a=1&b=2", "free", "free"), ("http://h/row", "r", "r cell"),
    ]
    assert pages.links(None, None) == []
    assert pages.page_scope("<title> T </title><p>some  text</p><nav>n</nav>", "u") == ("T", "T some  text") and pages.page_scope("<p>x", "u")[0] == "u"


def test_addresses(spark):
    d = spark.createDataFrame([("http://h/a.TXT?x=.html",), ("http://h/a.pdf#p",), ("http://h/a.html",), ("http://h/txt",), (None,), ("http://h/browse/authors/a#a1",), ("http://h/x/browse/authors/",)], "u string")
    got = d.select(pages.is_document(F.col("u")).alias("d"), pages.is_author_listing(F.col("u")).alias("l")).collect()
    assert [r["d"] for r in got] == [True, True, False, False, False, False, False] and [r["l"] for r in got] == [False] * 5 + [True, False]


def test_texts_and_pdfs(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("þe".encode())
    (tmp_path / "b.txt").write_bytes("þe x".encode("latin-1"))
    assert sorted(r["content"] for r in corpus_files.read_texts(spark, str(tmp_path)).collect()) == sorted(["þe", b"\xfee x".decode("utf-8", "replace")])
    (tmp_path / "c.doc").write_bytes(b"x")
    with pytest.raises(Exception, match="not a text file"):
        corpus_files.read_texts(spark, str(tmp_path)).collect()
    (tmp_path / "d.pdf").write_bytes(b"one|tw\xc2\x8eo|three")
    got = corpus_files.read_pdfs(spark, str(tmp_path), lambda b: b.decode().split("|"), most=2).collect()
    assert [r["content"] for r in got] == ["one\n\ntwéo"]


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("sources:\n- url: http://a\n  folder: f\n  other: 1\n- url: http://b\n")
    assert [tuple(r) for r in corpus_files.read_yaml(spark, str(tmp_path / "s.yaml"), "url string, folder string", "sources").collect()] == [("http://a", "f"), ("http://b", None)]
    assert corpus_files.read_yaml(spark, str(tmp_path / "none.yaml"), "url string").count() == 0


def test_discover(spark):
    good = [("r/w1/eng-1900-T-A-S.txt",), ("r/w1/ang-BC5-T-A-S.PDF",), ("r/w1/notes.md",), ("r/w2/eng-1900-T-A-S.txt",), ("r/w2/fra-1900-T_x-A_b-S.txt",)]
    got = corpus_files.discover(spark.createDataFrame(good, "path string")).orderBy("folder", "place").collect()
    assert [(r["folder"], r["place"], r["lang_code"], r["year"], r["author"]) for r in got] == [("r/w1", 0, "ang", -5, "A"), ("r/w1", 1, "eng", 1900, "A"), ("r/w2", 0, "eng", 1900, "A"), ("r/w2", 1, "fra", 1900, "A b")]
    with pytest.raises(Exception, match="fewer than two"):
        corpus_files.discover(spark.createDataFrame(good[:1], "path string")).collect()
    with pytest.raises(Exception, match="five fields"):
        corpus_files.discover(spark.createDataFrame([*good, ("r/w2/other.txt",)], "path string")).collect()


def test_names_need_all_fields(spark):
    d = lambda *x: spark.createDataFrame([x], "l string, y int, t string, a string, s string").select(corpus_files.build_name(*(F.col(c) for c in "lytas")).alias("n"))
    assert d("ang", -5, "A  b!", "C", "D e").first()["n"] == "ang-BC5-A_b-C-D_e"
    for bad in (("ang", 5, "!!", "C", "D"), ("", 5, "t", "C", "D"), ("ang", 5, "t", None, "D"), ("a-b", 5, "t", "C", "D"), ("ang", None, "t", "C", "D")):
        with pytest.raises(Exception, match="a name"):
            d(*bad).collect()


def test_role_names_and_drafts(spark):
    cases = {
        "Old work. Edited by A. B. Stone, Jr., New York: Press, 1900": "A. B. Stone, Jr., New York: Press, 1900", "Translated  by Mary Jones, Leeds: Moss": "Mary Jones", "text edited by X Y;": "X Y",
        "A long title 1850. Jane Roe, translator. Oslo: Birk": "Jane Roe", "Translators: none": None, "the editors of it": "the", "edited by": None, None: None,
    }
    got = {r["t"]: r["x"] for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", catalogue.role_name(F.col("t")).alias("x")).collect()}
    assert got == cases
    drafts = [("Work (AI draft)", "by (Some Model-3, 2024), (x)", ("Some Model-3", 2024)), ("(M, 999) AI Draft", "(N, 2000)", ("M", 999)), ("ai draft of 1999 and 2001", None, ("AI", 2001)), ("(M, 1999)", "drafty", None), ("AI  draft", "", None), ("(1M, 1999) AI draft", "", ("AI", 1999))]
    d = spark.createDataFrame([x[:2] for x in drafts], "l string, d string").select(catalogue.draft_provenance(F.col("l"), F.col("d")).alias("x")).collect()
    assert [r["x"] and tuple(r["x"]) for r in d] == [x[2] for x in drafts]


def test_acquire(spark):
    fetched = [("u1", "text/html", "http://h/1", "<p>þe</p><nav>x</nav>".encode()), ("u2", "", "http://h/2.pdf", b"p1|p2|p3|p4"), ("u3", "text/plain", "http://h/3", "þe".encode("latin-1"))]
    read = acquire.previews(spark.createDataFrame(fetched, "url string, content_type string, final_url string, raw binary"), lambda b: b.decode().split("|"))
    assert {r["url"]: (r["kind"], r["text"], r["preview"]) for r in read.collect()} == {"u1": ("html", "þe", "þe"), "u2": ("pdf", None, "p1\n\np2\n\np3"), "u3": ("txt", "þe", "þe")}
    names = spark.createDataFrame([(f"u{i}", "ang", 900 + i, "T", "A", "S") for i in (1, 2, 3)], "url string, lang_code string, year int, title string, author string, source string")
    entries = spark.createDataFrame([("u1", "own")], "url string, folder string")
    got = {r["url"]: (r["folder"], r["filename"]) for r in acquire.acquired(read, names, entries).collect()}
    assert got == {"u1": ("own", "ang-901-T-A-S.txt"), "u2": ("ang-902-T-A-S", "ang-902-T-A-S.pdf"), "u3": ("ang-903-T-A-S", "ang-903-T-A-S.txt")}
    same = names.withColumn("year", F.lit(900)).join(fetched_txt := spark.createDataFrame([("u1",), ("u3",)], "url string"), "url")
    with pytest.raises(Exception, match="refusing to overwrite"):
        acquire.acquired(read.join(fetched_txt, "url"), same).collect()


def test_structured_documents_take_slots(spark):
    cols = "folder string, filename string, lang_code string, year int, title string, author string, source string, role string, content string"
    old = [("w1", "grc-BC400-Cantica-Plato-X.txt", "grc", -400, "Cantica", "Plato", "X", "edition", "old"), ("w1", "eng-1894-Cantica-Marlow-X.txt", "eng", 1894, "Cantica", "Marlow", "X", "translation", "b"), ("w1", "eng-1894-Cantica-Tanner-X.txt", "eng", 1894, "Cantica", "Tanner", "X", "translation", "s"), ("w0", "grc-BC100-Cantica-Other-X.txt", "grc", -100, "Cantica", "Other", "X", "edition", "o")]
    new = [("k", "grc", -380, "CANTICA!", "Plato", "Plato of Athens", "P", "edition", "new"), ("k", "eng", 1894, "CANTICA!", "R. Marlow", "Plato of Athens", "P", "translation", "nb"), ("m", "lat", 10, "Fresh", "Ovid", "Ovid", "P", "edition", "f")]
    docs = spark.createDataFrame(new, "work string, lang_code string, year int, title string, author string, original_author string, source string, role string, content string")
    got = {(r["folder"], r["author"], r["content"]) for r in acquire.merge_structured(spark.createDataFrame(old, cols), docs).collect()}
    assert got == {("w0", "Other", "o"), ("w1", "Tanner", "s"), ("w1", "Plato", "new"), ("w1", "R. Marlow", "nb"), ("lat-10-Fresh-Ovid-P", "Ovid", "f")}


def test_memo_grows(spark, tmp_path):
    path, calls = str(tmp_path / "memo"), []

    def compute(left):
        calls.append(sorted(r["key"] for r in left.collect()))
        return left.where("key != 3").withColumn("result", F.concat(F.lit("r"), F.col("key").cast("string")))

    keys = lambda *x: spark.createDataFrame([(i,) for i in x], "key long")
    run = lambda k, f="f": {r["key"]: r["result"] for r in catalog.get_or_compute(k, path, f, "key", compute, "key long, result string").collect()}
    assert run(keys(1, 2, 3)) == {1: "r1", 2: "r2"} and run(keys(2, 3, 4)) == {2: "r2", 4: "r4"} and run(keys(1), "other") == {1: "r1"}
    assert calls == [[1, 2, 3], [3, 4], [1]]
    assert [r["key"] for r in catalog.rows_to_do(keys(1, 2, 3), keys(2), "key").orderBy("key").collect()] == [1, 3]


def test_crawl_is_a_queue_with_budgets(spark, tmp_path):
    e = [("a", "z", 0, 1.0), ("a", "b", 1, 1.0), ("a", "d.txt", 2, 1.0), ("z", "m", 0, 5.0), ("b", "m", 0, 1.0), ("b", "c", 1, 1.0), ("m", "n", 0, 1.0), ("n", "o", 0, 1.0), ("d.txt", "p", 0, 1.0), ("c", "a", 0, 1.0)]
    edges = spark.createDataFrame(e, "src string, dst string, place int, cost double")
    seeds = spark.createDataFrame([("a",)], "url string")
    run = lambda **more: {r["url"]: (r["depth"], r["chain"]) for r in catalog.crawl(seeds, edges, F.col("url").endswith(".txt"), str(tmp_path), **more).collect()}
    assert run() == {"a": (0, ["a"]), "z": (1, ["a", "z"]), "b": (1, ["a", "b"]), "d.txt": (1, ["a", "d.txt"]), "m": (2, ["a", "z", "m"]), "c": (2, ["a", "b", "c"]), "n": (3, ["a", "z", "m", "n"])}
    assert set(run(max_pages=2)) == {"a", "z", "b", "d.txt", "m"}
    assert set(run(max_cost=1.5)) == {"a", "z", "b", "d.txt", "m"} and set(run(max_cost=7.0)) == {"a", "z", "b", "d.txt", "m", "c"} and set(run(max_depth=0)) == {"a"}


def test_snapshot_usage_and_jsonl(spark, tmp_path):
    from datetime import datetime

    spark.range(3).write.parquet(str(tmp_path / "pairs.v1.parquet"))
    p = evaluate.snapshot(spark, str(tmp_path / "pairs.v1.parquet"), "run1", datetime(2020, 1, 2, 3, 4, 5))
    assert p.endswith("/pairs.v1.baseline_run1_20200102T030405.parquet") and spark.read.parquet(p).count() == 3
    with pytest.raises(Exception, match="already exists"):
        evaluate.snapshot(spark, str(tmp_path / "pairs.v1.parquet"), "run1", datetime(2020, 1, 2, 3, 4, 5))
    u = evaluate.usage_totals(spark.createDataFrame([(1, 2, 0.5), (None, 3, None)], "prompt_tokens int, completion_tokens int, cost_usd double")).first()
    assert tuple(u) == (2, 1, 5, 6, 0.5)
    assert tuple(evaluate.usage_totals(spark.createDataFrame([], "prompt_tokens int, completion_tokens int, cost_usd double")).first()) == (0, 0, 0, 0, 0.0)
    corpus_files.write_jsonl(spark.createDataFrame([("þ", None)], "a string, b int"), str(tmp_path / "j"))
    assert corpus_files.read_jsonl(spark, str(tmp_path / "j"), "a string, b int").collect() == [("þ", None)]
    assert "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "j").glob("part*")) == '{"a":"þ","b":null}\n'


def test_reviews_and_cleaning(spark):
    u = spark.createDataFrame([("d", i, f"u{i}") for i in range(5)], "doc_id string, unit_index int, unit_text string")
    r = spark.createDataFrame([("d", 0, '["a", " ", "c"]'), ("d", 1, '["only one"]')], "doc_id string, batch int, reply string")
    assert [x["unit_text"] for x in adapters.reviewed_units(u, r, size=3).orderBy("unit_index").collect()] == ["a", "u1", "c", "u3", "u4"]
    chunks = spark.createDataFrame([("d", 0), ("d", 1), ("e", 0)], "doc_id string, chunk_index int")
    replies = spark.createDataFrame([("d", 0, '[" x ", "", "y"]'), ("d", 1, '["z"]'), ("e", 0, "[]")], "doc_id string, chunk_index int, reply string")
    got = adapters.cleaned_units(chunks, replies)
    assert [(x["doc_id"], x["chunk_index"], x["unit_index"], x["unit_text"]) for x in got.orderBy("doc_id", "unit_index").collect()] == [("d", 0, 0, "x"), ("d", 0, 1, "y"), ("d", 1, 2, "z")]
    assert [tuple(x) for x in adapters.chunk_unit_counts(got).orderBy("chunk_index").collect()] == [("d", 0, 2, 2), ("d", 1, 1, 3)]
    assert [tuple(x) for x in adapters.unit_prompt(u.limit(2)).collect()] == [("d", "0. u0\n1. u1")]
    with pytest.raises(Exception, match="bad reply"):
        adapters.cleaned_units(chunks, replies.where("chunk_index = 0")).collect()


def test_work_titles_are_normalised(spark):
    new = spark.createDataFrame([("n1", "The  WORK!", "Plato"), ("n2", "other", "Plato")], "name string, title string, author string")
    f = spark.createDataFrame([("f2", "the work", "Plato"), ("f1", "The work", "Plato of Athens"), ("f0", "the work", "Unknown")], "folder string, title string, author string")
    assert {r["name"]: r["folder"] for r in catalog.match_work(new, f).collect()} == {"n1": "f1", "n2": None}


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://host:1"

        def getConf(self):  # noqa: N802
            return {}

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        corpus_files.shared_folder(Session())


def test_local_models_and_sections(spark):
    rows = [("ollama", None), (None, "http://localhost:1/v1"), ("openai", "http://10.1.2.3"), ("openai", "https://api.host.com"), ("x", "http://[::1]/"), (None, None), ("x", "http://[bad")]
    d = spark.createDataFrame(rows, "p string, b string").select(adapters.is_local(F.col("p"), F.col("b")).alias("x")).collect()
    assert [r["x"] for r in d] == [True, True, True, False, True, False, False]
    c = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id int, chunk_index int, chunk string")
    lab = spark.createDataFrame([(1, 0, "x"), (1, 1, None)], "doc_id int, chunk_index int, section string")
    want = lambda *n: spark.createDataFrame([(1, x) for x in n], "doc_id int, section string")
    assert [(r["section"], r["text"]) for r in catalog.sections(c, lab, wanted=want("x")).collect()] == [("x", "a")]
    with pytest.raises(Exception, match="no text for section"):
        catalog.sections(c, lab, wanted=want("x", "y")).collect()
