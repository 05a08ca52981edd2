import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossweave.functions import scores, tags, text
from glossweave.operators.align import increasing_chain
from glossweave.sources import corpus_files, pages


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'int'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_tokenize(spark):
    assert one(spark, text.tokenize(F.col("t")), t="Þæt wæs gōd, cyning_1!") == ["Þæt", "wæs", "gōd", ",", "cyning_1", "!"]
    assert one(spark, text.tokenize(F.col("t")), t=None) == []


@pytest.mark.parametrize("word,n", [("sir", 5), ("", 1), ("aaaa", 5), ("Ab", 4)])
def test_trigrams(spark, word, n):
    got = one(spark, text.char_trigrams(F.col("t")), t=word)
    p = f"  {word.lower()}  "
    assert sorted(got) == sorted({p[i : i + 3] for i in range(len(p) - 2)})
    assert len(got) == n


def test_dice(spark):
    g = lambda c: text.char_trigrams(F.col(c))
    assert one(spark, text.dice(g("a"), g("b")), a="the", b="the") == 1.0
    assert one(spark, text.dice(g("a"), g("b")), a="abc", b="xyz") == 0.0
    assert one(spark, text.dice(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0


def test_curves(spark):
    assert one(spark, scores.max_edits(F.col("n")), n=0) == 0
    assert one(spark, scores.max_edits(F.col("n")), n=5) == 1
    assert one(spark, scores.max_edits(F.col("n")), n=7) == 2
    assert one(spark, scores.dice_threshold(F.col("n")), n=10) == pytest.approx(0.5 * (1 - math.exp(-1)))
    assert one(spark, scores.semantic_weight(F.col("n"), 2000), n=1800) == pytest.approx(math.exp(-1))
    assert one(spark, scores.semantic_weight(F.col("n"), 2000), n=2100) == 1.0


def test_boilerplate(spark):
    banner = "license\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\nbody\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nmore"
    assert one(spark, text.strip_boilerplate(F.col("t")), t=banner) == "body"
    assert one(spark, text.strip_boilerplate(F.col("t")), t=banner.split("\n*** END")[0]) == "body"
    assert one(spark, text.strip_boilerplate(F.col("t")), t="  plain ") == "plain"


def test_mojibake(spark):
    assert one(spark, text.fix_mojibake(F.col("t")), t="greenÑthe \x8e\x90") == "green—the éê"


def test_find_span(spark):
    assert one(spark, text.find_span(F.col("t"), F.col("s")), t=["A", "b", "A", "B"], s=["a", "b"]) == [0, 1]
    assert one(spark, text.find_span(F.col("t"), F.col("s")), t=["a"], s=["a", "b"]) is None
    assert one(spark, text.find_span(F.col("t"), F.col("s")), t=["a"], s=[]) is None


@pytest.mark.parametrize("raw,value", [("0.5", 0.5), ("7", 1.0), ("-1", 0.0), ("true", None), ("NaN", None), ("x", None), ("inf", 1.0)])
def test_confidence(spark, raw, value):
    assert one(spark, tags.parse_confidence(F.col("t")), t=raw) == value


def test_tags(spark):
    assert one(spark, tags.normalize_deprel(F.col("t")), t="NSUBJ:pass") == "nsubj:pass"
    assert one(spark, tags.normalize_upos(F.col("t")), t="thing") == "X"


def test_names(spark):
    f = one(spark, corpus_files.parse_name(F.col("t")), t="grc-BC490-Song-7_of_Ships-Anon_Y-Some_Library")
    assert (f["lang_code"], f["year"], f["title"], f["author"], f["source"]) == ("grc", -490, "Song-7_of_Ships", "Anon Y", "Some Library")
    assert one(spark, corpus_files.parse_name(F.col("t")), t="a-b-c") is None
    assert one(spark, corpus_files.plausible_author(F.col("a"), F.col("b")), a="Vergil", b="P. Vergilius Maro") is True
    assert one(spark, corpus_files.plausible_author(F.col("a"), F.col("b")), a="Unknown", b="Vergil") is False


def test_content_type(spark):
    assert one(spark, corpus_files.content_type(F.col("h"), F.col("u")), h="application/pdf", u="http://x.org/a.txt") == "pdf"
    assert one(spark, corpus_files.content_type(F.col("h"), F.col("u")), h=None, u="http://x.org/a.HTML") == "html"
    assert one(spark, corpus_files.content_type(F.col("h"), F.col("u")), h=None, u=None) == "txt"


def test_pages(spark):
    html = "<nav><a href='/n'>n</a></nav><p>See <a href='a.txt'>A</a> now</p><p><a href='#x'>x</a><a href='a.txt'>again</a></p><script>x</script>"
    assert pages.links("http://h/", html) == [("http://h/a.txt", "A", "See A now")]
    assert one(spark, pages.visible_text(F.col("t")), t="<p>A &amp; b</p><style>x</style><!-- c -->d") == "A & b\nd"
    assert pages.tei_lines("<t><body><l>a <note>no</note>b</l><p>c\n d</p></body></t>") == ["a b", "c d"]
    assert pages.tei_lines("<broken") == []


@given(st.lists(st.integers(0, 30), max_size=25))
@settings(max_examples=200, deadline=None)
def test_chain_is_longest(js):
    got = [js[k] for k in increasing_chain(js)]
    assert all(a < b for a, b in zip(got, got[1:], strict=False))
    best = [1] * len(js)
    for i in range(len(js)):
        best[i] += max([best[k] for k in range(i) if js[k] < js[i]], default=0)
    assert len(got) == max(best, default=0)
