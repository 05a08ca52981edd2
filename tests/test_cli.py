"""Commands on small folders, and the composites behind them."""

import json

import pytest
from pyspark.sql import functions as F

from glossweave import cli
from glossweave.operators import adapters, catalog, sense
from glossweave.operators.index import read_index
from glossweave.sources import catalogue


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_align_index_compare(spark, tmp_path, capsys):
    work = tmp_path / "corpus" / "w"
    work.mkdir(parents=True)
    a, b = ["alpha beta", "gamma delta", "omega tau"], ["alpha betas", "gamma deltas", "omegas tau"]
    (work / "ang-BC5-T-A-S.txt").write_text("head\n*** START OF THE PROJECT GUTENBERG EBOOK T ***\n" + "\n\n".join(a))
    (work / "eng-1900-T-B-S.txt").write_text("\n".join(b))
    cli.main(["align", str(tmp_path / "corpus"), str(tmp_path / "pairs"), "--ingested-at", "now"])
    got = sorted((json.loads(x) for f in (tmp_path / "pairs").glob("part*") for x in f.read_text().splitlines()), key=lambda x: x["pair_id"])
    assert [(x["pair_id"], x["source_text"], x["target_text"]) for x in got] == [(f"t_-5x1900_{i:05d}", a[i], b[i]) for i in range(3)]
    assert got[0]["source"] == {"lang_code": "ang", "year": -5, "work": "T", "author": "A"} and got[0]["metadata"]["ingested_at"] == "now"
    cli.main(["index", str(tmp_path / "pairs"), str(tmp_path / "index")])
    x = read_index(spark, str(tmp_path / "index"))
    assert x.pairs.count() == 3 and x.vectors.count() == 6 and x.grams.where("ngram = 'alp'").count() == 2
    units = [lines(tmp_path / f"u{k}.jsonl", [{"unit_text": t} for t in y]) for k, y in enumerate((a, b))]
    capsys.readouterr()
    cli.main(["compare", str(tmp_path / "pairs"), str(tmp_path / "pairs"), *units, "--title", "X"])
    out = capsys.readouterr().out
    assert out.startswith("## X") and "pair_precision: 1.0000" in out and "drop_rate_a: None" in out


def test_relational_and_split(spark, tmp_path, capsys):
    (tmp_path / "c").mkdir()
    doc = {"doc_type": "attestation", "origin": {"lang_code": "ang", "tokens": [{"surface": "bēam"}]}, "target": {"lang_code": "eng", "text": "tree"}, "metadata": {"date": {"year": 900}, "source": "s", "contributor": "c", "license": "l", "validation": {"status": "validated"}}}
    (tmp_path / "c" / "a.json").write_text(json.dumps(doc, indent=1))
    cli.main(["relational", str(tmp_path / "c"), str(tmp_path / "r")])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"iso_code": "ang", "year_from": 900, "year_to": 900, "n_rows": 1}
    (tmp_path / "m.txt").write_text("one\n\ntwo\n\nthree")
    labels = lines(tmp_path / "l.jsonl", [{"chunk_index": 0, "section": "A"}, {"chunk_index": 1, "section": "B"}, {"chunk_index": 2, "section": None}])
    cli.main(["split", str(tmp_path / "m.txt"), labels, str(tmp_path / "s"), "--chars", "5"])
    assert {r["section"]: r["value"] for r in spark.read.text(str(tmp_path / "s"), wholetext=True).collect()} == {"A": "one\n", "B": "two\n"}


def test_survey(spark, tmp_path, capsys):
    link = lambda page, place, url, decision, **more: {"page": page, "place": place, "url": url, "text": f"t{place}", "decision": decision, "reasoning": "why", **more}
    decided = [
        link("http://h/a", 0, "http://h/b", "follow"), link("http://h/a", 1, "http://h/x.txt", "candidate", category="old_text_candidate"), link("http://h/a", 2, "http://h/c", "candidate", category="bilingual_reference", related_to="R"),
        link("http://h/a", 3, "http://h/browse/authors/a", "follow"), link("http://h/a", 4, "http://h/no", "irrelevant"), link("http://h/a", 5, "http://h/u", "uncertain"), link("http://h/b", 0, "http://h/deep", "follow"), link("http://h/b", 1, "http://h/e", "candidate"),
    ]
    visits = [{"url": "http://h/a", "kind": "links"}, {"url": "http://h/b", "kind": "links"}, {"url": "http://h/c", "kind": "document"}]
    cli.main(["survey", "http://h/a", lines(tmp_path / "l", decided), lines(tmp_path / "v", visits), "--max-depth", "1"])
    got = {(r["title"], r.get("document_url")): r for r in map(json.loads, capsys.readouterr().out.strip().splitlines())}
    assert set(got) == {("http://h/c", "http://h/c"), ("t1", "http://h/x.txt"), ("t3", None), ("t5", None), ("t0", None), ("t1", None)}
    assert got["http://h/c", "http://h/c"]["category"] == "bilingual_reference" and got["http://h/c", "http://h/c"]["related_to"] == "R" and got["t1", "http://h/x.txt"]["chain"] == ["http://h/a", "http://h/x.txt"]
    assert got["t0", None]["chain"] == ["http://h/a", "http://h/b", "http://h/deep"] and got["t0", None]["reasoning"].startswith("beyond")


def test_catalogued_documents(spark):
    cts = """<work xmlns="c" xml:lang="grc"><title xml:lang="eng">Songs</title><edition urn="u:1"/><edition urn="u:2" xml:lang="eng"><description>Glossary. Jane Roe, editor. Oslo: Birk, 1888</description></edition>
    <translation urn="u:3" xml:lang="eng"/><translation urn="u:4" xml:lang="eng"><label>x AI draft (Bot 2, 2024)</label></translation><translation urn="u:5" xml:lang="fre"/><commentary urn="u:6"/><translation urn="u:7" xml:lang="eng"/></work>"""
    tei = lambda head, date, body: f"<TEI><teiHeader><titleStmt>{head}</titleStmt><sourceDesc><biblStruct><monogr><imprint><date>{date}</date></imprint></monogr></biblStruct></sourceDesc></teiHeader><text><body><p>{body}</p></body></text></TEI>"
    files = [("u:1", tei("<author>Homer</author>", "1900", "a")), ("u:2", tei("", "", "g")), ("u:3", tei("<author>Homer</author><editor role='translator'>Tr</editor>", "1890-1914", "t")), ("u:4", tei("<author>Homer</author>", "", "d")), ("u:5", tei("", "none", "f")), ("u:6", tei("", "1900", "c"))]
    got = catalogue.resolve_documents(spark.createDataFrame([("w", cts)], "work string, xml string"), spark.createDataFrame(files, "urn string, xml string"), spark.createDataFrame([("w", -600)], "work string, year int"), "S").collect()
    assert {r["urn"]: (r["lang_code"], r["year"], r["author"], r["original_author"], r["role"], r["content"]) for r in got} == {
        "u:1": ("grc", -600, "Homer", "Homer", "edition", "a"), "u:2": ("eng", 1888, "Jane Roe", "unknown", "edition", "g"), "u:3": ("eng", 1914, "Tr", "Homer", "translation", "t"), "u:4": ("eng", 2024, "Bot 2", "Homer", "translation", "d"),
    }


def test_inventory_build_goes_on(spark, tmp_path):
    d = spark.createDataFrame([("a.n.01", "n", "a tree"), ("b.n.01", "n", "a light")], "sense_id string, pos string, definition string")
    calls = []

    def embed(c):
        calls.append(1)
        return adapters.hashed_trigrams(c)

    assert sense.build_inventory(d.limit(1), str(tmp_path / "i"), embed, "m").count() == 1
    got = sense.build_inventory(d, str(tmp_path / "i"), embed, "m")
    assert got.count() == 2 and spark.read.parquet(str(tmp_path / "i")).count() == 2 and sense.build_inventory(d, str(tmp_path / "i"), embed, "other").count() == 2
    near = sense.nearest_sense(d.select(F.col("sense_id").alias("gloss_id"), "pos", adapters.hashed_trigrams(F.col("definition")).alias("vector")), got)
    assert {r["gloss_id"]: r["sense_id"] for r in near.collect()} == {"a.n.01": "a.n.01", "b.n.01": "b.n.01"}


def test_unknown_command():
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
    assert catalog.followed is not None
