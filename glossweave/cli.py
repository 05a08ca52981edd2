"""Command line: `python -m glossweave.cli COMMAND …`. Paths are of any file system that Spark reads."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import strip_boilerplate
from .operators import adapters, align, catalog, contrib, evaluate, modes
from .operators.index import build_index
from .sources import catalogue, corpus_files

PAIR = "pair_id string, source struct<lang_code:string,year:int,work:string,author:string>, target struct<lang_code:string,year:int,work:string,author:string>, source_text string, target_text string, citation string, sentence_confidence double, sentence_method string"


def _session() -> SparkSession:
    return SparkSession.builder.appName("glossweave").getOrCreate()


def _report(rows: DataFrame) -> None:
    """Rows of a report, of which there are few, a JSON object a line."""
    for r in rows.toJSON().toLocalIterator():
        print(r)


def cmd_index(a: argparse.Namespace) -> None:
    """Pairs of JSON lines to a served index, with the offline encoder's vectors."""
    spark = _session()
    pairs = corpus_files.read_jsonl(spark, a.pairs, PAIR)
    numbered = pairs.withColumn("row_index", F.monotonically_increasing_id())
    _report(build_index(numbered, a.out, embed=adapters.hashed_trigrams).stats)


def cmd_relational(a: argparse.Namespace) -> None:
    """Contributions, a JSON object a file, to the attestation index."""
    spark = _session()
    docs = spark.read.text(a.contributions, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").withColumnRenamed("value", "json")
    _report(contrib.build_relational_index(docs, a.out))


def editions(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, place, fields, unit_index, unit_text): lines of a corpus' text files, works being folders, without banners and blank lines."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    texts = raw.select("path", strip_boilerplate(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))
    files = corpus_files.discover(texts.select("path"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    keyed = texts.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), F.posexplode(lines).alias("unit_index", "unit_text"))
    return files.join(keyed, ["folder", "name"])


def cmd_align(a: argparse.Namespace) -> None:
    """All pairs of editions of each work, aligned without a model, as JSON lines."""
    spark = _session()
    units = editions(spark, a.corpus)
    files = units.select("folder", "place", "name", "lang_code", "year", "title", "author").distinct()
    both = corpus_files.file_pairs(files.select("folder", "year", "name", "place", "lang_code", "title", "author"), "folder")
    key = F.concat_ws("|", "folder", "name", "name_b").alias("work")
    first = both.join(units.select("folder", "name", "unit_index", "unit_text"), ["folder", "name"]).select(key, "unit_index", "unit_text")
    second = both.join(units.select("folder", F.col("name").alias("name_b"), "unit_index", "unit_text"), ["folder", "name_b"]).select(key, "unit_index", "unit_text")
    pairs = modes.align_pairs("algorithmic", first, second, "work")
    other = files.select("folder", F.col("name").alias("name_b"), F.struct("lang_code", "year", F.col("title").alias("work"), "author").alias("target"))
    named = both.join(other, ["folder", "name_b"]).select(key, "title", F.struct("lang_code", "year", F.col("title").alias("work"), "author").alias("source"), "target")
    corpus_files.write_jsonl(modes.records(pairs, named, "work", a.ingested_at), a.out)
    _report(evaluate.confidence_stats(corpus_files.read_jsonl(spark, a.out, PAIR).withColumn("n_links", F.lit(0))))


def cmd_split(a: argparse.Namespace) -> None:
    """A mixed text's sections, from a table of labels (chunk_index, section) as JSON lines; a folder a section."""
    spark = _session()
    text = corpus_files.read_texts(spark, a.text).select(F.lit(0).alias("doc_id"), "content")
    chunks = text.select("doc_id", F.posexplode(align.pack_paragraphs("content", F.lit(a.chars))).alias("chunk_index", "chunk"))
    labels = corpus_files.read_jsonl(spark, a.labels, "chunk_index int, section string").withColumn("doc_id", F.lit(0))
    catalog.sections(chunks, labels).where("section IS NOT NULL").select("section", "text").write.mode("errorifexists").partitionBy("section").text(a.out)


def cmd_compare(a: argparse.Namespace) -> None:
    """Two runs of JSON lines over one corpus' units (unit_text), as a report."""
    spark = _session()
    read = lambda p: corpus_files.read_jsonl(spark, p, PAIR)
    units = lambda p: corpus_files.read_jsonl(spark, p, "unit_text string")
    row = evaluate.compare_alignment(read(a.first), read(a.second), units(a.source_units), units(a.target_units)).first()
    print(evaluate.markdown(a.title, row.asDict()))


def cmd_survey(a: argparse.Namespace) -> None:
    """A crawl over stored links (page, place, url, …, decision) from one address; visits (url, kind, reasoning)."""
    spark = _session()
    schema = "page string, place int, url string, text string, context string, decision string, category string, related_to string, reasoning string"
    links = corpus_files.read_jsonl(spark, a.links, schema)
    visits = corpus_files.read_jsonl(spark, a.visits, "url string, kind string, reasoning string")
    documents = F.col("url").isin([r["url"] for r in visits.where("kind = 'document'").limit(a.max_pages).collect()])
    reached = catalog.crawl(spark.createDataFrame([(a.start,)], "url string"), catalog.followed(links), documents, corpus_files.shared_folder(spark), a.max_depth, a.max_pages)
    _report(catalog.survey_results(reached, links, visits, a.max_depth))


def cmd_catalogue(a: argparse.Namespace) -> None:
    """Documents of catalogued works: (work, xml), (urn, xml) and (work, year) as JSON lines, to JSON lines."""
    spark = _session()
    read = lambda p, schema: corpus_files.read_jsonl(spark, p, schema)
    docs = catalogue.resolve_documents(read(a.works, "work string, xml string"), read(a.files, "urn string, xml string"), read(a.years, "work string, year int"), a.source)
    corpus_files.write_jsonl(docs, a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glossweave")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, *places: str, **options) -> None:
        c = sub.add_parser(name, help=run.__doc__)
        c.set_defaults(run=run)
        for x in places:
            c.add_argument(x)
        for k, v in options.items():
            c.add_argument("--" + k.replace("_", "-"), type=type(v) if v is not None else str, default=v)

    add("index", cmd_index, "pairs", "out")
    add("relational", cmd_relational, "contributions", "out")
    add("align", cmd_align, "corpus", "out", ingested_at=None)
    add("split", cmd_split, "text", "labels", "out", chars=2000)
    add("compare", cmd_compare, "first", "second", "source_units", "target_units", title="Comparison")
    add("survey", cmd_survey, "start", "links", "visits", max_depth=3, max_pages=300)
    add("catalogue", cmd_catalogue, "works", "files", "years", "out", source="catalogue")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(a)


if __name__ == "__main__":
    main(sys.argv[1:])
