"""Corpus files: scans, names of five fields, partitioned sinks. A missing source reads as an empty table of its schema."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import bound, fix_mojibake, match_key, sanitize_field


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. In local mode a temporary folder serves where it is unset; a cluster must name one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="glossweave-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores: for costly steps on rows that are small, whose files make few tasks."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def read_parquet(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Read with an explicit schema; empty where nothing is there."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One record a line; blank lines are no records; a record that can't be read fails the job."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


#: Suffixes of files that are texts of the corpus.
SUFFIXES = (".txt", ".pdf")


def _failed(message: Column, dies: Column) -> Column:
    """True, or the job's end with a message."""
    return F.when(dies, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole text files in UTF-8; what is none is replaced. The job fails at a file of another suffix."""
    raw = spark.read.format("binaryFile").load(path)
    other = ~F.lower("path").endswith(".txt")
    return raw.where(_failed(F.concat(F.lit("not a text file: "), "path"), other)).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def read_pdfs(spark: SparkSession, path: str, pages_of: Callable[[bytes], list[str]], most: int | None = None) -> DataFrame:
    """(path, content): the texts of a document's pages (of the first ones, for a preview), a blank line between, and characters of fonts without a map mended.

    pages_of reads a document; it is given, as no library for it is assumed.
    """

    @F.pandas_udf("string")
    def text(data: pd.Series) -> pd.Series:
        return data.map(lambda x: "\n\n".join(p or "" for p in pages_of(bytes(x))[:most]))

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return raw.select("path", fix_mojibake(text(F.col("content"))).alias("content"))


def read_yaml(spark: SparkSession, path: str, schema: StructType | str, key: str | None = None) -> DataFrame:
    """A worklist or manifest as rows: a list of mappings, or the list below a key. An empty or missing file has no rows; unknown entries are dropped, absent ones null."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs the yaml package") from e
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    loaded = yaml.safe_load("\n".join(r["value"] for r in spark.read.text(path).collect()))  # a worklist is written by hand
    rows = (loaded or {}).get(key) if key else loaded
    empty = spark.createDataFrame([], schema)
    return spark.createDataFrame([tuple((r or {}).get(c) for c in empty.columns) for r in rows or []], schema)


def discover(files: DataFrame) -> DataFrame:
    """(folder, place, name, lang_code, year, title, author, source) of a listing (path): files of the corpus' suffixes, told by their names, in order of year and
    name within their folder. The job fails at a name that can't be told and at a folder with fewer than two files."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    known = F.lit(False)
    for suffix in SUFFIXES:
        known = known | F.lower("path").endswith(suffix)
    x = files.where(known).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), name.alias("name"), parse_name(stem).alias("f"))
    x = x.where(_failed(F.concat(F.lit("a name without its five fields: "), "name"), F.col("f").isNull()))
    few = F.count("*").over(Window.partitionBy("folder")) < 2
    x = x.withColumn("few", few).where(_failed(F.concat(F.lit("fewer than two editions in "), "folder"), F.col("few"))).drop("few")
    place = F.row_number().over(Window.partitionBy("folder").orderBy("f.year", "name")) - 1
    return x.withColumn("place", place).select("folder", "place", "name", "f.*")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One record a line, in UTF-8; null fields stay."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").option("encoding", "UTF-8").json(path)


def decode_bytes(data: Column) -> Column:
    return F.when(F.is_valid_utf8(data.cast("string")), F.decode(data, "utf-8")).otherwise(F.decode(data, "iso-8859-1"))


def parse_name(stem: Column) -> Column:
    """lang, year (BC negative), title, author, source of `<lang>-<year>-<title...>-<author>-<source>`; null if there are fewer fields."""
    part = F.split(stem, "-")
    n = F.size(part)
    bc = F.regexp_extract(part[1], "^BC([0-9]+)$", 1)
    year = F.when(bc != "", -bc.try_cast("int")).otherwise(part[1].try_cast("int"))
    spaced = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    made = F.struct(part[0].alias("lang_code"), year.alias("year"), F.array_join(F.slice(part, F.lit(3), F.greatest(n - 4, F.lit(1))), "-").alias("title"), spaced(F.try_element_at(part, F.lit(-2))).alias("author"), spaced(F.try_element_at(part, F.lit(-1))).alias("source"))
    return F.when((n >= 5) & year.isNotNull(), made)


def build_name(lang: Column, year: Column, title: Column, author: Column, source: Column) -> Column:
    """The name that parse_name reads; the job fails at a field that is empty once it is made safe, and at one that would be read otherwise."""
    y = F.when(year < 0, F.concat(F.lit("BC"), (-year).cast("string"))).otherwise(year.cast("string"))
    fields = [sanitize_field(c) for c in (title, author, source)]
    name = F.concat_ws("-", lang, y, *fields)
    empty = F.coalesce(lang, F.lit("")) == ""
    for f in fields:
        empty = empty | (F.coalesce(f, F.lit("")) == "")
    back = parse_name(name)
    spaced = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    same = (back["lang_code"] == lang) & (back["year"] == year) & (back["title"] == fields[0]) & (back["author"] == spaced(fields[1])) & (back["source"] == spaced(fields[2]))
    return F.when(empty, F.raise_error(F.concat(F.lit("a name needs all fields: "), name))).when(~F.coalesce(same, F.lit(False)), F.raise_error(F.concat(F.lit("a name that reads otherwise: "), name))).otherwise(name)


def pair_slug(lang_a: Column, year_a: Column, lang_b: Column, year_b: Column) -> Column:
    return F.concat(lang_a, F.lit("-"), year_a.cast("string"), F.lit("_"), lang_b, F.lit("-"), year_b.cast("string"))


def plausible_author(a: Column, b: Column) -> Column:
    """Equal or, from three characters on, one within the other; `unknown` matches itself alone; empty matches nothing."""

    def fits(k: Column) -> Column:
        x, y = k["x"], k["y"]
        short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
        return F.when((x == "") | (y == ""), False).when((x == "unknown") | (y == "unknown"), x == y).otherwise((x == y) | ((F.length(short) >= 3) & F.contains(long, short)))

    return bound(F.struct(match_key(a).alias("x"), match_key(b).alias("y")), fits)


def content_type(header: Column, url: Column) -> Column:
    """txt, pdf, html or xml by the header, else by the path's suffix; txt where neither tells."""
    h, p = F.lower(F.coalesce(header, F.lit(""))), F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return (
        F.when(h.contains("pdf"), "pdf").when(h.contains("html"), "html").when(h.contains("xml"), "xml").when(h.contains("text/plain"), "txt")
        .when(p.endswith(".pdf"), "pdf").when(p.rlike(r"\.html?$"), "html").when(p.endswith(".xml"), "xml").otherwise("txt")
    )


#: Bibliographic language codes and the codes they stand for.
ISO_639_2B = {"alb": "sqi", "arm": "hye", "baq": "eus", "bur": "mya", "chi": "zho", "cze": "ces", "dut": "nld", "fre": "fra", "geo": "kat", "ger": "deu", "gre": "ell", "ice": "isl", "mac": "mkd", "mao": "mri", "may": "msa", "per": "fas", "rum": "ron", "slo": "slk", "tib": "bod", "wel": "cym"}


def normalize_lang(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in ISO_639_2B.items() for x in kv))
    return F.coalesce(F.try_element_at(table, code), code)


def oldest_per_work(files: DataFrame, work: str, year: str, name: str) -> DataFrame:
    """The file of least year, by name where years are equal, of each work."""
    return files.groupBy(work).agg(F.min_by(name, F.struct(year, name)).alias("oldest_file"), F.min(year).alias("oldest_year"))


#: Files of a work that one task pairs with another such number of them.
PAIR_BLOCK = 2048


def file_pairs(files: DataFrame, work: str = "work", year: str = "year", name: str = "name") -> DataFrame:
    """All pairs of a work's files, older first; equal years by name.

    The pairs of a large work are dealt over tasks: its files go in blocks, and each two blocks meet by themselves, so that each pair is made once, where it belongs.
    """
    f = files.withColumn("rank", F.row_number().over(Window.partitionBy(work).orderBy(year, name))).withColumn("block", F.floor((F.col("rank") - 1) / PAIR_BLOCK).cast("int"))
    last = f.groupBy(work).agg(F.max("block").alias("last"))
    f = f.join(last, work)
    older = f.withColumn("block_b", F.explode(F.sequence("block", "last")))
    newer = f.select(work, *(F.col(c).alias(f"{c}_b") for c in (year, name, "rank", "block")), F.explode(F.sequence(F.lit(0), "block")).alias("block"))
    pairs = older.join(newer.hint("shuffle_hash"), [work, "block", "block_b"]).where("rank < rank_b")
    return pairs.select(*files.columns, f"{year}_b", f"{name}_b")


def overlapping(shards: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Shards whose range meets [start, end]; an absent bound is open."""
    out = shards
    if start is not None:
        out = out.where(F.col("year_to") >= start)
    if end is not None:
        out = out.where(F.col("year_from") <= end)
    return out


def with_reversed(shards: DataFrame, lang_a: str, lang_b: str) -> DataFrame:
    """Rows of (a, b), else those of (b, a); never both."""
    order = F.when((F.col("lang_a") == lang_a) & (F.col("lang_b") == lang_b), 0).when((F.col("lang_a") == lang_b) & (F.col("lang_b") == lang_a), 1)
    ranked = shards.withColumn("direction", order).where("direction IS NOT NULL")
    return ranked.join(F.broadcast(ranked.agg(F.min("direction").alias("direction"))), "direction").drop("direction")
