"""The corpus tables that queries work on, derived from the test tables; SQL twins in `SQL`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import char_trigrams, tokenize
from ..operators.index import Index, build_index, read_index
from ..sources.corpus_files import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and the answer to it; row_index from conversation and turn, so that no global numbering is needed."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source_text"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target_text"))
    return u.join(a, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 4096 + F.col("turn")).alias("row_index"), "conv_id", "turn", "source_text", "target_text",
        (1000 + (F.col("conv_id") * 37) % 1000).alias("source_year"), F.lit(1999).cast("long").alias("target_year"),
    )


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each side of a pair: what all serving operators read."""
    side = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.lit(lang).alias("lang_code"), F.col(f"{n}_year").alias("year"), F.col(f"{n}_text").alias("text")) for s, lang, n in ((0, "a", "source"), (1, "b", "target")))))
    return pairs(spark, sf_dir).select("row_index", "conv_id", side.alias("s")).select("row_index", "conv_id", "s.*").withColumn("tokens", tokenize(F.col("text")))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir).select("row_index", "side", F.posexplode("tokens").alias("token_index", "token"))


def gram_postings(words: DataFrame) -> DataFrame:
    """(ngram, row_index, side, token_index, token_ngram_count) of tokens."""
    g = words.withColumn("grams", char_trigrams(F.col("token")))
    return g.select(F.explode("grams").alias("ngram"), "row_index", "side", "token_index", F.size("grams").alias("token_ngram_count"))


def term_postings(words: DataFrame) -> DataFrame:
    return words.groupBy(F.lower("token").alias("term"), "row_index", "side").agg(F.count("*").alias("term_frequency"))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with tokens of both sides and alignment links: every third token pair, tagged by its place."""
    p = pairs(spark, sf_dir).withColumns({"source_tokens": tokenize(F.col("source_text")), "target_tokens": tokenize(F.col("target_text"))})
    least = F.least(F.size("source_tokens"), F.size("target_tokens"))
    upos = F.array(*map(F.lit, ("NOUN", "VERB", "ADJ", "ADV", "DET")))
    link = lambda k: F.struct(F.array(k).alias("source_idx"), F.array(k).alias("target_idx"), F.element_at(upos, (F.floor(k / 3) % 5 + 1).cast("int")).alias("upos"), F.when(k % 9 == 0, "PER").otherwise("O").alias("ner"))
    return p.withColumn("links", F.when(least > 0, F.transform(F.sequence(F.lit(0), least - 1, F.lit(3)), link)).otherwise(F.array().cast("array<struct<source_idx:array<int>,target_idx:array<int>,upos:string,ner:string>>")))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that hold more than white space, numbered from 0 within each."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(lines).alias("unit_index", "unit_text"))


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as the index takes them: three source languages by conversation, a citation for every third row, no confidence for every fifth."""
    p = linked(spark, sf_dir)
    i = F.col("row_index")
    side = lambda lang, year: F.struct(lang.alias("lang_code"), F.col(year).cast("int").alias("year"), F.lit("w").alias("work"), F.lit("a").alias("author"))
    lemma = lambda c, x: F.lower(F.get(F.col(c), F.get(x, F.lit(0))))
    link = lambda x: F.struct(x["source_idx"].alias("source_idx"), x["target_idx"].alias("target_idx"), *(y.alias(f"{n}_{t}") for n in ("source", "target") for t, y in (("upos", x["upos"]), ("ner", x["ner"]), ("lemma", lemma(f"{n}_tokens", x[f"{n}_idx"])))))
    return p.select(
        "row_index", F.concat(F.lit("p"), i.cast("string")).alias("pair_id"), side(F.concat(F.lit("l"), (F.col("conv_id") % 3).cast("string")), "source_year").alias("source"), side(F.lit("eng"), "target_year").alias("target"),
        F.coalesce("source_text", F.lit("")).alias("source_text"), F.coalesce("target_text", F.lit("")).alias("target_text"), "source_tokens", "target_tokens",
        F.when(i % 3 == 0, F.concat(F.lit("c"), i.cast("string"))).alias("citation"), F.when(i % 5 != 0, (i * 7919) % 1000 / 1000.0).alias("sentence_confidence"), F.transform("links", link).alias("alignment_links"),
    )


def side_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_index, side, embedding): a side's stand-in vector is that of its place modulo the number of vectors."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return sides(spark, sf_dir).select("row_index", "side", F.pmod(F.col("row_index") * 2 + F.col("side"), F.lit(v.count())).alias("vec_id")).join(v, "vec_id").drop("vec_id")


_STORED: dict[tuple[str, str], str] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of the pairs: built by the first query that needs it, in the shared folder, and read by all others of the session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORED:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        build_index(served(spark, sf_dir), path, vectors=side_vectors(spark, sf_dir))
        _STORED[key] = path
    return read_index(spark, _STORED[key])


def _asking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turns of every twentieth conversation ask; in turns in its source language and in English."""
    c = table(spark, sf_dir, "conversations").where("conv_id % 20 = 0 AND turn = 0")
    k = F.floor(F.col("conv_id") / 20) % 4
    own = F.concat(F.lit("l"), (F.col("conv_id") % 3).cast("string"))
    return c.select(F.col("conv_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"), k.alias("k"), F.when(k % 2 == 0, own).otherwise("eng").alias("lang"), F.when(k % 2 == 0, F.lit("eng")).otherwise(own).alias("target_lang"))


def word_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third token of each asking turn; some ask for tags."""
    q = _asking(spark, sf_dir).withColumn("query", F.get(tokenize(F.col("text")), F.lit(2))).where("query IS NOT NULL")
    return q.select("query_id", "query", "lang", "target_lang", F.when(F.col("k") < 2, "NOUN").alias("upos"), F.when(F.col("k") == 1, "PER").alias("ner"))


def passage_queries(spark: SparkSession, sf_dir: str, tags: bool = False) -> DataFrame:
    """Each asking turn, with a year and a window or without."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("query_vector"))
    q = _asking(spark, sf_dir).withColumn("vec_id", F.pmod("query_id", F.lit(v.count()))).join(v, "vec_id")
    none = F.lit(None).cast("string")
    return q.select("query_id", F.col("text").alias("query"), "query_vector", "lang", F.when(F.col("k") != 3, 1000 + (F.col("query_id") * 37) % 1000).alias("year"), F.when(F.col("k") != 1, 200 + 100 * F.col("k")).alias("window"), (F.lit("ADJ") if tags else none).alias("upos"), (F.lit("O") if tags else none).alias("ner"))


_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
SQL = {
    "pairs": """pairs AS (SELECT u.conv_id * 4096 + u.turn AS row_index, u.conv_id, u.turn, u.text AS source_text, a.text AS target_text, 1000 + (u.conv_id * 37) % 1000 AS source_year, 1999::BIGINT AS target_year
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')""",
    "sides": f"""sides AS (SELECT *, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') AS tokens FROM (
  SELECT row_index, conv_id, 0 AS side, 'a' AS lang_code, source_year AS year, source_text AS text FROM pairs UNION ALL SELECT row_index, conv_id, 1, 'b', target_year, target_text FROM pairs))""",
    "tokens": "tokens AS (SELECT row_index, side, unnest(range(len(tokens)))::INT AS token_index, unnest(tokens) AS token FROM sides)",
    "grams": """grams AS (SELECT row_index, side, token_index, token, list_distinct(list_transform(range(1, length('  ' || lower(token) || '  ') - 1), lambda i: substring('  ' || lower(token) || '  ', i, 3))) AS grams FROM tokens)""",
    "postings": "postings AS (SELECT unnest(grams) AS ngram, row_index, side, token_index, len(grams)::INT AS token_ngram_count FROM grams)",
    "terms": "terms AS (SELECT lower(token) AS term, row_index, side, count(*) AS term_frequency FROM tokens GROUP BY ALL)",
    "linked": f"""linked AS (SELECT *, list_transform(range(0, least(len(source_tokens), len(target_tokens)), 3), lambda k: {{'idx': k, 'upos': ['NOUN', 'VERB', 'ADJ', 'ADV', 'DET'][(k // 3) % 5 + 1], 'ner': CASE WHEN k % 9 = 0 THEN 'PER' ELSE 'O' END}}) AS links
  FROM (SELECT *, regexp_extract_all(coalesce(source_text, ''), '{_TOKEN}') AS source_tokens, regexp_extract_all(coalesce(target_text, ''), '{_TOKEN}') AS target_tokens FROM pairs))""",
    "units": r"""units AS (SELECT doc_id, lang, unnest(range(len(l)))::INT AS unit_index, unnest(l) AS unit_text FROM (SELECT doc_id, lang, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l FROM documents))""",
    "asking": f"""asking AS (SELECT conv_id AS query_id, coalesce(text, '') AS query, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') AS t, (conv_id // 20) % 4 AS k, 'l' || conv_id % 3 AS own FROM conversations WHERE conv_id % 20 = 0 AND turn = 0)""",
    "words": "words AS (SELECT query_id, t[3] AS query, own AS lang_a, (k % 2)::INT AS side, CASE WHEN k < 2 THEN 'NOUN' END AS upos, CASE WHEN k = 1 THEN 'PER' END AS ner FROM asking WHERE len(t) >= 3)",
    "passages": "passages AS (SELECT query_id, query, CASE WHEN k % 2 = 0 THEN own ELSE 'eng' END AS lang, CASE WHEN k <> 3 THEN 1000 + (query_id * 37) % 1000 END AS year, CASE WHEN k <> 1 THEN 200 + 100 * k END AS win FROM asking)",
    "ss": "ss AS (SELECT *, 'l' || conv_id % 3 AS lang_a, CASE side WHEN 0 THEN 'l' || conv_id % 3 ELSE 'eng' END AS lang FROM sides)",
    "tt": "tt AS (SELECT *, 'l' || (row_index // 4096) % 3 AS lang_a, CASE side WHEN 0 THEN 'l' || (row_index // 4096) % 3 ELSE 'eng' END AS lang FROM terms)",
    "pp": "pp AS (SELECT *, 'l' || (row_index // 4096) % 3 AS lang_a FROM postings)",
}


def with_(*names: str) -> str:
    """A WITH clause of the named tables and those they need, in order."""
    need = {"sides": ["pairs"], "tokens": ["pairs", "sides"], "grams": ["pairs", "sides", "tokens"], "postings": ["pairs", "sides", "tokens", "grams"], "terms": ["pairs", "sides", "tokens"], "linked": ["pairs"], "words": ["asking"], "passages": ["asking"], "ss": ["pairs", "sides"], "tt": ["pairs", "sides", "tokens", "terms"], "pp": ["pairs", "sides", "tokens", "grams", "postings"]}
    wanted = {x for n in names for x in [*need.get(n, []), n]}
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in SQL if n in wanted)
