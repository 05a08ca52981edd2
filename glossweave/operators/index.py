"""The served index: pair shards with their gram postings, term postings, vectors and statistics, built by one job and read by lookup and search.

Shards are language pairs with a range of years, as partition columns of every artifact, so that readers prune by folders. Postings are sorted by
token or term within, so that a probe reads few row groups; terms carry what BM25 needs of their shard and side. Grams stand once for each different token of a
shard's side, and tokens have the places where they stand: a gram posting for each place is a view of the two.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import char_trigrams, tokenize
from ..sources.corpus_files import exists

#: The columns of a shard.
SHARD = ["lang_a", "lang_b", "year_from", "year_to"]
ARTIFACTS = ["pairs", "sides", "words", "places", "terms", "stats", "vectors"]


def with_shards(pairs: DataFrame) -> DataFrame:
    """Pairs (…, source and target with lang_code and year) with the columns of their shard: the range is over the years of both sides."""
    p = pairs.withColumns({"lang_a": F.col("source.lang_code"), "lang_b": F.col("target.lang_code")})
    years = p.groupBy("lang_a", "lang_b").agg(F.min(F.least("source.year", "target.year")).alias("year_from"), F.max(F.greatest("source.year", "target.year")).alias("year_to"))
    return p.join(years, ["lang_a", "lang_b"])


def sides_of(pairs: DataFrame) -> DataFrame:
    """(shard, row_index, side, lang_code, year, text, tokens): a row for each side of a pair."""
    both = F.array(*(F.struct(F.lit(i).alias("side"), F.col(f"{n}.lang_code").alias("lang_code"), F.col(f"{n}.year").alias("year"), F.coalesce(f"{n}_text", F.lit("")).alias("text"), F.col(f"{n}_tokens").alias("tokens")) for i, n in enumerate(("source", "target"))))
    return pairs.select(*SHARD, "row_index", F.explode(both).alias("s")).select(*SHARD, "row_index", "s.*")


def _in_rows(rows: DataFrame, tokens: str, *keys: str) -> DataFrame:
    """(keys, token, places): the different tokens of each row and where they stand. A row's are found in the row: nothing is grouped by a shuffle."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches):
        for batch in batches:
            row, token, places = [], [], []
            for k, own in enumerate(batch[tokens].to_pylist()):
                at: dict[str, list[int]] = {}
                for i, t in enumerate(own or ()):
                    at.setdefault(t, []).append(i)
                row += [k] * len(at)
                token += at
                places += at.values()
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch[c].take(take) for c in keys), pa.array(token, pa.string()), pa.array(places, pa.list_(pa.int32()))], [*keys, "token", "places"])

    return rows.select(*keys, tokens).mapInArrow(run, f"{kinds}, token string, places array<int>")


def token_places(sides: DataFrame) -> DataFrame:
    """(shard, row_index, side, token, places): each different token of a row, and its places."""
    return _in_rows(sides, "tokens", *SHARD, "row_index", "side")


def side_words(places: DataFrame) -> DataFrame:
    """(shard, side, token, grams, rows): the different tokens of each shard's side with their trigrams, and in how many rows they stand."""
    return places.groupBy(*SHARD, "side", "token").agg(F.count("*").alias("rows")).withColumn("grams", char_trigrams(F.col("token")))


def term_postings(sides: DataFrame) -> DataFrame:
    """(shard, term, row_index, side, term_frequency, length): length is the row's number of tokens."""
    low = sides.select(*SHARD, "row_index", "side", F.size("tokens").alias("length"), F.transform("tokens", F.lower).alias("tokens"))
    return _in_rows(low, "tokens", *SHARD, "row_index", "side", "length").select(*SHARD, F.col("token").alias("term"), "row_index", "side", "length", F.size("places").cast("long").alias("term_frequency"))


def side_stats(sides: DataFrame) -> DataFrame:
    """(shard, side, n_rows, n_tokens): of each shard and side."""
    return sides.groupBy(*SHARD, "side").agg(F.count("*").alias("n_rows"), F.sum(F.size("tokens")).cast("long").alias("n_tokens"))


def document_frequency(terms: DataFrame, *by: str) -> DataFrame:
    """(by, term, doc_freq): rows that have each term."""
    return terms.groupBy(*by, "term").agg(F.countDistinct("row_index").alias("doc_freq"))


def collection(sides: DataFrame, *by: str) -> DataFrame:
    """(by, n_rows, mean_length): rows, and their mean number of tokens."""
    return sides.groupBy(*by).agg(F.count("*").alias("n_rows"), F.avg(F.size("tokens")).alias("mean_length"))


@dataclass(frozen=True)
class Index:
    """The artifacts as tables; those of an absent index are empty."""

    pairs: DataFrame
    sides: DataFrame
    words: DataFrame
    places: DataFrame
    terms: DataFrame
    stats: DataFrame
    vectors: DataFrame

    @property
    def grams(self) -> DataFrame:
        """(shard, ngram, row_index, side, token_index, token, token_ngram_count): a row for each gram of each token in its place."""
        x = self.places.join(self.words.select(*SHARD, "side", "token", "grams"), [*SHARD, "side", "token"])
        x = x.select(*SHARD, "row_index", "side", "token", "grams", F.explode("places").alias("token_index"))
        return x.select(*SHARD, F.explode("grams").alias("ngram"), "row_index", "side", "token_index", "token", F.size("grams").alias("token_ngram_count"))


def build_index(pairs: DataFrame, path: str, embed: Callable[[Column], Column] | None = None, vectors: DataFrame | None = None) -> Index:
    """Write all artifacts of all language pairs in one job each; the job fails without pairs.

    pairs: (row_index, pair_id, source and target structs with lang_code and year, source_text, target_text, and what else is to be served). Tokens are made where they
    are absent. Vectors are made by `embed` from a side's text, or taken from a table (row_index, side, embedding).
    """
    spark = pairs.sparkSession
    if "source_tokens" not in pairs.columns:
        pairs = pairs.withColumns({f"{n}_tokens": tokenize(F.col(f"{n}_text")) for n in ("source", "target")})
    if pairs.isEmpty():
        raise ValueError("no pairs to index")
    _write(with_shards(pairs), f"{path}/pairs", "row_index")
    stored = spark.read.parquet(f"{path}/pairs")
    _write(sides_of(stored), f"{path}/sides", "side", "row_index")
    sides = spark.read.parquet(f"{path}/sides")
    _write(token_places(sides), f"{path}/places", "token", "side")
    _write(side_words(spark.read.parquet(f"{path}/places")), f"{path}/words", "token", "side")
    _write(term_postings(sides), f"{path}/terms", "term", "side")
    side_stats(sides).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    made = sides.select(*SHARD, "row_index", "side", embed(F.col("text")).alias("embedding")) if embed else sides.select(*SHARD, "row_index", "side").join(vectors, ["row_index", "side"]) if vectors is not None else None
    if made is not None:
        _write(made.select(*SHARD, "row_index", "side", "embedding"), f"{path}/vectors", "side", "row_index")
    return read_index(spark, path)


def _write(rows: DataFrame, path: str, *order: str) -> None:
    # a token's or term's rows are together, small partitions are joined and those of a common one split, by their sizes when they are known
    rows.hint("rebalance", *SHARD, order[0]).sortWithinPartitions(*SHARD, *order).write.mode("overwrite").partitionBy(*SHARD).parquet(path)


_LINK = "struct<source_idx:array<int>,target_idx:array<int>," + ",".join(f"{s}_{t}:string" for s in ("source", "target") for t in ("upos", "ner", "lemma")) + ">"
_SHARDS = "lang_a string, lang_b string, year_from int, year_to int"
_EMPTY = {
    "pairs": f"row_index long, pair_id string, source_text string, target_text string, source_tokens array<string>, target_tokens array<string>, alignment_links array<{_LINK}>, {_SHARDS}",
    "sides": f"row_index long, side int, lang_code string, year int, text string, tokens array<string>, {_SHARDS}",
    "words": f"side int, token string, rows long, grams array<string>, {_SHARDS}",
    "places": f"row_index long, side int, token string, places array<int>, {_SHARDS}",
    "terms": f"term string, row_index long, side int, length int, term_frequency long, {_SHARDS}",
    "stats": f"{_SHARDS}, side int, n_rows long, n_tokens long",
    "vectors": f"row_index long, side int, embedding array<float>, {_SHARDS}",
}


def read_index(spark: SparkSession, path: str) -> Index:
    """The stored artifacts; a missing one is an empty table."""
    return Index(**{a: spark.read.parquet(f"{path}/{a}") if exists(spark, f"{path}/{a}") else spark.createDataFrame([], _EMPTY[a]) for a in ARTIFACTS})


def discover_pairs(index: Index, lang: str) -> DataFrame:
    """The language pairs that have a language on either side, sorted."""
    return index.stats.where((F.col("lang_a") == lang) | (F.col("lang_b") == lang)).select("lang_a", "lang_b").distinct().orderBy("lang_a", "lang_b")


def shards_between(rows: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows of the shards whose range of years meets [start, end]; an open bound is None. Read from the folders' names alone."""
    if start is not None:
        rows = rows.where(F.col("year_to") >= start)
    return rows.where(F.col("year_from") <= end) if end is not None else rows
