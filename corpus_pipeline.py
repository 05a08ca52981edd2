"""A corpus made ready for training: toxic documents out, one of each group of near duplicates, repeated passages cut,
documents with benchmark passages out, the rest encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; what it returns is written and read again as the next one's
docs. All but the last return the columns of docs, others than the usual ones included, unchanged but for text and n_chars.
Rows are told apart by id and text: rows that share an id but not the text are documents of their own, of equal rows one stays.
Null and empty texts pass all stages; rows without an id are like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossweave.llm import bpe, decontaminate, jaccard_join, substring_dedup, toxicity
from glossweave.llm.common import drop_stashes, stash, stashed, table, unstash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), ["toxic"])
    rows = docs.select("doc_id", "text", F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return toxicity.score(rows, chain, carry=("row",)).where("NOT rejected").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similar shingle sets the document with the least id (one with an id, if any has)."""
    rid = "_rid_" + "_".join(docs.columns)
    rows = docs.withColumn(rid, F.xxhash64("doc_id", "text"))
    groups = jaccard_join.near_duplicates(rows.select(rid, "text"), key=rid).select(rid, "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", rid)
    first = rows.select(rid, "doc_id").distinct().join(groups, rid).groupBy("component_id").agg(F.min_by(rid, order).alias(rid))
    kept = rows.join(first.select(rid), rid, "left_semi")
    place = "_n" + rid
    one = kept.withColumn(place, F.row_number().over(Window.partitionBy(rid, "doc_id", F.xxhash64("text", F.lit(1))).orderBy("text"))).where(F.col(place) == 1)
    return one.select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 35-word windows that start elsewhere too."""
    rows = docs.select("doc_id", "text", F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    done = substring_dedup.substring_dedup(rows, with_text=True, carry=("row",))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return done.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage near a benchmark item."""
    rid = "_rid_" + "_".join(docs.columns)
    rows = docs.withColumn(rid, F.xxhash64("doc_id", "text"))
    leaks = decontaminate.find_leaks(rows.select(rid, "text"), table(spark, sf_dir, "benchmark"), key=rid).select(rid).distinct()
    return rows.join(leaks, rid, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of them and of the text decoded from them."""
    return bpe.bpe_columns(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path(bpe.FILE), decoded=False, carry=("lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: The stages can't be expressed in SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage stashes goes once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = stashed()
        after = stash(stage(spark, docs, sf_dir))
        unstash(docs)
        drop_stashes(stashed() - before - stashed(after))
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
