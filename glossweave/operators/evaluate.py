"""Run comparison: overlap, coverage, confidence, separation, drop rates; reports and snapshots."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nfkc_words


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys of both runs and of each; precision is their share of b, recall of a."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    n = x.join(y, keys, "full").agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count(F.col("_a") + F.col("_b")).alias("both"))
    return n.select("n_a", "n_b", "both", _ratio(F.col("both"), F.col("n_b")).alias("precision"), _ratio(F.col("both"), F.col("n_a")).alias("recall"))


def coverage(pairs: DataFrame, units: DataFrame, text: str, unit: str):
    """One row: characters of the pairs' texts over those of the units."""
    p = pairs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("used"))
    u = units.agg(F.coalesce(F.sum(F.length(unit)), F.lit(0)).alias("there"))
    return p.join(F.broadcast(u)).select("used", "there", _ratio(F.col("used"), F.col("there")).alias("coverage"))


def compare_alignment(a: DataFrame, b: DataFrame, source_units: DataFrame, target_units: DataFrame, candidates: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """One row on two runs over the same units: pairs; overlap of whole pairs and of source texts (normalised) with precision and recall of b; coverage of the units of
    either side by either run; and, where the numbers of candidates before verification are told, the shares dropped by it. a, b: (source_text, target_text)."""
    key = lambda x: x.select(nfkc_words(F.col("source_text")).alias("s"), nfkc_words(F.col("target_text")).alias("t"), F.length("source_text").alias("sl"), F.length("target_text").alias("tl"))
    x, y = key(a), key(b)
    whole = overlap(x, y, ["s", "t"]).withColumnsRenamed({"n_a": "keys_a", "n_b": "keys_b", "both": "pair_overlap", "precision": "pair_precision", "recall": "pair_recall"})
    spans = overlap(x, y, ["s"]).withColumnsRenamed({"n_a": "sources_a", "n_b": "sources_b", "both": "source_overlap", "precision": "source_precision", "recall": "source_recall"})
    sums = lambda z, n: z.agg(F.count("*").alias(f"pairs_{n}"), F.coalesce(F.sum("sl"), F.lit(0)).alias(f"sl_{n}"), F.coalesce(F.sum("tl"), F.lit(0)).alias(f"tl_{n}"))
    there = lambda u, n: u.agg(F.coalesce(F.sum(F.length("unit_text")), F.lit(0)).alias(n))
    one = whole
    for part in (spans, sums(x, "a"), sums(y, "b"), there(source_units, "source_there"), there(target_units, "target_there")):
        one = one.join(F.broadcast(part))  # a row each
    rates = [_ratio(F.col(f"{c}_{n}"), F.col(f"{s}_there")).alias(f"{s}_coverage_{n}") for s, c in (("source", "sl"), ("target", "tl")) for n in "ab"]
    drops = [(F.lit(1.0) - F.col(f"pairs_{n}") / k if k else F.lit(None).cast("double")).alias(f"drop_rate_{n}") for n, k in zip("ab", candidates, strict=True)]
    return one.select("pairs_a", "pairs_b", "pair_overlap", "pair_precision", "pair_recall", "source_overlap", "source_precision", "source_recall", *rates, *drops)


def usage_totals(calls: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens and cost of a log of model calls (prompt_tokens, completion_tokens, cost_usd; null counts as 0), in all or by columns."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"), (total("prompt_tokens") + total("completion_tokens")).alias("total_tokens"), total("cost_usd").cast("double").alias("cost_usd"))


def snapshot(spark: SparkSession, path: str, tag: str, at: datetime) -> str:
    """A copy of a stored table beside it, named after its stem, a tag and the time; the job fails if there is none. Returns its path."""
    folder, _, name = path.rstrip("/").rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    stem, suffix = (stem, dot + suffix) if dot and stem else (name, "")
    target = f"{folder}/{stem}.baseline_{tag}_{at:%Y%m%dT%H%M%S}{suffix}"
    spark.read.parquet(path).write.mode("errorifexists").parquet(target)
    return target


def confidence_stats(pairs: DataFrame) -> DataFrame:
    """By method, up to its colon: pairs, mean confidence (null as 0), mean number of links."""
    m = F.split_part(F.coalesce("sentence_method", F.lit("unknown")), F.lit(":"), F.lit(1))
    return pairs.groupBy(m.alias("method")).agg(F.count("*").alias("n_pairs"), F.avg(F.coalesce("sentence_confidence", F.lit(0.0))).alias("mean_confidence"), F.avg("n_links").alias("mean_links"))


def separation(scored: DataFrame, by: str) -> DataFrame:
    """scored: (by, positive, score or null). Least positive, greatest negative, whether they are apart, accuracy at a half, missing."""
    pos, neg = F.when(F.col("positive"), F.col("score")), F.when(~F.col("positive"), F.col("score"))
    right = F.count_if((pos >= 0.5) | (neg < 0.5))
    out = scored.groupBy(by).agg(F.min(pos).alias("positive_min"), F.max(neg).alias("negative_max"), right.alias("right"), F.count("score").alias("n"), F.count_if(F.col("score").isNull()).alias("missing"))
    return out.select(by, "positive_min", "negative_max", (F.col("positive_min") > F.col("negative_max")).alias("cleanly_separated"), _ratio(F.col("right"), F.col("n")).alias("accuracy"), "missing")


def markdown(title: str, metrics: dict) -> str:
    """A report of metrics: floats with four places, nested ones indented below their name."""

    def lines(items: dict, depth: int):
        for k, v in items.items():
            if isinstance(v, dict):
                yield f"{'  ' * depth}- {k}:"
                yield from lines(v, depth + 1)
            else:
                yield f"{'  ' * depth}- {k}: {v:.4f}" if isinstance(v, float) else f"{'  ' * depth}- {k}: {v}"

    return "\n".join([f"## {title}", "", *lines(metrics, 0), ""])
