"""Scores and curves as columns. Fixed values are the defaults of Params."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """Fixed values of scoring, lookup, re-ranking and alignment."""

    candidates: int = 100
    ngram_share: float = 0.5
    tag_boost: float = 0.1
    rank_untagged: int = 1
    rank_mismatch: int = 2
    k1: float = 1.5
    b: float = 0.75
    semantic_years: float = 200.0
    dice_max: float = 0.5
    dice_k: float = 10.0
    edit_max: float = 2.0
    edit_k: float = 4.5
    local_years: int = 100
    lambda_max: float = 0.01
    lambda_k: float = 300.0
    native_threshold: float = 0.75
    native_hits: int = 5
    sense_threshold: float = 0.80
    band_ratio: float = 0.1
    min_band: int = 20
    margin: float = 0.05
    block: int = 40
    overlap: float = 0.15
    chunk_chars: int = 6000
    attest_window: int = 50
    top_k: int = 5


P = Params()


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log((n - df + 0.5) / (df + 0.5) + 1))


def bm25_term(tf: Column, df: Column, n: Column, length: Column, mean: Column, p: Params = P) -> Column:
    norm = F.when(mean > 0, p.k1 * (1 - p.b + p.b * length / mean)).otherwise(F.lit(p.k1))
    return F.when(tf > 0, idf(n, df) * tf * (p.k1 + 1) / (tf + norm)).otherwise(F.lit(0.0))


def semantic_weight(year: Column, now: int, p: Params = P) -> Column:
    return F.exp(-F.greatest(F.lit(0), F.lit(now) - year) / p.semantic_years)


def dice_threshold(length: Column, p: Params = P) -> Column:
    return F.when(length <= 0, F.lit(0.0)).otherwise(p.dice_max * (1 - F.exp(-length / p.dice_k)))


def max_edits(length: Column, p: Params = P) -> Column:
    """Half goes to the even neighbour."""
    return F.when(length <= 0, F.lit(0)).otherwise(F.rint(p.edit_max * (1 - F.exp(-length / p.edit_k))).cast("int"))


def minmax(x: Column, *by: str) -> Column:
    """(x - least) / (most - least) over all rows of a key; 1 where all are equal."""
    w = Window.partitionBy(*by)
    return between(x, F.min(x).over(w), F.max(x).over(w))


def between(x: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, F.lit(1.0)).otherwise((x - low) / (high - low))


def ends(rows: DataFrame, x: str, by: str) -> DataFrame:
    """(by, low, high), for broadcast: what minmax needs of many rows a key, which then stay where they are."""
    return F.broadcast(rows.groupBy(by).agg(F.min(x).alias("low"), F.max(x).alias("high")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def decay_rate(near: Column, p: Params = P) -> Column:
    """From the number of hits within local_years."""
    return F.when(near <= 0, F.lit(0.0)).otherwise(p.lambda_max * (1 - F.exp(-near / p.lambda_k)))


def hybrid(weight: Column, vector: Column, ngram: Column, bm25: Column, p: Params = P) -> Column:
    return weight * vector + (1 - weight) * (p.ngram_share * ngram + (1 - p.ngram_share) * bm25)


def tag_rank(pairs: list[tuple[str | None, Column]], p: Params = P) -> Column:
    """0 for agreement with each queried tag; more for no tag, most for another tag. Empty and absent queries don't count."""
    rank = F.lit(0)
    for asked, found in pairs:
        if asked:
            rank = rank + F.when(found.isNull(), p.rank_untagged).when(found != asked, p.rank_mismatch).otherwise(0)
    return rank
