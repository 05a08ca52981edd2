"""Attestation, nearest vectors, and what clients make of hits: each answers many queries in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import P, Params, decay_rate

#: Rows of a query table up to which it is broadcast; a larger one is joined by shuffle.
SMALL = 10_000


def small(queries: DataFrame, most: int = SMALL) -> DataFrame:
    """The queries, marked for broadcast where they are counted to be few."""
    return F.broadcast(queries) if queries.limit(most + 1).count() <= most else queries


def attest(rows: DataFrame, lemma: str, iso: str, year: int, window: int = P.attest_window, ner: str | None = None) -> DataFrame:
    """Exact attestations: pushed down as comparisons. An empty ner is not asked for."""
    out = rows.where((F.col("iso_code") == iso) & F.col("attestation_year").between(year - window, year + window) & (F.col("lemma") == lemma))
    return out.where(F.col("ner") == ner) if ner else out


def top_k(rows: DataFrame, k: int, score: str, *ties: str, by: str = "query_id") -> DataFrame:
    """Ranked with a total order; each partition keeps k a key before the shuffle (a window group limit)."""
    w = Window.partitionBy(by).orderBy(F.desc(score), *ties)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Bytes of query vectors that a broadcast holds, vectors that a task compares at a time, similarities that it holds at once, and places that they are rounded to, so that
#: equal vectors tie wherever they stand.
BLOCK_BYTES, CHUNK, CELLS, DIGITS = 16 << 20, 1 << 16, 1 << 21, 9


def nearest(queries: DataFrame, vectors: DataFrame, k: int, by: tuple[str, ...] = (), on: str | None = None) -> DataFrame:
    """Exact top-k inner products, of each group of vectors `by` some columns: (query_id, similarity, *vector columns, rank); queries (query_id,
    query_vector), vectors (..., embedding). With `on`, one of `by` that queries have too, a query meets the vectors that have its value alone.

    Blocks of queries are broadcast, of a size counted beforehand, and vectors stream past each in chunks; a task keeps k a query and group of each chunk, ties by the
    vector columns in order, and holds no more than CELLS similarities at once. Rows without a vector match nothing; without queries there are no rows.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = queries.where("query_vector IS NOT NULL").select("query_id", "query_vector", *([on] if on else []))
    spark = queries.sparkSession
    keys = [c for c in vectors.columns if c != "embedding"]
    schema = ", ".join([f"query_id {queries.schema['query_id'].dataType.simpleString()}, similarity double", *(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keys)])
    size = rows.agg(F.sum(F.size("query_vector") * 8 + 16 * k)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    known = vectors.where("embedding IS NOT NULL").select(*keys, "embedding")
    cells = CELLS

    def matrix(lists: pa.Array) -> np.ndarray:
        return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)

    def of(block: int) -> DataFrame:
        got = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast((got["query_id"].combine_chunks(), matrix(got["query_vector"].combine_chunks()) if got.num_rows else None, np.array(got[on].to_pylist(), object) if on else None))

        def chunks(batches):
            held, n = [], 0
            for batch in batches:
                held, n = [*held, batch], n + batch.num_rows
                if n >= CHUNK:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
            if n:
                yield pa.Table.from_batches(held)

        def run(batches):
            ids, q, asks = sent.value
            if not len(ids):
                return
            for table in chunks(batches):
                if keys:
                    table = table.take(pc.sort_indices(table.select(keys), [(c, "ascending") for c in (*by, *(c for c in keys if c not in by))]))
                [batch] = table.combine_chunks().to_batches()
                v = matrix(batch["embedding"])
                new = np.zeros(batch.num_rows, bool)
                for c in by:
                    code = batch[c].dictionary_encode(null_encoding="encode").indices.to_numpy()
                    new[1:] |= code[1:] != code[:-1]
                for at in np.split(np.arange(batch.num_rows), np.flatnonzero(new)):
                    who = np.arange(len(ids)) if on is None else np.flatnonzero(asks == batch[on][int(at[0])].as_py())
                    part = v[at[0] : at[-1] + 1].T
                    m = min(k, part.shape[1])
                    step = max(1, cells // part.shape[1])
                    for lo in range(0, len(who), step):
                        own = np.round(q[who[lo : lo + step]] @ part, DIGITS)
                        floor = np.partition(own, own.shape[1] - m, axis=1)[:, own.shape[1] - m][:, None]
                        i, j = np.nonzero(own >= floor)
                        same = own[i, j] == floor[i, 0]
                        # of those equal to the k-th the first in order, as many as there is room for
                        start = np.searchsorted(i, np.arange(len(own)))
                        before = np.cumsum(same) - same
                        room = m - np.bincount(i[~same], minlength=len(own))
                        keep = ~same | (before - before[start[i]] < room[i])
                        i, j = i[keep], j[keep]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(who[lo + i])), pa.array(own[i, j]), *(batch[c].take(pa.array(at[j])) for c in keys)], ["query_id", "similarity", *keys])

        return known.mapInArrow(run, schema)

    out = of(0) if blocks else spark.createDataFrame([], schema)
    for b in range(1, blocks):
        out = out.unionByName(of(b))
    w = Window.partitionBy("query_id", *by).orderBy(F.desc("similarity"), *keys)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def temporal_rerank(hits: DataFrame, year: Column, p: Params = P) -> DataFrame:
    """similarity * exp(-rate * distance in years), the rate from the number of a query's hits within local_years."""
    gap = F.abs(F.col("hit_year") - year)
    near = F.count_if(gap <= p.local_years).over(Window.partitionBy("query_id"))
    rate = decay_rate(near, p)
    return hits.withColumns({"near": near, "rate": rate}).withColumn("reranked", F.col("similarity") * F.exp(-F.col("rate") * gap))


def fallback_native(hits: DataFrame, p: Params = P) -> DataFrame:
    """Hits (query_id, row_index, span, confidence): of those with a span the best native_hits; the first that reaches the threshold."""
    best = top_k(hits.where("span IS NOT NULL"), p.native_hits, "confidence", "row_index")
    return best.where(F.col("confidence") >= p.native_threshold).groupBy("query_id").agg(F.min_by(F.struct("row_index", "span", "confidence"), "rank").alias("f")).select("query_id", "f.*")
