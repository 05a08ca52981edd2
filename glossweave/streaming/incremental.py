"""Incremental index: a file stream of pairs appended to posting tables, once for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..plans.views import gram_postings, term_postings

PAIRS = "row_index long, source_text string, target_text string"


def exploded(pairs: DataFrame) -> DataFrame:
    side = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), tokenize(F.col(f"{n}_text")).alias("tokens")) for s, n in ((0, "source"), (1, "target")))))
    return pairs.select("row_index", side.alias("s")).select("row_index", "s.side", F.posexplode("s.tokens").alias("token_index", "token"))


def index_stream(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 16):
    """Start a query that indexes new JSON lines files below source. A batch that runs again overwrites its own folder, so that rows come once."""
    stream = spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", files_per_batch).json(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        words = exploded(batch)
        gram_postings(words).write.mode("overwrite").parquet(f"{target}/grams/batch={number}")
        term_postings(words).write.mode("overwrite").parquet(f"{target}/terms/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_windows(events: DataFrame, length: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Counts and sums by event type in tumbling windows; rows later than the watermark are dropped by the engine, for a stream."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
