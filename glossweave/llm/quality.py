"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled good; unlabelled web text are all rows, labels unseen. The model minimises the
non-negative unbiased risk. Its class prior is estimated from trusted and unlabelled rows alone: a first model tells them apart, and
the share of positives follows from the scores of rows that it didn't see. Features are shares and rates of the text alone (case, symbols,
repetition, line and word shape), each cut at quantiles of the unlabelled text.

Folds: crc32 of the id's digits modulo 3; remainder 1 is held out, from labels and from the unlabelled rows. Quantiles are those of all
rows of the learning folds, by counts of values to 8 binary places, which add up over tasks. For the gradient steps at most SAMPLE rows of
each kind are taken, those of least id hash. A null text counts as empty; an empty text gets a score from its features. Rows with a null id
are scored, not held out, and not learned from; repeated rows stay repeated and count as often. Other columns are not read; ValueError where the
key has the name of a result column.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, by_bytes, no_clash, raw, table, tuned, windows
from .linear import mixture_share, nn_pu, sigmoid

SAMPLE = 15_000
#: Even quantiles, and some of the tails, where bad text is.
QUANTILES = np.unique(np.concatenate(([0.01, 0.03, 0.9, 0.95, 0.97, 0.99], np.linspace(0.1, 0.8, 6))))
CUTS = len(QUANTILES)
NAMES = ("words", "word_bytes", "long_words", "upper", "digit", "symbol", "mark", "bang", "line_words", "dup_lines", "distinct", "top_word", "pairs", "triples", "same_next", "wide")


def _classes() -> np.ndarray:
    out = np.zeros((6, 256), np.int64)
    out[0, list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
    out[1, list(b"0123456789")] = 1
    out[2, list(b"#*$%&|<>@^~_=+\\{}[]")] = 1
    out[3, list(b".,;:?'\"-()")] = 1
    out[4, list(b"!")] = 1
    out[5, 0x80:] = 1
    return out


_CLASSES = _classes()


def measures(texts: list[bytes | None]) -> np.ndarray:
    """A row of NAMES for each text; all 0 for a text without words."""
    words = Words(texts)
    buf = np.frombuffer(words.data, np.uint8)
    count = np.stack([np.diff(np.concatenate(([0], np.cumsum(c[buf])))[words.place]) for c in _CLASSES], axis=1)
    size = words.end - words.begin
    sums = np.concatenate(([0], np.cumsum(size)))
    long = np.concatenate(([0], np.cumsum(size > 14)))
    twos = windows(words.hashes, 2) if len(words.hashes) > 1 else words.hashes
    threes = windows(words.hashes, 3) if len(words.hashes) > 2 else words.hashes
    again = np.concatenate(([0], np.cumsum(words.hashes[1:] == words.hashes[:-1]), [0]))
    out = np.zeros((len(texts), len(NAMES)))
    for i, text in enumerate(texts):
        a, b = int(words.at[i]), int(words.at[i + 1])
        n = b - a
        if not n:
            continue
        total = sums[b] - sums[a]
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        share = lambda x: 1 - len(np.unique(x)) / len(x) if len(x) else 0.0
        _, times = np.unique(words.hashes[a:b], return_counts=True)
        up, digit, symbol, mark, bang, wide = count[i] / total
        # repeats grow with length even in good text: they are taken against the root of the number of words
        out[i] = (np.log(n), total / n, (long[b] - long[a]) / n, up, digit, symbol, mark, bang, np.log(n / len(lines)), 1 - len(set(lines)) / len(lines), (1 - len(times) / n) / np.sqrt(np.log(n + 2)), times.max() / n, share(twos[a : max(a, b - 1)]), share(threes[a : max(a, b - 2)]), (again[b - 1] - again[a]) / n, wide)
    return out


def expand(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Each measure as the share of its quantiles it exceeds, and as a step at each."""
    steps = (x[:, :, None] > cuts[None]).astype(float)
    return steps.reshape(len(x), -1)


def fold(key):
    return F.crc32(key.cast("string").cast("binary")) % 3


def value_codes(x: np.ndarray) -> np.ndarray:
    """Codes of numbers from 0 up, in their order: sign, exponent and 8 binary places of the mantissa."""
    return x.astype(np.float32).view(np.uint32) >> 15


def code_tops(codes: np.ndarray) -> np.ndarray:
    """The least number of the next code."""
    return ((codes.astype(np.uint32) + 1) << 15).view(np.float32).astype(float)


def quantile_cuts(docs: DataFrame) -> np.ndarray:
    """Quantiles of each measure over the texts of all rows. What is sent to the driver is bounded by the codes there are, 2 ** 16 a measure."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in by_bytes(batches, "text"):
            codes = value_codes(measures(raw(batch["text"]))).astype(np.int64) | np.arange(len(NAMES)) << 32
            key, n = np.unique(codes, return_counts=True)
            key, at = np.unique(np.concatenate((total[0], key)), return_inverse=True)
            total = key, np.bincount(at, weights=np.concatenate((total[1], n))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total[0]), pa.array(total[1])], ["code", "n"])

    got = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow().sort_by("code")
    code, n = got["code"].to_numpy(), got["n"].to_numpy()
    cuts = np.zeros((len(NAMES), CUTS))
    for k in range(len(NAMES)):
        own = code >> 32 == k
        if own.any():
            upto = np.cumsum(n[own])
            at = np.minimum(np.searchsorted(upto, QUANTILES * upto[-1]), len(upto) - 1)
            cuts[k] = code_tops(code[own][at] & 0xFFFFFFFF)
    return cuts


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among unlabelled rows: a model of either half scores the other."""
    if min(len(p), len(u)) < 2:
        return 0.5
    halves = np.arange(len(p)) % 2, np.arange(len(u)) % 2
    shares = []
    for h in (0, 1):
        w = nn_pu(p[halves[0] == h], u[halves[1] == h], 0.5)
        shares.append(mixture_share(p[halves[0] != h] @ w[:-1], u[halves[1] != h] @ w[:-1]))
    return min(max(float(np.mean(shares)), 0.02), 0.98)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """(cuts, weights, prior)."""
    tuned(docs.sparkSession)
    learn = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text")).where("id IS NOT NULL").where(fold(F.col("id")) != 1)
    known = labels.select(labels[key].alias("id"), labels[label].cast("int").alias("y")).where("id IS NOT NULL AND y = 1").where(fold(F.col("id")) != 1).select("id").distinct()
    good = known.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample).select("id", F.lit(1).alias("kind"))
    free = learn.select("id").withColumn("h", F.xxhash64("id", F.lit(7))).orderBy("h", "id").limit(sample).select("id", F.lit(0).alias("kind"))
    rows = learn.join(F.broadcast(good.unionByName(free).distinct()), "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch["id"].cast(pa.string()), batch["kind"], pa.array([x.tobytes() for x in measures(raw(batch["text"]))], pa.binary())], ["id", "kind", "x"])

    got = rows.mapInArrow(run, "id string, kind int, x binary").toArrow().sort_by([("kind", "ascending"), ("id", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(got["x"].to_pylist()), float).reshape(-1, len(NAMES))
    kind = got["kind"].to_numpy()
    p, u = x[kind == 1], x[kind == 0]
    if not len(p) or not len(u):
        return np.zeros((len(NAMES), CUTS)), np.zeros(len(NAMES) * CUTS + 1), 0.5
    cuts = quantile_cuts(learn)
    p, u = expand(p, cuts), expand(u, cuts)
    prior = class_prior(p, u)
    return cuts, nn_pu(p, u, prior), prior


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) of each row."""
    spark = tuned(docs.sparkSession)
    no_clash([key], ["held_out", "score", "predicted"])
    src = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text"), F.coalesce(fold(docs[key]) == 1, F.lit(False)).alias("held_out"))
    sent = spark.sparkContext.broadcast(model[:2])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, w = sent.value
        for batch in by_bytes(batches, "text"):
            p = sigmoid(expand(measures(raw(batch["text"])), cuts) @ w[:-1] + w[-1])
            yield pa.RecordBatch.from_arrays([batch["id"], batch["held_out"], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int").withColumnRenamed("id", key)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
