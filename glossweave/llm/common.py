"""What the operators of this folder share: words, 64-bit hashes, the shared folder, connected components."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes an Arrow batch holds at most; they bound a worker's memory. A longer row is alone.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Partitions that buckets are dealt to at most. Where there are more buckets, a partition streams its buckets one after the other.
MOST_PARTITIONS = 32_768
#: Entries a worker's memo of words holds before it starts anew.
MEMO = 400_000
_SHIFT = np.uint64(31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, and this package on the workers' path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, paths) if p)
    return spark


def no_clash(kept: Iterable[str], made: Iterable[str]) -> None:
    """Raise ValueError where a kept column has the name of another or of a result column, whatever the case of its letters."""
    kept = [c.lower() for c in kept]
    made = {c.lower() for c in made}
    if bad := sorted({c for c in kept if c in made or kept.count(c) > 1}):
        raise ValueError(f"columns {bad} clash with result columns or each other")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a temporary folder serves in local mode; a cluster must name one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="glossweave-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/glossweave-{uuid.uuid4().hex}"


_STASHED: dict[str, SparkSession] = {}


def stash(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._glossweave_path = path
    if not _STASHED:
        atexit.register(clear_stashes)
    _STASHED[path] = spark
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _STASHED.pop(path, None)


def unstash(*dfs: DataFrame) -> None:
    """Delete stashed rows that no later plan reads."""
    for df in dfs:
        if path := getattr(df, "_glossweave_path", None):
            _delete(df.sparkSession, path)


def stashed(df: DataFrame | None = None) -> set[str]:
    """Folders of stashed rows that are not deleted: all, or that of df."""
    return set(_STASHED) if df is None else {df._glossweave_path}


def drop_stashes(paths: Iterable[str]) -> None:
    for path in paths:
        _delete(_STASHED[path], path)


def clear_stashes() -> None:
    """Delete what results still read: call it when they are written. The end of the driver's Python does, where Spark still runs."""
    for path, spark in list(_STASHED.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  Spark has stopped: its folder outlives it
            _STASHED.pop(path, None)


def dealt(rows: DataFrame, buckets: int, *order: str) -> DataFrame:
    """Rows with a column `bucket` dealt by it: the rows of a bucket are in one partition, one after the other."""
    return rows.repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket", *order)


def buckets_for(docs: DataFrame, stored: int, least: int = 32) -> int:
    """So many buckets that each stands for about so many bytes of stored input, from the number of input partitions."""
    spark = docs.sparkSession
    each = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return max(least, docs.rdd.getNumPartitions() * max(1, each // stored))


def release_memory() -> None:
    """Give freed memory back to the system: the driver goes on for long after a model is fitted."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that every bit of the result depends on every bit of x."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _SHIFT
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A fixed random number for each byte.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
#: Bytes hashed at a time; longer only for a word that is longer.
_BLOCK = 1 << 20


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as they were needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= len(cls.up):
            n = max(n + 1, 2 * len(cls.up))
            make = lambda base: np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)))
            with np.errstate(over="ignore"):
                cls.up, cls.down = make(_BASE), make(pow(_BASE, -1, 1 << 64))
        return cls.up, cls.down


class RunHash:
    """Hashes of any runs of a sequence of uint64, from one pass of prefix sums."""

    def __init__(self, values: np.ndarray) -> None:
        up, _ = _Powers.to(len(values))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = _Powers.to(len(self.sums))
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * down[start] + (end - start).astype(np.uint64))


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of several texts: 64-bit hashes in one array, found without making strings.

    Words of text i are hashes[at[i]:at[i + 1]]; begin and end are their places in `data`, the joined texts.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False) -> None:
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
        data = b"\n".join(t or b"" for t in texts) + b"\n"
        if lower:
            data = data.lower()  # bytes: A-Z only
        self.data = data
        buf = np.frombuffer(data, np.uint8)
        gap = _SPACE[buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(buf) and not gap[0]:
            edge = np.concatenate(([0], edge))
        self.begin, self.end = edge[0::2], edge[1::2]
        self.place = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.at = np.searchsorted(self.begin, self.place)
        self.hashes = np.empty(len(self.begin), np.uint64)
        w = 0
        while w < len(self.begin):
            lo = int(self.begin[w])
            to = max(w + 1, int(np.searchsorted(self.end, lo + _BLOCK, side="right")))
            hi = int(self.end[to - 1])
            self.hashes[w:to] = RunHash(_BYTE[buf[lo:hi]]).of(self.begin[w:to] - lo, self.end[w:to] - lo)
            w = to

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.at[i] : self.at[i + 1]]

    def __len__(self) -> int:
        return len(self.at) - 1


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of so many consecutive words; with fewer words, of the whole; empty for none."""
    n = len(hashes)
    width = min(width, n)
    if not n:
        return hashes
    out = np.full(n - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out ^= hashes[k : n - width + 1 + k]
            out *= np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(35)
    return mix(out)


def raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows, cut so that the texts of a batch hold about so many bytes; a longer text is alone."""
    for batch in batches:
        sizes = np.array([len(x) if x else 0 for x in raw(batch[column])], np.int64)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (u, v): each node with the least node it can reach.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until nothing changes; every step is written to the
    shared folder, so that lineage stays short. Returns (node, root) for nodes that have an edge.
    """

    def total(df: DataFrame):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    now = stash(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = total(now)
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        after = stash(small)
        then = total(after)
        unstash(now)
        now = after
        if then == mark:
            break
        mark = then
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    out = stash(roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().join(now.select(F.col("u").alias("node")).distinct(), "node", "left_anti")))
    unstash(now)
    return out
