"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other: the model of each gets the log-odds of all earlier ones beside the text's features.
While training, those are out-of-fold predictions, so that a later model learns how far an earlier one can be trusted. Features are
the presence of words and of their first letters (4 to 6), hashed.

A label table with one flag gives three categories, derived on the training rows: `term` (toxic, with a word that is found in toxic
texts almost alone), `dense` (toxic, with three or more of them) and `toxic` itself; with more flags, each is a category. Which words
tell is found anew for each fold from the other folds' rows, so that a row held out shapes neither labels nor features of the model that predicts
it. The threshold of the last category is the one with the fewest errors out of fold.

Models are fitted on at most SAMPLE labelled rows, those of least id hash. The fits of a category, one for each fold and one of all rows, are tasks;
the driver holds the sample's features and no model but the results. Null and empty texts have no features: their score is the
models' constant, and they are never rejected. Repeated rows stay repeated; a label that is repeated counts as its greatest. Labels are no
features. An empty or one-sided label table rejects nothing. Carried columns stay; ValueError where one has the name of a result column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MEMO, by_bytes, no_clash, release_memory, table, tuned
from .linear import CHUNK, Rows, logistic, logit, sigmoid

SAMPLE = 12_000
FOLDS = 4
#: Places for hashed words, and as many for hashed beginnings of words.
PLACES = 1 << 20
#: Features a model has at most: those that tell most about the label.
WIDTH = 4096
#: Where training can't tell a threshold.
THRESHOLD = 0.5
_LETTERS = re.compile(r"[^\W\d_]+")


class Features:
    """A text's distinct features, sorted: words below PLACES, beginnings above."""

    def __init__(self) -> None:
        self.memo: dict[str, tuple[int, ...]] = {}

    def _new(self, word: str) -> tuple[int, ...]:
        h = xxhash.xxh3_64_intdigest
        return (h(word) % PLACES, *(PLACES + h(word[:k], seed=k) % PLACES for k in (4, 5, 6) if len(word) >= k))

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        memo, out = self.memo, []
        for w in set(_LETTERS.findall(text.lower())):
            got = memo.get(w)
            if got is None:
                if len(memo) > MEMO // 2:
                    memo.clear()
                got = memo[w] = self._new(w)
            out.extend(got)
        return np.unique(np.array(out, np.int32))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that divides out-of-fold predictions with the fewest errors: the middle of the widest such gap (in log-odds)."""
    order = np.argsort(p, kind="stable")
    z, y = logit(p[order]), y[order]
    # a threshold before place i rejects i and what follows
    errors = np.concatenate(([0], np.cumsum(y))) + (len(y) - y.sum()) - np.concatenate(([0], np.cumsum(1 - y)))
    low, high = np.concatenate((z[:1], z)), np.concatenate((z, z[-1:]))
    ok = np.flatnonzero((errors == errors.min()) & (high > low))
    if not len(ok):
        return THRESHOLD
    i = ok[np.argmax(high[ok] - low[ok])]
    return float(sigmoid((low[i] + high[i]) / 2))


class Chain:
    """Categories in order, each with weights by feature place, weights of earlier log-odds, and a constant; the last one's threshold."""

    threshold = THRESHOLD

    def __init__(self, names: list[str], weights: list[dict[int, float]], earlier: list[np.ndarray], constant: list[float]) -> None:
        self.names, self.weights, self.earlier, self.constant = names, weights, earlier, constant
        used = sorted(set().union(*weights))
        self.place = np.zeros(2 * PLACES, np.int32)  # 0: in no model
        self.place[used] = np.arange(1, len(used) + 1)
        self.table = np.zeros((len(names), len(used) + 1))
        for row, w in zip(self.table, weights, strict=True):
            row[self.place[list(w)]] = list(w.values())

    def scores(self, features: np.ndarray) -> list[float]:
        sums, odds = self.table[:, self.place[features]].sum(axis=1), []
        for k in range(len(self.names)):
            odds.append(float(np.clip(sums[k] + self.constant[k] + np.dot(self.earlier[k], odds), -14, 14)))
        return sigmoid(np.array(odds)).tolist()


@dataclass
class Sample:
    """Training rows: row i has the features col[at[i]:at[i + 1]], a 0/1 flag for each category, and a fold."""

    at: np.ndarray
    col: np.ndarray
    flags: np.ndarray
    fold: np.ndarray

    def parts(self, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of the rows taken each entry's number of its row among them, and its feature; about CHUNK entries at a time."""
        place = np.full(len(self.fold), -1, np.int32)
        place[of] = np.arange(len(of))
        cuts = np.unique(np.concatenate(([0], np.searchsorted(self.at, np.arange(CHUNK, int(self.at[-1]), CHUNK)), [len(self.fold)])))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            row = np.repeat(place[lo:hi], np.diff(self.at[lo : hi + 1]))
            taken = row >= 0
            yield row[taken], self.col[self.at[lo] : self.at[hi]][taken]

    def counts(self, of: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of y, number) of the rows taken that have each feature."""
        n1, n = np.zeros(2 * PLACES), np.zeros(2 * PLACES, np.int64)
        for row, col in self.parts(of):
            n1 += np.bincount(col, weights=y[row], minlength=2 * PLACES)
            n += np.bincount(col, minlength=2 * PLACES)
        return n1, n

    def labels(self, of: np.ndarray) -> np.ndarray:
        """A column for each category, from the rows taken alone."""
        if self.flags.shape[1] > 1:
            return self.flags[of].astype(float)
        toxic = self.flags[of, 0].astype(float)
        n1, n = self.counts(of, toxic)
        telling = (n >= 3) & (n1 >= 0.95 * n)
        telling[PLACES:] = False
        found = np.zeros(len(of))
        for row, col in self.parts(of):
            found += np.bincount(row, weights=telling[col], minlength=len(of))
        return np.stack([toxic * (found >= 1), toxic * (found >= 3), toxic], axis=1)


def _informative(n1: np.ndarray, n: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """The features whose presence tells most about y (by a signed-root likelihood ratio), sorted."""
    seen = np.flatnonzero(n >= 3)
    base = y.mean()
    p = (n1[seen] + base) / (n[seen] + 1)
    gain = n[seen] * (p * np.log(p / base) + (1 - p) * np.log((1 - p + 1e-9) / (1 - base)))
    return np.sort(seen[np.argsort(-gain, kind="stable")[:most]])


def fit_one(x: Sample, k: int, held: int | None, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Category k's model of all rows but those of a fold: (features, weights with those of earlier log-odds and the constant, log-odds of the held rows)."""
    every = np.arange(len(x.fold))
    of = every if held is None else every[x.fold != held]
    out = every[:0] if held is None else every[x.fold == held]
    y = x.labels(of)[:, k] if len(of) else np.zeros(0)
    if not 0 < y.sum() < len(y):
        c = 14.0 if len(y) and y.sum() else -14.0
        return every[:0], np.append(np.zeros(odds.shape[1]), c), np.full(len(out), c)
    use = _informative(*x.counts(of, y), y, WIDTH)
    place = np.full(2 * PLACES, -1, np.int32)
    place[use] = np.arange(len(use))
    kind = np.min_scalar_type(len(use))

    def rows(which: np.ndarray) -> Rows:
        sizes, cols = np.zeros(len(which), np.int64), [place[:0].astype(kind)]
        for row, col in x.parts(which):
            col = place[col]
            sizes += np.bincount(row[col >= 0], minlength=len(which))
            cols.append(col[col >= 0].astype(kind))
        at = np.concatenate(([0], np.cumsum(sizes)))
        return Rows(at, np.concatenate(cols), len(use), np.concatenate((odds[which] / 14, np.ones((len(which), 1))), axis=1))

    w = logistic(rows(of), y)
    return use, w, rows(out).dot(w) if len(out) else np.zeros(0)


def fit(features: list[np.ndarray], labels: np.ndarray, names: list[str], fold: np.ndarray, share: Callable | None = None) -> Chain:
    """A chain from rows of features and a 0/1 column for each category; one column alone is divided into three.

    share(sample) gives a function that does a list of jobs for fit_one, as in tasks; by default they are done here.
    """
    at = np.concatenate(([0], np.cumsum([len(f) for f in features]))).astype(np.int64)
    col = np.concatenate([*features, np.zeros(0, np.int32)])
    common = np.bincount(col, minlength=2 * PLACES)[col] >= 3  # rarer ones are used nowhere
    sample = Sample(np.concatenate(([0], np.cumsum(common)))[at], col[common], labels, fold)
    del col, common
    do = share(sample) if share else lambda jobs: [fit_one(sample, *j) for j in jobs]
    names = ["term", "dense", "toxic"] if len(names) == 1 else names
    odds = np.zeros((len(features), 0))
    weights, earlier, constant = [], [], []
    folds = np.unique(fold).tolist()
    for k in range(len(names)):
        (use, w, _), *held = do([(k, None, odds), *((k, f, odds) for f in folds)])
        weights.append(dict(zip(use.tolist(), w[: len(use)].tolist(), strict=True)))
        earlier.append(w[len(use) : -1] / 14)
        constant.append(float(w[-1]))
        own = np.zeros(len(features))
        for f, (_, _, z) in zip(folds, held, strict=True):
            own[fold == f] = z
        odds = np.concatenate((odds, np.clip(own, -14, 14)[:, None]), axis=1)
    chain = Chain(names, weights, earlier, constant)
    last = labels[:, -1].astype(float)
    if 0 < last.sum() < len(last):
        chain.threshold = best_threshold(sigmoid(odds[:, -1]), last)
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: list[str], text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Chain:
    """A chain from the labelled rows with the least hash of their id, `sample` of them at most."""
    tuned(docs.sparkSession)
    flags = labels.select(labels[key].alias("id"), *(labels[c].cast("int").alias(f"c{i}") for i, c in enumerate(categories))).where(" AND ".join(f"c{i} IS NOT NULL" for i in range(len(categories))) + " AND id IS NOT NULL").groupBy("id").agg(*(F.max(f"c{i}").alias(f"c{i}") for i in range(len(categories))))
    few = flags.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample)
    rows = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text")).join(F.broadcast(few), "id")
    wide = len(categories)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in by_bytes(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch["h"], pa.array([features.of(t).tobytes() for t in batch["text"].to_pylist()], pa.binary()), *(batch[f"c{i}"] for i in range(wide))], ["h", "features", *(f"c{i}" for i in range(wide))])

    got = rows.mapInArrow(run, "h long, features binary, " + ", ".join(f"c{i} int" for i in range(wide))).toArrow().sort_by("h")
    x = [np.frombuffer(b, np.int32) for b in got["features"].to_pylist()]
    y = np.stack([got[f"c{i}"].to_numpy() for i in range(wide)], axis=1) if len(x) else np.zeros((0, wide))
    fold = got["h"].to_numpy() % FOLDS
    del got
    spark = docs.sparkSession
    sent = []

    def share(sample: Sample) -> Callable:
        sent.append(one := spark.sparkContext.broadcast(sample))

        def task(job: tuple) -> tuple:
            out = fit_one(one.value, *job)
            release_memory()  # the worker goes on with other tasks
            return out

        return lambda jobs: spark.sparkContext.parallelize(jobs, len(jobs)).map(task).collect()

    chain = fit(x, y, categories, fold, share)
    for one in sent:
        one.destroy()
    del x
    release_memory()
    return chain


def score(docs: DataFrame, chain: Chain, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = (), threshold: float | None = None) -> DataFrame:
    """(key, carried columns, p_<category>..., rejected): rejected where the last category's probability reaches the threshold, by default the chain's."""
    spark = tuned(docs.sparkSession)
    threshold = chain.threshold if threshold is None else threshold
    made = [*(f"p_{c}" for c in chain.names), "rejected"]
    keys = [key, *(c for c in carry if c != key)]
    no_clash(keys, made)
    # columns by place: the kept ones may have any name
    src = docs.select(docs[text].cast("string").alias("text"), *(docs[c].alias(f"c{i}") for i, c in enumerate(keys)))
    own = [f"c{i}" for i in range(len(keys))]
    sent = spark.sparkContext.broadcast((chain.names, chain.weights, chain.earlier, chain.constant))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), Chain(*sent.value)
        for batch in by_bytes(batches, "text"):
            p = [(model.scores(x), len(x)) for x in map(features.of, batch["text"].to_pylist())]
            cols = [pa.array([q[0][k] for q in p], pa.float64()) for k in range(len(model.names))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own), *cols, pa.array([n > 0 and q[-1] >= threshold for q, n in p], pa.bool_())], [*own, *made])

    out = src.mapInArrow(run, ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in own) + "".join(f", `{c}` double" for c in made[:-1]) + ", rejected boolean")
    return out.toDF(*keys, *made)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"), ["toxic"]))
