"""Cross-entropy difference scores (Moore and Lewis 2010) from two matched n-gram models.

The background model counts all documents, the target model those that are trusted (labelled good and not toxic). Both are
interpolated bigram models with one vocabulary and one set of bigrams, so that their losses differ by their counts alone. Every word
and every pair of the corpus is counted, whatever its size; nothing is broadcast. A pair the whole corpus has once is not kept as a
pair: its share of the context goes to single words.

Documents are dealt by id to chunks of about CHUNK bytes. A chunk sends its distinct pairs with their counts to buckets of the pairs'
hashes; a bucket adds them up and answers each chunk with the totals, in the order asked. With these the chunk knows which of its pairs
are the corpus's only ones, and does the same for its words: counts, counts as a context, and pairs of that context seen once. Then it
has all that its documents' losses need. Texts and answers meet by chunk; the chunk's texts are dealt once and read three times. A chunk asks those buckets
alone that it has words or pairs in, so that what is sent grows with the corpus and not with chunks times buckets; the sizes of the
vocabulary and of the corpora are counted beforehand, by tasks.

score = target loss - background loss, in nats a token; less is nearer to the target. Texts without words (null and empty) have
n_tokens 0 and losses and score 0. Rows without an id are background only: they are scored, and never trusted. Repeated rows stay repeated and count as
often. Other columns are not read; ValueError where the key has the name of a result column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, by_bytes, dealt, mix, no_clash, raw, table, tuned

MIX = 0.6
SMOOTH = 0.5
#: Bytes of text a chunk and a bucket stand for; more text makes more of them.
CHUNK, BUCKET = 6 << 20, 8 << 20
_U = np.uint64
#: Stands before a text's first word.
_BEGIN = _U(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Model:
    """Both models, by what they are counted from; score() counts and answers in one plan."""

    docs: DataFrame
    target: DataFrame
    text: str
    key: str


def _planes(x: np.ndarray) -> bytes:
    """Numbers in as few bytes as the largest needs, the first byte of all, then the second: zeros and sorted tops compress."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _pack(columns: Iterable[np.ndarray]) -> bytes:
    return b"".join(map(_planes, columns))


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        width = blob[at]
        x = np.frombuffer(blob, np.uint8, n * width, at + 1).reshape(width, n)
        out.append(np.ascontiguousarray(x.T).view(f"<u{width}").ravel().astype(_U))
        at += 1 + n * width
    return out


_ASK = "bucket int, chunk int, n long, blob binary"


def _in_buckets(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, begin, end) of the buckets that sorted codes fall in: buckets are ranges of codes."""
    top = ((code >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)
    here, begin = np.unique(top, return_index=True)
    return here.astype(np.int32), begin, np.append(begin[1:], len(code))


def _asks(chunk: int, n: int, code: np.ndarray, counts: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket that the chunk has codes in, in order."""
    here, begin, end = _in_buckets(code, n)
    blobs = [_pack([code[a:b], *(c[a:b] for c in counts)]) for a, b in zip(begin, end, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(here), pa.array(np.full(len(here), chunk, np.int32)), pa.array((end - begin).astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "chunk", "n", "blob"])


def _answers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals over all chunks, to each chunk for what it asked; rows come sorted by bucket."""

    def answer(b: int, asked: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(blob, n) for _, n, blob in asked]
        columns = []
        for k in range(len(parts[0])):
            columns.append(np.concatenate([p[k] for p in parts]))
            for p in parts:
                p[k] = None
        found, where = np.unique(columns[0], return_inverse=True)
        totals = [np.bincount(where, weights=c, minlength=len(found)).astype(_U) for c in columns[1:]]
        del columns
        at = 0
        for chunk, n, _ in asked:
            mine = where[at : at + n]
            at += n
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([chunk], pa.int32()), pa.array([n], pa.int64()), pa.array([_pack(t[mine] for t in totals)], pa.binary())], ["bucket", "chunk", "n", "blob"])

    now, held = None, []
    for batch in batches:
        for b, *rest in zip(*(batch[c].to_pylist() for c in ("bucket", "chunk", "n", "blob")), strict=True):
            if b != now:
                if held:
                    yield from answer(now, held)
                now, held = b, []
            held.append(tuple(rest))
    if held:
        yield from answer(now, held)


def _told(answers: list[dict] | None, columns: int) -> list[np.ndarray]:
    """The totals in order of the chunk's sorted codes."""
    parts = [_unpack(a["blob"], a["n"]) for a in sorted(answers or (), key=lambda a: a["bucket"])]
    return [np.concatenate(x).astype(np.float64) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * columns


def _distinct_words(n: int):
    """Distinct words of groups of batches, to buckets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0

        def sent() -> pa.RecordBatch:
            code = np.unique(np.concatenate(found))
            here, begin, end = _in_buckets(code, n)
            return pa.RecordBatch.from_arrays([pa.array(here), pa.array([_pack([code[a:b]]) for a, b in zip(begin, end, strict=True)], pa.binary()), pa.array((end - begin).astype(np.int64))], ["bucket", "blob", "n"])

        for batch in by_bytes(batches, "text"):
            words = Words(raw(batch["text"]), lower=True)
            found.append(np.unique(words.hashes))
            size += len(words.data)
            if size > 4 * CHUNK:
                yield sent()
                found, size = [], 0
        if found:
            yield sent()

    return run


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, known, total = None, np.zeros(0, _U), 0
    for batch in batches:
        for b, blob, n in zip(*(batch[c].to_pylist() for c in ("bucket", "blob", "n")), strict=True):
            if b != now:
                total, known, now = total + len(known), np.zeros(0, _U), b
            known = np.union1d(known, _unpack(blob, n)[0])
    yield pa.RecordBatch.from_arrays([pa.array([total + len(known)])], ["n"])


class _Chunk:
    """A chunk's documents as words and pairs, the same each time whatever the order of its rows."""

    def __init__(self, docs: pa.Array, good: pa.Scalar | None) -> None:
        self.ids, self.asked = docs.field("id"), docs.field("ask")
        self.words = words = Words(raw(docs.field("text")), lower=True)
        self.now = words.hashes
        self.before = np.concatenate(([_BEGIN], self.now[:-1])) if len(self.now) else self.now
        self.starts = words.at[:-1][np.diff(words.at) > 0]
        self.before[self.starts] = _BEGIN
        with np.errstate(over="ignore"):
            pair = mix(self.before * _U(0x9FB21C651E98DF25) + self.now)
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        counted = docs.field("counted").to_numpy(zero_copy_only=False)
        trusted = counted & pc.is_in(self.ids, value_set=good.values).to_numpy(zero_copy_only=False) if good is not None and good.is_valid else np.zeros(len(self.ids), bool)
        self.weights = [np.repeat(x.astype(np.float64), np.diff(words.at)) for x in (counted, trusted)]

    def number_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted codes of words and of the beginning, the place of each word among them, that of the word before)."""
        codes, now = np.unique(self.now, return_inverse=True)
        if not len(now):
            return codes, now, now
        at = int(np.searchsorted(codes, _BEGIN))
        if at == len(codes) or codes[at] != _BEGIN:
            codes, now = np.insert(codes, at, _BEGIN), now + (now >= at)
        before = np.concatenate((now[:1], now[:-1]))
        before[self.starts] = at
        return codes, now, before


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, _Chunk, dict[str, list[dict]]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            good = row["good"][0] if "good" in row.schema.names else None
            yield row["chunk"][0].as_py(), _Chunk(row["docs"][0].values, good), {c: row[c][0].as_py() for c in ("pairs", "words") if c in row.schema.names}


def _ask_pairs(n: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, x, _ in _chunks(batches):
            yield _asks(chunk, n, x.pairs, [np.bincount(x.pair, weights=w, minlength=len(x.pairs)).astype(_U) for w in x.weights])

    return run


def _ask_words(n: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, x, told in _chunks(batches):
            once = (_told(told["pairs"], 2)[0] == 1)[x.pair]
            codes, now, before = x.number_words()
            counts = [np.bincount(at, weights=w * s, minlength=len(codes)).astype(_U) for at, s in ((now, 1), (before, 1), (before, once)) for w in x.weights]
            yield _asks(chunk, n, codes, counts)

    return run


def _losses(x: _Chunk, told: dict[str, list[dict]], size: int, total: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, summed losses by model) for each text. size: of the vocabulary and two; total: words of either model."""
    pair, word = _told(told["pairs"], 2), _told(told["words"], 6)
    _, now, before = x.number_words()
    sums = np.zeros((len(x.now) + 1, 2))
    for m in range(2):
        single, context, once = (word[2 * k + m] for k in range(3))
        safe = np.maximum(context, 1)
        p = (1 - MIX * (context - once) / safe)[before] * ((single + SMOOTH) / (total[m] + SMOOTH * size))[now]
        p += np.where(pair[0] > 1, MIX * pair[m], 0)[x.pair] / safe[before]
        np.cumsum(-np.log(p), out=sums[1:, m])
    at = x.words.at
    return np.diff(at), sums[at[1:]] - sums[at[:-1]]


def train(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """Models of all documents and of those whose id is in target."""
    return Model(docs, target, text, key)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, target_loss, background_loss, score) of each row; losses are means over its tokens."""
    no_clash([key], ["n_tokens", "target_loss", "background_loss", "score"])
    tuned(docs.sparkSession).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(CHUNK // 2))  # a chunk is one row
    kind = docs.schema[key].dataType

    def rows(d: DataFrame, text: str, key: str, counted: bool, ask: bool) -> DataFrame:
        return d.select(d[key].cast(kind).alias("id"), d[text].cast("string").alias("text"), F.lit(counted).alias("counted"), F.lit(ask).alias("ask"))

    if (text, key) == (model.text, model.key) and docs.sameSemantics(model.docs):
        src = rows(docs, text, key, True, True)
    else:
        src = rows(model.docs, model.text, model.key, True, False).union(rows(docs, text, key, False, True))
    good = model.target.select(model.target[model.key].cast(kind).alias("id")).where("id IS NOT NULL").distinct()
    # counted before the join, so that no text is dealt for it
    n_words = F.when(F.col("counted"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).otherwise(0)
    narrow = src.select("id", n_words.alias("n"), F.octet_length("text").alias("bytes"))
    sums = narrow.join(good.withColumn("good", F.lit(True)), "id", "left").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("all"), F.sum(F.when(F.col("good"), F.col("n"))).alias("good")).first()
    size, total = sums["bytes"] or 0, (sums["all"] or 0, sums["good"] or 0)
    chunks, n = max(4, size // CHUNK), max(4, size // BUCKET)
    types = dealt(src.where("counted").select("text").mapInArrow(_distinct_words(n), "bucket int, blob binary, n long"), n).mapInArrow(_count_words, "n long").agg(F.sum("n")).first()[0] or 0

    def chunk(by: Column) -> Column:
        # never null, so that inner joins add no filter and Spark deals the texts once
        return F.coalesce(F.pmod(by, F.lit(chunks)).cast("int"), F.lit(0)).alias("chunk")

    by_id = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id"))
    texts = src.select(chunk(by_id), F.struct("id", "text", "counted", "ask").alias("d")).groupBy("chunk").agg(F.collect_list("d").alias("docs")).hint("merge")
    good = good.select(chunk(F.xxhash64("id")), "id").groupBy("chunk").agg(F.collect_list("id").alias("good")).hint("merge")

    def answered(asked: DataFrame, ask: Callable, name: str) -> DataFrame:
        told = dealt(asked.mapInArrow(ask, _ASK), n).mapInArrow(_answers, _ASK)
        return told.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "blob")).alias(name)).hint("merge")

    pairs = answered(texts.join(good, "chunk", "left"), _ask_pairs(n), "pairs")
    words = answered(texts.join(good, "chunk", "left").join(pairs, "chunk", "left"), _ask_words(n), "words")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, told in _chunks(batches):
            tokens, loss = _losses(x, told, types + 2, total)
            mean = loss / np.maximum(tokens, 1)[:, None]
            made = pa.RecordBatch.from_arrays([x.ids, pa.array(tokens.astype(np.int64)), pa.array(mean[:, 1]), pa.array(mean[:, 0]), pa.array(mean[:, 1] - mean[:, 0])], [key, "n_tokens", "target_loss", "background_loss", "score"])
            yield made.filter(x.asked)

    return texts.join(pairs, "chunk", "left").join(words, "chunk", "left").mapInArrow(run, f"`{key}` {kind.simpleString()}, n_tokens long, target_loss double, background_loss double, score double")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")))
