"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of words (A-Z in lower case). A leak of an item is a run of a document's words within an edit distance of
a fifth of the item's words. A random walk (Chakraborty, Goldenberg, Koucky 2016) copies a window into a longer sequence; it moves on
or stays at each step by a bit that depends on the step and the word, so that few edits become few differing places. Bands of sampled places,
over several walks, are looked up among the items of the window's size; what meets is verified by exact edit distance.

Windows are embedded where they can hold a leak at all. Of the m - q + 1 runs of q words that an item has, each edit breaks at most q; with
q = min(3, m // (edits + 1)) one or more are always left, so windows start where such a run puts the item's first word, if enough of them
are near. That loses nothing, at any length; what can be lost is lost by the bands alone (README: measured recall by length). Items of
under five words allow no edit and are found exactly.

Items are broadcast in blocks of about BLOCK_BYTES of text, by a sum over all items beforehand; each block is one scan of the documents.
Null and empty texts, of items or documents, hold nothing. Each pair of a document row and an item is one row, however often the document
holds the item: with the nearest run, the first of equally near ones. Repeated rows of either table are rows of their own. Other columns
are not read; ValueError where the key has the name of a result column.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, by_bytes, mix, no_clash, raw, table, tuned, windows

#: Bytes of item texts that a broadcast holds on average.
BLOCK_BYTES = 4 << 20
#: An edit distance of up to m * NUM // DEN words.
NUM, DEN = 1, 5
#: Walks (more for long items, whose walks meet less often), and per walk bands of so many sampled steps.
WALKS, BANDS, SAMPLES = 12, 6, 3
_U = np.uint64
_BITMAP = 1 << 22


def cgk(rows: np.ndarray, walk: int, steps: np.ndarray) -> np.ndarray:
    """The embedding's symbols at the given (sorted) steps, for windows of one size (a row each); 0 once the walk has left its window."""
    n, size = rows.shape
    each = np.arange(n)
    bits = [mix(rows ^ mix(np.full(1, (walk << 16) | k, _U))) for k in range(int(steps[-1]) // 64 + 1)]
    at, out, k = np.zeros(n, np.int64), np.zeros((n, len(steps)), _U), 0
    for j in range(int(steps[-1]) + 1):
        inside, here = at < size, np.minimum(at, size - 1)
        if k < len(steps) and steps[k] == j:
            out[:, k] = np.where(inside, rows[each, here], _U(0))
            k += 1
        at += np.where(inside, (bits[j // 64][each, here] >> _U(j % 64)) & _U(1), _U(1)).astype(np.int64)
    return out


@functools.cache
def sampled(size: int) -> list[list[np.ndarray]]:
    """For each walk its bands' sampled steps: fixed by the size; of the steps that walks reach within the window."""
    g = np.random.default_rng(size)
    reach = max(SAMPLES, int(1.7 * size))
    walks = max(WALKS, min(1000, size * WALKS // 60))
    return [[np.sort(g.choice(reach, SAMPLES, replace=False)) for _ in range(BANDS)] for _ in range(walks)]


def band_keys(rows: np.ndarray) -> np.ndarray:
    """A key for each window (row) and band."""
    size, keys = rows.shape[1], []
    for w, bands in enumerate(sampled(size)):
        steps = np.unique(np.concatenate(bands))
        got = cgk(rows, w, steps)
        for b, own in enumerate(bands):
            x = np.full(len(rows), (size << 20) | (w << 10) | b, _U)
            for c in np.searchsorted(steps, own):
                x = mix(x ^ got[:, c])
            keys.append(x)
    return np.stack(keys, axis=1)


def edit_matches(item: list[int], region: list[int], most: int) -> tuple[int, int] | None:
    """(distance, end) of the run of the region nearest to the item, by Myers' bit vectors; None if farther than most."""
    m = len(item)
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = (m, 0)
    for j, w in enumerate(region):
        eq = where.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= most else None


def seed_width(size: int) -> int:
    """Words of the runs of which an item of so many words keeps one or more, whatever the allowed edits."""
    return min(3, size // (size * NUM // DEN + 1))


class Seeds:
    """Runs of so many words of items, to be found in texts."""

    def __init__(self, width: int, runs: dict[int, np.ndarray]) -> None:
        self.width = width
        got = {k: windows(r, width) for k, r in runs.items()}
        seed = np.concatenate(list(got.values()))
        item = np.concatenate([np.full(len(x), k) for k, x in got.items()])
        place = np.concatenate([np.arange(len(x)) for x in got.values()])
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place = seed[order], item[order], place[order]
        self.bitmap = np.zeros(_BITMAP, bool)
        self.bitmap[(seed % _U(_BITMAP)).astype(np.int64)] = True

    def starts(self, words: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(size, first word) of the windows that can be near an item of that size."""
        none = np.zeros((0, 2), np.int64)
        if len(words) < self.width:
            return none
        t = windows(words, self.width)
        hit = np.flatnonzero(self.bitmap[(t % _U(_BITMAP)).astype(np.int64)])
        low, high = np.searchsorted(self.seed, t[hit]), np.searchsorted(self.seed, t[hit], side="right")
        n = high - low
        hit = np.repeat(hit, n)
        entry = np.repeat(low, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        item = self.item[entry]
        start, size = hit - self.place[entry], size[item]
        most = size * NUM // DEN
        code = np.sort(item * (len(words) + 1) + hit)
        near = lambda at: np.searchsorted(code, item * (len(words) + 1) + np.clip(at, 0, len(words)))
        ok = near(start + size + 2 * most) - near(start - most) >= size - self.width + 1 - self.width * most
        return np.unique(np.stack([size[ok], np.maximum(start[ok], 0)], axis=1), axis=0)


class Items:
    """A block of items, ready to be met by windows."""

    def __init__(self, ids: list, texts: list[bytes | None]) -> None:
        words = Words(texts, lower=True)
        runs = [words.of(i) for i in range(len(words))]
        keep = [i for i, r in enumerate(runs) if len(r)]
        self.ids, self.runs = [ids[i] for i in keep], [runs[i].tolist() for i in keep]
        self.size = np.array([len(r) for r in self.runs], np.int64)
        by_width: dict[int, dict[int, np.ndarray]] = {}
        by_size: dict[int, list[int]] = {}
        for k, i in enumerate(keep):
            by_width.setdefault(seed_width(len(runs[i])), {})[k] = runs[i]
            by_size.setdefault(len(runs[i]), []).append(k)
        self.seeds = [Seeds(width, own) for width, own in sorted(by_width.items())]
        self.bands: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, own in by_size.items():
            keys = band_keys(np.array([self.runs[k] for k in own], _U))
            flat, who = keys.ravel(), np.repeat(np.array(own), keys.shape[1])
            order = np.argsort(flat, kind="stable")
            self.bands[size] = flat[order], who[order]

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """(item, first word) pairs at which a window meets an item in a band; words of several documents at once."""
        found = [np.zeros((0, 2), np.int64)]
        for seeds in self.seeds:
            spots = seeds.starts(words, self.size)
            for s in np.unique(spots[:, 0]).tolist():
                at = spots[spots[:, 0] == s, 1]
                flat, who = self.bands[s]
                for lo in range(0, len(at), 20_000):
                    part = at[lo : lo + 20_000]
                    place = part[:, None] + np.arange(s)
                    keys = band_keys(np.where(place < len(words), words[np.minimum(place, len(words) - 1)], _U(0)))
                    a, b = np.searchsorted(flat, keys.ravel()), np.searchsorted(flat, keys.ravel(), side="right")
                    n = b - a
                    if n.any():
                        entry = np.repeat(a, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                        found.append(np.unique(np.stack([who[entry], np.repeat(np.repeat(part, keys.shape[1]), n)], axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def leaks(self, words: Words) -> list[tuple[int, int, int, int, int]]:
        """(document's position, item's, distance, first word, last word + 1): the nearest run for each pair that is near enough."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        found = self.candidates(words.hashes)
        doc = np.searchsorted(words.at, found[:, 1], side="right") - 1
        seen: set[tuple[int, int, int]] = set()
        for (k, start), d in zip(found.tolist(), doc.tolist(), strict=True):
            item = self.runs[k]
            m = len(item)
            most = m * NUM // DEN
            # a window can begin before the document that holds its triple: each document it touches is searched
            for e in range(d, min(int(np.searchsorted(words.at, start + m, side="left")), len(words))):
                a, b = int(words.at[e]), int(words.at[e + 1])
                lo, hi = max(a, start - m), min(b, start + 2 * m)
                if hi - lo < m - most or (k, e, start // m) in seen:
                    continue
                seen.add((k, e, start // m))
                lo, hi = max(a, start // m * m - m), min(b, start // m * m + 3 * m)
                region = words.hashes[lo:hi].tolist()
                got = edit_matches(item, region, most)
                if got and ((e, k) not in best or got[0] < best[e, k][0]):
                    far = edit_matches(item[::-1], region[: got[1]][::-1], most)
                    best[e, k] = (got[0], lo + got[1] - (far[1] if far else m) - a, lo + got[1] - a)
        return [(e, k, *v) for (e, k), v in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, n_words, distance, first_word, end_word): a row for each document and item that it leaks."""
    spark = tuned(docs.sparkSession)
    names = ["item_id", "n_words", "distance", "first_word", "end_word"]
    no_clash([key], names)
    src = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text"))
    items = benchmark.select(benchmark[item_key].alias("item_id"), benchmark[item_text].cast("string").alias("item_text")).where("item_text IS NOT NULL")
    item_kind = items.schema["item_id"].dataType
    size = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    schema = f"id {src.schema['id'].dataType.simpleString()}, item_id {item_kind.simpleString()}, n_words long, distance long, first_word long, end_word long"
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(item_kind)

    def search(block: int) -> DataFrame:
        rows = items.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == block).collect()
        sent = spark.sparkContext.broadcast([(r["item_id"], r["item_text"].encode()) for r in rows])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items([x[0] for x in sent.value], [x[1] for x in sent.value])
            for batch in by_bytes(batches, "text"):
                got = known.leaks(Words(raw(batch["text"]), lower=True))
                if got:
                    doc, item, dist, first, end = (list(c) for c in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(doc)), pa.array([known.ids[k] for k in item], item_type), pa.array([len(known.runs[k]) for k in item], pa.int64()), *(pa.array(c, pa.int64()) for c in (dist, first, end))], ["id", *names])

        return src.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [search(b) for b in range(blocks)]).withColumnRenamed("id", key)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
