"""Substring dedup: suffix automata of reference shards; texts streamed for matching statistics.

The reference is the corpus itself, so automata of all of it can't go to every task: that would grow with the square of the
corpus. Each 35-word window is therefore routed by its anchor, the least-hashed 8-word run in it: equal windows have equal
anchors, so that the shard of an anchor's segments (the words that the windows with that anchor cover) holds every
start of each of its windows. A shard is bounded; its automaton lives in one task and meets only the segments that can match it.

1. One pass over the texts finds anchors; what is sent is the anchor's hash, its windows and a hash of the segment. A segment with
   two starts needs no comparison, as all of its windows repeat. Of equal segments in a group of texts one is sent, so that no anchor,
   however common, brings more to its task than a few starts a group.
2. Of anchors with other segments, a copy of each segment is fetched. Their suffix automaton, with the number of starts of
   each of its strings, is streamed with each segment: where at least 35 matched words have two or more starts, they go.
   Anchors with more than WIDE different segments (the edges of a very common passage) are split by window instead, and
   starts of each window counted, by 128 bits of hashes.
3. Spans found are merged by document and removed.

Results are the same by either way. README tells which share of the windows is decided where.

A null text has no words; a text of under 35 words loses none. Rows that are equal, ids included, each count as a start of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RunHash, Words, buckets_for, by_bytes, dealt, no_clash, raw, stash, table, tuned, unstash, windows

WINDOW = 35
GRAM = 8
#: Different segments an automaton takes at most: about 50,000 words.
WIDE = 1000
#: Bytes of text that a task looks at together before it sends, and different segments of one anchor that such a group sends to the anchor's bucket.
GROUP, LOCAL = 16 << 20, 64
#: Bytes of starts that a task holds before those of wide anchors go.
HOLD = 64 << 20
_U = np.uint64
_POS = _U(26)  # bits of a word's position in its document
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def anchors(hashes: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each anchor of a document: the windows that have it as their least-hashed run of words."""
    n = len(hashes)
    if n < width:
        z = np.zeros(0, np.int64)
        return z.astype(_U), z, z
    grams = windows(hashes, GRAM)
    code = (grams >> _POS << _POS) | np.arange(len(grams), dtype=_U)
    span, low, have = width - GRAM + 1, code, 1
    while have < span:  # the least of a sliding window, by doubling
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    at = (low & ((_U(1) << _POS) - _U(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return grams[at[first]], first, np.append(first[1:], len(at)) - 1


class Automaton:
    """Suffix automaton of several sequences, with the number of starts of each string; a sequence can count more than once."""

    def __init__(self, sequences: list[list[int]], times: list[int]) -> None:
        step: list[dict[int, int]] = [{}]
        link, length, count = [-1], [0], [0]
        for k, (seq, many) in enumerate(zip(sequences, times, strict=True)):
            last = 0
            for w in seq:
                p, q = last, step[last].get(w)
                if q is not None and length[q] == length[p] + 1:
                    last = q
                    count[last] += many
                    continue
                if q is None:
                    cur = len(step)
                    step.append({})
                    length.append(length[p] + 1)
                    link.append(0)
                    count.append(many)
                    while p >= 0 and w not in step[p]:
                        step[p][w] = cur
                        p = link[p]
                    if p < 0:
                        last = cur
                        continue
                    q = step[p][w]
                    if length[p] + 1 == length[q]:
                        link[cur] = q
                        last = cur
                        continue
                else:
                    cur = -1
                clone = len(step)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                count.append(0)
                while p >= 0 and step[p].get(w) == q:
                    step[p][w] = clone
                    p = link[p]
                link[q] = clone
                if cur >= 0:
                    link[cur] = clone
                    last = cur
                else:
                    count[clone] += many
                    last = clone
        for v in sorted(range(1, len(step)), key=length.__getitem__, reverse=True):
            if link[v] > 0:
                count[link[v]] += count[v]
        self.step, self.link, self.length, self.count = step, link, length, count

    def matches(self, seq: list[int], starts: int = 2) -> list[int]:
        """Matching statistics: for each place the length of the longest string ending there that has so many starts."""
        step, link, length, count = self.step, self.link, self.length, self.count
        at = n = 0
        out = []
        for w in seq:
            while True:
                to = step[at].get(w)
                if to is not None and count[to] >= starts:
                    at, n = to, n + 1
                    break
                if at == 0:
                    n = 0
                    break
                at = link[at]
                n = length[at]
            out.append(n)
        return out


#: A start of an anchor: its hash, a hash of its segment, row and first window, windows after that; 2 times stands for more, too.
_START = np.dtype([("key", "<u8"), ("seg", "<u8"), ("rid", "<i8"), ("first", "<u4"), ("more", "<u2"), ("times", "u1")])
#: A window of a wide anchor.
_WINDOW = np.dtype([("key", "<u8"), ("hash", "<u8"), ("rid", "<i8"), ("at", "<u4"), ("times", "u1")])
_SPAN = np.dtype([("rid", "<i8"), ("first", "<u4"), ("last", "<u4")])
#: What a packed row holds.
STARTS, WIDE_STARTS, SPANS, SEGMENT, WINDOWS = range(5)
_MORE = 60_000  # windows that "more" can tell; longer runs, as in a text of one word, are sent in pieces


def _packed(rows: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, rows of it as bytes, column by column, so that they compress)."""
    if not len(rows):
        return
    order = np.argsort(bucket, kind="stable")
    here, start = np.unique(bucket[order], return_index=True)
    for b, part in zip(here.tolist(), np.split(rows[order], start[1:]), strict=True):
        yield b, b"".join(np.ascontiguousarray(part[c]).tobytes() for c in rows.dtype.names)


def _unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    n = len(blob) // kind.itemsize
    out, at = np.empty(n, kind), 0
    for c in kind.names:
        out[c] = np.frombuffer(blob, kind[c], n, at)
        at += n * kind[c].itemsize
    return out


def _filled(kind: np.dtype, **columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(next(iter(columns.values()))), kind)
    for c, x in columns.items():
        out[c] = x
    return out


def _runs(*columns: np.ndarray) -> np.ndarray:
    """For sorted rows, whether each is the first with its values."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _merged(rid: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Runs of windows of rows, joined where they meet."""
    order = np.lexsort((last, first, rid))
    rid, first, last = rid[order], first[order].astype(np.int64), last[order].astype(np.int64)
    # rows are laid one after the other, so that one running maximum serves all
    base = (np.cumsum(_runs(rid)) - 1) << 32
    reach = np.maximum.accumulate(base + last) if len(rid) else base
    start = np.ones(len(rid), bool)
    start[1:] = (base + first)[1:] > reach[:-1] + 1
    at = np.flatnonzero(start)
    end = np.append(at[1:], len(rid)) - 1
    return _filled(_SPAN, rid=rid[at], first=first[at], last=reach[end] - base[end]) if len(rid) else np.empty(0, _SPAN)


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x.view(_U) >> _U(24)) % _U(buckets)).astype(np.int32)


def _anchors_of(buckets: int, width: int):
    """Anchors' starts to the buckets of their hashes. Within a group of texts a segment that comes twice or more is decided: all of its windows
    repeat, one start goes on for all of them. Of an anchor with more than LOCAL different segments in a group, the rest goes on as wide."""

    def flush(parts: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
        x = np.concatenate(parts)
        x = x[np.lexsort((x["first"], x["rid"], x["seg"], x["key"]))]
        new = _runs(x["key"], x["seg"])
        start = np.flatnonzero(new)
        times = np.minimum(np.diff(np.append(start, len(x))), 2)
        known = x[times[np.cumsum(new) - 1] > 1]
        spans = _merged(known["rid"], known["first"], known["first"].astype(np.int64) + known["more"])
        x = x[start]
        key = _runs(x["key"])
        at = np.flatnonzero(key)
        place = np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))
        x["times"] = times
        x["times"][place == LOCAL - 1] |= 128  # tells the anchor's bucket that there may be more
        more = x[place >= LOCAL]
        x = x[place < LOCAL]
        for kind, rows, by in ((STARTS, x, x["key"]), (WIDE_STARTS, more, more["rid"].view(_U)), (SPANS, spans, spans["rid"].copy().view(_U))):
            for b, blob in _packed(rows, _bucket(np.ascontiguousarray(by), buckets)):
                yield b, kind, blob

    def starts(words: Words, rids: np.ndarray) -> Iterator[np.ndarray]:
        for i, rid in enumerate(rids):
            h = words.of(i)
            key, first, last = anchors(h, width)
            if not len(key):
                continue
            n = (last - first) // _MORE + 1
            if n.max() > 1:
                piece = np.concatenate([np.arange(x) for x in n])
                key, first, last = np.repeat(key, n), np.repeat(first, n) + _MORE * piece, np.repeat(last, n)
                last = np.minimum(last, first + _MORE - 1)
            yield _filled(_START, key=key, seg=RunHash(h).of(first, last + width), rid=np.full(len(key), rid), first=first, more=last - first, times=np.ones(len(key)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, GROUP):
            parts = [x for words, batch in group for x in starts(words, batch["rid"].to_numpy())]
            if parts:
                yield from _rows(flush(parts))

    return run


def _groups(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[Iterator[tuple[Words, pa.RecordBatch]]]:
    """Words of batches, in groups of about so many bytes of text."""
    rest = by_bytes(batches, "text")
    while (first := next(rest, None)) is not None:

        def group(batch=first):
            size = 0
            while batch is not None:
                words = Words(raw(batch["text"]))
                yield words, batch
                size += len(words.data)
                batch = next(rest, None) if size < most else None

        yield group()


def _rows(rows: Iterable[tuple[int, int, bytes]], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size > most:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, kind, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "kind", "blob"])


_FOUND = ["kind", "key", "seg", "rid", "first", "last", "times"]


def _found(kind: int, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of what anchors tell: SPANS, windows that repeat; SEGMENT, a segment for its anchor's automaton; WINDOWS, one to be split by window."""
    for lo in range(0, len(rows), 100_000):
        x = rows[lo : lo + 100_000]
        first = x["first"].astype(np.int64)
        if kind == SPANS:
            zero = np.zeros(len(x), np.int64)
            cols = (zero, zero, x["rid"], first, x["last"].astype(np.int64), zero)
        else:
            cols = (x["key"].copy().view(np.int64), x["seg"].copy().view(np.int64), x["rid"], first, first + x["more"], x["times"].astype(np.int64) & 127)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in cols)], _FOUND)


def _by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """(bucket, its (kind, blob)s) of rows sorted by bucket, as they come."""
    from itertools import groupby

    rows = (r for batch in batches for r in zip(batch["bucket"].to_pylist(), batch["kind"].to_pylist(), batch["blob"].to_pylist(), strict=True))
    for b, group in groupby(rows, key=lambda r: r[0]):
        yield b, ((k, blob) for _, k, blob in group)


def _repeated(wide: int):
    """Anchors of a bucket: of those with two or more starts, which windows are known to repeat and which segments must be compared."""

    def told(x: np.ndarray, known: np.ndarray, last: bool) -> tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]:
        """(rows, starts to hold on to, anchors known to be wide). Only starts of wide anchors go while more can come."""
        x = x[np.lexsort((x["rid"], x["seg"], x["key"]))]
        new_key = _runs(x["key"])
        new_seg = new_key | _runs(x["seg"])
        of_key, of_seg = np.cumsum(new_key) - 1, np.cumsum(new_seg) - 1
        segs = np.bincount(of_key, weights=new_seg)
        full = (segs > wide) | (np.bincount(of_key, weights=x["times"] >= 128) > 0) | np.isin(x["key"][new_key], known)
        known = np.union1d(known, x["key"][new_key][full])
        plain = (x["times"] & 127).astype(np.int64)
        starts, times = np.bincount(of_key, weights=plain)[of_key], np.bincount(of_seg, weights=plain)[of_seg]
        out: list[pa.RecordBatch] = []
        go = np.ones(len(x), bool) if last else full[of_key]
        again = go & (times > 1) & (plain == 1)  # its segment starts elsewhere too
        out += _found(SPANS, _merged(x["rid"][again], x["first"][again], x["first"][again].astype(np.int64) + x["more"][again]))
        one = x.copy()
        one["times"] = np.minimum(times, 2)
        out += _found(WINDOWS, one[go & new_seg & full[of_key]])
        out += _found(SEGMENT, one[go & new_seg & ~full[of_key] & (starts > 1) & (segs[of_key] > 1)])
        return out, x[~go], known

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            held, size, limit, known = [], 0, HOLD, np.zeros(0, _U)
            for kind, blob in rows:
                if kind == SPANS:
                    yield from _found(SPANS, _unpacked(blob, _SPAN))
                elif kind == WIDE_STARTS:
                    yield from _found(WINDOWS, _unpacked(blob, _START))
                else:
                    held.append(_unpacked(blob, _START))
                    size += len(blob)
                    if size > limit:  # what wide anchors hold goes now; the rest is bounded by the bucket's other anchors
                        out, rest, known = told(np.concatenate(held), known, False)
                        yield from out
                        held, size = [rest], rest.nbytes
                        limit = max(HOLD, 2 * size)
            if held:
                yield from told(np.concatenate(held), known, True)[0]

    return run


def _fetch(width: int, buckets: int):
    """Segments as word hashes to their anchors' buckets; windows of wide anchors to the buckets of their hashes. Windows that a group of texts holds
    twice or more are decided, and one of them goes on for all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, GROUP):
            yield from _rows(of(group))

    def of(group: Iterator[tuple[Words, pa.RecordBatch]]) -> Iterator[tuple[int, int, bytes]]:
        parts = [np.empty(0, _WINDOW)]
        for words, batch in group:
            for i, (rid, asks) in enumerate(zip(batch["rid"].to_pylist(), batch["asks"].to_pylist(), strict=True)):
                h, run = words.of(i), None
                for a in asks:
                    if a["kind"] == SEGMENT:
                        head = np.array([(a["key"], a["seg"], rid, a["first"], a["times"])], _HEAD)
                        yield int(_bucket(head["key"].view(_U), buckets)[0]), SEGMENT, head.tobytes() + h[a["first"] : a["last"] + width].astype("<u8").tobytes()
                        continue
                    run = run or RunHash(h)
                    at = np.arange(a["first"], a["last"] + 1)
                    same = np.full(len(at), 1)
                    parts.append(_filled(_WINDOW, key=np.full(len(at), a["key"], np.int64).view(_U), hash=run.of(at, at + width), rid=same * rid, at=at, times=same * a["times"]))
        x, spans = _counted(np.concatenate(parts))
        for kind, rows, by in ((WINDOWS, x, x["hash"]), (SPANS, spans, spans["rid"])):
            for b, blob in _packed(rows, _bucket(np.ascontiguousarray(by), buckets)):
                yield b, kind, blob

    return run


_HEAD = np.dtype([("key", "<i8"), ("seg", "<i8"), ("rid", "<i8"), ("first", "<i8"), ("times", "<i8")])


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one window for all that are equal, spans of those that have equals here). Windows sent with 2 times are decided already."""
    x = x[np.lexsort((x["hash"], x["key"]))]
    new = _runs(x["key"], x["hash"])
    of = np.cumsum(new) - 1
    times = np.bincount(of, weights=x["times"], minlength=0)
    again = x[(times[of] > 1) & (x["times"] == 1)] if len(x) else x
    x = x[new].copy()
    x["times"] = np.minimum(times, 2)
    return x, _merged(again["rid"], again["at"], again["at"])


def _decide(width: int):
    """(rid, first, last) of runs of windows that have other starts: by an automaton of each anchor's segments, or by the window's count."""

    def automaton(group: list[bytes]) -> Iterator[tuple[int, int, int]]:
        rows = {}
        for blob in group:  # equal rows fetch a segment more than once
            head = np.frombuffer(blob, _HEAD, 1)[0]
            rows.setdefault(int(head["seg"]), (head, np.frombuffer(blob, "<u8", offset=_HEAD.itemsize).tolist()))
        number: dict[int, int] = {}
        seqs = [[number.setdefault(w, len(number)) for w in words] for _, words in rows.values()]
        auto = Automaton(seqs, [int(head["times"]) for head, _ in rows.values()])
        for (head, _), seq in zip(rows.values(), seqs, strict=True):
            if head["times"] > 1:
                continue  # known to repeat
            e = np.flatnonzero(np.array(auto.matches(seq)) >= width) - width + 1
            cut = np.flatnonzero(np.diff(e) > 1)
            for a, b in zip(e[np.append(0, cut + 1)], e[np.append(cut, len(e) - 1)], strict=True) if len(e) else ():
                yield int(head["rid"]), int(head["first"] + a), int(head["first"] + b)

    def spans_of(rows: Iterable[tuple[int, bytes]]) -> Iterator[np.ndarray]:
        windows, size, groups = [], 0, {}
        for kind, blob in rows:
            if kind == SPANS:
                yield _unpacked(blob, _SPAN)
            elif kind == WINDOWS:
                windows.append(_unpacked(blob, _WINDOW))
            else:
                groups.setdefault(blob[:8], []).append(blob)
        for group in groups.values():
            if found := list(automaton(group)):
                yield np.array(found, _SPAN)
        if windows:
            yield _counted(np.concatenate(windows))[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            for x in spans_of(rows):
                for lo in range(0, len(x), 100_000):
                    y = x[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(y[c]).astype(np.int64)) for c in _SPAN.names], list(_SPAN.names))

    return run


def _cut(width: int, with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            out = []
            for text, spans in zip(raw(batch["text"]), batch["spans"].to_pylist(), strict=True):
                words = text.split() if text else []
                keep, kept = None, words
                if spans:
                    gone = np.zeros(len(words) + 1, np.int32)
                    for s in spans:
                        gone[s["first"]] += 1
                        gone[s["last"] + width] -= 1
                    keep = np.cumsum(gone[:-1]) == 0
                    kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                row = [len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()]
                if with_text:
                    row.append(_without(text, keep).decode() if keep is not None else None if text is None else text.decode())
                out.append(row)
            cols = list(zip(*out, strict=True))
            names = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
            keys = [c for c in batch.schema.names if c not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keys), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2])] + ([pa.array(cols[3], pa.string())] if with_text else []), keys + names)

    return run


def _without(text: bytes, keep: np.ndarray) -> bytes:
    """The text without the words that go, each with the white space after it; the rest stays as it is."""
    at = [m.start() for m in _WORD.finditer(text)]
    parts, place = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate(([True], keep, [True])).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        parts.append(text[place : at[a]])
        place = at[b] if b < len(at) else len(text)
    return b"".join([*parts, text[place:]])


def substring_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WINDOW, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, n_words, n_removed, kept_sha256[, kept_text]) of each row.

    Raises ValueError where a carried column or the key has the name of a result column. Other columns are not read.
    """
    tuned(docs.sparkSession)
    kept = [key, *(c for c in carry if c != key)]
    no_clash(kept, ["n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])
    body = docs[text].cast("string").alias("text")
    rid = F.xxhash64(docs[key], docs[text].cast("string")).alias("rid")
    texts = docs.select(rid, body)
    buckets = buckets_for(texts, 8 << 20)
    packed = "bucket int, kind int, blob binary"
    found = stash(dealt(texts.mapInArrow(_anchors_of(buckets, width), packed), buckets).mapInArrow(_repeated(WIDE), ", ".join(f"{c} long" for c in _FOUND)))
    asks = found.where(f"kind != {SPANS}").groupBy("rid").agg(F.collect_list(F.struct("kind", "key", "seg", "first", "last", "times")).alias("asks"))
    fetched = texts.join(asks, "rid").mapInArrow(_fetch(width, buckets), packed)
    spans = dealt(fetched, buckets).mapInArrow(_decide(width), "rid long, first long, last long")
    spans = found.where(f"kind = {SPANS}").select("rid", "first", "last").unionByName(spans)
    per_doc = stash(spans.groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("spans")))
    unstash(found)
    # columns by place: the kept ones may have any name
    src = docs.select(body, rid, *(docs[c].alias(f"c{i}") for i, c in enumerate(kept)))
    joined = src.join(per_doc, "rid", "left").select(*(f"c{i}" for i in range(len(kept))), "text", "spans")
    made = "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    out = joined.mapInArrow(_cut(width, with_text), ", ".join([*(f"c{i} {joined.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(kept))), made]))
    return out.toDF(*kept, *out.columns[len(kept) :])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS p, w FROM w WHERE len(w) >= 35),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS g FROM s),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY sha256(g)) AS c FROM g) WHERE c > 1),
x AS (SELECT doc_id, unnest(range(p, p + 35)) AS i FROM r),
d AS (SELECT doc_id, list(DISTINCT i) AS gone FROM x GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT doc_id, array_to_string(list(word ORDER BY i), ' ') AS kept, count(*) AS n_kept FROM u WHERE (doc_id, i) NOT IN (SELECT doc_id, i FROM x) GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
