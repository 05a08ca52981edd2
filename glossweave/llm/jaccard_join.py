"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct 5-word shingles. Sets link when their Jaccard similarity is 0.8 or more, and then
their symmetric difference has at most (a + b) / 9 members. Every shingle is XOR-ed into one place of a sketch: places
in which two sketches differ are then never more than members in which the sets differ. That is used twice.

1. Per band of sizes the sketch has k > d places (blocks), d the largest difference of a pair of that band. At least one
   non-empty block of a document with more than d of them is the same in each partner (pigeonhole): blocks are the join
   keys. A document with fewer also sends each shingle by itself. Keys travel packed by bucket, a few bytes each.
2. A second, dense sketch of about four bits a shingle bounds the difference of a candidate pair from below before texts are fetched.
   Folded to a quarter it does so more loosely: that part travels with all candidates, the rest with those alone that pass it.

What passes is verified on the texts. Sets that are equal form one class beforehand. To not emit all pairs of a group
of near copies, each key first proposes only pairs with its least member. Keys whose members are then in different
components propose a spanning forest of the nearest across components by their sketches; once that is verified, keys with more such pairs propose all
across what are still different components. Keys with more than HOT members do so for documents
alone that need them: a document whose other non-empty blocks still exceed d meets each partner at one of these. A document
with at most d non-empty blocks needs all of its keys, as its partner can have more blocks and then no shingle keys.

Texts are asked for once a document and sent to the tasks of their pairs' centres, whose own text is sent once for many pairs.
Rows that no pair asks for are told, for the most part, by a bitmap of BITS hashes of the ids asked for, and stay where they are; the join
that follows is exact, so that a bitmap that is full costs shuffle alone.

Rows without words link with nothing; rows that share an id count as one document in links. A null id is never an id of
a component: such rows have the component of their text's other rows, else null. Null and empty texts have n_shingles 0 and are their own
component; repeated rows stay repeated. Other columns are not read; ValueError where the key has the name of a result column.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, buckets_for, by_bytes, components, dealt, mix, no_clash, raw, stash, table, tuned, unstash, windows

WIDTH = 5
#: A similarity of NUM / DEN or more links.
NUM, DEN = 8, 10
GROWTH = 1.6
LEAST_BITS, MOST_BITS = 256, 1 << 16
HOT = 32
#: Bytes of keys that a task holds before the members of keys with HELD_MEMBERS or more go on.
HOLD, HELD_MEMBERS = 64 << 20, 100_000
#: Members of a key that are compared with each other in one task; more are split into blocks, and pairs of blocks dealt out.
BLOCK = 512
#: Pairs with one centre that are verified together, each time with a copy of the centre's text.
SHARE = 200
#: Bits of the bitmap of ids asked for; it is broadcast in words of 64.
BITS = 1 << 24
_U = np.uint64


def difference(a: int, b: int) -> int:
    """The most members in which linked sets of a and b members differ: from DEN * i >= NUM * (a + b - i)."""
    return int((a + b) * (DEN - NUM) // (DEN + NUM))


def bands(most: int) -> list[tuple[int, int, int, int]]:
    """(least size, size after the last of the smaller set, d, blocks) of each band up to a size."""
    out, low = [], 1
    while low <= most:
        high = max(low + 1, int(np.ceil(low * GROWTH)))
        a = high - 1
        d = difference(a, a * DEN // NUM)
        out.append((low, high, d, int(np.ceil(1.25 * (d + 1) + 1.5 * np.sqrt(d + 1)))))
        low = high
    return out


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; words are in lower case as far as A-Z go."""
    words = Words(texts, lower=True)
    runs = windows(words.hashes, WIDTH) if len(words.hashes) >= WIDTH else words.hashes
    out = []
    for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True):
        x = np.sort(runs[a : b - WIDTH + 1]) if b - a >= WIDTH else windows(words.hashes[a:b], WIDTH)
        out.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x)
    return out


def dense_sketch(members: np.ndarray) -> bytes:
    """Parities of the members by hash, in about four bits a member: a power of two of bits, so that a longer sketch folds to a shorter."""
    bits = int(min(MOST_BITS, max(LEAST_BITS, 1 << int(4 * len(members) - 1).bit_length())))
    return np.packbits((np.bincount((members % _U(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def packed(sketch: bytes) -> tuple[bytes, bytes]:
    """(the sketch folded to a quarter, its last three quarters): together as long as the sketch, which they give back."""
    x = np.frombuffer(sketch, _U).reshape(4, -1)
    return np.bitwise_xor.reduce(x, axis=0).tobytes(), x[1:].tobytes()


def unpacked(coarse: bytes, rest: bytes) -> bytes:
    x = np.frombuffer(coarse + rest, _U).reshape(4, -1)
    return np.bitwise_xor.reduce(x, axis=0).tobytes() + rest


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the length of the shortest."""
    least = min(map(len, sketches))
    out = np.empty((len(sketches), least // 8), _U)
    for i, s in enumerate(sketches):
        x = np.frombuffer(s, _U)
        while len(x) > least // 8:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def block_keys(sets: list[np.ndarray], all_bands: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, set's position, shift) of each non-empty block, and room[shift, position]: non-empty blocks less d.

    Shift 0 is the band of a set's size; 1 the band before, where the set can be the larger partner of one of its sets.
    """
    keys, owners, shifts = [], [], []
    sizes = np.array([len(s) for s in sets], np.int64)
    lows = np.array([b[0] for b in all_bands])
    own = np.searchsorted(lows, sizes, side="right") - 1
    room = np.full((2, len(sets)), 1 << 20, np.int64)
    for shift in (0, 1):
        at = own - shift
        take = [i for i in np.flatnonzero((sizes > 0) & (at >= 0)) if all_bands[at[i]][2] and (not shift or sizes[i] <= (all_bands[at[i]][1] - 1) * DEN // NUM)]
        if not take:
            continue
        members = np.concatenate([sets[i] for i in take])
        owner = np.repeat(np.arange(len(take)), sizes[take])
        band = at[take]
        blocks = np.array([all_bands[b][3] for b in band], _U)
        spread = mix(members ^ _U(0xA5A5A5A5A5A5A5A5))
        code = (owner.astype(_U) << _U(40)) | ((spread >> _U(20)) % blocks[owner])
        order = np.argsort(code)
        code = code[order]
        start = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        parity = np.bitwise_xor.reduceat(spread[order], start)
        who = (code[start] >> _U(40)).astype(np.int64)
        salt = mix((band[who].astype(_U) << _U(32)) | (code[start] & _U(0xFFFFFFFF)))
        keys.append(mix(parity ^ salt))
        owners.append(np.array(take)[who])
        left = np.bincount(who, minlength=len(take)) - np.array([all_bands[b][2] for b in band])
        for j in np.flatnonzero(left <= 0):  # too few blocks: each shingle by itself
            s = sets[take[j]]
            keys.append(mix(s ^ mix(np.full(1, 0x51DE << 16 | int(band[j]), _U))))
            owners.append(np.full(len(s), take[j]))
            left[j] = 0  # it needs its blocks, too, where they are keys of many
        room[shift, take] = left
        shifts += [np.full(len(k), shift) for k in keys[len(shifts) :]]
    if not keys:
        z = np.zeros(0, np.int64)
        return z.astype(_U), z, z, room
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(shifts), room


#: A key's low bits; a set's number, of which the last bit tells the shift.
_PACK = np.dtype([("key", "<u4"), ("node", "<i8")])
_ROW = ("n", "fp", "node", "coarse", "rest", "room0", "room1")
_KINDS = {"n": "long", "fp": "binary", "node": "long", "coarse": "binary", "rest": "binary", "room0": "long", "room1": "long"}
_ARROW = {"long": pa.int64(), "binary": pa.binary()}


def _sketches(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of two kinds, each with the bucket to send it to: a document's size, fingerprint and dense sketch; packed keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            sets = shingle_sets(raw(batch["text"]))
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            # the last bit is for the shift
            node = np.array([int.from_bytes(p[:8], "little", signed=True) & ~1 if p else 0 for p in prints], np.int64)
            n = np.array([len(s) for s in sets], np.int64)
            _, first, which = np.unique(node, return_index=True, return_inverse=True)  # equal sets of a batch send their keys once
            some = [sets[i] for i in first]
            key, owner, shift, room = block_keys(some, bands(max(map(len, some), default=0)))
            m = len(sets)
            dense = [packed(dense_sketch(s)) if len(s) else (None, None) for s in sets]
            cols = [pa.array(n), pa.array(prints, pa.binary()), pa.array(node), *(pa.array([d[i] for d in dense], pa.binary()) for i in (0, 1)), pa.array(room[0][which]), pa.array(room[1][which])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *cols, pa.array(((node.view(_U) >> _U(1)) % _U(buckets)).astype(np.int32)), pa.nulls(m, pa.binary())], ["doc_id", *_ROW, "bucket", "blob"])
            bucket = ((key >> _U(32)) % _U(buckets)).astype(np.int32)
            order = np.argsort(bucket)
            low, who = key[order].astype("<u4"), (node[first][owner] | shift)[order].astype("<i8")
            here, start = np.unique(bucket[order], return_index=True)
            blobs = [low[a:b].tobytes() + who[a:b].tobytes() for a, b in zip(start.tolist(), [*start[1:].tolist(), len(low)][: len(here)], strict=True)]
            m = len(here)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, batch["doc_id"].type), *(pa.nulls(m, _ARROW[_KINDS[c]]) for c in _ROW), pa.array(here, pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", *_ROW, "bucket", "blob"])

    shape = ", ".join(f"{c} {_KINDS[c]}" for c in _ROW)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {shape}, bucket int, blob binary")


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document rows as they are; of each key with two or more sets every member, with a member that is the key's centre and the number of members.

    Rows come sorted by bucket. The least member is the centre; of a key with very many the least of those that came first.
    """
    names = ["doc_id", *_ROW, "g", "shift", "centre", "size"]
    kind = pa.int64()

    def rows(bucket: int, key: np.ndarray, node: np.ndarray, centre: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(key), 100_000):
            i = slice(lo, lo + 100_000)
            m = len(key[i])
            cols = {"node": node[i] & ~1, "g": key[i].astype(np.int64) | (np.int64(bucket) << 32), "shift": node[i] & 1, "centre": centre[i], "size": size[i]}
            yield pa.RecordBatch.from_arrays([pa.nulls(m, kind), *(pa.array(cols[c]) if c in cols else pa.nulls(m, _ARROW[_KINDS[c]]) for c in _ROW), *(pa.array(cols[c]) for c in ("g", "shift", "centre", "size"))], names)

    def told(bucket: int, held: list[np.ndarray], centres: dict[int, int], last: bool) -> tuple[list[pa.RecordBatch], np.ndarray]:
        """(rows, keys to hold on to). Before the last call only members of very common keys go."""
        x = np.concatenate(held)
        x = x[np.lexsort((x["node"], x["key"]))]
        fresh = np.ones(len(x), bool)
        fresh[1:] = (x["key"][1:] != x["key"][:-1]) | (x["node"][1:] != x["node"][:-1])
        x = x[fresh]
        start = np.flatnonzero(np.concatenate(([True], x["key"][1:] != x["key"][:-1])))
        count, least = np.diff(np.append(start, len(x))), x["node"][start] & ~1
        own = x["key"][start]
        for k in np.flatnonzero((count >= HELD_MEMBERS) & (not last)).tolist():
            centres.setdefault(int(own[k]), int(least[k]))
        if centres:
            for k in np.flatnonzero(np.isin(own, np.array(list(centres), np.uint32))).tolist():
                least[k], count[k] = centres[int(own[k])], max(count[k], HELD_MEMBERS)
            go = np.isin(own, np.array(list(centres), np.uint32)) | last
        else:
            go = np.full(len(own), last)
        per = np.diff(np.append(start, len(x)))
        size, centre, go = np.repeat(count, per), np.repeat(least, per), np.repeat(go, per)
        out = go & (size > 1)
        return list(rows(bucket, x["key"][out], x["node"][out], centre[out], size[out])), x[~go]

    now, held, size, limit, centres = None, [], 0, HOLD, {}
    for batch in batches:
        kind = batch["doc_id"].type
        is_row = pa.compute.is_null(batch["blob"])
        docs = batch.filter(is_row)
        if m := docs.num_rows:
            yield pa.RecordBatch.from_arrays([docs["doc_id"], *(docs[c] for c in _ROW), *(pa.nulls(m, pa.int64()) for _ in range(4))], names)
        keys = batch.filter(pa.compute.invert(is_row))
        for b, blob in zip(keys["bucket"].to_pylist(), keys["blob"].to_pylist(), strict=True):
            if b != now:
                if held:
                    yield from told(now, held, centres, True)[0]
                now, held, size, limit, centres = b, [], 0, HOLD, {}
            n = len(blob) // _PACK.itemsize
            x = np.empty(n, _PACK)
            x["key"], x["node"] = np.frombuffer(blob, "<u4", n), np.frombuffer(blob, "<i8", n, 4 * n)
            held.append(x)
            size += len(blob)
            if size > limit:
                out, rest = told(b, held, centres, False)
                yield from out
                held, size = [rest], rest.nbytes
                limit = max(HOLD, 2 * size)
    if held:
        yield from told(now, held, centres, True)[0]


def _fits(a: str, b: str):
    return (F.least(a, b) * DEN >= F.greatest(a, b) * NUM) & (F.col(a) + F.col(b) > 8)


def _likely(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose value in a column may be among those of ids, which has one column: all that are, and some others."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    words = ids.select(place(ids.columns[0]).alias("_place")).groupBy(F.expr("_place div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, int(_place % 64)))").alias("_bits"))
    placed = rows.withColumn("_place", place(column)).withColumn("_word", F.expr("_place div 64"))
    return placed.join(F.broadcast(words), "_word").where("shiftright(_bits, int(_place % 64)) & 1 = 1").select(*rows.columns)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, buckets: int) -> DataFrame:
    """Pairs (a, b) of nodes that link, as ids (u, v), stashed: folded sketches first, then the whole ones, then the texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def beside(pairs: DataFrame, *columns: str) -> DataFrame:
        asked = _likely(classes.select("node", *columns), "node", pairs.select(F.explode(F.array("a", "b"))))
        for c in ("a", "b"):
            pairs = pairs.join(asked.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in columns)), c)
        return pairs

    close = stash(beside(pairs, "n", "coarse").where(_fits("n_a", "n_b")).mapInArrow(_near(["a", "b"], False), "a long, b long"))
    kept = stash(beside(close, "id", "n", "fp", "coarse", "rest").mapInArrow(_near(["id_a", "id_b", "fp_a", "fp_b"], True), f"u {kind}, v {kind}, fp_a binary, fp_b binary"))
    unstash(close)
    # pairs of one centre go to tasks of about SHARE pairs, each with a copy of the centre's text
    shares = kept.groupBy("u", "fp_a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    own = shares.select(F.col("u").alias("doc_id"), "u", "fp_a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("place"), F.col("fp_a").alias("fp"))
    other = kept.join(shares, ["u", "fp_a"]).select(F.col("v").alias("doc_id"), "u", "fp_a", F.pmod(F.xxhash64("v"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("place"), F.col("fp_b").alias("fp"))
    asks = own.unionByName(other).groupBy("doc_id").agg(F.collect_list(F.struct("u", "fp_a", "share", "place", "fp")).alias("asks"))
    got = _likely(docs, "doc_id", kept.select(F.explode(F.array("u", "v")))).join(asks, "doc_id").select("doc_id", "text", F.explode("asks").alias("ask"))
    got = got.select(F.pmod(F.xxhash64("ask.u", "ask.share"), F.lit(buckets)).cast("int").alias("bucket"), "ask.u", "ask.fp_a", "ask.share", "ask.place", F.col("doc_id").alias("v"), "ask.fp", "text")
    out = stash(dealt(got, buckets, "u", "fp_a", "share", "place").mapInArrow(_similar, f"u {kind}, v {kind}").distinct())
    unstash(kept)
    return out


def _near(columns: list[str], whole: bool):
    """These columns of the pairs whose sketches, whole or folded, allow a link; by place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch[f"coarse_{c}"].to_pylist() for c in "ab"]
            if whole:
                sides = [map(unpacked, side, batch[f"rest_{c}"].to_pylist()) for side, c in zip(sides, "ab", strict=True)]
            ok = []
            for a, b, m in zip(*sides, (batch["n_a"].to_numpy() + batch["n_b"].to_numpy()).tolist(), strict=True):
                x = folded([a, b])
                ok.append(int(np.bitwise_count(x[0] ^ x[1]).sum()) * (DEN + NUM) <= m * (DEN - NUM))
            got = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([got[c] for c in columns], [c.replace("id_a", "u").replace("id_b", "v") for c in columns])

    return run


def _across(node: list[int], n: list[int], part: list[str], sketches: list[bytes], block: list[int], forest: bool) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of one key's members in different components whose folded sketches allow a link: all, or a spanning forest of the nearest; and whether these are all.

    Members of two blocks are compared across the blocks alone; those of one with each other.
    """
    x, size, where = folded(sketches), np.array(n, np.int64), np.array(block)
    code: dict[str, int] = {}
    own = np.array([code.setdefault(p, len(code)) for p in part])
    split = where.min() != where.max()
    m, words = x.shape
    step = max(1, (2 << 20) // (m * words))
    found = []
    for lo in range(0, m, step):
        apart = np.bitwise_count(x[lo : lo + step, None] ^ x[None]).sum(axis=2, dtype=np.int64)
        a, b = size[lo : lo + step, None], size[None]
        ok = (apart * (DEN + NUM) <= (a + b) * (DEN - NUM)) & (np.minimum(a, b) * DEN >= np.maximum(a, b) * NUM) & (own[lo : lo + step, None] != own[None])
        ok &= np.arange(lo, min(lo + step, m))[:, None] < np.arange(m)[None]
        if split:
            ok &= where[lo : lo + step, None] != where[None]
        i, j = np.nonzero(ok)
        found.append(np.stack([apart[i, j], i + lo, j], axis=1))
    pairs = np.concatenate(found)
    all_ = len(pairs)
    if forest and all_:
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        top = list(range(len(code)))

        def root(k: int) -> int:
            while top[k] != k:
                top[k] = top[top[k]]
                k = top[k]
            return k

        kept, open_ = [], len(code) - 1
        for k, (i, j) in enumerate(zip(own[pairs[:, 1]].tolist(), own[pairs[:, 2]].tolist(), strict=True)):
            i, j = root(i), root(j)
            if i != j:
                top[i] = j
                kept.append(k)
                open_ -= 1
                if not open_:
                    break
        pairs = pairs[kept]
    return [(min(node[i], node[j]), max(node[i], node[j])) for _, i, j in pairs.tolist()], len(pairs) == all_


def _propose(forest: bool):
    """(a, b, g): pairs, and with null pairs the keys that have more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out, more = None, tuple([] for _ in range(5)), set(), set()

        def told() -> None:
            if len(group[0]) > 1:
                pairs, whole = _across(*group, forest)
                out.update(pairs)
                if not whole:
                    more.add(now[0])

        def made() -> pa.RecordBatch:
            rows = [(a, b, None) for a, b in sorted(out)] + [(None, None, g) for g in sorted(more)]
            out.clear()
            more.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["a", "b", "g"])

        for batch in batches:
            for g, x, y, *row in zip(*(batch[c].to_pylist() for c in ("g", "x", "y", "node", "n", "part", "coarse", "block")), strict=True):
                if (g, x, y) != now:
                    told()
                    now, group = (g, x, y), tuple([] for _ in range(5))
                    if len(out) > 50_000:
                        yield made()
                for c, v in zip(group, row, strict=True):
                    c.append(v)
        told()
        if out or more:
            yield made()

    return run


def _similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that link, from rows sorted so that each centre's text stands before those of its partners."""
    now, centre = None, None
    for batch in by_bytes(batches, "text"):
        texts = raw(batch["text"])
        fps = batch["fp"].to_pylist()
        sets = shingle_sets(texts)
        ok = []
        for u, own, share, place, fp, x in zip(*(batch[c].to_pylist() for c in ("u", "fp_a", "share", "place")), fps, sets, strict=True):
            if (u, own, share) != now:
                now, centre = (u, own, share), None
            right = xxhash.xxh3_128_digest(x.tobytes()) == fp  # else another row with this id
            if place == 0 and right:
                centre = x
            i = -1
            if place and right and centre is not None:
                at = np.minimum(np.searchsorted(centre, x), len(centre) - 1)
                i = int((centre[at] == x).sum())
            ok.append(i >= 0 and DEN * i >= NUM * (len(centre) + len(x) - i))
        got = batch.filter(pa.array(ok, pa.bool_()))
        yield pa.RecordBatch.from_arrays([got["u"], got["v"]], ["u", "v"])


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, class_id) of each row; class_id is the least id with the same shingle set."""
    tuned(docs.sparkSession)
    no_clash([key], ["n_shingles", "component_id", "class_id"])
    src = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    shape = ", ".join(f"{c} {_KINDS[c]}" for c in _ROW)
    buckets = buckets_for(src, 2 << 20)
    found = stash(dealt(_sketches(src, buckets), buckets).mapInArrow(_members, f"doc_id {kind}, {shape}, g long, shift long, centre long, size long"))
    of_row = found.where("g IS NULL").select("doc_id", *_ROW)
    members = found.where("g IS NOT NULL").select("g", "node", "shift", "centre", "size")
    rows = stash(of_row.select("doc_id", "n", "fp"))
    classes = stash(of_row.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in _ROW if c != "fp")))
    named = classes.where("id IS NOT NULL")
    tried = stash(members.where("node != centre").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct())

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified(pairs, named, src, buckets)

    def roots_of(edges: DataFrame) -> DataFrame:
        found = components(edges)
        out = stash(found.join(named.select(F.col("id").alias("node"), F.col("node").alias("code")), "node").select(F.col("code").alias("node"), "root", F.col("node").alias("id")))
        unstash(found)
        return out

    edges = verified(tried)
    roots = roots_of(edges)

    # pairs across components, at keys of three or more whose members are not all in one
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = tried.join(of("a"), "a", "left").join(of("b"), "b", "left").where("NOT coalesce(root_a = root_b, false)").select("a", "b")
    wide = members.where("size > 2")
    mixed = wide.where("node != centre").select("g", F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).join(apart, ["a", "b"], "left_semi").select("g").distinct()
    hot = members.where(f"size > {HOT}").groupBy("node", "shift").agg(F.count("*").alias("hot")).join(named.select("node", "room0", "room1"), "node")
    needs = hot.where("hot >= CASE WHEN shift = 0 THEN room0 ELSE room1 END").select("node", "shift")
    left = wide.join(mixed, "g", "left_semi").select("g", "node", "shift", "size")
    left = left.where(f"size <= {HOT}").unionByName(left.where(f"size > {HOT}").join(needs, ["node", "shift"], "left_semi"))
    left = stash(left.select("g", "node").distinct())
    unstash(found)

    def proposals(left: DataFrame, roots: DataFrame, forest: bool) -> DataFrame:
        part = F.coalesce(F.concat(F.lit("r"), F.col("root").cast("string")), F.concat(F.lit("n"), F.col("node").cast("string")))
        at = left.join(roots, "node", "left").select("g", "node", part.alias("part"))
        # keys with the same members propose the same pairs: one of them does
        keys = at.groupBy("g").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.min("part").alias("p"), F.max("part").alias("q")).where("p != q")
        keys = keys.groupBy("m", "x", "y").agg(F.min("g").alias("g")).select("g", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
        at = at.join(keys, "g").join(named.select("node", "n", "coarse"), "node").withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
        at = at.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"x": F.least("block", "with"), "y": F.greatest("block", "with")})
        at = at.withColumn("bucket", F.pmod(F.xxhash64("g", "x", "y"), F.lit(buckets)).cast("int"))
        return dealt(at, buckets, "g", "x", "y").mapInArrow(_propose(forest), "a long, b long, g long").distinct()

    told = stash(proposals(left, roots, True).join(tried, ["a", "b"], "left_anti"))
    near = told.where("g IS NULL").select("a", "b")
    more = verified(near)
    after = roots_of(edges.union(more))
    more_of = left.join(told.where("g IS NOT NULL").select("g").distinct(), "g", "left_semi")
    rest = stash(proposals(more_of, after, False).select("a", "b").join(tried, ["a", "b"], "left_anti").join(near, ["a", "b"], "left_anti"))
    last = verified(rest)
    final = roots_of(edges.union(more).union(last)) if last.limit(1).count() else after
    least = classes.select("fp", "id").join(final.select("id", "root"), "id", "left").select("fp", F.col("id").alias("class_id"), F.coalesce("root", "id").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(least, "fp", "left")
    out = stash(out.select(F.col("doc_id").alias(key), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id")))
    unstash(rows, classes, tried, edges, roots, left, told, more, after, rest, last, *([final] if final is not after else []))
    return out


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("class_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM i WHERE 100 * c >= 80 * (n + m - c)),
r AS (SELECT doc_id AS u, doc_id AS v FROM s UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.v) AS component_id FROM s JOIN r ON s.doc_id = r.u GROUP BY ALL
"""
