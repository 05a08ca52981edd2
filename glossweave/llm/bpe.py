"""Byte-level BPE: a priority queue of merge ranks over a doubly linked list of symbols; decoding joins vocabulary strings.

Texts are cut by the tokenizer's own pattern; the ids of short cuts are remembered. Entries in the queue whose
symbols have changed since they were put there are skipped when taken out. A null text counts as empty; an empty text
has no ids and decodes to the empty text. The string of a special token in a text becomes that token, as in the library.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import MEMO, by_bytes, no_clash, table, tuned

FILE = "byte_bpe_50k.json"
#: Cuts up to so many characters are remembered.
SHORT = 48


@functools.cache
def printable_bytes() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str, most: int = MEMO) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.most = spec["model"]["vocab"], most
        chars = printable_bytes()
        byte_of = {c: b for b, c in chars.items()}
        self.single = [vocab[chars[b]] for b in range(256)]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in s)
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.digits = [str(i) for i in range(len(self.bytes_of))]
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.memo: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The ids of one cut."""
        ids: list[int] = [self.single[b] for b in data]
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # stale: one of the two symbols has merged meanwhile
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(queue, (m[0], i, new, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(queue, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> Iterable[int]:
        cuts, memo = self.cut(text), self.memo
        if new := set(cuts).difference(memo):
            if len(memo) > self.most:
                memo.clear()
                new = set(cuts)
            long = {}
            for c in new:
                (memo if len(c) <= SHORT else long)[c] = self.merge(c.encode())
            if long:
                return chain.from_iterable(long[c] if c in long else memo[c] for c in cuts)
        return chain.from_iterable(map(memo.__getitem__, cuts))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self.split or not any(s in text for s in self.special):
            return list(self._plain(text))
        ids: list[int] = []
        for part in self.split(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids.extend(self._plain(part))
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def bpe_columns(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", ids: bool = True, decoded: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, n_tokens, ids_sha256, decoded_sha256), with the ids and the decoded text themselves where asked for.

    Repeated rows stay repeated. Other columns are not read; ValueError where a kept column has the name of a result column.
    """
    tuned(docs.sparkSession)
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids, *["decoded"] * decoded]
    keys = [key, *(c for c in carry if c != key)]
    no_clash(keys, names)
    kept = [f"c{i}" for i in range(len(keys))]
    src = docs.select(docs[text].cast("string").alias("text"), *(docs[c].alias(k) for c, k in zip(keys, kept, strict=True)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in by_bytes(batches, "text"):
            rows, n, a, b, out = [], [], [], [], []
            for t in batch["text"].to_pylist():
                x = bpe.encode(t)
                d = bpe.decode(x)
                n.append(len(x))
                a.append(sha(",".join(map(bpe.digits.__getitem__, x)).encode()))
                b.append(sha(d.encode()))
                if ids:
                    rows.append(x)
                if decoded:
                    out.append(d)
            more = ([pa.array(rows, pa.list_(pa.int32()))] if ids else []) + ([pa.array(out, pa.string())] if decoded else [])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(n, pa.int64()), pa.array(a), pa.array(b), *more], [*kept, *names])

    schema = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in kept) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    return src.mapInArrow(run, schema).toDF(*keys, *names)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_columns(table(spark, sf_dir, "documents"), public_tokenizers.path(FILE), ids=False, decoded=False)
