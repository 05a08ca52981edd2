"""Token counts: batch encoding in an Arrow function that returns lengths only.

No piece of the vocabulary holds a word mark after its first other character, and none holds a line feed. A text can therefore
be cut before each run of spaces and around each line feed without changing a merge: the count of a text is the sum of
the counts of its cuts. Cuts met before come from a memo; new ones go to the library in batches balanced by bytes.
A null text counts as empty; an empty text has no tokens. A run without spaces and line feeds has no safe boundary: it is one cut, of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import MEMO, by_bytes, no_clash, table, tuned

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Cuts up to so many characters are remembered.
SHORT = 64
_CUT = re.compile(r" +[^ \n]*|\n|[^ \n]+")
_MARK = "▁"


class PieceMemo:
    """The library's result for safe cuts: their lengths, or their ids."""

    def __init__(self, path: str, ids: bool = False, most: int = MEMO) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.vocab_size())]
        if any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces):
            raise ValueError("this vocabulary has pieces across word marks or line feeds; texts can't be cut there")
        self.take = (lambda x: x) if ids else len
        self.bare = self.lib.piece_to_id(_MARK)
        self.ids, self.most, self.memo = ids, most, {}

    def _encode(self, cuts: list[str], into: dict, most: int = 1 << 20) -> None:
        start, total = 0, 0
        for i, c in enumerate([*cuts, ""]):
            if i == len(cuts) or total > most:
                some = cuts[start:i]
                # the library puts a mark before each text: it stands for the first space, or is taken off again with a line feed
                got = self.lib.encode([c[1:] if c[0] == " " else "\n" + c for c in some], num_threads=1)
                for c, x in zip(some, got, strict=True):
                    x = [self.bare] if c == " " else x if c[0] == " " else x[2:]
                    into[c] = self.take(x)
                start, total = i, 0
            total += len(c)

    def of(self, texts: list[str | None]) -> list[list]:
        """For each text the results of its cuts, in order."""
        cuts = [_CUT.findall(" " + t.replace(_MARK, " ")) if t else [] for t in texts]
        if len(self.memo) > self.most:
            self.memo.clear()
        new = sorted(set().union(*cuts).difference(self.memo))
        self._encode([c for c in new if len(c) <= SHORT], self.memo)
        long: dict[str, int | list] = {}
        self._encode([c for c in new if len(c) > SHORT], long)
        if long:
            return [[long[x] if x in long else self.memo[x] for x in c] for c in cuts]
        get = self.memo.__getitem__
        return [list(map(get, c)) for c in cuts]


def token_counts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row; repeated rows stay repeated. Other columns are not read; ValueError where the key has
    the name of a result column."""
    tuned(docs.sparkSession)
    names = ["n_bytes", "n_tokens", "over_limit"]
    no_clash([key], names)
    src = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = PieceMemo(path)
        for batch in by_bytes(batches, "text"):
            texts = batch["text"].to_pylist()
            n = [sum(x) for x in memo.of(texts)]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", *names])

    return src.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", key)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
