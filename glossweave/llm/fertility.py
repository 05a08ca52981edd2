"""Quality rules by tokeniser fertility.

Public vocabularies split natural text of a language at a steady rate. For each text and vocabulary: characters per token, the share of
tokens that are bare bytes of a character, and the entropy of its tokens in bits. A text is rejected where a measure is outside the
band of its language and length (powers of two of words).

Bands are fitted to the corpus: to all trusted rows that pass the base rules, whatever their number, by their quartiles (counts of rounded values add up over
tasks). A band is the median and SPREADS robust standard deviations on either side, and at least the margin of its measure; entropy has no upper limit and
byte share no lower one. Where a language has under MIN_ROWS trusted rows at a length, its next shorter length with a band counts, else the next longer one,
but for entropy. A language without any band is judged by the text's main script, that by all text; where there is
no band, the base rules alone decide. Without a trusted table, all rows that pass the base rules are trusted.

A null text has no words; a text without words has measures of 0 and fails the base rules. Texts of any length are measured whole. Repeated rows
stay repeated and count as often. Other columns are not read; ValueError where the key has the name of a result column.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, by_bytes, no_clash, raw, stash, table, tuned, windows

#: The vocabularies by name, and their files.
VOCABULARIES = {"piece": "piece_bpe_32k.model", "byte": "byte_bpe_multi_50k.tiktoken"}
MIN_ROWS = 50
SPREADS = 5.0
#: The least half-widths of bands: a share of the median for characters per token, a share of tokens, bits.
MARGINS = {"chars_per_token": 0.10, "byte_share": 0.03, "entropy": 0.35}
#: Rows of bands up to which they are broadcast.
FEW = 50_000
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
_MARK = "▁"
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
#: Bytes that begin a code point that is no white space.
_STARTS = np.ones(256, np.int64)
_STARTS[[0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)]] = 0
_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(texts: list[bytes | None], words: Words | None = None) -> np.ndarray:
    """For each UTF-8 text n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = Words(texts) if words is None else words
    buf = np.frombuffer(words.data, np.uint8)
    upto = lambda table: np.concatenate(([0], np.cumsum(table[buf])))[words.place]
    out = np.zeros((len(texts), 5), np.int64)
    out[:, 0] = np.diff(words.at)
    out[:, 1], out[:, 2] = np.diff(upto(_STARTS)), np.diff(upto(_SYMBOL))
    runs = windows(words.hashes, 3) if len(words.hashes) >= 3 else words.hashes
    for i, text in enumerate(texts):
        if text and b"\n" in text:
            seen: set[bytes] = set()
            for line in text.split(b"\n"):
                if line in seen:
                    out[i, 3] += 1
                elif line and not line.isspace():  # of bytes: \\x20 and \\x09-\\x0D alone
                    seen.add(line)
        a, b = int(words.at[i]), int(words.at[i + 1])
        if b - a >= 4:
            x = runs[a : b - 2]
            order = np.argsort(x)
            same = x[order][1:] == x[order][:-1]
            if same.any():
                often = np.zeros(b - a - 2, bool)
                often[order[1:][same]] = often[order[:-1][same]] = True
                covered = np.zeros(b - a, bool)
                for d in range(3):
                    covered[d : d + b - a - 2] |= often
                out[i, 4] = covered.sum()
    return out


class Vocabulary:
    """Ids of words, each as after a space, and which ids are bytes that are no whole character.

    Distinct words go to the library joined by spaces, as no id reaches across a space; where what comes back can't be told apart again (odd white
    space within words), they go one by one.
    """

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            lib = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [lib.id_to_piece(i) for i in range(lib.vocab_size())]
            self.is_byte = np.array([lib.is_byte(i) for i in range(len(pieces))])
            self.begins = np.array([p.startswith(_MARK) for p in pieces])
            self.length = None
            self.encode = lambda text: lib.encode(text.removeprefix(" "), num_threads=1)  # it puts a mark before the text
        else:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lib.encode_ordinary
            self.is_byte, self.length = np.zeros(max(ranks.values()) + 1, bool), np.zeros(max(ranks.values()) + 1, np.int64)
            for token, i in ranks.items():
                self.length[i] = len(token)
                try:
                    token.decode()
                except UnicodeDecodeError:
                    self.is_byte[i] = True

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        ids = np.array(self.encode(" " + " ".join(words)), np.int64)
        if self.length is None:
            first = np.flatnonzero(self.begins[ids])
            if len(first) != len(words) or not len(ids) or first[0]:
                return None
            return ids, np.diff(np.append(first, len(ids)))
        ends = np.cumsum([1 + len(w.encode()) for w in words])
        at = np.searchsorted(upto := np.cumsum(self.length[ids]), ends)
        if not len(ids) or at[-1] >= len(ids) or (upto[at] != ends).any():
            return None
        return ids, np.diff(at + 1, prepend=0)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, numbers of ids of each)."""
        flat, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        texts = [w.decode("utf-8", "replace") for w in words]
        for lo in range(0, len(texts), 512):
            part = texts[lo : lo + 512]
            got = self._joined(part)
            if got is None:
                each = [np.array(self.encode(" " + w), np.int64) for w in part]
                got = np.concatenate(each), np.array([len(x) for x in each], np.int64)
            flat.append(got[0])
            size.append(got[1])
        return np.concatenate(flat), np.concatenate(size)


def fertility(words: Words, vocabulary: Vocabulary) -> np.ndarray:
    """For each text tokens, bare bytes among them, and the entropy of its tokens in bits; 0 for no words."""
    hashes, first, word = np.unique(words.hashes, return_index=True, return_inverse=True)
    flat, size = vocabulary.ids([words.data[a:b] for a, b in zip(words.begin[first].tolist(), words.end[first].tolist(), strict=True)])
    at = np.cumsum(size) - size
    bare = np.diff(np.concatenate(([0], np.cumsum(vocabulary.is_byte[flat])))[np.append(at, len(flat))])
    out = np.zeros((len(words), 3))
    upto = lambda x: np.concatenate(([0], np.cumsum(x[word])))[words.at]
    out[:, 0], out[:, 1] = np.diff(upto(size)), np.diff(upto(bare))
    if not len(word):
        return out
    # how often each text has each word, then each token
    text = np.repeat(np.arange(len(words)), np.diff(words.at))
    pair, times = np.unique(text * len(hashes) + word, return_counts=True)
    text, word = np.divmod(pair, len(hashes))
    n = size[word]
    token = flat[np.repeat(at[word], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    code, where = np.unique(np.repeat(text, n) * len(vocabulary.is_byte) + token, return_inverse=True)
    count = np.bincount(where, weights=np.repeat(times, n))
    text = code // len(vocabulary.is_byte)
    p = count / out[text, 0]
    out[:, 2] = np.bincount(text, weights=-p * np.log2(p), minlength=len(words))
    return out


class Scripts:
    """The commonest script of a text's letters, by their Unicode names; `*` without letters."""

    def __init__(self) -> None:
        self.code, self.names = np.zeros(0x110000, np.int16), ["", "*"]  # 0: not seen yet, 1: no letter

    def of(self, text: str) -> str:
        chars = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        own = self.code[chars]
        if not own.all():
            for c in np.unique(chars[own == 0]).tolist():
                name = unicodedata.name(chr(c), "* ").split(" ", 1)[0] if chr(c).isalpha() else "*"
                if name not in self.names:
                    self.names.append(name)
                self.code[c] = self.names.index(name)
            own = self.code[chars]
        n = np.bincount(own, minlength=2)
        n[1] = 0
        best = n.max()
        return min((self.names[i] for i in np.flatnonzero(n == best)), default="*") if best else "*"


def measured(docs: DataFrame, paths: dict[str, str], text: str = "text", key: str = "doc_id", lang: str | None = "lang") -> DataFrame:
    """(id, lang, script, base counts, and for each vocabulary v tokens_v, chars_per_token_v, byte_share_v, entropy_v) of each row."""
    tuned(docs.sparkSession)
    src = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text"), (docs[lang].cast("string") if lang else F.lit(None).cast("string")).alias("lang"))
    names = ["id", "lang", "script", *_COLUMNS, *(f"{m}_{v}" for v in paths for m in ("tokens", *MARGINS))]
    kinds = [src.schema["id"].dataType.simpleString(), "string", "string", *["long"] * len(_COLUMNS), *["long", "double", "double", "double"] * len(paths)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies, scripts = [Vocabulary(p) for p in paths.values()], Scripts()
        for batch in by_bytes(batches, "text"):
            texts = raw(batch["text"])
            words = Words(texts)
            base = base_counts(texts, words)
            cols = [batch["id"], batch["lang"], pa.array([scripts.of(t) if t else "*" for t in batch["text"].to_pylist()]), *(pa.array(base[:, i]) for i in range(len(_COLUMNS)))]
            for v in vocabularies:
                tokens, bare, entropy = fertility(words, v).T
                cols += [pa.array(tokens.astype(np.int64)), pa.array(base[:, 1] / np.maximum(tokens, 1)), pa.array(bare / np.maximum(tokens, 1)), pa.array(entropy)]
            yield pa.RecordBatch.from_arrays(cols, names)

    return src.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def length_class():
    return F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int")


def fitted_bands(rows: DataFrame, vocabularies: Iterable[str]) -> DataFrame:
    """(level, name, lengths): for each length in order its quartiles of each measure, over measured rows that pass the base rules; level 0 language, 1 script, 2 all."""
    at = F.array(*(F.struct(F.lit(i).alias("level"), n.alias("name")) for i, n in enumerate((F.col("lang"), F.col("script"), F.lit("*")))))
    values = F.array(*(F.struct(F.lit(f"{m}_{v}").alias("measure"), (F.round(F.col(f"{m}_{v}") * 512) / 512).alias("value")) for v in vocabularies for m in MARGINS))
    x = rows.where(~base_failed()).select(length_class().alias("length"), F.explode(values).alias("m"), at.alias("at")).select("length", "m.*", F.explode("at").alias("a")).select("length", "measure", "value", "a.level", "a.name").where("name IS NOT NULL")
    by = ["level", "name", "length", "measure"]
    n = x.groupBy(*by, "value").agg(F.count("*").alias("n"))
    n = n.withColumns({"upto": F.sum("n").over(Window.partitionBy(*by).orderBy("value")), "total": F.sum("n").over(Window.partitionBy(*by))}).where(f"total >= {MIN_ROWS}")
    q = n.groupBy(*by).agg(*(F.min(F.when(F.col("upto") >= F.col("total") * share, F.col("value"))).alias(name) for name, share in (("low", 0.25), ("mid", 0.5), ("high", 0.75))))
    q = q.groupBy("level", "name", "length").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "mid", "high")))).alias("bands"))
    return q.groupBy("level", "name").agg(F.array_sort(F.collect_list(F.struct("length", "bands")), lambda a, b: a["length"] - b["length"]).alias("lengths"))


def quality_rules(docs: DataFrame, paths: dict[str, str], trusted: DataFrame | None = None, text: str = "text", key: str = "doc_id", lang: str | None = "lang") -> DataFrame:
    """One row per input row: base counts, base_failed, the measures by each vocabulary, reasons of rejection, kept. trusted: a table of keys."""
    made = [*_COLUMNS, "base_failed", *(f"{m}_{v}" for v in paths for m in ("tokens", *MARGINS)), "reasons", "kept"]
    no_clash([key], made)
    rows = stash(measured(docs, paths, text, key, lang))
    known = rows if trusted is None else rows.join(trusted.select(trusted[key].alias("id")), "id", "left_semi")
    bands = stash(fitted_bands(known, paths))
    n = bands.count()
    out = rows
    for level, name in enumerate((F.col("lang"), F.col("script"), F.when(F.col("n_words") >= 0, "*"))):  # not a constant: joins stay on equality
        own = bands.where(F.col("level") == level).select(F.col("name").alias("own"), F.col("lengths").alias(f"b{level}"))
        out = out.join(F.broadcast(own) if n <= FEW else own, name == F.col("own"), "left").drop("own")
    out = out.withColumns({"length": length_class(), "lengths": F.coalesce("b0", "b1", "b2")})
    out = out.withColumn("band", F.coalesce(F.try_element_at(F.filter("lengths", lambda x: x["length"] <= F.col("length")), F.lit(-1)), F.get("lengths", F.lit(0))))
    why = [F.when(base_failed(), F.lit("base"))]
    for v in paths:
        for m, margin in MARGINS.items():
            b, x = F.try_element_at("band.bands", F.lit(f"{m}_{v}")), F.col(f"{m}_{v}")
            wide = F.greatest((b["high"] - b["low"]) / 1.349 * SPREADS, margin * b["mid"] if m == "chars_per_token" else F.lit(margin))
            low, high = m != "byte_share", m != "entropy"
            fits = F.col("band.length") <= F.col("length") if m == "entropy" else F.lit(True)  # of longer texts entropy is higher
            outside = (fits & (x < b["mid"] - wide) if low else F.lit(False)) | ((x > b["mid"] + wide) if high else F.lit(False))
            why.append(F.when(outside, F.lit(f"{m}_{v}")))
    out = out.withColumns({"base_failed": base_failed(), "reasons": F.array_compact(F.array(*why))}).withColumn("kept", F.size("reasons") == 0)
    return out.select(F.col("id").alias(key), *made)


def op6_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules(table(spark, sf_dir, "documents"), {v: public_tokenizers.path(f) for v, f in VOCABULARIES.items()}, trusted).drop("reasons")
