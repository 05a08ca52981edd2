"""Text functions as columns: tokens, trigrams, normalisers, cleaning of extracted text, replies of models.

Three normalisers are told apart: collapse() for verbatim checks, nfkc_key() for dedup, nfkc_words() for the comparison of runs.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, StringType

#: Words of letters, digits and low lines, or single other signs.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value bound to a variable (of a list of one), so that it is found once and not anew wherever it stands, or for each element of a list."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def char_trigrams(token: Column) -> Column:
    """Distinct trigrams of the lower-cased token with two spaces on either side.

    The characters are bound to a variable (a list of one), so that they are found once and not anew for each place.
    """
    chars = F.split(F.concat(F.lit("  "), F.lower(token), F.lit("  ")), "")
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))))
    return F.get(F.transform(F.array(chars), grams), F.lit(0))


def token_char_length(grams: Column) -> Column:
    """A token's length from the number of its distinct trigrams; too short for repeated ones, as posted counts are."""
    return F.greatest(F.lit(0), grams - 2)


def dice(a: Column, b: Column) -> Column:
    """Twice the shared members over all members; 0 for two empty sets. Each set is made once."""

    def score(x: Column) -> Column:
        both = F.size(x["a"]) + F.size(x["b"])
        return F.when(both == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(x["a"], x["b"])) / both)

    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), score), F.lit(0))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.lower(a), F.lower(b))


def collapse(text: Column) -> Column:
    """White space collapsed and lower case: for verbatim checks."""
    return F.lower(F.trim(F.regexp_replace(text, r"[\s]+", " ")))


def word_slug(text: Column, default: str) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def dash_slug(text: Column) -> Column:
    """For names of files of reports: case stays; `unknown` where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def match_key(text: Column) -> Column:
    """Lower case, marks and spaces as single spaces: by which titles and authors are compared."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _plain(make: Callable[[str], object], kind: DataType) -> Callable[[Column], Column]:
    """A column function from one on strings; null stays null."""

    @F.pandas_udf(kind)
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else make(t))

    return apply


#: Compatibility characters as their plain ones (NFKC), no outer white space, lower case: for dedup.
nfkc_key = _plain(lambda t: unicodedata.normalize("NFKC", t).strip().lower(), StringType())
#: The same with inner white space collapsed: for the comparison of runs.
nfkc_words = _plain(lambda t: " ".join(unicodedata.normalize("NFKC", t).split()).lower(), StringType())


def sanitize_field(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", "_"), "^_+|_+$", "")


def last_year(text: Column) -> Column:
    """The last four-digit year from 1000 to 2099, else null."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"\b(1[0-9]{3}|20[0-9]{2})\b"), F.lit(1)), F.lit(-1)).cast("int")


#: Banner lines around the body of a public-domain e-book.
BANNER_START = r"(?im)^\*{3}[ \t]*START OF (?:THE|THIS) PROJECT GUTENBERG.*?\*{3}[ \t]*$"
BANNER_END = r"(?im)^\*{3}[ \t]*END OF (?:THE|THIS) PROJECT GUTENBERG.*?\*{3}[ \t]*$"


def strip_boilerplate(text: Column) -> Column:
    """What is between the banners; after the first, where there is no second after it; else the text. Outer white space goes."""
    start, end = (F.regexp_extract(text, f"({p})", 1) for p in (BANNER_START, BANNER_END))
    s, e = F.instr(text, start), F.instr(text, end)
    after = s + F.length(start)
    body = F.when((start != "") & (end != "") & (after <= e), F.substring(text, after, e - after)).when(start != "", F.substring(text, after, F.length(text))).otherwise(text)
    return F.regexp_replace(body, r"^\s+|\s+$", "")


def _macroman() -> tuple[str, str]:
    """Control characters of extraction without a font's map, and what their bytes mean in that font encoding; then five letters that stand for marks."""
    codes = [chr(c) for c in range(0x80, 0xA0)]
    #: Letters that extraction writes for a dash and quotes.
    marks = {"Ñ": "—", "Ò": "“", "Ó": "”", "Ô": "‘", "Õ": "’"}
    first = [bytes([ord(c)]).decode("mac_roman") for c in codes]
    return "".join(codes) + "".join(marks), "".join(marks.get(c, c) for c in first) + "".join(marks.values())


def fix_mojibake(text: Column) -> Column:
    bad, good = _macroman()
    return F.translate(text, bad, good)


def find_span(tokens: Column, span: Column) -> Column:
    """Zero-based places of the first run of tokens equal to span but for case; null if none or span is empty."""
    low, want = F.transform(tokens, F.lower), F.transform(span, F.lower)
    last = F.size(low) - F.size(want)
    starts = F.when((F.size(want) > 0) & (last >= 0), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(low, i + 1, F.size(want)) == want))
    first = F.try_element_at(starts, F.lit(1))
    return F.when(first.isNotNull(), F.sequence(first, first + F.size(want) - 1))


def _bare(reply: str) -> str:
    """A reply without the code fence around it."""
    text = reply.strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[1] if "\n" in text else text.lstrip("`")
        text = text.rstrip().removesuffix("```")
    return text.strip()


_JSON = json.JSONDecoder(strict=False)  # raw control characters in strings


def _first_value(reply: str) -> str:
    text = _bare(reply)
    try:
        value, _ = _JSON.raw_decode(text)
    except ValueError:
        # prose before the value: it begins at the first bracket. What is within a value that was cut off is none
        start = re.search(r"[\[{]", text)
        try:
            value, _ = _JSON.raw_decode(text, start.start()) if start else _JSON.raw_decode("")
        except ValueError:
            return text
    return json.dumps(value, ensure_ascii=False)


#: The first complete JSON value of a reply: code fences, prose around it and what follows are dropped. Where there is none the text stays.
first_value = _plain(_first_value, StringType())


def _cut_off(reply: str) -> bool:
    text = _bare(reply)
    if not text:
        return True
    try:
        _JSON.raw_decode(text)
    except json.JSONDecodeError as e:
        return "Unterminated string" in e.msg or e.pos >= len(text) - 1
    return False


#: Whether a reply looks as if the model had stopped before its end: empty, within a string, or an error at the very end.
cut_off = _plain(_cut_off, BooleanType())


def parse_reply(reply: Column, schema: str) -> Column:
    """A model's JSON reply: the first complete value, raw control characters allowed, one object taken as a list of one. Null if it can't be read."""
    bare = first_value(reply)
    return F.from_json(F.when(bare.startswith("{"), F.concat(F.lit("["), bare, F.lit("]"))).otherwise(bare), schema, {"allowUnquotedControlChars": "true"})


def numbered_lines(items: Column) -> Column:
    """`0. first`, `1. second` … on a line each, as prompts list units."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(i.cast("string"), F.lit(". "), x)), "\n")


def annotation_note(note: Column, check: Column, passed: Column) -> Column:
    """A form's note; where the sentence failed its check with a note, that too."""
    n, c = F.coalesce(note, F.lit("")), F.concat(F.lit("self-check: "), check)
    said = ~F.coalesce(passed, F.lit(False)) & (F.coalesce(check, F.lit("")) != "")
    return F.when(~said, n).when(n == "", c).otherwise(F.concat(n, F.lit(" — "), c))


def approved(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))) == "true", F.lit(False))


def sentence_method(method: Column, model: str, encoder: str) -> Column:
    """How a pair was found: the stage and the model it used."""
    return F.when(method == "embedding", F.lit(f"embedding:{encoder}")).when(method == "lexical", F.lit("lexical:trigram-dice")).when(method == "llm_judge", F.lit(f"llm_judge:{model}")).otherwise(F.lit(f"llm:{model}"))


#: What a service says that has no more to give for now.
LIMIT_MARKS = ("usage limit reached", "credit balance too low", "rate limited", "overloaded", "529")


def is_limit_message(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    found = F.lit(False)
    for mark in LIMIT_MARKS:
        found = found | F.contains(low, F.lit(mark))
    return found
