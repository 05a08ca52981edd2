"""Acquisition: from fetched bytes to named documents in folders of works. Fetching itself is left to what fills the table of fetched pages."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus_files import build_name, content_type, decode_bytes
from ..sources.pages import visible_text
from .catalog import match_work, overwrite_slots

#: Characters of a text that a model sees to name it.
PREVIEW = 4000


def previews(fetched: DataFrame, pages_of: Callable[[bytes], list[str]] | None = None, pdf_pages: int = 3) -> DataFrame:
    """(url, kind, text, preview): of fetched (url, content_type, final_url, raw) by kind: pages' visible text, texts decoded, documents' first pages where pages_of
    reads them (their text stays null: they are stored as they are)."""
    x = fetched.withColumn("kind", content_type(F.col("content_type"), F.col("final_url")))
    decoded = decode_bytes(F.col("raw"))

    @F.pandas_udf("string")
    def first_pages(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None or pages_of is None else "\n\n".join(p or "" for p in pages_of(bytes(b))[:pdf_pages]))

    text = F.when(F.col("kind") == "html", visible_text(decoded)).when(F.col("kind") != "pdf", decoded)
    x = x.withColumns({"text": text, "pdf": first_pages(F.when(F.col("kind") == "pdf", F.col("raw")))})
    return x.select("url", "kind", "text", F.substring(F.coalesce("text", "pdf", F.lit("")), 1, PREVIEW).alias("preview"))


def acquired(read: DataFrame, names: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(url, folder, filename, kind, text): read (of previews) with the five fields that name it (url, lang_code, year, title, author, source); the folder is that of its
    entry (url, folder), else named after the file. The job fails where two documents would have one name in one folder."""
    x = read.join(names, "url")
    stem = build_name(*(F.col(c) for c in ("lang_code", "year", "title", "author", "source")))
    x = x.withColumn("stem", stem).withColumn("filename", F.concat("stem", F.when(F.col("kind") == "pdf", ".pdf").otherwise(".txt")))
    x = x.join(entries.select("url", F.col("folder").alias("own")), "url", "left") if entries is not None else x.withColumn("own", F.lit(None).cast("string"))
    x = x.withColumn("folder", F.coalesce("own", "stem"))
    twice = F.count("*").over(Window.partitionBy("folder", "filename")) > 1
    x = x.withColumn("twice", twice)
    ok = F.when(F.col("twice"), F.raise_error(F.concat(F.lit("refusing to overwrite "), "folder", F.lit("/"), "filename")).cast("boolean")).otherwise(F.lit(True))
    return x.where(ok).select("url", "folder", "filename", "kind", "text")


def merge_structured(existing: DataFrame, documents: DataFrame) -> DataFrame:
    """(folder, filename, lang_code, year, title, author, source, role, content) of all files after documents of a structured source are merged in.

    A document goes to the first folder, by name, whose oldest file has its title and a plausible original author, else to one named after the work's first document. There it takes
    the place of an edition of its language, or of a translation of its language, year and a plausible translator; else it is added. documents: (work, lang_code, year, title,
    author, original_author, source, role, content); existing as the result.
    """
    oldest = existing.groupBy("folder").agg(F.min_by(F.struct("title", "author"), F.struct("year", "filename")).alias("o")).select("folder", "o.title", "o.author")
    name = build_name(*(F.col(c) for c in ("lang_code", "year", "title", "author", "source")))
    works = documents.groupBy("work").agg(F.min_by(F.struct("title", "original_author", name.alias("stem")), F.struct(F.col("role") != "edition", "year", "author")).alias("w"))
    asked = works.select(F.col("work").alias("name"), "w.title", F.col("w.original_author").alias("author"), "w.stem")
    home = match_work(asked.select("name", "title", "author"), oldest).select(F.col("name").alias("work"), "folder").join(works.select("work", "w.stem"), "work")
    new = documents.join(home.select("work", F.coalesce("folder", "stem").alias("folder")), "work").withColumn("filename", F.concat(name, F.lit(".txt")))
    columns = ["folder", "filename", "lang_code", "year", "title", "author", "source", "role", "content"]
    new = new.select(*columns)
    left = overwrite_slots(existing.select(*columns), new.where("role != 'edition'"), ["folder", "lang_code", "year"]).join(new.select("folder", "filename", F.lit(True).alias("_new")), ["folder", "filename"], "left").where("_new IS NULL").drop("_new")
    editions = new.where("role = 'edition'")
    left = left.join(editions.select("folder", "lang_code"), ["folder", "lang_code"], "left_anti")
    return left.unionByName(new)

