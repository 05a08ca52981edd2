"""Catalogue upkeep: upserts, slots, memo misses, work matching, crawling over fetched pages."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import match_key
from ..sources.corpus_files import exists, plausible_author
from ..sources.pages import is_author_listing, is_document


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last of the new rows in order, else the old one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def misses(wanted: DataFrame, memo: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """What is not in the memo of this run's fingerprint; a memo of another run counts as empty."""
    return wanted.join(memo.where(F.col("fingerprint") == fingerprint).select(key), key, "left_anti")


def overwrite_slots(old: DataFrame, new: DataFrame, slot: list[str], author: str = "author") -> DataFrame:
    """Old rows but for those whose slot a new row of a plausible author takes, and all new rows."""
    # authors are compared once for each two that meet in a slot, however many rows have them
    name = lambda rows, c: rows.where(F.col(author).isNotNull()).select(*slot, F.col(author).alias(c)).distinct()
    met = name(old, "_old").join(name(new, "_new"), slot).where(plausible_author(F.col("_old"), F.col("_new")))
    taken = met.select(*slot, F.col("_old").alias(author)).distinct()
    return old.join(taken, [*slot, author], "left_anti").select(*old.columns).unionByName(new)


def match_work(new: DataFrame, folders: DataFrame) -> DataFrame:
    """For each new file the first folder, by name, of the same title (case, marks and spaces aside) whose oldest file has a plausible author."""
    # titles and authors are compared once for each two that meet, however many files and folders have them
    f = folders.groupBy(match_key(F.col("title")).alias("_title"), match_key(F.col("author")).alias("folder_author")).agg(F.min("folder").alias("folder"))
    files = new.withColumns({"_title": match_key(F.col("title")), "_author": match_key(F.col("author"))})
    hit = files.select("_title", "_author").distinct().join(f, "_title").where(plausible_author(F.col("_author"), F.col("folder_author")))
    named = files.select("name", "_title", "_author").join(hit.groupBy("_title", "_author").agg(F.min("folder").alias("folder")), ["_title", "_author"]).groupBy("name").agg(F.min("folder").alias("folder"))
    return new.join(named, "name", "left")


def remembered(spark: SparkSession, path: str, fingerprint: str, schema: str) -> DataFrame:
    """A memo's rows of this run's fingerprint (schema: of its key and result); a missing memo and one of another run count as empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, fingerprint string").parquet(path).where(F.col("fingerprint") == fingerprint).drop("fingerprint")


def get_or_compute(wanted: DataFrame, path: str, fingerprint: str, key: str, compute: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Results of all wanted keys: those of the memo, and new ones, which are appended to it before they are returned. A key that compute leaves out stays
    uncomputed and is asked for again by the next run. The first result of a key counts."""
    spark = wanted.sparkSession
    known = remembered(spark, path, fingerprint, schema)
    new = compute(wanted.join(known.select(key), key, "left_anti"))
    new.select(*known.columns).withColumn("fingerprint", F.lit(fingerprint)).write.mode("append").parquet(path)
    return remembered(spark, path, fingerprint, schema).join(wanted.select(key).distinct(), key, "left_semi").dropDuplicates([key])


def chunks_to_do(chunks: DataFrame, done: DataFrame, by: str = "doc_id") -> DataFrame:
    """Chunks (by, chunk_index, …) that still need an answer. done: (by, chunk_index, total_chunks) of an interrupted run; it counts for a document that still
    has as many chunks, else all of them are to do anew."""
    n = chunks.groupBy(by).agg(F.count("*").alias("_n"))
    valid = done.join(n, by).where("total_chunks = _n").select(by, "chunk_index").distinct()
    return chunks.join(valid, [by, "chunk_index"], "left_anti")


def rows_to_do(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that an interrupted build has not stored yet: work goes on where it stopped, whatever the order in which tasks stored theirs."""
    return rows.join(done.select(key), key, "left_anti")


def grow_registry(registry: DataFrame, tagged: DataFrame, closed: list[str]) -> DataFrame:
    """The registry (lang, year, form, upos) with the function words found in tagged tokens (lang, year, token, upos, position): the last tag of a form wins, a new
    one over an old one."""
    new = tagged.where(F.col("upos").isin(closed)).groupBy("lang", "year", F.lower("token").alias("form")).agg(F.max_by("upos", "position").alias("upos"))
    return registry.select("lang", "year", "form", "upos").join(new, ["lang", "year", "form"], "left_anti").unionByName(new)


def crawl(seeds: DataFrame, edges: DataFrame, documents: Column, shared: str, max_depth: int = 3, max_pages: int = 300, max_cost: float | None = None) -> DataFrame:
    """(url, depth, chain, is_document) of what is reached over edges (src, dst[, place[, cost]]): breadth first, each address once.

    An address takes the first way by which it is met, in the order of a queue: that of the pages that lead to it, and of the links on them (`place`, then the address).
    Documents are not opened. Pages are opened in that order until max_pages are, or until those opened before cost max_cost (an edge's cost is that of
    opening its source). A round is a join and an anti join, written below `shared` and read from there by the next; places in the queue are the ways
    themselves, compared link by link, so that no round numbers its rows in one task.
    """
    spark = seeds.sparkSession
    base = f"{shared.rstrip('/')}/crawl-{uuid.uuid4().hex}"
    for c in ("place", "cost"):
        edges = edges if c in edges.columns else edges.withColumn(c, F.lit(0.0 if c == "cost" else 0))
    links = edges.select("src", "dst", F.col("place").cast("long").alias("link"))
    costs = edges.groupBy("src").agg(F.max("cost").cast("double").alias("page_cost"))
    start = seeds.select("url").distinct().select("url", F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("way"), F.array("url").alias("chain"))
    start.withColumn("is_document", documents).write.parquet(f"{base}/0")
    opened, spent, depth = 0, 0.0, 0
    while depth < max_depth and opened < max_pages and (max_cost is None or spent < max_cost):
        # at most max_pages rows: a budget
        now = spark.read.parquet(f"{base}/{depth}").where("NOT is_document").orderBy("way", "chain").limit(max_pages - opened)
        now = now.join(costs, now["url"] == costs["src"], "left").select("url", "way", "chain", F.coalesce("page_cost", F.lit(0.0)).alias("page_cost"))
        if max_cost is not None:
            before = F.sum("page_cost").over(Window.partitionBy(F.lit(0)).orderBy("way", "chain").rowsBetween(Window.unboundedPreceding, -1))
            now = now.withColumn("before", F.coalesce(before, F.lit(0.0)) + spent).where(F.col("before") < max_cost).drop("before")
        now.write.parquet(f"{base}/opened-{depth}")
        now = spark.read.parquet(f"{base}/opened-{depth}")
        sums = now.agg(F.count("*").alias("n"), F.sum("page_cost").alias("cost")).first()
        opened, spent = opened + sums["n"], spent + (sums["cost"] or 0.0)
        seen = spark.read.parquet(*(f"{base}/{d}" for d in range(depth + 1))).select(F.col("url").alias("dst"))
        met = now.select(F.col("url").alias("src"), "way", "chain").join(links, "src").join(seen, "dst", "left_anti")
        first = met.groupBy("dst").agg(F.min(F.struct("way", "chain", "link")).alias("w"))
        depth += 1
        found = first.select(F.col("dst").alias("url"), F.lit(depth).alias("depth"), F.concat("w.way", F.array("w.link")).alias("way"), F.concat("w.chain", F.array("dst")).alias("chain"))
        found.withColumn("is_document", documents).write.parquet(f"{base}/{depth}")
    return spark.read.parquet(*(f"{base}/{d}" for d in range(depth + 1))).select("url", "depth", "chain", "is_document")


def followed(decisions: DataFrame) -> DataFrame:
    """Edges (src, dst, place) of decided links (page, place, url, decision, …) that a crawl goes along: those to follow but for listings of an author's works, and
    candidates that don't look like documents yet."""
    along = ((F.col("decision") == "follow") & ~is_author_listing(F.col("url"))) | ((F.col("decision") == "candidate") & ~is_document(F.col("url")))
    return decisions.where(along).select(F.col("page").alias("src"), F.col("url").alias("dst"), "place")


def survey_results(crawled: DataFrame, decisions: DataFrame, visits: DataFrame, max_depth: int = 3) -> DataFrame:
    """(document_url, chain, title, category, reasoning, related_to): what a survey found, from the pages crawled, the decisions about their links and the visits
    (url, kind, reasoning): `document`, `links`, `no_links` or `broad_listing`.

    Documents met, candidates that look like documents, and, for somebody to look at, pages without links, broad listings, listings of an author, uncertain links and what would
    have been followed beyond the last round. Irrelevant links leave nothing.
    """
    none = F.lit(None).cast("string")
    row = lambda x, url, chain, title, category, why, related: x.select(url.alias("document_url"), chain.alias("chain"), title.alias("title"), F.coalesce(category, F.lit("uncertain")).alias("category"), F.coalesce(why, F.lit("")).alias("reasoning"), F.coalesce(related, F.lit("")).alias("related_to"))
    v = crawled.join(visits.select("url", "kind", F.col("reasoning").alias("why")), "url")
    led = decisions.where("decision = 'candidate'").select(F.col("page").alias("_page"), F.col("url").alias("_url"), "category", "reasoning", "related_to").dropDuplicates(["_page", "_url"])
    docs = v.where("kind = 'document'").withColumn("_from", F.try_element_at("chain", F.lit(-2))).join(led, (F.col("_from") == F.col("_page")) & (F.col("url") == F.col("_url")), "left")
    out = row(docs, F.col("url"), F.col("chain"), F.col("url"), F.col("category"), F.col("reasoning"), F.col("related_to"))
    odd = v.where("kind IN ('no_links', 'broad_listing')")
    out = out.unionByName(row(odd, none, F.col("chain"), F.col("url"), none, F.when(F.col("kind") == "no_links", "a page without links: it may be a document itself").otherwise(F.concat(F.lit("a broad listing, not opened further. "), F.coalesce("why", F.lit("")))), none))
    x = v.where("kind = 'links'").select(F.col("url").alias("page"), "depth", F.col("chain").alias("upto")).join(decisions, "page").withColumn("way", F.concat("upto", F.array("url")))
    last, listing, document = F.col("depth") >= max_depth, is_author_listing(F.col("url")), is_document(F.col("url"))
    follow, candidate = F.col("decision") == "follow", F.col("decision") == "candidate"
    kept = x.where((follow & (listing | last)) | (candidate & (document | last)) | (F.col("decision") == "uncertain"))
    why = F.when(follow & listing, F.concat(F.lit("a listing of an author's works, not followed: "), "reasoning")).when(follow, F.concat(F.lit("beyond the last round: "), "reasoning")).otherwise(F.col("reasoning"))
    links = row(kept, F.when(candidate & document, F.col("url")), F.col("way"), F.col("text"), F.when(candidate, F.col("category")), why, F.when(candidate, F.col("related_to")))
    return out.unionByName(links)


def rename_to_oldest(folders: DataFrame, new: DataFrame) -> DataFrame:
    """(folder, new_folder): a work's folder takes the name of the oldest new file where that is strictly older than its oldest file.

    folders (folder, oldest_year), new (folder, year, name). The job fails where the name is taken by another folder.
    """
    first = new.groupBy("folder").agg(F.min("year").alias("year"), F.min_by("name", F.struct("year", "name")).alias("name"))
    moved = folders.join(first, "folder").where("year < oldest_year").select("folder", F.col("name").alias("new_folder"))
    taken = folders.select(F.col("folder").alias("new_folder"), F.lit(True).alias("taken"))
    checked = moved.join(taken, "new_folder", "left")
    return checked.where(F.when(F.col("taken"), F.raise_error(F.concat(F.lit("folder exists: "), F.col("new_folder"))).cast("boolean")).otherwise(F.lit(True))).select("folder", "new_folder")


def batches(rows: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """Rows numbered into batches of so many within each key."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def sections(chunks: DataFrame, labels: DataFrame, by: str = "doc_id", wanted: DataFrame | None = None) -> DataFrame:
    """The text of each labelled section: its chunks in order, a blank line between. The job fails if a document's labels don't match its chunks, or if a wanted
    section (by, section) has no text. Chunks of no section (null) are front and back matter."""
    n = chunks.groupBy(by).agg(F.count("*").alias("n")).join(labels.groupBy(by).agg(F.count("*").alias("m")), by, "left")
    bad = F.when(F.coalesce("m", F.lit(0)) != F.col("n"), F.raise_error(F.concat(F.lit("labels don't match chunks of "), F.col(by).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    both = chunks.join(n.where(bad).select(by), by).join(labels, [by, "chunk_index"])
    out = both.groupBy(by, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk"))), lambda x: x["chunk"]), "\n\n").alias("text"))
    if wanted is None:
        return out
    found = wanted.select(by, "section").join(out.where("section IS NOT NULL"), [by, "section"], "left")
    lost = F.coalesce(F.trim("text"), F.lit("")) == ""
    return found.where(F.when(lost, F.raise_error(F.concat(F.lit("no text for section "), "section")).cast("boolean")).otherwise(F.lit(True)))
