"""Queries over the test tables, one or more for each operator, with SQL that must give the same rows."""

from __future__ import annotations


import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, tags, text
from ..operators import adapters, align, catalog, contrib, evaluate, modes, retrieval, sense, serve
from ..operators.index import SHARD, build_index, collection, discover_pairs, document_frequency, shards_between
from ..sources import catalogue, corpus_files, pages
from . import views
from .views import SQL as V
from .views import table, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(x):
    return F.round(x, 6)


_TOK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: SQL of a trigram set and of Dice similarity.
_GRAMS = "list_distinct(list_transform(range(1, length('  ' || lower({0}) || '  ') - 1), lambda i: substring('  ' || lower({0}) || '  ', i, 3)))"
_DICE = "(2.0 * len(list_intersect({0}, {1})) / (len({0}) + len({1})))"


# --- text ---------------------------------------------------------------------------------------------------------


@query(rf"""SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct, t[1] AS first_token, t[len(t)] AS last_token
FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_TOK}') AS t FROM documents)""")
def tokenize_docs(s, d):
    t = table(s, d, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.try_element_at("t", F.lit(1)).alias("first_token"), F.try_element_at("t", F.lit(-1)).alias("last_token"))


@query(with_("tokens", "grams") + " SELECT DISTINCT token, len(grams)::INT AS n_grams, greatest(0, len(grams) - 2)::INT AS char_length FROM grams")
def trigrams_distinct(s, d):
    t = views.tokens(s, d).select("token").distinct().withColumn("n_grams", F.size(text.char_trigrams(F.col("token"))))
    return t.withColumn("char_length", text.token_char_length(F.col("n_grams")))


@query(with_("postings") + " SELECT * FROM postings")
def trigram_postings(s, d):
    return views.gram_postings(views.tokens(s, d))


@query(with_("terms") + " SELECT * FROM terms")
def bm25_postings(s, d):
    return views.term_postings(views.tokens(s, d))


@query(with_("terms") + " SELECT side, term, count(DISTINCT row_index) AS doc_freq FROM terms GROUP BY ALL")
def term_doc_freq(s, d):
    return document_frequency(views.term_postings(views.tokens(s, d)), "side")


@query(with_("sides") + " SELECT side, count(*) AS n_rows, round(avg(len(tokens)), 6) AS mean_length FROM sides GROUP BY ALL")
def corpus_stats(s, d):
    return collection(views.sides(s, d), "side").withColumn("mean_length", r6("mean_length"))


@query(with_("pairs") + f" SELECT row_index, round({_DICE.format(_GRAMS.format('source_text'), _GRAMS.format('target_text'))}, 6) AS dice FROM pairs")
def dice_pairs(s, d):
    g = lambda c: text.char_trigrams(F.col(c))
    return views.pairs(s, d).select("row_index", r6(text.dice(g("source_text"), g("target_text"))).alias("dice"))


#: SQL's edit distance counts bytes: letters of two bytes are written as capitals, which a lower-cased token has none of.
_LOW = "translate(lower({0}), 'óéñèíüçêäöß', 'ABCDEFGHIJK')"
_LEV = "levenshtein(" + _LOW + ", " + _LOW.replace("{0}", "{1}") + ")"


@query(with_("tokens") + f" SELECT a.row_index, a.token_index, {_LEV.format('a.token', 'b.token')}::INT AS distance FROM tokens a JOIN tokens b USING (row_index, token_index) WHERE a.side = 0 AND b.side = 1")
def edit_distance_pairs(s, d):
    t = views.tokens(s, d)
    b = t.where("side = 1").select("row_index", "token_index", F.col("token").alias("other"))
    return t.where("side = 0").join(b, ["row_index", "token_index"]).select("row_index", "token_index", text.edit_distance(F.col("token"), F.col("other")).alias("distance"))


@query("""SELECT n::INT AS pair_length, round(CASE WHEN n <= 0 THEN 0.0 ELSE 0.5 * (1 - exp(-n / 10.0)) END, 6) AS dice_threshold,
CASE WHEN n <= 0 THEN 0 ELSE round_even(2.0 * (1 - exp(-n / 4.5)), 0) END::INT AS max_edits, round(exp(-greatest(0, 2025 - n * 30) / 200.0), 6) AS semantic_weight,
round(CASE WHEN n <= 0 THEN 0.0 ELSE 0.01 * (1 - exp(-n / 300.0)) END, 6) AS decay_rate FROM range(0, 80) t(n)""")
def lookup_curves(s, d):
    n = F.col("id").cast("int")
    return s.range(80).select(n.alias("pair_length"), r6(scores.dice_threshold(n)).alias("dice_threshold"), scores.max_edits(n).alias("max_edits"), r6(scores.semantic_weight(n * 30, 2025)).alias("semantic_weight"), r6(scores.decay_rate(n)).alias("decay_rate"))


# --- index, lookup and search -----------------------------------------------------------------------------------------


@query(with_("ss", "tt", "pp") + """, y AS (SELECT 'l' || conv_id % 3 AS lang_a, min(least(source_year, target_year))::INT AS year_from, max(greatest(source_year, target_year))::INT AS year_to FROM pairs GROUP BY ALL),
n AS (SELECT 'pairs' AS artifact, 'l' || conv_id % 3 AS lang_a, count(*) AS n_rows, sum(row_index)::BIGINT AS total FROM pairs GROUP BY ALL UNION ALL SELECT 'sides', lang_a, count(*), sum(len(tokens))::BIGINT FROM ss GROUP BY ALL
  UNION ALL SELECT 'grams', lang_a, count(*), sum(token_ngram_count)::BIGINT FROM pp GROUP BY ALL UNION ALL SELECT 'terms', tt.lang_a, count(*), sum(term_frequency * len(tokens))::BIGINT FROM tt JOIN ss USING (row_index, side) GROUP BY ALL
  UNION ALL SELECT 'stats', lang_a, 2, sum(len(tokens))::BIGINT FROM ss GROUP BY ALL UNION ALL SELECT 'vectors', lang_a, count(*), sum(row_index)::BIGINT FROM ss GROUP BY ALL)
SELECT artifact, lang_a, 'eng' AS lang_b, year_from, year_to, n_rows, total FROM n JOIN y USING (lang_a)""")
def index_build(s, d):
    """The whole index, built anew and read back: rows and a sum of each artifact and shard."""
    x = build_index(views.served(s, d), f"{corpus_files.shared_folder(s)}/index-{uuid.uuid4().hex}", vectors=views.side_vectors(s, d))
    total = {"pairs": "row_index", "sides": F.size("tokens"), "grams": "token_ngram_count", "terms": F.col("term_frequency") * F.col("length"), "stats": "n_tokens", "vectors": "row_index"}
    out = None
    for name, value in total.items():
        part = getattr(x, name).groupBy(*SHARD).agg(F.count("*").alias("n_rows"), F.sum(value).cast("long").alias("total")).select(F.lit(name).alias("artifact"), *SHARD, "n_rows", "total")
        out = part if out is None else out.unionByName(part)
    return out


_CAND = f"""asked AS (SELECT query_id, query, lang_a, side, {_GRAMS.format('query')} AS g FROM words), ag AS (SELECT query_id, query, lang_a, side, len(g) AS n, unnest(g) AS ngram FROM asked),
cand AS (SELECT query_id, query, row_index, side, token_index, count(*) AS shared, 2.0 * count(*) / (any_value(n) + max(token_ngram_count)) AS dice, max(token_ngram_count) AS m FROM ag JOIN pp USING (lang_a, side, ngram) GROUP BY query_id, query, row_index, side, token_index),
kept AS (SELECT * FROM cand WHERE dice >= 0.5 * (1 - exp(-(length(query) + greatest(0, m - 2)) / 10.0)))"""
_REFINED = f"""refined AS (SELECT k.*, token, {_LEV.format('query', 'token')} AS distance FROM kept k JOIN tokens t USING (row_index, side, token_index)
  WHERE {_LEV.format('query', 'token')} <= round_even(2.0 * (1 - exp(-(length(query) + length(token)) / 4.5)), 0))"""


@query(with_("pp", "words") + ",\n" + _CAND + " SELECT query_id, query, row_index, side, token_index, shared, round(dice, 6) AS dice FROM kept")
def lookup_candidates(s, d):
    found = retrieval.candidates(views.word_queries(s, d), views.index(s, d))
    return found.select("query_id", "query", "row_index", "side", "token_index", "shared", r6("dice").alias("dice"))


@query(with_("pp", "words") + ",\n" + _CAND + ",\n" + _REFINED + " SELECT query_id, row_index, side, token_index, token, distance::INT AS distance FROM refined")
def lookup_refined(s, d):
    found = retrieval.lookup_refined(views.word_queries(s, d), views.index(s, d))
    return found.select("query_id", "row_index", "side", "token_index", "token", "distance")


_LOOKUP = _CAND + ",\n" + _REFINED + """,
m AS (SELECT query_id, row_index, side, list(DISTINCT token_index ORDER BY token_index) AS matched FROM refined GROUP BY ALL),
l AS (SELECT query_id, row_index, m.side, matched, words.upos, words.ner, words.lang_a, CASE m.side WHEN 0 THEN source_tokens ELSE target_tokens END AS own, CASE m.side WHEN 0 THEN target_tokens ELSE source_tokens END AS other,
  coalesce(CASE m.side WHEN 0 THEN source_text ELSE target_text END, '') AS query_sentence, coalesce(CASE m.side WHEN 0 THEN target_text ELSE source_text END, '') AS target_sentence, list_filter(links, x -> list_contains(matched, x.idx))[1] AS link,
  coalesce(CASE WHEN row_index % 3 = 0 THEN 'c' || row_index END, '') AS citation, CASE WHEN row_index % 5 <> 0 THEN ((row_index * 7919) % 1000) / 1000.0 ELSE 0.0 END AS confidence FROM m JOIN linked USING (row_index) JOIN words USING (query_id)),
ranked AS (SELECT *, coalesce(CASE WHEN upos IS NULL THEN 0 WHEN link.upos IS NULL THEN 1 WHEN link.upos <> upos THEN 2 ELSE 0 END, 0) + coalesce(CASE WHEN ner IS NULL THEN 0 WHEN link.ner IS NULL THEN 1 WHEN link.ner <> ner THEN 2 ELSE 0 END, 0) AS tag_rank FROM l),
placed AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY tag_rank, lang_a, row_index) - 1)::INT AS place FROM ranked)""".replace("x ->", "lambda x:")


def _lookup(s, d):
    return retrieval.lookup(views.word_queries(s, d), views.index(s, d))


@query(with_("pp", "linked", "words") + ",\n" + _LOOKUP + " SELECT query_id, place, row_index, side, array_to_string(matched, ',') AS matched, other[link.idx + 1] AS span, link.upos AS matched_upos, link.ner AS matched_ner, lower(CASE side WHEN 0 THEN own[link.idx + 1] ELSE own[link.idx + 1] END) AS matched_lemma, query_sentence, target_sentence, citation, confidence FROM placed")
def lookup_batch(s, d):
    """The served answer to each word: passages in order, the span of the first link met, tags, citation and confidence."""
    x = _lookup(s, d).withColumn("matched", F.array_join("matched", ","))
    return x.select("query_id", "place", "row_index", "side", "matched", "span", "matched_upos", "matched_ner", "matched_lemma", "query_sentence", "target_sentence", "citation", "confidence")


@query(with_("pp", "linked", "words") + ",\n" + _LOOKUP + " SELECT query_id, row_index, (row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, place) - 1)::INT AS place, confidence FROM placed")
def lookup_by_confidence(s, d):
    return retrieval.lookup_by_confidence(views.word_queries(s, d), views.index(s, d)).select("query_id", "row_index", "place", "confidence")


@query("SELECT 'l' || m AS lang_a, 'eng' AS lang_b FROM (SELECT DISTINCT u.conv_id % 3 AS m FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')")
def index_pairs_of_language(s, d):
    return discover_pairs(views.index(s, d), "eng")


_BM25 = """qt AS (SELECT DISTINCT query_id, lang, unnest(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: x <> '')) AS term FROM passages),
df AS (SELECT lang_a, side, term, count(*) AS df FROM tt GROUP BY ALL),
cs AS (SELECT lang_a, side, count(*) AS n, avg(len(tokens)) AS mean FROM ss GROUP BY ALL),
bm AS (SELECT query_id, tt.row_index, tt.side, sum(greatest(0.0, ln((n - df + 0.5) / (df + 0.5) + 1)) * term_frequency * 2.5 / (term_frequency + 1.5 * (0.25 + 0.75 * len(tokens) / mean))) AS bm25
  FROM qt JOIN tt USING (lang, term) JOIN df USING (lang_a, side, term) JOIN cs USING (lang_a, side) JOIN ss ON ss.row_index = tt.row_index AND ss.side = tt.side GROUP BY query_id, tt.row_index, tt.side)"""


def _bm25(s, d, top=None):
    return retrieval.bm25(views.passage_queries(s, d), views.index(s, d), top=top)


@query(with_("ss", "tt", "passages") + f",\n{_BM25}" + " SELECT query_id, row_index, side, round(bm25, 6) AS bm25, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, row_index, side)::INT AS rank FROM bm) WHERE rank <= 10")
def bm25_topk(s, d):
    return serve.top_k(_bm25(s, d, top=10).withColumn("bm25", r6("bm25")), 10, "bm25", "row_index", "side").select("query_id", "row_index", "side", "bm25", "rank")


@query(with_("ss", "tt", "passages") + f",\n{_BM25}" + " SELECT query_id, row_index, side, round(CASE WHEN max(bm25) OVER w = min(bm25) OVER w THEN 1.0 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END, 6) AS normalized FROM bm WINDOW w AS (PARTITION BY query_id)")
def minmax_normalize(s, d):
    x = _bm25(s, d)
    return x.select("query_id", "row_index", "side", "bm25").join(scores.ends(x, "bm25", "query_id"), "query_id").select("query_id", "row_index", "side", r6(scores.between(F.col("bm25"), F.col("low"), F.col("high"))).alias("normalized"))


def _vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", "embedding")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
x AS (SELECT query_id, vec_id, label, list_inner_product(q, embedding::DOUBLE[]) AS s FROM q, embeddings)
SELECT query_id, vec_id, label, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id, label)::INT AS rank FROM x) WHERE rank <= 5""")
def cosine_topk(s, d):
    v = _vectors(s, d)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return serve.nearest(q, v.select("vec_id", "label", "embedding"), 5).select("query_id", "vec_id", "label", r6("similarity").alias("similarity"), "rank")


_SEARCH = f"""v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), size AS (SELECT count(*) AS size FROM embeddings),
near AS (SELECT query_id, row_index, ss.side, ss.lang_a, round(list_inner_product(q.e, v.e), 9) AS ip FROM size, passages p JOIN v q ON q.vec_id = p.query_id % size JOIN ss ON ss.lang = p.lang JOIN v ON v.vec_id = (ss.row_index * 2 + ss.side) % size),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lang_a ORDER BY ip DESC, row_index, side) AS r FROM near) WHERE r <= 100),
h AS (SELECT hits.query_id, hits.row_index, hits.side, hits.lang_a, p.year, ss.year AS hit_year, ip, {_DICE.format(_GRAMS.format('p.query'), _GRAMS.format("coalesce(ss.text, '')"))} AS ng, coalesce(bm25, 0.0) AS bm
  FROM hits JOIN passages p USING (query_id) JOIN ss ON ss.row_index = hits.row_index AND ss.side = hits.side LEFT JOIN bm ON bm.query_id = hits.query_id AND bm.row_index = hits.row_index AND bm.side = hits.side
  WHERE p.year IS NULL OR win IS NULL OR abs(ss.year - p.year) <= win),
n AS (SELECT *, CASE WHEN max(ip) OVER w = min(ip) OVER w THEN 1.0 ELSE (ip - min(ip) OVER w) / (max(ip) OVER w - min(ip) OVER w) END AS a, CASE WHEN max(ng) OVER w = min(ng) OVER w THEN 1.0 ELSE (ng - min(ng) OVER w) / (max(ng) OVER w - min(ng) OVER w) END AS b,
  CASE WHEN max(bm) OVER w = min(bm) OVER w THEN 1.0 ELSE (bm - min(bm) OVER w) / (max(bm) OVER w - min(bm) OVER w) END AS c, exp(-greatest(0, 2025 - year) / 200.0) AS sw FROM h WINDOW w AS (PARTITION BY query_id)),
scored AS (SELECT *, CASE WHEN year IS NULL THEN ip ELSE sw * a + (1 - sw) * (0.5 * b + 0.5 * c) END AS base FROM n)"""


def _search(s, d, tags=False, **more):
    return retrieval.search(views.passage_queries(s, d, tags), views.index(s, d), now=2025, **more)


def _rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


@query(with_("ss", "tt", "passages") + f",\n{_BM25},\n{_SEARCH}" + " SELECT query_id, lang_a, row_index, side, round(ng, 6) AS ng, round(bm, 6) AS bm, round(base, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base DESC, lang_a, row_index, side)::INT AS rank FROM scored) WHERE rank <= 5")
def hybrid_search(s, d):
    return _rounded(_search(s, d), "ng", "bm", "score").select("query_id", "lang_a", "row_index", "side", "ng", "bm", "score", "rank")


@query(with_("ss", "tt", "passages", "linked") + f",\n{_BM25},\n{_SEARCH}" + """, boosted AS (SELECT scored.*, list_filter(links, lambda x: x.upos = 'ADJ' AND x.ner = 'O')[1] AS link, CASE side WHEN 0 THEN source_tokens ELSE target_tokens END AS own, base + CASE WHEN len(list_filter(links, lambda x: x.upos = 'ADJ' AND x.ner = 'O')) > 0 THEN 0.1 ELSE 0 END AS score FROM scored JOIN linked USING (row_index))
SELECT query_id, row_index, side, round(score, 6) AS score, rank, link.upos AS upos, link.ner AS ner, lower(own[link.idx + 1]) AS lemma FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lang_a, row_index, side)::INT AS rank FROM boosted) WHERE rank <= 5""")
def hybrid_search_tag_boost(s, d):
    return _rounded(_search(s, d, tags=True), "score").select("query_id", "row_index", "side", "score", "rank", "upos", "ner", "lemma")


@query(with_("ss", "tt", "passages") + f",\n{_BM25},\n{_SEARCH}" + " SELECT query_id, count(*) AS n_hits, min(hit_year)::INT AS first_year, max(hit_year)::INT AS last_year FROM h GROUP BY ALL")
def search_year_window(s, d):
    return _search(s, d, top=300).groupBy("query_id").agg(F.count("*").alias("n_hits"), F.min("hit_year").alias("first_year"), F.max("hit_year").alias("last_year"))


_RERANK = """, k AS (SELECT query_id, row_index, hit_year, base AS similarity FROM scored), y AS (SELECT *, abs(hit_year - 1500) AS gap, count(*) FILTER (abs(hit_year - 1500) <= 100) OVER (PARTITION BY query_id) AS near FROM k),
z AS (SELECT *, CASE WHEN near <= 0 THEN 0.0 ELSE 0.01 * (1 - exp(-near / 300.0)) END AS rate FROM y)"""


def _reranked(s, d):
    return serve.temporal_rerank(_search(s, d, top=300).withColumnRenamed("score", "similarity"), F.lit(1500))


@query(with_("ss", "tt", "passages") + f",\n{_BM25},\n{_SEARCH}" + _RERANK + " SELECT DISTINCT query_id, near, round(rate, 8) AS rate FROM z")
def temporal_lambda(s, d):
    return _reranked(s, d).select("query_id", "near", F.round("rate", 8).alias("rate")).distinct()


@query(with_("ss", "tt", "passages") + f",\n{_BM25},\n{_SEARCH}" + _RERANK + " SELECT query_id, row_index, round(similarity * exp(-rate * gap), 6) AS reranked, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity * exp(-rate * gap) DESC, row_index)::INT AS rank FROM z) WHERE rank <= 10")
def temporal_rerank(s, d):
    return serve.top_k(_reranked(s, d).drop("rank"), 10, "reranked", "row_index").select("query_id", "row_index", r6("reranked").alias("reranked"), "rank")


@query(with_("pp", "linked", "words") + ",\n" + _LOOKUP + """, h AS (SELECT query_id, row_index, other[link.idx + 1] AS span, confidence FROM placed), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, row_index) AS r FROM h WHERE span IS NOT NULL)
SELECT query_id, row_index, span, confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS q FROM b WHERE r <= 5 AND confidence >= 0.75) WHERE q = 1""")
def fallback_native(s, d):
    return retrieval.lookup_native(views.word_queries(s, d), views.index(s, d))


# --- attestation, shards ------------------------------------------------------------------------------------------


def _attested(s, d):
    o = table(s, d, "orders")
    return o.select("o_orderkey", F.col("o_orderpriority").alias("iso_code"), F.year("o_orderdate").alias("attestation_year"), F.col("o_orderstatus").alias("lemma"), F.when(F.col("o_custkey") % 3 == 0, "PER").otherwise("O").alias("ner"))


_ATTESTED = "attested AS (SELECT o_orderkey, o_orderpriority AS iso_code, year(o_orderdate)::INT AS attestation_year, o_orderstatus AS lemma, CASE WHEN o_custkey % 3 = 0 THEN 'PER' ELSE 'O' END AS ner FROM orders)"


@query(f"WITH {_ATTESTED} SELECT * FROM attested WHERE iso_code = '1-URGENT' AND lemma = 'F' AND attestation_year BETWEEN 1994 AND 1996")
def attest_exact(s, d):
    return serve.attest(_attested(s, d), "F", "1-URGENT", 1995, window=1, ner="")


@query(f"WITH {_ATTESTED} SELECT * FROM attested WHERE iso_code = '2-HIGH' AND lemma = 'O' AND attestation_year BETWEEN 1990 AND 2000 AND ner = 'PER'")
def attest_ner(s, d):
    return serve.attest(_attested(s, d), "O", "2-HIGH", 1995, window=5, ner="PER")


def _shards(s, d):
    return _attested(s, d).groupBy("iso_code", (F.col("attestation_year") - F.col("attestation_year") % 2).alias("base")).agg(F.min("attestation_year").alias("year_from"), F.max("attestation_year").alias("year_to"), F.count("*").alias("n_rows"))


_SHARDS = f"{_ATTESTED}, shards AS (SELECT iso_code, attestation_year - attestation_year % 2 AS base, min(attestation_year) AS year_from, max(attestation_year) AS year_to, count(*) AS n_rows FROM attested GROUP BY ALL)"


@query(f"WITH {_SHARDS} SELECT * FROM shards WHERE year_to >= 1994 AND year_from <= 1996")
def shard_prune_overlap(s, d):
    return corpus_files.overlapping(_shards(s, d), 1994, 1996)


def _lang_pairs(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("lang"))
    c = table(s, d, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("lang").alias("lang_b")), "c_nationkey").select("c_custkey", "lang_b", F.col("c_mktsegment").alias("lang_a"))
    return c


_LANGS = "langs AS (SELECT c_custkey, r_name AS lang_b, c_mktsegment AS lang_a FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {_LANGS} SELECT DISTINCT lang_a, lang_b FROM langs WHERE lang_a = 'BUILDING' OR lang_b = 'ASIA'")
def lang_pair_discovery(s, d):
    return _lang_pairs(s, d).where("lang_a = 'BUILDING' OR lang_b = 'ASIA'").select("lang_a", "lang_b").distinct()


@query(f"WITH {_LANGS} SELECT c_custkey, lang_a, lang_b FROM langs WHERE lang_a = 'BUILDING' AND lang_b = 'ASIA'")
def pair_reverse_fallback(s, d):
    return corpus_files.with_reversed(_lang_pairs(s, d), "ASIA", "BUILDING").select("c_custkey", "lang_a", "lang_b")


# --- contributions -------------------------------------------------------------------------------------------------


def _contributions(s, d):
    """Contributions made of documents, as JSON: ids decide what is broken about them, so that each rule of the schema is broken by some."""
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    i = F.col("doc_id")
    no, yes = (lambda n, x: F.when(i % n != 0, x)), (lambda n, x: F.when(i % n == 0, x))
    token = lambda x: F.struct(x.alias("surface"), F.when(i % 5 == 0, "name").when(i % 31 == 0, "place").alias("class"), F.when(F.startswith(x, F.lit("E")), True).alias("gap"))
    lit = F.lit
    body = F.struct(
        F.when(i % 7 == 0, "grammar_note").when(i % 11 == 0, "poem").when(i % 2 == 0, "attestation").otherwise("dictionary_entry").alias("doc_type"),
        F.struct(no(13, F.col("lang")).alias("lang_code"), F.when((i % 6 == 0) | (i % 29 == 0), "free").alias("text"), no(6, F.transform(w, token)).alias("tokens"), yes(19, lit("x")).alias("note")).alias("origin"),
        F.struct(F.struct(no(41, (1000 + i % 900).cast("int")).alias("year"), F.when(i % 43 == 0, "about").otherwise("exact").alias("precision")).alias("date"), no(17, F.col("source")).alias("source"), no(23, lit("c")).alias("contributor"), no(47, lit("cc")).alias("license"), F.struct(F.when(i % 53 == 0, "done").when(i % 3 == 0, "pending").otherwise("validated").alias("status")).alias("validation")).alias("metadata"),
    )
    target = F.when(i % 14 != 7, F.to_json(F.struct(lit("eng").alias("lang_code"), no(37, lit("x")).alias("text")))).otherwise("null")
    json = F.to_json(body)
    whole = F.when(i % 28 == 7, json).otherwise(F.concat(lit('{"target":'), target, lit(","), F.substring(json, 2, 1 << 30)))
    return contrib.read_json(table(s, d, "documents").select("doc_id", whole.alias("json")), "json")


@query(r"""WITH c AS (SELECT doc_id AS i, lang, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n FROM documents),
v AS (SELECT i, list_filter([CASE WHEN i % 7 <> 0 AND i % 11 = 0 THEN 'doc_type' END, CASE WHEN i % 13 = 0 OR lang IS NULL THEN 'origin' END, CASE WHEN i % 6 <> 0 AND i % 29 = 0 THEN 'tokens_or_text' END, CASE WHEN i % 6 <> 0 AND i % 5 <> 0 AND i % 31 = 0 AND n > 0 THEN 'token_class' END,
CASE WHEN i % 14 <> 7 AND i % 37 = 0 THEN 'target' END, CASE WHEN i % 7 = 0 AND i % 6 <> 0 AND i % 29 <> 0 THEN 'grammar_note_text' END, CASE WHEN i % 7 = 0 AND i % 14 <> 7 THEN 'grammar_note_target' END, CASE WHEN i % 41 = 0 THEN 'year' END, CASE WHEN i % 43 = 0 THEN 'precision' END,
CASE WHEN i % 17 = 0 OR source IS NULL THEN 'source' END, CASE WHEN i % 23 = 0 THEN 'contributor' END, CASE WHEN i % 47 = 0 THEN 'license' END, CASE WHEN i % 53 = 0 THEN 'status' END, CASE WHEN i % 28 = 7 THEN 'no_target' END, CASE WHEN i % 19 = 0 THEN 'extra' END], lambda x: x IS NOT NULL) AS v FROM c)
SELECT i AS doc_id, array_to_string(v, ',') AS violations FROM v""")
def contribution_validate(s, d):
    return contrib.violations(_contributions(s, d)).select("doc_id", F.array_join("violations", ",").alias("violations"))


_ROWS = r"""c AS (SELECT doc_id AS i, lang, source, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT *, array_to_string(list_filter(w, lambda x: NOT starts_with(x, 'E')), ' ') AS form FROM c WHERE i % 6 <> 0 AND i % 7 <> 0 AND i % 3 <> 0 AND i % 53 <> 0),
rows AS (SELECT CASE WHEN i % 13 <> 0 THEN lang END AS iso_code, form, CASE WHEN i % 41 <> 0 THEN (1000 + i % 900)::INT END AS attestation_year, CASE WHEN i % 17 <> 0 THEN source END AS source, CASE WHEN i % 11 = 0 THEN 'poem' WHEN i % 2 = 0 THEN 'attestation' ELSE 'dictionary_entry' END AS doc_type,
  CASE WHEN i % 5 = 0 AND len(w) > 0 THEN 'PER' ELSE 'O' END AS ner, CASE WHEN i % 5 = 0 AND len(w) > 0 THEN 'name:' || form END AS sense_id FROM f WHERE form <> '')"""


@query(f"WITH {_ROWS} SELECT iso_code, form, form AS lemma, sense_id, attestation_year, source, doc_type, ner FROM rows")
def contribution_rows(s, d):
    return contrib.relational_rows(_contributions(s, d)).select("iso_code", "form", "lemma", "sense_id", "attestation_year", "source", "doc_type", "ner")


@query(f"WITH {_ROWS} SELECT iso_code, min(attestation_year) AS year_from, max(attestation_year) AS year_to, count(*) AS n_rows FROM rows GROUP BY ALL")
def relational_partition_ranges(s, d):
    return contrib.year_ranges(contrib.relational_rows(_contributions(s, d)))


@query(f"WITH {_ROWS}, r AS (SELECT iso_code, min(attestation_year) AS year_from, max(attestation_year) AS year_to FROM rows GROUP BY ALL) SELECT iso_code, year_from, year_to, attestation_year, count(*) AS n FROM rows JOIN r USING (iso_code) WHERE attestation_year BETWEEN 1050 AND 1150 GROUP BY ALL")
def relational_index(s, d):
    """Written by language and range of years, and read back for a century."""
    path = f"{corpus_files.shared_folder(s)}/relational-{uuid.uuid4().hex}"
    contrib.write_relational(contrib.relational_rows(_contributions(s, d)), path)
    x = shards_between(s.read.parquet(path), 1050, 1150).where("attestation_year BETWEEN 1050 AND 1150")
    return x.groupBy("iso_code", "year_from", "year_to", "attestation_year").agg(F.count("*").alias("n"))


# --- alignment ---------------------------------------------------------------------------------------------------------


def _editions(s, d):
    """Documents 2k and 2k + 1 as two editions of work k."""
    u = views.units(s, d).withColumn("work", F.floor(F.col("doc_id") / 2))
    return u.where("doc_id % 2 = 0").select("work", "unit_index", "unit_text"), u.where("doc_id % 2 = 1").select("work", "unit_index", "unit_text")


_BAND = V["units"] + f""",
ea AS (SELECT doc_id // 2 AS work, unit_index AS i, unit_text AS ta FROM units WHERE doc_id % 2 = 0), eb AS (SELECT doc_id // 2 AS work, unit_index AS j, unit_text AS tb FROM units WHERE doc_id % 2 = 1),
sizes AS (SELECT work, n_a, n_b, greatest(20, round_even(0.1 * greatest(n_a, n_b), 0))::INT AS size FROM (SELECT work, count(*)::INT AS n_a FROM ea GROUP BY ALL) JOIN (SELECT work, count(*)::INT AS n_b FROM eb GROUP BY ALL) USING (work)),
met AS (SELECT work, i, j, ta, tb, j >= round_even(i / n_a * n_b, 0) - size AND j <= round_even(i / n_a * n_b, 0) + size AS in_a, i >= round_even(j / n_b * n_a, 0) - size AND i <= round_even(j / n_b * n_a, 0) + size AS in_b FROM ea JOIN sizes USING (work) JOIN eb USING (work)),
banded AS (SELECT * FROM met WHERE in_a OR in_b)"""
_SET = "list_distinct(list_transform(range(1, length(p) - 1), lambda k: substring(p, k, 3)))"
_TOP = f"""{_BAND},
ga AS MATERIALIZED (SELECT work, i, {_SET} AS ga FROM (SELECT work, i, '  ' || lower(ta) || '  ' AS p FROM ea)), gb AS MATERIALIZED (SELECT work, j, {_SET} AS gb FROM (SELECT work, j, '  ' || lower(tb) || '  ' AS p FROM eb)),
scored AS MATERIALIZED (SELECT work, i, j, in_a, in_b, {_DICE.format('ga', 'gb')} AS score FROM banded JOIN ga USING (work, i) JOIN gb USING (work, j)),
ta AS (SELECT work, i, j, score FROM (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM scored WHERE in_a WINDOW w AS (PARTITION BY work, i ORDER BY score DESC, j)) WHERE r = 1 AND (second IS NULL OR score - second >= 0.05)),
tb AS (SELECT work, i, j, score FROM (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM scored WHERE in_b WINDOW w AS (PARTITION BY work, j ORDER BY score DESC, i)) WHERE r = 1 AND (second IS NULL OR score - second >= 0.05)),
mutual AS (SELECT ta.work, ta.i, ta.j, ta.score FROM ta JOIN tb ON ta.work = tb.work AND ta.i = tb.i AND ta.j = tb.j)"""


#: The longest rising chain of `mutual` by piles: a match goes on the pile of its length; the chain ends with the last one on the last pile, and each
#: member follows the one last put on the pile before when it was put on its own.
_CHAIN = """chain AS (SELECT work, i, j, 1 AS n FROM mutual UNION SELECT m.work, m.i, m.j, c.n + 1 FROM chain c JOIN mutual m ON m.work = c.work AND m.i > c.i AND m.j > c.j),
piles AS (SELECT work, i, j, max(n) AS n FROM chain GROUP BY ALL), ends AS (SELECT work, max(n) AS n FROM piles GROUP BY ALL),
walk AS (SELECT work, max(i) AS i, n FROM piles JOIN ends USING (work, n) GROUP BY work, n UNION ALL SELECT w.work, max(p.i), p.n FROM walk w JOIN piles p ON p.work = w.work AND p.n = w.n - 1 AND p.i < w.i GROUP BY w.work, p.n),
lis AS (SELECT m.* FROM mutual m JOIN walk USING (work, i))"""


@query(f"WITH {_BAND} SELECT work, i, j, in_a, in_b FROM banded")
def band_join(s, d):
    return align.band_join(*_editions(s, d), "work").select("work", "i", "j", "in_a", "in_b")


def _scored(s, d):
    return align.lexical_top(*_editions(s, d), "work")


@query(f"WITH {_TOP} SELECT work, i, j, round(score, 6) AS score FROM ta")
def margin_top1(s, d):
    return _rounded(align.margin_top1(_scored(s, d), "work", "i", "j", "in_a"), "score")


@query(f"WITH {_TOP} SELECT work, i, j, round(score, 6) AS score FROM mutual")
def mutual_best(s, d):
    return _rounded(align.mutual_best(_scored(s, d), "work"), "score")


def _matches(s, d):
    return align.monotone(align.mutual_best(_scored(s, d), "work"), "work")


@query(f"WITH RECURSIVE {_TOP}, {_CHAIN} SELECT work, i, j, round(score, 6) AS score FROM lis")
def lexical_align_lis(s, d):
    return _rounded(_matches(s, d), "score")


@query(f"""WITH RECURSIVE {_TOP},
chain AS (SELECT work, i, j, 1 AS n FROM mutual UNION SELECT m.work, m.i, m.j, c.n + 1 FROM chain c JOIN mutual m ON m.work = c.work AND m.i > c.i AND m.j > c.j)
SELECT work, max(n)::BIGINT AS length FROM chain GROUP BY ALL""")
def alignment_chain_length(s, d):
    return _matches(s, d).groupBy("work").agg(F.count("*").alias("length"))


def _sizes(s, d):
    a, b = _editions(s, d)
    return a.groupBy("work").agg(F.count("*").cast("int").alias("n_a")).join(b.groupBy("work").agg(F.count("*").cast("int").alias("n_b")), "work")


#: Anchors for the gap query: every third line of a to the same line of b, so that SQL need not find the chain.
def _anchors(s, d):
    a, b = _editions(s, d)
    return a.select("work", F.col("unit_index").alias("i")).join(b.select("work", F.col("unit_index").alias("j")), "work").where("i = j AND i % 3 = 1").select("work", "i", "j", F.lit(1.0).alias("score"))


@query(f"""WITH {_BAND}, an AS (SELECT work, i, j FROM ea JOIN eb USING (work) WHERE i = j AND i % 3 = 1 UNION ALL SELECT work, n_a, n_b FROM sizes),
x AS (SELECT work, coalesce(lag(i) OVER w, -1) + 1 AS i_from, i AS i_to, coalesce(lag(j) OVER w, -1) + 1 AS j_from, j AS j_to FROM an WHERE work IN (SELECT work FROM sizes) WINDOW w AS (PARTITION BY work ORDER BY i, j))
SELECT * FROM x WHERE i_to > i_from AND j_to > j_from""")
def gap_extract(s, d):
    return align.gaps(_anchors(s, d), _sizes(s, d), "work")


@query(f"""WITH {_BAND}, b AS (SELECT work, n_a, n_b, unnest(range(0, n_a, 34)) AS a_from FROM sizes)
SELECT work, a_from::INT AS a_from, least(n_a, a_from + 40)::INT AS a_to, floor(a_from / n_a * n_b)::INT AS b_from, least(n_b, greatest(floor(a_from / n_a * n_b) + 1, round_even(least(n_a, a_from + 40) / n_a * n_b, 0)))::INT AS b_to FROM b WHERE a_from = 0 OR a_from - 34 + 40 < n_a""")
def make_blocks(s, d):
    return align.blocks(_sizes(s, d), "work")


@query(f"""WITH RECURSIVE {_TOP}, {_CHAIN} SELECT work, (row_number() OVER (PARTITION BY work ORDER BY i) - 1)::INT AS pair_no, ta AS source_text, tb AS target_text, round(score, 6) AS sentence_confidence, 'lexical:trigram-dice' AS sentence_method
FROM lis JOIN ea USING (work, i) JOIN eb USING (work, j)""")
def align_algorithmic(s, d):
    """Whole alignment without a model: anchors, check against the editions, numbers."""
    x = modes.align_pairs("algorithmic", *_editions(s, d), "work")
    return x.select("work", "pair_no", "source_text", "target_text", r6("sentence_confidence").alias("sentence_confidence"), "sentence_method")


def _encoded(s, d):
    a, b = _editions(s, d)
    return (x.withColumn("vector", adapters.hashed_trigrams(F.col("unit_text"))) for x in (a, b))


@query()
def align_hybrid(s, d):
    """Anchors by vectors; a stand-in for the model answers each gap with the first lines of its two sides."""
    a, b = _encoded(s, d)
    asked = modes.requests("hybrid", a, b, "work", modes.anchors("hybrid", a, b, "work"))
    x = modes.align_pairs("hybrid", a, b, "work", {"blocks": _block_replies(a, b, asked)}, models=("stand-in", "hashed"))
    return x.select("work", "pair_no", "source_text", "target_text", r6("sentence_confidence").alias("sentence_confidence"), "sentence_method")


def _block_replies(a, b, asked):
    """For each block a reply with a pair of its first lines, one of its last lines, and one that stands in neither edition."""
    at = lambda u, c, n: u.select("work", F.col("unit_index").alias(c), F.col("unit_text").alias(n))
    x = asked.select("work", "block", "i_from", "j_from", (F.col("i_to") - 1).alias("i_last"), (F.col("j_to") - 1).alias("j_last"))
    x = x.join(at(a, "i_from", "a0"), ["work", "i_from"]).join(at(b, "j_from", "b0"), ["work", "j_from"]).join(at(a, "i_last", "a1"), ["work", "i_last"]).join(at(b, "j_last", "b1"), ["work", "j_last"])
    pair = lambda p, q, c: F.struct(p.alias("source_text"), q.alias("target_text"), F.lit(c).alias("sentence_confidence"))
    made = F.to_json(F.array(pair(F.col("a0"), F.col("b0"), "0.9"), pair(F.col("a1"), F.col("b1"), "1.7"), pair(F.lit("words that nobody wrote"), F.col("b0"), "0.5")))
    return x.select("work", "block", F.concat(F.lit("```json\n"), made, F.lit("\n```\nThat is all.")).alias("reply"))


@query(f"""WITH {_BAND}, b AS (SELECT work, n_a, n_b, unnest(range(0, n_a, 34)) AS a_from FROM sizes),
blocks AS (SELECT work, a_from::INT AS i0, least(n_a, a_from + 40)::INT - 1 AS i1, floor(a_from / n_a * n_b)::INT AS j0, least(n_b, greatest(floor(a_from / n_a * n_b) + 1, round_even(least(n_a, a_from + 40) / n_a * n_b, 0)))::INT - 1 AS j1 FROM b WHERE a_from = 0 OR a_from - 34 + 40 < n_a),
p AS (SELECT work, i0, 0 AS k, i0 AS i, j0 AS j, 0.9 AS c FROM blocks UNION ALL SELECT work, i0, 1, i1, j1, 1.0 FROM blocks),
t AS (SELECT p.*, trim(ta, ' ') AS s, trim(tb, ' ') AS t FROM p JOIN ea USING (work, i) JOIN eb USING (work, j)),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY work, lower(trim(s, E' \t\n\r\f\x0B\x1C\x1D\x1E\x1F')), lower(trim(t, E' \t\n\r\f\x0B\x1C\x1D\x1E\x1F')) ORDER BY i0, k) AS r FROM t) WHERE r = 1)
SELECT work, (row_number() OVER (PARTITION BY work ORDER BY i0, k) - 1)::INT AS pair_no, s AS source_text, t AS target_text, c::DOUBLE AS sentence_confidence, 'llm:stand-in' AS sentence_method FROM u""")
def align_llm(s, d):
    """All of two editions in overlapping blocks: what two blocks tell alike is one pair, what stands in neither edition is none."""
    a, b = _editions(s, d)
    asked = modes.requests("llm", a, b, "work", modes.anchors("llm", a, b, "work"))
    x = modes.align_pairs("llm", a, b, "work", {"blocks": _block_replies(a, b, asked)}, models=("stand-in", "none"))
    return x.select("work", "pair_no", "source_text", "target_text", r6("sentence_confidence").alias("sentence_confidence"), "sentence_method")


_JUDGED = _TOP.replace(f"{_DICE.format('ga', 'gb')} AS score FROM banded JOIN ga USING (work, i) JOIN gb USING (work, j)", "least(length(ta), length(tb)) / greatest(length(ta), length(tb), 1) AS score, round(least(length(ta), length(tb)) / greatest(length(ta), length(tb), 1), 3) AS back FROM banded")
_JUDGED = _JUDGED[: _JUDGED.index("tb AS (")] + _JUDGED[_JUDGED.index("tb AS (") :].replace("lead(score) OVER w AS second", "lead(back) OVER w AS second", 1).replace("score DESC, i", "back DESC, i", 1).replace("score - second", "back - second", 1)


@query(f"""WITH RECURSIVE {_JUDGED}, {_CHAIN}, t AS (SELECT lis.*, ta, tb, row_number() OVER (PARTITION BY work, lower(trim(ta, E' \\t\\n\\r\\f\\x0B\\x1C\\x1D\\x1E\\x1F')), lower(trim(tb, E' \\t\\n\\r\\f\\x0B\\x1C\\x1D\\x1E\\x1F')) ORDER BY i) AS r FROM lis JOIN ea USING (work, i) JOIN eb USING (work, j))
SELECT work, (row_number() OVER (PARTITION BY work ORDER BY i) - 1)::INT AS pair_no, ta AS source_text, tb AS target_text, round(score, 6) AS sentence_confidence, 'llm_judge:stand-in' AS sentence_method FROM t WHERE r = 1""")
def align_llm_judge(s, d):
    """Anchors by judged scores; a stand-in for the model scores lines by their lengths."""
    a, b = _editions(s, d)
    near = align.band_join(a, b, "work")
    alike = F.least(F.length("unit_a"), F.length("unit_b")) / F.greatest(F.length("unit_a"), F.length("unit_b"), F.lit(1))
    judged = near.select("work", "i", "j", alike.alias("score_ab"), F.round(alike, 3).alias("score_ba"))
    x = modes.align_pairs("llm_judge", a, b, "work", {"judgements": judged}, models=("stand-in", "none"))
    return x.select("work", "pair_no", "source_text", "target_text", r6("sentence_confidence").alias("sentence_confidence"), "sentence_method")


@query(f"WITH {V['units']} SELECT doc_id, unit_index, unit_text FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(unit_text, E' \t\n\r\f\x0B\x1C\x1D\x1E\x1F')) ORDER BY doc_id, unit_index) AS n FROM units) WHERE n = 1")
def dedup_first_wins(s, d):
    return align.first_wins(views.units(s, d).withColumn("key", text.nfkc_key(F.col("unit_text"))), [F.col("key")], ["doc_id", "unit_index"]).select("doc_id", "unit_index", "unit_text")


@query(r"""WITH t AS (SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '[\s]+', ' ', 'g'))) AS whole FROM documents), b AS (SELECT item_id, text AS part, lower(trim(regexp_replace(text, '[\s]+', ' ', 'g'))) AS item FROM benchmark)
SELECT doc_id, item_id, part FROM t JOIN b ON contains(whole, item)""")
def verify_verbatim(s, d):
    """Every benchmark item, whole, against every document."""
    return align.containing(table(s, d, "documents"), table(s, d, "benchmark").select("item_id", F.col("text").alias("part")))


@query(with_("pairs") + " SELECT row_index, 'a-' || source_year || '_b-1999_' || lpad((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::VARCHAR, 5, '0') AS pair_id FROM pairs")
def finalize_ids(s, d):
    p = views.pairs(s, d)
    return align.numbered(p, corpus_files.pair_slug(F.lit("a"), F.col("source_year"), F.lit("b"), F.col("target_year")), "conv_id", ["turn"]).select("row_index", "pair_id")


# --- cleaning ------------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, trim(CASE WHEN doc_id % 3 = 0 THEN t WHEN doc_id % 3 = 1 THEN t || chr(10) ELSE 'head' || chr(10) || t END, E' \t\n\r\f\x0B') AS body FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def boilerplate_strip(s, d):
    t, i = F.coalesce("text", F.lit("")), F.col("doc_id")
    start, end = F.lit("*** START OF THE PROJECT GUTENBERG EBOOK X ***"), F.lit("*** END OF THIS PROJECT GUTENBERG EBOOK X ***")
    full = F.when(i % 3 == 0, F.concat_ws("\n", F.lit("license"), start, t, end, F.lit("more"))).when(i % 3 == 1, F.concat_ws("\n", start, t, F.lit(""))).otherwise(F.concat_ws("\n", F.lit("head"), t))
    return table(s, d, "documents").select("doc_id", text.strip_boilerplate(full).alias("body"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(t, 'Ñ', '—'), 'Ò', '“'), 'Ó', '”'), 'Ô', '‘'), 'Õ', '’') AS fixed FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def mojibake_fix(s, d):
    return table(s, d, "documents").select("doc_id", text.fix_mojibake(F.coalesce("text", F.lit(""))).alias("fixed"))


@query()
def html_text(s, d):
    return table(s, d, "pages").select("page_id", pages.visible_text(F.col("html")).alias("text"))


@query("SELECT page_id, 0 AS place, regexp_extract(url, '^[a-z]+://[^/?#]+') || '/p/' || (page_id % 50) AS url, 'page' AS text, 'See page & more' AS context FROM pages")
def html_links(s, d):
    """Pages have links in their navigation, which counts as none; a list with one link, met twice, and a script is added."""
    more = F.concat(F.lit('<ul><li>See <A HREF=" /p/'), (F.col("page_id") % 50).cast("string"), F.lit('"><b>page</b></a> &amp; more</li><li><a href="JavaScript:x()">no</a><a href="#top">top</a><a href="/p/'), (F.col("page_id") % 50).cast("string"), F.lit('">again</a></ul>'))
    x = table(s, d, "pages").select("page_id", F.posexplode(pages.page_links(F.col("url"), F.concat(F.coalesce("html", F.lit("")), more))).alias("place", "link"))
    return x.select("page_id", "place", "link.*")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'http://h/e/' || p_partkey || '.txt' END AS file, 'Author: ' || p_brand || ' & co; Title: ' || p_name AS hint FROM part")
def library_records(s, d):
    """Pages of a library's records, made of parts: one download of three is a text, and one row of three says who or what."""
    k = F.col("p_partkey").cast("string")
    kind = F.when(F.col("p_partkey") % 3 == 0, "Text/Plain; charset=utf-8").otherwise("application/epub+zip")
    html = F.concat(F.lit("<p><a class='btn featured-format-link' type='"), kind, F.lit("' href='e/"), k, F.lit(".txt'>get</a></p><table id=bibrec><tr><th>Author</th><td><a>"), _escaped(F.col("p_brand")), F.lit("</a> &amp; co</td></tr><tr><th>Release</th><td>x</td></tr><tr><th> Title </th><td>"), _escaped(F.col("p_name")), F.lit("</td></tr></table>"))
    x = corpus_files.spread(table(s, d, "part").select("p_partkey", "p_brand", "p_name")).select("p_partkey", pages.library_records(F.lit("http://h/"), html).alias("r"))
    return x.select("p_partkey", F.get("r.files", F.lit(0)).alias("file"), "r.hint")


@query(r"""SELECT page_id, CASE WHEN lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)) LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '\.html?$') THEN 'html' ELSE 'txt' END AS kind FROM pages""")
def content_type(s, d):
    return table(s, d, "pages").select("page_id", corpus_files.content_type(F.lit(None).cast("string"), F.col("url")).alias("kind"))


@query(r"""WITH RECURSIVE q AS (SELECT doc_id, list_filter(string_split(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x, E' \t\n\r\f\x0B\x1C\x1D\x1E\x1F\u0085') <> '') AS l FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS t FROM q),
r AS (SELECT doc_id, i, t, 0 AS chunk, length(t) + 2 AS size FROM p WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, p.t, CASE WHEN size + length(p.t) + 2 > 600 THEN chunk + 1 ELSE chunk END, CASE WHEN size + length(p.t) + 2 > 600 THEN length(p.t) + 2 ELSE size + length(p.t) + 2 END FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1),
c AS (SELECT doc_id, chunk AS chunk_index, string_agg(t, chr(10) || chr(10) ORDER BY i) AS c FROM r GROUP BY ALL)
SELECT doc_id, chunk_index::INT AS chunk_index, length(c)::INT AS n_chars, sha256(c) AS sha FROM c""")
def chunk_pack(s, d):
    """Documents with every second line end doubled, packed into chunks of at most 600 characters."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n\n")
    x = table(s, d, "documents").select("doc_id", F.posexplode(align.pack_paragraphs(t, F.lit(600))).alias("chunk_index", "chunk"))
    return x.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("sha"))


@query(V["units"].join(["WITH ", ""]) + """ SELECT doc_id, (unit_index // 4)::INT AS chunk_index, count(*) AS n_units, sum(count(*)) OVER (PARTITION BY doc_id ORDER BY unit_index // 4)::BIGINT AS upto FROM units GROUP BY doc_id, unit_index // 4""")
def chunk_unit_counts(s, d):
    """Replies of a cleaning model, four lines a chunk: units in order, and where each chunk's stand."""
    u = views.units(s, d).withColumn("chunk_index", F.floor(F.col("unit_index") / 4).cast("int"))
    replies = u.groupBy("doc_id", "chunk_index").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("unit_index", "unit_text"))), lambda x: x["unit_text"])).alias("reply"))
    return adapters.chunk_unit_counts(adapters.cleaned_units(replies.select("doc_id", "chunk_index"), replies))


@query(V["units"].join(["WITH ", ""]) + """, n AS (SELECT doc_id, unit_index // 40 AS batch, count(*) AS n FROM units GROUP BY ALL)
SELECT doc_id, unit_index, CASE WHEN (doc_id + batch) % 3 = 0 THEN trim(unit_text || ' !', ' ') ELSE unit_text END AS unit_text FROM units JOIN n USING (doc_id) WHERE unit_index // 40 = batch""")
def units_reviewed(s, d):
    """A second reading that adds a mark: batches whose reply is absent or too short keep their units."""
    u = views.units(s, d).withColumn("batch", F.floor(F.col("unit_index") / 40).cast("int"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("unit_index", "unit_text"))), lambda x: F.concat(x["unit_text"], F.lit(" !")))
    r = u.groupBy("doc_id", "batch").agg(told.alias("told")).withColumn("k", (F.col("doc_id") + F.col("batch")) % 3)
    r = r.where("k < 2").select("doc_id", "batch", F.to_json(F.when(F.col("k") == 0, F.col("told")).otherwise(F.concat("told", F.array(F.lit("one more"))))).alias("reply"))
    return adapters.reviewed_units(u.select("doc_id", "unit_index", "unit_text"), r)


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS chunk_index FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey % 5 <> 0)""")
def chunk_resume(s, d):
    """Chunks still to do after an interrupted run: what it did counts for documents that still have as many chunks."""
    c = table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index"), "l_returnflag")
    n = c.groupBy("doc_id").agg(F.count("*").alias("n"))
    done = c.where("l_returnflag = 'R'").join(n, "doc_id").select("doc_id", "chunk_index", F.when(F.col("doc_id") % 5 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("total_chunks"))
    return catalog.chunks_to_do(c.drop("l_returnflag"), done)


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE 'new' END AS result FROM orders WHERE o_orderkey % 7 <> 0")
def checkpoint_write_back(s, d):
    """A memo that has a third of the keys, and a compute that fails for some of the rest."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("key"))
    path = f"{corpus_files.shared_folder(s)}/memo-{uuid.uuid4().hex}"
    o.where("key % 3 = 0 AND key % 7 != 0").select("key", F.lit("old").alias("result"), F.lit("f1").alias("fingerprint")).union(o.select("key", F.lit("other"), F.lit("f0"))).write.parquet(path)
    return catalog.get_or_compute(o, path, "f1", "key", lambda left: left.where("key % 7 != 0").withColumn("result", F.lit("new")), "key long, result string")


# --- names and catalogue ---------------------------------------------------------------------------------------------------


def _stems(s, d):
    p = table(s, d, "part")
    year = (F.col("p_partkey") % 2500 - 500).cast("int")
    return p.select("p_partkey", F.element_at(F.array(*map(F.lit, ("ang", "enm", "grc", "fre"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("lang"), year.alias("year"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.col("p_type").alias("source"))


_STEMS = "stems AS (SELECT p_partkey, ['ang', 'enm', 'grc', 'fre'][p_partkey % 4 + 1] AS lang, (p_partkey % 2500 - 500)::INT AS year, p_name AS title, p_brand AS author, p_type AS source FROM part)"
_SAN = r"trim(regexp_replace({}, '[^\p{{L}}\p{{N}}_]+', '_', 'g'), '_')"
_STEM = f"lang || '-' || CASE WHEN year < 0 THEN 'BC' || (-year) ELSE year::VARCHAR END || '-' || {_SAN.format('title')} || '-' || {_SAN.format('author')} || '-' || {_SAN.format('source')}"


@query(f"WITH {_STEMS} SELECT p_partkey, {_STEM} AS stem FROM stems")
def filename_build(s, d):
    return _stems(s, d).select("p_partkey", corpus_files.build_name(*(F.col(c) for c in ("lang", "year", "title", "author", "source"))).alias("stem"))


@query(f"WITH {_STEMS} SELECT p_partkey, lang AS lang_code, year, {_SAN.format('title')} AS title, replace({_SAN.format('author')}, '_', ' ') AS author, replace({_SAN.format('source')}, '_', ' ') AS source FROM stems")
def filename_parse(s, d):
    return filename_build(s, d).select("p_partkey", corpus_files.parse_name(F.col("stem")).alias("f")).select("p_partkey", "f.*")


def _plausible(a: str, b: str) -> str:
    a, b = _NORM.format(a), _NORM.format(b)
    return f"CASE WHEN {a} = '' OR {b} = '' THEN false WHEN {a} = 'unknown' OR {b} = 'unknown' THEN {a} = {b} ELSE {a} = {b} OR (least(length({a}), length({b})) >= 3 AND (contains({a}, {b}) OR contains({b}, {a}))) END"


_NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(f"""WITH a AS (SELECT p_partkey, {_NORM.format('p_brand')} AS a, {_NORM.format("CASE p_partkey % 3 WHEN 0 THEN p_brand || ' of ' || p_type WHEN 1 THEN p_type ELSE 'Unknown' END")} AS b FROM part)
SELECT p_partkey, CASE WHEN a = '' OR b = '' THEN false WHEN a = 'unknown' OR b = 'unknown' THEN a = b ELSE a = b OR (least(length(a), length(b)) >= 3 AND (contains(a, b) OR contains(b, a))) END AS plausible FROM a""")
def author_match(s, d):
    k = F.col("p_partkey") % 3
    other = F.when(k == 0, F.concat_ws(" of ", "p_brand", "p_type")).when(k == 1, F.col("p_type")).otherwise("Unknown")
    return table(s, d, "part").select("p_partkey", corpus_files.plausible_author(F.col("p_brand"), other).alias("plausible"))


@query(f"""WITH n AS (SELECT 'f' || lpad(p_partkey::VARCHAR, 9, '0') AS name, p_type AS title, p_brand AS author FROM part), f AS (SELECT p_type AS title, p_brand AS author, 'w' || min(p_partkey) AS folder FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL)
SELECT name, min(folder) AS folder FROM n LEFT JOIN f ON f.title = n.title AND {_plausible('f.author', 'n.author')} GROUP BY ALL""")
def work_folder_match(s, d):
    p = table(s, d, "part")
    new = p.select(F.concat(F.lit("f"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("name"), F.col("p_type").alias("title"), F.col("p_brand").alias("author"))
    folders = p.where("p_partkey % 2 = 0").groupBy(F.col("p_type").alias("title"), F.col("p_brand").alias("author")).agg(F.concat(F.lit("w"), F.min("p_partkey").cast("string")).alias("folder"))
    return catalog.match_work(new, folders).select("name", "folder")


@query("SELECT p_type AS work, arg_min(p_name, (p_size, p_name)) AS oldest_file, min(p_size) AS oldest_year FROM part GROUP BY ALL")
def oldest_file(s, d):
    return corpus_files.oldest_per_work(table(s, d, "part").select(F.col("p_type").alias("work"), F.col("p_size").alias("year"), F.col("p_name").alias("name")), "work", "year", "name")


@query("""WITH f AS (SELECT s_nationkey % 5 AS work, s_suppkey % 50 AS year, s_name AS name, row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY s_suppkey % 50, s_name) AS r FROM supplier)
SELECT a.work, a.year, a.name, b.year AS year_b, b.name AS name_b FROM f a JOIN f b ON a.work = b.work AND a.r < b.r""")
def file_pairs(s, d):
    return corpus_files.file_pairs(table(s, d, "supplier").select((F.col("s_nationkey") % 5).alias("work"), (F.col("s_suppkey") % 50).alias("year"), F.col("s_name").alias("name")))


@query("SELECT p_partkey, ['deu', 'fra', 'enm', 'ell'][p_partkey % 4 + 1] AS lang FROM part")
def iso_normalize(s, d):
    return table(s, d, "part").select("p_partkey", corpus_files.normalize_lang(F.element_at(F.array(*map(F.lit, ("ger", "fre", "enm", "gre"))), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("lang"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders")
def year_extract(s, d):
    return table(s, d, "orders").select("o_orderkey", text.last_year(F.concat(F.lit("no. 123, vol 12345; first 1300, then "), F.date_format("o_orderdate", "dd MM yyyy"), F.lit("."))).alias("year"))


@query("""WITH o AS (SELECT user_id AS key, event_id, event_type, value FROM events WHERE event_id % 2 = 0), w AS (SELECT user_id AS key, event_id, event_type, value FROM events WHERE event_id % 2 = 1),
x AS (SELECT *, 0 AS n FROM o UNION ALL SELECT *, 1 FROM w) SELECT key, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, event_id DESC) AS r FROM x) WHERE r = 1""")
def catalog_upsert(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("key"), "event_id", "event_type", "value")
    return catalog.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "key", "event_id")


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def checkpoint_miss(s, d):
    memo = table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("fingerprint"))
    return catalog.misses(table(s, d, "orders").select(F.col("o_orderkey").alias("key")), memo, "key", "R")


@query(f"""WITH p AS (SELECT p_partkey, p_type AS lang, p_size AS year, p_brand AS author FROM part), n AS (SELECT * FROM p WHERE p_partkey % 10 = 0), o AS (SELECT * FROM p WHERE p_partkey % 10 <> 0)
SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.lang = o.lang AND n.year = o.year AND {_plausible('n.author', 'o.author')}) UNION ALL SELECT * FROM n""")
def slot_overwrite(s, d):
    p = table(s, d, "part").select("p_partkey", F.col("p_type").alias("lang"), F.col("p_size").alias("year"), F.col("p_brand").alias("author"))
    return catalog.overwrite_slots(p.where("p_partkey % 10 != 0"), p.where("p_partkey % 10 = 0"), ["lang", "year"])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey % 97 AS src, l_partkey % 1009 AS dst FROM lineitem), w AS (SELECT 1::BIGINT AS url, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN e ON e.src = w.url WHERE depth < 3 AND url % 10 <> 7)
SELECT url, min(depth)::INT AS depth, url % 10 = 7 AS is_document FROM w GROUP BY ALL""")
def crawl_frontier(s, d):
    e = table(s, d, "lineitem").select((F.col("l_orderkey") % 97).alias("src"), (F.col("l_partkey") % 1009).alias("dst")).distinct()
    return catalog.crawl(s.createDataFrame([(1,)], "url long"), e, F.col("url") % 10 == 7, corpus_files.shared_folder(s), max_pages=100_000).select("url", "depth", "is_document")


# --- structured catalogues ---------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'Model ' || p_size END AS draft_name, CASE WHEN p_partkey % 2 = 0 THEN 2024 END::INT AS draft_year FROM part""")
def catalogue_names(s, d):
    k = F.col("p_partkey")
    text_ = F.when(k % 3 == 0, F.concat(F.lit("Old work. Edited by "), F.col("p_brand"), F.lit(", London: Press, 1900"))).when(k % 3 == 1, F.concat(F.col("p_brand"), F.lit(", translator. Boston: Press"))).otherwise("nobody")
    label = F.when(k % 2 == 0, F.concat(F.lit("Work AI draft (Model "), F.col("p_size").cast("string"), F.lit(", 2024)"))).otherwise("Work (Someone, 1999)")
    return corpus_files.spread(table(s, d, "part").select("p_partkey", "p_brand", "p_size")).select("p_partkey", catalogue.role_name(text_).alias("name"), catalogue.draft_provenance(label, text_).alias("draft")).select("p_partkey", "name", F.col("draft.name").alias("draft_name"), F.col("draft.year").alias("draft_year"))


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text, 'T ' || doc_id AS translator, 1900 + (doc_id % 100)::INT AS year FROM documents""")
def tei_documents(s, d):
    """Documents wrapped as editions, and read back."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("<l>"), _escaped(x), F.lit("<note>no</note></l>")))
    head = F.concat(F.lit("<TEI xmlns='http://x'><teiHeader><titleStmt><editor role='translator'>T "), F.col("doc_id").cast("string"), F.lit("</editor></titleStmt><sourceDesc><biblStruct><monogr><imprint><date>c. "), (1900 + F.col("doc_id") % 100).cast("string"), F.lit("</date></imprint></monogr></biblStruct></sourceDesc></teiHeader><text><body>"))
    xml = F.concat(head, F.array_join(lines, ""), F.lit("</body></text></TEI>"))
    x = table(s, d, "documents").select("doc_id", pages.tei_text(xml).alias("t"), catalogue.tei_header(xml).alias("h"))
    return x.select("doc_id", F.array_join("t", "\n").alias("text"), F.col("h.translator").alias("translator"), catalogue.header_year(F.col("h.date")).alias("year"))


@query("""SELECT p_partkey, 'urn:' || p_partkey AS urn, 'translation' AS role, 'ell' AS lang, p_name AS title FROM part UNION ALL SELECT p_partkey, 'urn:e', 'edition', 'deu', p_name FROM part WHERE p_partkey % 2 = 0""")
def catalogue_entries(s, d):
    k = F.col("p_partkey")
    xml = F.concat(F.lit("<work xmlns='http://c' xml:lang='gre'><title xml:lang='lat'>x</title><title xml:lang='eng'>"), _escaped(F.col("p_name")), F.lit("</title>"), F.when(k % 2 == 0, "<edition urn='urn:e' xml:lang='ger'/>").otherwise("<edition/>"), F.lit("<translation urn='urn:"), k.cast("string"), F.lit("'><label>l</label></translation></work>"))
    return table(s, d, "part").select("p_partkey", F.explode(catalogue.catalogue_entries(xml)).alias("e")).select("p_partkey", "e.urn", "e.role", "e.lang", "e.title")


@query("SELECT event_id, user_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 15)::INT AS batch FROM events")
def batch_numbering(s, d):
    return catalog.batches(table(s, d, "events").select("event_id", "user_id"), "user_id", ["event_id"], 15)


@query(f"""WITH {V['units']} SELECT doc_id, CASE WHEN unit_index % 2 = 0 THEN 'verse' ELSE 'prose' END AS section, array_to_string(list(unit_text ORDER BY unit_index), chr(10) || chr(10)) AS text FROM units GROUP BY ALL""")
def split_sections(s, d):
    u = views.units(s, d).select("doc_id", F.col("unit_index").alias("chunk_index"), F.col("unit_text").alias("chunk"))
    return catalog.sections(u, u.select("doc_id", "chunk_index", F.when(F.col("chunk_index") % 2 == 0, "verse").otherwise("prose").alias("section")))


# --- tags, confidences, senses ------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT event_id, ['noun ', 'Verb', 'xyz', 'PROPN', 'adj'][event_id % 5 + 1] AS u, ['per', ' LOC', 'zzz', 'o'][event_id % 4 + 1] AS n, ['NSUBJ:pass', 'obj', 'foo:bar', ' Root '][event_id % 4 + 1] AS r FROM events)
SELECT event_id, CASE WHEN upper(trim(u)) = 'XYZ' THEN 'X' ELSE upper(trim(u)) END AS upos, CASE WHEN upper(trim(n)) = 'ZZZ' THEN 'O' ELSE upper(trim(n)) END AS ner, CASE WHEN r = 'foo:bar' THEN 'dep' ELSE lower(trim(r)) END AS deprel FROM t""")
def ud_normalize(s, d):
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("event_id") % len(x) + 1).cast("int"))
    return table(s, d, "events").select("event_id", tags.normalize_upos(pick("noun ", "Verb", "xyz", "PROPN", "adj")).alias("upos"), tags.normalize_ner(pick("per", " LOC", "zzz", "o")).alias("ner"), tags.normalize_deprel(pick("NSUBJ:pass", "obj", "foo:bar", " Root ")).alias("deprel"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'abc' WHEN 2 THEN 'NaN' WHEN 3 THEN '-3' ELSE (value / 100)::VARCHAR END AS c, value / 100 AS v FROM events)
SELECT event_id, round(CASE WHEN event_id % 6 < 3 THEN NULL WHEN event_id % 6 = 3 THEN 0.0 ELSE least(greatest(v, 0.0), 1.0) END, 6) AS confidence FROM t""")
def confidence_parse(s, d):
    k = F.col("event_id") % 6
    c = F.when(k == 0, "true").when(k == 1, "abc").when(k == 2, "NaN").when(k == 3, "-3").otherwise((F.col("value") / 100).cast("string"))
    return table(s, d, "events").select("event_id", r6(tags.parse_confidence(c)).alias("confidence"))


def _tokens_to_tag(s, d):
    return views.tokens(s, d).select((F.col("row_index") * 2 + F.col("side")).alias("seq"), F.col("token_index").alias("position"), "token", F.when(F.col("side") == 0, "a").otherwise("b").alias("lang"), F.lit(1500).alias("year"))


def _tag_replies(s, d):
    """Replies in upper case, but for tokens that it turns into others: 'ß' becomes 'SS'."""
    t = _tokens_to_tag(s, d)
    p = F.col("position")
    return t.select("seq", "position", F.when(p % 7 == 0, "?").when(F.length(F.upper("token")) == F.length("token"), F.upper("token")).otherwise(F.col("token")).alias("token"), F.when(p % 3 == 0, "noun").when(p % 3 == 1, "bad").otherwise("VERB").alias("upos"), F.when(p % 5 == 0, "PER").otherwise("O").alias("ner"), F.lower("token").alias("lemma"))


_FUNCTION_WORDS = [("a", 1500, "the", "DET"), ("a", 1500, "of", "ADP"), ("b", 1500, "and", "CCONJ"), ("b", 1500, "la", "DET")]
_TAGGED = with_("tokens") + """, reg(lang, form, upos) AS (VALUES ('a', 'the', 'DET'), ('a', 'of', 'ADP'), ('b', 'and', 'CCONJ'), ('b', 'la', 'DET')),
t AS (SELECT row_index * 2 + side AS seq, token_index AS position, token, CASE side WHEN 0 THEN 'a' ELSE 'b' END AS lang, token_index % 7 <> 0 AS same FROM tokens),
u AS (SELECT *, CASE WHEN same AND position % 3 = 0 THEN 'NOUN' WHEN same AND position % 3 = 2 THEN 'VERB' ELSE 'X' END AS u, CASE WHEN same AND position % 5 = 0 THEN 'PER' ELSE 'O' END AS ner FROM t)
SELECT seq, position, token, CASE WHEN u = 'X' THEN coalesce(reg.upos, 'X') ELSE u END AS upos, ner, CASE WHEN same THEN lower(token) END AS lemma FROM u LEFT JOIN reg ON reg.lang = u.lang AND reg.form = lower(token)"""


@query(_TAGGED)
def classify_resolve(s, d):
    reg = s.createDataFrame(_FUNCTION_WORDS, "lang string, year int, form string, upos string")
    return adapters.resolve_tags(_tokens_to_tag(s, d), _tag_replies(s, d), reg).select("seq", "position", "token", "upos", "ner", "lemma")


@query("WITH " + _TAGGED.split("WITH RECURSIVE ", 1)[1].replace("SELECT seq, position, token,", ", r AS (SELECT u.lang, lower(token) AS form, seq, position,", 1).replace("AS upos, ner, CASE WHEN same THEN lower(token) END AS lemma", "AS upos", 1).replace("FROM t)\n, r AS", "FROM t),\nr AS") + "), n AS (SELECT lang, form, arg_max(upos, (seq, position)) AS upos FROM r WHERE upos IN ('DET', 'ADP', 'CCONJ') GROUP BY ALL) SELECT lang, 1500 AS year, form, coalesce(n.upos, reg.upos) AS upos FROM reg FULL JOIN n USING (lang, form)")
def registry_fill(s, d):
    """Function words found, added to the registry: one row a form, the last tag wins."""
    t = classify_resolve(s, d).withColumns({"lang": F.when(F.col("seq") % 2 == 0, "a").otherwise("b"), "year": F.lit(1500), "position": F.struct("seq", "position")})
    reg = s.createDataFrame(_FUNCTION_WORDS, "lang string, year int, form string, upos string")
    return catalog.grow_registry(reg, t, tags.CLOSED)


@query("""WITH g AS (SELECT vec_id AS gloss_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0), n AS (SELECT 'x.n.' || lpad(vec_id::VARCHAR, 9, '0') AS sense_id, label, embedding::DOUBLE[] AS e FROM embeddings)
SELECT gloss_id, sense_id, round(sim, 6) AS similarity FROM (SELECT gloss_id, sense_id, list_inner_product(g.e, n.e) AS sim, row_number() OVER (PARTITION BY gloss_id ORDER BY round(list_inner_product(g.e, n.e), 9) DESC, sense_id) AS r FROM g JOIN n USING (label)) WHERE r = 1""")
def sense_nearest(s, d):
    v = _vectors(s, d).select(F.col("vec_id").alias("id"), F.col("label").alias("pos"), F.col("embedding").alias("vector"))
    senses = v.select(F.concat(F.lit("x.n."), F.lpad(F.col("id").cast("string"), 9, "0")).alias("sense_id"), "pos", "vector")
    got = sense.nearest_sense(v.where("id % 20 = 0").withColumnRenamed("id", "gloss_id"), senses)
    return got.withColumn("similarity", r6("similarity"))


@query("SELECT stem, (max(n) + 1)::INT AS next FROM (SELECT lower(p_brand) || '.n' AS stem, p_partkey % 90 + 1 AS n FROM part) GROUP BY ALL")
def sense_mint_suffix(s, d):
    ids = table(s, d, "part").select(F.concat(F.lit("minted:"), F.lower("p_brand"), F.lit(".n."), F.lpad((F.col("p_partkey") % 90 + 1).cast("string"), 2, "0")).alias("sense_id"))
    return sense.next_suffix(ids)


@query()
def sense_mint(s, d):
    v = _vectors(s, d).select(F.col("vec_id").alias("gloss_id"), F.concat(F.lit("Lemma "), (F.col("vec_id") % 7).cast("string")).alias("lemma"), F.col("label").cast("string").alias("pos"), F.col("embedding").alias("vector"))
    minted = v.where("gloss_id % 50 = 0").select(F.concat(F.lit("minted:old."), "pos", F.lit("."), F.lpad(F.col("gloss_id").cast("string"), 4, "0")).alias("sense_id"), "pos", "vector")
    return sense.mint(v.where("gloss_id % 50 != 0"), minted, threshold=0.4)


@query()
def sense_resolve(s, d):
    """Glosses against an inventory and senses minted before: open classes by nearness, closed ones always anew."""
    tag = F.element_at(F.array(*map(F.lit, ("NOUN", "PROPN", "VERB", "ADJ", "DET", "adv"))), (F.col("vec_id") % 6 + 1).cast("int"))
    v = _vectors(s, d).select("vec_id", F.col("embedding").alias("vector"), tag.alias("upos"))
    glosses = v.where("vec_id % 10 != 1").select(F.col("vec_id").alias("gloss_id"), F.concat(F.lit("Lemma "), (F.col("vec_id") % 7).cast("string")).alias("lemma"), "upos", "vector")
    inventory = v.where("vec_id % 10 = 1").select(F.concat(F.lit("x.n."), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("sense_id"), sense.inventory_pos(F.col("upos")).alias("pos"), "vector")
    minted = v.where("vec_id % 100 = 0").select(F.concat(F.lit("minted:lemma_0.n."), F.lpad(F.col("vec_id").cast("string"), 4, "0")).alias("sense_id"), F.lit("NOUN").alias("upos"), "vector")
    return sense.resolve(glosses, inventory, minted, threshold=0.5)


@query("""WITH c AS (SELECT label, list(embedding::DOUBLE[]) AS e, count(*) AS n FROM embeddings GROUP BY ALL), p AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS k FROM embeddings),
m AS (SELECT label, k, avg(x) AS m FROM p GROUP BY ALL) SELECT vec_id, label, round(sum(x * m), 6) AS similarity FROM p JOIN m USING (label, k) GROUP BY ALL""")
def cosine_by_label(s, d):
    """Inner product of each vector with the mean of its label."""
    p = _vectors(s, d).select("vec_id", "label", F.posexplode("embedding").alias("k", "x"))
    m = p.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("mean"))
    return _vectors(s, d).join(m, "label").select("vec_id", "label", r6(scores.dot(F.col("embedding"), F.col("mean"))).alias("similarity"))


# --- evaluation -----------------------------------------------------------------------------------------------------------------


@query(f"""WITH {V['units']}, k AS (SELECT DISTINCT doc_id % 2 AS run, lower(trim(unit_text)) AS u FROM units), n AS (SELECT count(*) FILTER (run = 0) AS n_a, count(*) FILTER (run = 1) AS n_b FROM k), b AS (SELECT count(*) AS n FROM (SELECT u FROM k GROUP BY u HAVING count(*) = 2))
SELECT n_a, n_b, b.n AS "both", round(b.n / n_b, 6) AS precision, round(b.n / n_a, 6) AS recall FROM n, b""")
def cleaning_metrics(s, d):
    u = views.units(s, d).withColumn("u", F.lower(F.trim("unit_text")))
    return _rounded(evaluate.overlap(u.where("doc_id % 2 = 0"), u.where("doc_id % 2 = 1"), ["u"]), "precision", "recall")


@query(with_("pairs") + """, a AS (SELECT DISTINCT source_text, target_text FROM pairs WHERE row_index % 3 <> 0), b AS (SELECT DISTINCT source_text, target_text FROM pairs WHERE row_index % 3 <> 1), x AS (SELECT * FROM a INTERSECT SELECT * FROM b)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM x) AS "both", round((SELECT count(*) FROM x) / (SELECT count(*) FROM b), 6) AS precision, round((SELECT count(*) FROM x) / (SELECT count(*) FROM a), 6) AS recall""")
def alignment_metrics(s, d):
    p = views.pairs(s, d)
    return _rounded(evaluate.overlap(p.where("row_index % 3 != 0"), p.where("row_index % 3 != 1"), ["source_text", "target_text"]), "precision", "recall")


@query(with_("pairs") + """, a AS (SELECT lower(trim(regexp_replace(coalesce(source_text, ''), '\\s+', ' ', 'g'))) AS s, lower(trim(regexp_replace(coalesce(target_text, ''), '\\s+', ' ', 'g'))) AS t, length(source_text) AS sl, length(target_text) AS tl, row_index % 3 AS k FROM pairs),
x AS (SELECT DISTINCT s, t FROM a WHERE k <> 0), y AS (SELECT DISTINCT s, t FROM a WHERE k <> 1), p AS (SELECT count(*) AS n FROM (SELECT * FROM x INTERSECT SELECT * FROM y)), q AS (SELECT count(*) AS n FROM (SELECT s FROM x INTERSECT SELECT s FROM y)),
z AS (SELECT count(*) FILTER (k <> 0) AS na, count(*) FILTER (k <> 1) AS nb, sum(sl) FILTER (k <> 0) AS sa, sum(sl) FILTER (k <> 1) AS sb, sum(tl) FILTER (k <> 0) AS ta, sum(tl) FILTER (k <> 1) AS tb, sum(sl) AS s, sum(tl) AS t FROM a)
SELECT na AS pairs_a, nb AS pairs_b, p.n AS pair_overlap, round(p.n / (SELECT count(*) FROM y), 6) AS pair_precision, round(p.n / (SELECT count(*) FROM x), 6) AS pair_recall, q.n AS source_overlap, round(q.n / (SELECT count(DISTINCT s) FROM y), 6) AS source_precision, round(q.n / (SELECT count(DISTINCT s) FROM x), 6) AS source_recall,
round(sa / s, 6) AS source_coverage_a, round(sb / s, 6) AS source_coverage_b, round(ta / t, 6) AS target_coverage_a, round(tb / t, 6) AS target_coverage_b, round(1 - na / 100000.0, 6) AS drop_rate_a, NULL::DOUBLE AS drop_rate_b FROM z, p, q""")
def alignment_comparison(s, d):
    """Two runs over the same units: overlap of pairs and of source texts, coverage, drop rates."""
    p = views.pairs(s, d)
    units = lambda c: p.select(F.col(c).alias("unit_text"))
    x = evaluate.compare_alignment(p.where("row_index % 3 != 0"), p.where("row_index % 3 != 1"), units("source_text"), units("target_text"), (100_000, None))
    return _rounded(x, *(c for c, t in x.dtypes if t == "double"))


@query("SELECT event_type AS stage, count(*) AS calls, sum(event_id % 100)::BIGINT AS prompt_tokens, coalesce(sum(CASE WHEN event_id % 7 <> 0 THEN event_id % 10 END), 0)::BIGINT AS completion_tokens, (sum(event_id % 100) + coalesce(sum(CASE WHEN event_id % 7 <> 0 THEN event_id % 10 END), 0))::BIGINT AS total_tokens, round(sum(value), 4) AS cost_usd FROM events GROUP BY ALL")
def usage_totals(s, d):
    i = F.col("event_id")
    calls = table(s, d, "events").select(F.col("event_type").alias("stage"), (i % 100).alias("prompt_tokens"), F.when(i % 7 != 0, i % 10).alias("completion_tokens"), F.col("value").alias("cost_usd"))
    return evaluate.usage_totals(calls, "stage").withColumn("cost_usd", F.round("cost_usd", 4))


@query(with_("pairs") + " SELECT p.used, u.there, round(p.used / u.there, 6) AS coverage FROM (SELECT sum(length(source_text))::BIGINT AS used FROM pairs) p, (SELECT sum(length(text))::BIGINT AS there FROM conversations) u")
def coverage_ratio(s, d):
    return _rounded(evaluate.coverage(views.pairs(s, d), table(s, d, "conversations"), "source_text", "text"), "coverage")


@query(with_("linked") + " SELECT ['embedding', 'lexical', 'llm', 'unknown'][row_index % 4 + 1] AS method, count(*) AS n_pairs, round(avg(CASE WHEN row_index % 5 = 0 THEN 0.0 ELSE (row_index % 100) / 100.0 END), 6) AS mean_confidence, round(avg(len(links)), 6) AS mean_links FROM linked GROUP BY ALL")
def method_split(s, d):
    i = F.col("row_index")
    p = views.linked(s, d).select(F.element_at(F.array(F.lit("embedding:m"), F.lit("lexical:trigram-dice"), F.lit("llm:x"), F.lit(None)), (i % 4 + 1).cast("int")).alias("sentence_method"), F.when(i % 5 != 0, (i % 100) / 100.0).alias("sentence_confidence"), F.size("links").alias("n_links"))
    return _rounded(evaluate.confidence_stats(p), "mean_confidence", "mean_links")


@query("""WITH s AS (SELECT lang, quality = 1 AS positive, CASE WHEN n_chars % 10 <> 0 THEN n_chars::DOUBLE / (n_chars + 1000) END AS score FROM documents JOIN labels USING (doc_id)),
m AS (SELECT lang, min(score) FILTER (positive) AS positive_min, max(score) FILTER (NOT positive) AS negative_max, count(*) FILTER ((positive AND score >= 0.5) OR (NOT positive AND score < 0.5)) AS ok, count(score) AS n, count(*) FILTER (score IS NULL) AS missing FROM s GROUP BY ALL)
SELECT lang, round(positive_min, 6) AS positive_min, round(negative_max, 6) AS negative_max, positive_min > negative_max AS cleanly_separated, round(CASE WHEN n > 0 THEN ok / n ELSE 0.0 END, 6) AS accuracy, missing FROM m""")
def separation_metrics(s, d):
    x = table(s, d, "documents").select("doc_id", "lang", "n_chars").join(table(s, d, "labels"), "doc_id")
    x = x.select("lang", (F.col("quality") == 1).alias("positive"), F.when(F.col("n_chars") % 10 != 0, F.col("n_chars").cast("double") / (F.col("n_chars") + 1000)).alias("score"))
    return _rounded(evaluate.separation(x, "lang"), "positive_min", "negative_max", "accuracy")


@query("""WITH r AS (SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events) SELECT event_id, k, k IS NOT NULL AS approved FROM r""")
def reply_parse(s, d):
    """JSON replies as models write them: fenced, one object for a list of one."""
    e = table(s, d, "events")
    reply = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return e.select("event_id", text.parse_reply(reply, "array<struct<k:bigint>>").alias("x")).select("event_id", F.get("x", F.lit(0))["k"].alias("k"), text.approved(F.get("x", F.lit(0))["k"].isNotNull()).alias("approved"))


@query("""WITH t AS (SELECT row_index, regexp_extract_all(coalesce(source_text, ''), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]') AS t FROM (SELECT u.conv_id * 4096 + u.turn AS row_index, u.text AS source_text FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'))
SELECT row_index, list_filter(range(0, len(t) - 1), lambda i: lower(t[i + 1]) = lower(t[4]) AND lower(t[i + 2]) = lower(t[5]))[1]::INT AS first_index FROM t""")
def find_span(s, d):
    p = views.pairs(s, d).select("row_index", text.tokenize(F.col("source_text")).alias("t"))
    return p.select("row_index", F.get(text.find_span(F.col("t"), F.slice("t", 4, 2)), F.lit(0)).alias("first_index"))


# --- streaming ---------------------------------------------------------------------------------------------------------------------


@query(with_("terms") + " SELECT * FROM terms")
def stream_incremental_postings(s, d):
    """The term postings, built by a file stream in several batches: the same rows as in one batch."""
    from ..streaming.incremental import index_stream

    root = f"{corpus_files.shared_folder(s)}/stream-{uuid.uuid4().hex}"
    views.pairs(s, d).select("row_index", "source_text", "target_text").repartition(4).write.json(f"{root}/in")
    q = index_stream(s, f"{root}/in", f"{root}/out", f"{root}/state", files_per_batch=1)
    q.awaitTermination()
    got = s.read.option("basePath", f"{root}/out/terms").parquet(f"{root}/out/terms")
    return got.select("term", "row_index", "side", "term_frequency")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(s, d):
    from ..streaming.incremental import late_windows

    return late_windows(table(s, d, "events")).withColumn("total", F.round("total", 4))



