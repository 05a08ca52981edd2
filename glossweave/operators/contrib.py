"""Community contributions: the rules of their schema, and rows of the attestation table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the schema of contributions allows.
DOC_TYPES = ["dictionary_entry", "grammar_note", "attestation"]
TOKEN_CLASSES = ["name", "common", "anachronism"]
PRECISIONS = ["exact", "circa", "range"]
STATUSES = ["pending", "proofread", "validated", "rejected"]
#: The properties that each object can have, by its path.
PROPERTIES = {
    "$": ["doc_type", "origin", "target", "metadata"],
    "$.origin": ["lang_code", "text", "tokens"],
    "$.target": ["lang_code", "text"],
    "$.metadata": ["date", "location", "source", "author", "contributor", "license", "validation"],
    "$.metadata.date": ["year", "precision"],
    "$.metadata.validation": ["status"],
}
TOKEN_PROPERTIES = ["surface", "alt", "class", "gap"]
SCHEMA = """doc_type string, origin struct<lang_code:string,text:string,tokens:array<struct<surface:string,alt:array<string>,class:string,gap:boolean>>>,
target struct<lang_code:string,text:string>, metadata struct<date:struct<year:int,precision:string>,location:string,source:string,author:string,contributor:string,license:string,validation:struct<status:string>>"""
_TOKENS = "array<struct<surface:string,alt:array<string>,class:string,gap:boolean>>"


def read_json(rows: DataFrame, json: str) -> DataFrame:
    """Contributions from a column of JSON texts: their fields, `extra` (paths of properties that the schema doesn't know) and `no_target`
    (the key itself is absent, where null is allowed). A text that is no JSON object has null fields and breaks the rules."""
    text = F.col(json)
    # parsed as a generated row: what uses its fields doesn't parse again
    parsed = rows.select("*", F.inline(F.array(F.from_json(text, SCHEMA))))

    def others(path: str, keys: Column, names: list[str]) -> Column:
        return F.transform(F.array_except(keys, F.array(*map(F.lit, names))), lambda k: F.concat(F.lit(path + "."), k))

    none = F.array().cast("array<string>")
    unknown = [others(path, F.coalesce(F.json_object_keys(text if path == "$" else F.get_json_object(text, path)), none), names) for path, names in PROPERTIES.items()]
    token_keys = F.flatten(F.transform(F.coalesce(F.from_json(F.get_json_object(text, "$.origin.tokens"), "array<map<string,string>>"), F.array().cast("array<map<string,string>>")), F.map_keys))
    unknown.append(others("$.origin.tokens", token_keys, TOKEN_PROPERTIES))
    return parsed.withColumns({"extra": F.concat(*unknown), "no_target": ~F.coalesce(F.array_contains(F.json_object_keys(text), "target"), F.lit(False))})


def _in(value: Column, allowed: list[str]) -> Column:
    return F.coalesce(value.isin(allowed), F.lit(False))


def rules(columns: list[str]) -> dict[str, Column]:
    """Each rule's name, and the condition that breaks it."""
    origin, target, meta = F.col("origin"), F.col("target"), F.col("metadata")
    note = F.coalesce(F.col("doc_type") == "grammar_note", F.lit(False))
    classes = F.transform(F.coalesce(origin["tokens"], F.array().cast(_TOKENS)), lambda t: t["class"])
    found = {
        "doc_type": ~_in(F.col("doc_type"), DOC_TYPES),
        "origin": origin["lang_code"].isNull(),
        "tokens_or_text": origin["tokens"].isNull() == origin["text"].isNull(),
        "token_class": F.exists(classes, lambda c: c.isNotNull() & ~c.isin(TOKEN_CLASSES)),
        "target": target.isNotNull() & (target["lang_code"].isNull() | target["text"].isNull()),
        "grammar_note_text": note & origin["text"].isNull(),
        "grammar_note_target": note & target.isNotNull(),
        "year": meta["date"]["year"].isNull(),
        "precision": meta["date"]["precision"].isNotNull() & ~_in(meta["date"]["precision"], PRECISIONS),
        "source": meta["source"].isNull(),
        "contributor": meta["contributor"].isNull(),
        "license": meta["license"].isNull(),
        "status": ~_in(meta["validation"]["status"], STATUSES),
    }
    found = {k: F.coalesce(v, F.lit(True)) for k, v in found.items()}
    if "no_target" in columns:
        found["no_target"] = F.col("no_target")
    if "extra" in columns:
        found["extra"] = F.size("extra") > 0
    return found


def violations(docs: DataFrame) -> DataFrame:
    """docs with an array of the rules that each breaks."""
    return docs.withColumn("violations", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules(docs.columns).items()))))


def require_valid(docs: DataFrame) -> DataFrame:
    """The same rows; the job fails at the first that breaks a rule."""
    checked = violations(docs)
    return checked.where(F.when(F.size("violations") > 0, F.raise_error(F.concat(F.lit("invalid contribution: "), F.array_join("violations", ", "))).cast("boolean")).otherwise(F.lit(True))).drop("violations")


def content_tags(tags: DataFrame) -> DataFrame:
    """A form's tag among those of its tokens (iso_code, form, position, lemma, upos, ner[, sense_id]): the first that is neither
    punctuation nor unknown, else the first."""
    tags = tags if "sense_id" in tags.columns else tags.withColumn("sense_id", F.lit(None).cast("string"))
    order = F.struct(F.col("upos").isin("PUNCT", "X"), F.col("position"))
    return tags.groupBy("iso_code", "form").agg(F.min_by(F.struct("lemma", "upos", "ner", "sense_id"), order).alias("t")).select("iso_code", "form", "t.*")


def relational_rows(docs: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Attestation rows of validated contributions; no row for grammar notes, for no target and for no form.

    A name is its own lemma. tags: a tagger's table as content_tags takes it; a form that is not in it is its own lemma and has no class.
    """
    tokens = F.coalesce("origin.tokens", F.array().cast(_TOKENS))
    kept = F.filter(tokens, lambda t: ~F.coalesce(t["gap"], F.lit(False)) & (F.coalesce(t["surface"], F.lit("")) != ""))
    form = F.array_join(F.transform(kept, lambda t: t["surface"]), " ")
    name = F.exists(tokens, lambda t: F.coalesce(t["class"] == "name", F.lit(False)))
    d = docs.where("metadata.validation.status = 'validated' AND doc_type != 'grammar_note' AND target IS NOT NULL")
    d = d.select(F.col("origin.lang_code").alias("iso_code"), form.alias("form"), name.alias("is_name"), F.col("metadata.date.year").alias("attestation_year"), F.col("metadata.source").alias("source"), "doc_type").where("form != ''")
    if tags is None:
        d = d.withColumns({c: F.lit(None).cast("string") for c in ("t_lemma", "t_ner", "t_sense")})
    else:
        t = content_tags(tags).select("iso_code", "form", F.nullif("lemma", F.lit("")).alias("t_lemma"), F.col("ner").alias("t_ner"), F.col("sense_id").alias("t_sense"))
        d = d.join(t, ["iso_code", "form"], "left")
    none = F.lit(None).cast("string")
    return d.select(
        "iso_code", "form", F.when(F.col("is_name"), F.col("form")).otherwise(F.coalesce("t_lemma", "form")).alias("lemma"),
        F.when(F.col("is_name"), F.concat(F.lit("name:"), F.col("form"))).otherwise(F.col("t_sense")).alias("sense_id"), "attestation_year", "source", "doc_type",
        none.alias("donor_language"), F.lit(None).cast("int").alias("first_borrowing_year"), none.alias("register"), none.alias("dialect"),
        F.when(F.col("is_name"), "PER").otherwise(F.coalesce("t_ner", F.lit("O"))).alias("ner"),
    )


def year_ranges(rows: DataFrame) -> DataFrame:
    """(iso_code, year_from, year_to, n_rows): what the folders of the relational index are named after."""
    return rows.groupBy("iso_code").agg(F.min("attestation_year").alias("year_from"), F.max("attestation_year").alias("year_to"), F.count("*").alias("n_rows"))


def write_relational(rows: DataFrame, path: str) -> None:
    """By language and its range of years, as partition columns; sorted by year within, so that a year's rows are few row groups. No rows, no folder."""
    ranged = rows.where("iso_code IS NOT NULL").join(year_ranges(rows).drop("n_rows"), "iso_code")
    ranged.repartitionByRange("iso_code", "attestation_year").sortWithinPartitions("iso_code", "attestation_year").write.mode("overwrite").partitionBy("iso_code", "year_from", "year_to").parquet(path)


def build_relational_index(contributions: DataFrame, path: str, json: str = "json", tags: DataFrame | None = None) -> DataFrame:
    """Validate all contributions (the job fails at one that breaks a rule), and write the rows of the validated ones. Returns the ranges written."""
    rows = relational_rows(require_valid(read_json(contributions, json)), tags)
    write_relational(rows, path)
    return year_ranges(rows)
