"""Senses: the nearest of the same part of speech, else a new one."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import P
from ..functions.text import word_slug
from .catalog import get_or_compute

#: Parts of speech that an inventory of senses knows, by universal tag; others are closed classes.
INVENTORY_POS = {"NOUN": "n", "PROPN": "n", "VERB": "v", "ADJ": "a", "ADV": "r"}
#: Bytes of sense vectors that a broadcast holds; a larger inventory is broadcast in blocks, by a count beforehand.
BLOCK_BYTES = 128 << 20


def inventory_pos(upos: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in INVENTORY_POS.items() for x in kv))
    return F.try_element_at(table, F.upper(upos))


def nearest_sense(glosses: DataFrame, senses: DataFrame) -> DataFrame:
    """(gloss_id, sense_id, similarity): the best sense of the gloss's part of speech, the least id on ties.

    glosses (gloss_id, pos, vector), senses (sense_id, pos, vector), ids of any type that has an order. Blocks of senses are broadcast as matrices and glosses
    stream past each; a task keeps one best a gloss and block. Rows without a vector or part of speech have no match; an empty table gives no rows.
    """
    spark = glosses.sparkSession
    s = senses.where("vector IS NOT NULL AND pos IS NOT NULL").select("sense_id", "pos", "vector")
    g = glosses.where("vector IS NOT NULL AND pos IS NOT NULL").select("gloss_id", "pos", "vector")
    kinds = g.schema["gloss_id"].dataType, s.schema["sense_id"].dataType
    schema = f"gloss_id {kinds[0].simpleString()}, sense_id {kinds[1].simpleString()}, similarity double"
    size = s.agg(F.sum(F.size("vector") * 8 + 64)).first()[0] or 0
    if not size:
        return spark.createDataFrame([], schema)
    blocks = -(-size // BLOCK_BYTES)

    def best_of(block: int) -> DataFrame:
        by_pos: dict = {}
        rows = s.where(F.pmod(F.xxhash64("sense_id", "pos"), F.lit(blocks)) == block).toArrow().sort_by("sense_id")
        for pos in set(rows["pos"].to_pylist()):
            own = rows.filter(pa.compute.equal(rows["pos"], pos))
            by_pos[pos] = own["sense_id"].combine_chunks(), np.array(own["vector"].to_pylist(), np.float64)
        sent = spark.sparkContext.broadcast(by_pos)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pos = np.array(batch["pos"].to_pylist(), object)
                for p in set(pos.tolist()) & sent.value.keys():
                    ids, matrix = sent.value[p]
                    at = np.flatnonzero(pos == p)
                    x = np.array(batch["vector"].take(pa.array(at)).to_pylist(), np.float64) @ matrix.T
                    top = x.argmax(axis=1)  # the first of equal ones, and ids are sorted
                    yield pa.RecordBatch.from_arrays([batch["gloss_id"].take(pa.array(at)), ids.take(pa.array(top)), pa.array(x[np.arange(len(at)), top])], ["gloss_id", "sense_id", "similarity"])

        return g.mapInArrow(run, schema)

    found = best_of(0)
    for b in range(1, blocks):
        found = found.unionByName(best_of(b))
    return found if blocks == 1 else found.groupBy("gloss_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "sense_id")).alias("b")).select("gloss_id", "b.sense_id", (-F.col("b.s")).alias("similarity"))


def next_suffix(minted: DataFrame) -> DataFrame:
    """(stem, next): one more than the greatest number of the minted ids `ns:stem.pos.NN`."""
    key = F.regexp_extract("sense_id", r"^[^:]+:(.*)\.[0-9]+$", 1)
    number = F.regexp_extract("sense_id", r"\.([0-9]+)$", 1).try_cast("int")
    return minted.where(key != "").groupBy(key.alias("stem")).agg((F.max(number) + 1).alias("next"))


class Minted:
    """The senses minted so far of one part of speech, in a matrix that grows."""

    def __init__(self, old: list[tuple[str, np.ndarray | None]], namespace: str) -> None:
        known = [(i, v) for i, v in old if v is not None]
        self.ids, self.namespace, self.n = [i for i, _ in known], namespace, len(known)
        self.matrix = np.array([v for _, v in known], np.float64) if known else np.zeros((0, 0))
        self.last: dict[str, int] = {}
        for i, _ in old:
            stem, _, n = i.partition(":")[2].rpartition(".")
            if n.isdigit():
                self.last[stem] = max(self.last.get(stem, 0), int(n))

    def nearest(self, v: np.ndarray) -> tuple[float, str | None]:
        if not self.n:
            return -np.inf, None
        s = self.matrix[: self.n] @ v
        k = int(s.argmax())
        return float(s[k]), self.ids[k]

    def mint(self, stem: str, v: np.ndarray | None) -> str:
        self.last[stem] = self.last.get(stem, 0) + 1
        new = f"{self.namespace}:{stem}.{self.last[stem]:02d}"
        if v is not None:
            if self.n == len(self.matrix):
                grown = np.zeros((max(64, 2 * self.n), len(v)))
                if self.n:
                    grown[: self.n] = self.matrix[: self.n]
                self.matrix = grown
            self.matrix[self.n] = v
            self.n += 1
            self.ids.append(new)
        return new


def mint(glosses: DataFrame, minted: DataFrame, threshold: float = P.sense_threshold, namespace: str = "minted") -> DataFrame:
    """(gloss_id, sense_id, is_new): in order of gloss_id, a gloss takes the nearest sense minted so far, or mints one.

    glosses (gloss_id, lemma, pos, vector[, reach]) that no inventory matched, minted (sense_id, pos, vector). A sense below the threshold, or not above `reach` (the
    similarity of another match), isn't taken; where `reach` reaches the threshold, a gloss that takes none has no row. A gloss without a vector mints. Sequential within a part of speech by its nature, as a later gloss can reuse an
    earlier one's sense: a task holds the vectors of one part of speech's minted senses, and streams its glosses, sorted by Spark.
    """
    kind = glosses.schema["gloss_id"].dataType.simpleString()
    none = F.lit(None)
    reach = F.col("reach").cast("double") if "reach" in glosses.columns else none.cast("double")
    a = glosses.select(F.lit(1).alias("kind"), F.col("gloss_id").alias("id"), F.concat_ws(".", word_slug(F.coalesce("lemma", F.lit("unknown")), "sense"), "pos").alias("name"), "pos", F.col("vector").cast("array<double>").alias("vector"), reach.alias("reach"))
    b = minted.select(F.lit(0).alias("kind"), none.cast(kind).alias("id"), F.col("sense_id").alias("name"), "pos", F.col("vector").cast("array<double>").alias("vector"), none.cast("double").alias("reach"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by part of speech, those minted before first
        now, state, old = object(), None, []
        for batch in batches:
            out = []
            for is_gloss, gloss, name, pos, vector, reach in zip(*(batch[c].to_pylist() for c in ("kind", "id", "name", "pos", "vector", "reach")), strict=True):
                if pos != now:
                    now, state, old = pos, None, []
                v = None if vector is None else np.asarray(vector, float)
                if not is_gloss:
                    old.append((name, v))
                    continue
                if state is None:
                    state = Minted(old, namespace)
                best, taken = (-np.inf, None) if v is None else state.nearest(v)
                if taken is not None and best >= threshold and (reach is None or best > reach):
                    out.append((gloss, taken, False))
                elif reach is None or reach < threshold:
                    out.append((gloss, state.mint(name, v), True))
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch["id"].type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_())], ["gloss_id", "sense_id", "is_new"])

    both = a.unionByName(b).where("pos IS NOT NULL")
    return both.repartition("pos").sortWithinPartitions("pos", "kind", "id", F.when(F.col("kind") == 0, F.col("name"))).mapInArrow(run, f"gloss_id {kind}, sense_id string, is_new boolean")


def resolve(glosses: DataFrame, inventory: DataFrame, minted: DataFrame, threshold: float = P.sense_threshold, namespace: str = "minted", inventory_namespace: str = "en") -> DataFrame:
    """(gloss_id, sense_id, origin): the sense of each gloss (gloss_id, lemma, upos, vector).

    Open classes: the nearest sense of the inventory (sense_id, pos, vector) with the same part of speech or of those minted (sense_id, upos, vector) with the same
    tag, in order of gloss_id also of those minted here, if it reaches the threshold; of equals the inventory's. Else, and always for closed classes, a new one.
    origin: inventory, minted, new. Closed classes share the part of speech `x` and nothing takes their senses again.
    """
    g = glosses.select("gloss_id", "lemma", F.upper("upos").alias("upos"), inventory_pos(F.col("upos")).alias("wn"), "vector")
    known = nearest_sense(g.select("gloss_id", F.col("wn").alias("pos"), "vector"), inventory).withColumnsRenamed({"sense_id": "known", "similarity": "reach"})
    g = g.join(known, "gloss_id", "left").withColumn("close", F.col("reach") >= threshold)
    # a tag's minted senses are its own; numbers go by stem and inventory part of speech, so tags that share one are numbered together
    slug = lambda pos: F.concat_ws(".", word_slug(F.coalesce("lemma", F.lit("unknown")), "sense"), pos)
    open_ = g.where("wn IS NOT NULL").select("gloss_id", "lemma", F.col("upos").alias("pos"), "vector", F.when(F.col("close"), F.col("reach")).alias("reach"))
    tagged = minted.select("sense_id", F.upper("upos").alias("pos"), "vector")
    made = mint(open_, tagged, threshold, namespace).withColumnRenamed("sense_id", "taken")
    x = g.where("wn IS NOT NULL").join(made, "gloss_id", "left")
    new = x.where("is_new").select("gloss_id", slug(F.col("wn")).alias("stem"), F.col("taken").alias("group"))
    closed = g.where("wn IS NULL").select("gloss_id", slug(F.lit("x")).alias("stem"), F.lit(None).cast("string").alias("group"))
    named = _numbered(new.unionByName(closed), minted, namespace)
    # senses minted here were told by their tag's number; what took one follows to its final name
    final = named.where("group IS NOT NULL").select(F.col("group").alias("taken"), F.col("sense_id").alias("final"))
    reused = x.where("NOT is_new").select("gloss_id", "taken").join(final, "taken", "left").select("gloss_id", F.coalesce("final", "taken").alias("sense_id"), F.lit("minted").alias("origin"))
    own = x.where("is_new IS NULL").select("gloss_id", F.concat(F.lit(f"{inventory_namespace}:"), F.col("known").cast("string")).alias("sense_id"), F.lit("inventory").alias("origin"))
    return own.unionByName(reused).unionByName(named.select("gloss_id", "sense_id", F.lit("new").alias("origin")))


def _numbered(new: DataFrame, minted: DataFrame, namespace: str) -> DataFrame:
    """New senses numbered within their stem, in order of gloss_id, after those minted before."""
    from pyspark.sql import Window

    start = next_suffix(minted.where(F.startswith("sense_id", F.lit(f"{namespace}:")))).withColumnRenamed("next", "start")
    n = new.join(start, "stem", "left").withColumn("n", F.row_number().over(Window.partitionBy("stem").orderBy("gloss_id")) - 1 + F.coalesce("start", F.lit(1)))
    return n.select("gloss_id", "group", F.concat(F.lit(f"{namespace}:"), "stem", F.lit("."), F.lpad(F.col("n").cast("string"), F.greatest(F.length(F.col("n").cast("string")), F.lit(2)), F.lit("0"))).alias("sense_id"))


def build_inventory(definitions: DataFrame, path: str, embed: Callable[[Column], Column], model: str) -> DataFrame:
    """(sense_id, pos, definition, vector): the stored vectors of an inventory's definitions (sense_id, pos, definition) by one model. A build that was interrupted goes on with
    the senses that are not stored yet; another model's vectors don't count."""
    schema = "sense_id string, pos string, definition string, vector array<float>"
    make = lambda left: left.withColumn("vector", embed(F.col("definition")))
    return get_or_compute(definitions.select("sense_id", "pos", "definition"), path, model, "sense_id", make, schema)
