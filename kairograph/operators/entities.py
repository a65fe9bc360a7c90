"""Entity mentions and entities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.functions.ids import content_hash_id, no_cui_id

MIN_LENGTH, MAX_LENGTH, LINK_THRESHOLD, ALIASES = 2, 100, 0.7, 10
DEFAULT_TYPE = "unknown"
#: The entity type of each semantic type identifier.
SEMANTIC_TYPES = {
    "T001": "organism", "T002": "organism", "T004": "organism", "T005": "organism", "T007": "organism", "T008": "organism", "T010": "organism",
    "T011": "organism", "T012": "organism", "T013": "organism", "T014": "organism", "T015": "organism", "T016": "organism",
    "T017": "anatomical_structure", "T018": "anatomical_structure", "T019": "disease", "T020": "disease", "T021": "anatomical_structure",
    "T022": "anatomical_structure", "T023": "anatomical_structure", "T024": "anatomical_structure", "T025": "cell_type", "T026": "cell_type",
    "T028": "gene", "T029": "anatomical_structure", "T030": "anatomical_structure", "T033": "disease", "T037": "disease", "T038": "pathway",
    "T039": "pathway", "T040": "pathway", "T041": "pathway", "T042": "pathway", "T043": "pathway", "T044": "pathway", "T045": "pathway",
    "T046": "disease", "T047": "disease", "T048": "disease", "T049": "disease", "T085": "gene", "T086": "gene", "T087": "protein",
    "T088": "gene", "T114": "gene", "T116": "protein", "T118": "drug", "T119": "drug", "T120": "drug", "T121": "drug", "T122": "drug",
    "T123": "drug", "T124": "drug", "T125": "drug", "T126": "drug", "T127": "drug", "T129": "drug", "T130": "drug", "T131": "drug",
    "T184": "disease", "T190": "disease", "T191": "disease", "T195": "drug", "T196": "drug", "T197": "drug", "T200": "drug",
}
#: Parts of names that suggest a type.
DRUG_PARTS, DISEASE_PARTS = ("mab", "nib", "vir", "ine", "cin"), ("cancer", "tumor", "syndrome", "disease", "disorder")


#: First words of names up to which their index is broadcast (some 100 bytes each); beyond it Spark's own joins are used.
BROADCAST_FIRST_WORDS = 200_000


def match_gazetteer(texts: DataFrame, gazetteer: DataFrame, key: str = "doc_id", text: str = "text", max_words: int = 3, most: int = BROADCAST_FIRST_WORDS) -> DataFrame:
    """(key, start, mention, canonical_id, label) where runs of up to ``max_words`` words, without case, are names in (name, canonical_id, label).

    Words with their places meet an index of the names' first words, which has the lengths of the names that start so; only
    where a name may start are runs made, of these lengths, and meet the names in an equi-join. A text of many words is so
    many narrow rows, and runs are no more than the places of first words times the lengths there.
    """
    names = gazetteer.withColumn("_norm", F.lower("name")).drop("name")
    parts = F.split("_norm", " ")
    index = names.select(parts[0].alias("_first"), F.size(parts).alias("_n")).filter(F.col("_n") <= max_words).groupBy("_first").agg(F.collect_set("_n").alias("_lengths"))
    if index.count() <= most:
        index = F.broadcast(index)
    words = F.regexp_extract_all(F.col(text), F.lit(r"(?U)\w+"), F.lit(0))
    placed = texts.select(key, words.alias("_words"))
    runs = F.transform("_words", lambda w, i: F.struct(F.lower(w).alias("first"), F.slice("_words", i + 1, max_words).alias("run")))
    placed = placed.select(key, F.posexplode(runs).alias("start", "_w")).select(key, "start", F.col("_w.first").alias("_first"), F.col("_w.run").alias("_run"))
    found = placed.join(index, "_first").select(key, "start", "_run", F.explode("_lengths").alias("_n")).filter(F.size("_run") >= F.col("_n"))
    found = found.select(key, "start", F.array_join(F.slice("_run", F.lit(1), F.col("_n")), " ").alias("mention"))
    return found.withColumn("_norm", F.lower("mention")).join(names, "_norm").drop("_norm")


def extract_with(texts: DataFrame, model: Callable[[], Callable[[list[str]], list[list[tuple]]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """N1 with a model: ``model()`` is made once per task and returns (start, end, label, score) tuples for each text."""
    kind = texts.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = model()
        for f in frames:
            bodies = f["text"].fillna("").tolist()
            rows = [(k, t[s:e], s, e, label, score) for k, t, found in zip(f["key"], bodies, tag(bodies)) for s, e, label, score in found]
            yield pd.DataFrame(rows, columns=["key", "mention", "start", "end", "label", "confidence"])

    return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, mention string, start int, end int, label string, confidence double").withColumnRenamed("key", key)


def length_filter(mentions: DataFrame, text: str = "mention", least: int = MIN_LENGTH, most: int = MAX_LENGTH) -> DataFrame:
    """N2"""
    return mentions.filter(F.length(text).between(least, most))


def link(mentions: DataFrame, candidates: DataFrame, knowledge: DataFrame, threshold: float = LINK_THRESHOLD) -> DataFrame:
    """Mentions (mention_id, …) with their best candidate (mention_id, concept_id, score) if its score suffices, and that concept's
    name, types, first aliases and definition. One grouped aggregate picks the best; ties go to the smaller id."""
    best = candidates.groupBy("mention_id").agg(F.min_by(F.struct("concept_id", "score"), F.struct(-F.col("score"), F.col("concept_id"))).alias("b"))
    linked = mentions.join(best.filter(F.col("b.score") >= threshold).select("mention_id", "b.*"), "mention_id", "left")
    known = knowledge.select(F.col("concept_id"), "canonical_name", "semantic_types", F.slice("aliases", 1, ALIASES).alias("aliases"), "definition")
    return linked.join(known, "concept_id", "left")


def entity_type(types: Column | str, text: Column | str) -> Column:
    """The type of the first known semantic type, else by parts of the name, else by capitals, else the default."""
    t = F.col(types) if isinstance(types, str) else types
    name = F.col(text) if isinstance(text, str) else text
    known = F.create_map(*(F.lit(x) for pair in SEMANTIC_TYPES.items() for x in pair))
    mapped = F.get(F.filter(F.transform(F.coalesce(t, F.array().cast("array<string>")), lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull()), F.lit(0))
    has = lambda parts: F.lower(name).rlike("|".join(parts))
    return F.coalesce(mapped, F.when(has(DRUG_PARTS), "drug").when(name.rlike("^[A-Z0-9]{2,10}$"), "gene").when(has(DISEASE_PARTS), "disease").otherwise(DEFAULT_TYPE))


def first_mentions(mentions: DataFrame, paper: str = "pmcid", order: tuple[str, ...] = ("section_ord", "start")) -> DataFrame:
    """The first mention of each entity in each paper."""
    rest = [c for c in mentions.columns if c not in (paper, "canonical_id")]
    first = mentions.groupBy(paper, "canonical_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("m"))
    return first.select(paper, "canonical_id", "m.*")


def statistics(mentions: DataFrame) -> DataFrame:
    """By type and over all (type null): mentions, linked ones, those with a content-hash id, linked share, mean confidence."""
    linked = F.col("canonical_id").isNotNull() & ~F.col("canonical_id").startswith("HASH:")
    return mentions.rollup("entity_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(linked).alias("linked"), F.count_if(F.col("canonical_id").startswith("HASH:")).alias("hashed"),
        F.avg(F.coalesce(linked, F.lit(False)).cast("double")).alias("linked_ratio"), F.avg("confidence").alias("mean_confidence"),
    )


def upsert(existing: DataFrame, incoming: DataFrame, order: str = "seq") -> DataFrame:
    """(canonical_id, label, entity_type): new ids are added, non-empty incoming values overwrite, the latest by ``order`` (numbers) last."""
    both = existing.select("canonical_id", "label", "entity_type", F.lit(float("-inf")).alias("_seq")).unionAll(incoming.select("canonical_id", "label", "entity_type", F.col(order).cast("double")))
    latest = lambda c: F.max_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("_seq", c))).alias(c)
    return both.groupBy("canonical_id").agg(latest("label"), latest("entity_type"))


def upsert_max_confidence(rows: DataFrame, key: str = "cui", order: str = "seq") -> DataFrame:
    """The first row of each id, with the greatest confidence of all."""
    rest = [c for c in rows.columns if c not in (key, "confidence")]
    merged = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(order, *rest)).alias("m"), F.max("confidence").alias("confidence"))
    return merged.select(key, "m.*", "confidence")


def lookup(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """The entities of a table of canonical ids, null where unknown."""
    return ids.select("canonical_id").distinct().join(entities, "canonical_id", "left")


def to_entities(mentions: DataFrame) -> DataFrame:
    """Mentions as entity rows; those without an id are dropped."""
    return mentions.filter("canonical_id is not null").select(
        "canonical_id", F.coalesce("canonical_name", "mention").alias("label"), F.coalesce("entity_type", F.lit("Unknown")).alias("entity_type"), F.coalesce("source_ontology", F.lit("UMLS")).alias("source_ontology")
    )


def with_fallback_ids(mentions: DataFrame, text: str = "mention", label: str = "label", scheme: str = "hash") -> DataFrame:
    """Mentions without an id get one from their content."""
    made = content_hash_id(text) if scheme == "hash" else no_cui_id(text, label)
    return mentions.withColumn("canonical_id", F.coalesce("canonical_id", made))


def in_order(mentions: DataFrame, paper: str = "pmcid") -> DataFrame:
    """Mentions numbered within their paper."""
    return mentions.withColumn("mention_ord", F.row_number().over(Window.partitionBy(paper).orderBy("section_ord", "start")))
