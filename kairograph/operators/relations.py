"""Relations from model responses to facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.functions.ids import response_key
from kairograph.operators.facts import RELATION_TYPES, with_ids

ITEM = "struct<subject_id:string,subject_label:string,relation_type:string,object_id:string,object_label:string,evidence:string,confidence:double,is_negated:boolean,temporal_context:string>"
REQUIRED = ("subject_id", "subject_label", "relation_type", "object_id", "object_label")


def mentions_per_chunk(mentions: DataFrame, chunks: DataFrame, keys: tuple[str, ...] = ("pmcid", "section_ord", "chunk_idx")) -> DataFrame:
    """L1: the mentions of each chunk in order, with its text; empty where the text is missing."""
    grouped = mentions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "mention", "canonical_id"))).alias("mentions"))
    return grouped.join(chunks.select(*keys, F.col("chunk").alias("text")), list(keys), "left").fillna("", ["text"])


def prompts(grouped: DataFrame, instruction: str, limit: int = 50) -> DataFrame:
    """L2: prompt text and its cache key from a chunk and its first mentions."""
    listed = F.array_join(F.transform(F.slice("mentions", 1, limit), lambda m: F.concat(F.lit("- "), m["mention"], F.lit(" ("), F.coalesce(m["canonical_id"], F.lit("?")), F.lit(")"))), "\n")
    prompt = F.concat(F.lit(instruction + "\n\nText:\n"), F.col("text"), F.lit("\n\nEntities:\n"), listed)
    return grouped.withColumn("prompt", prompt).withColumn("prompt_key", response_key("prompt"))


def split_cached(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prompts with a stored response (prompt_key, response), and the pending ones."""
    return wanted.join(cache.select("prompt_key", "response"), "prompt_key"), wanted.join(cache.select("prompt_key"), "prompt_key", "left_anti")


def recovered_json(response: Column | str) -> Column:
    """L3: the JSON array in a response: the whole of it, a fenced block, or from the first to the last bracket; an object
    becomes an array of one; null when nothing parses."""
    text = F.trim(F.col(response) if isinstance(response, str) else response)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    between = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    parsed = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.rlike(r"^\s*[\[{]"), c)
    found = F.coalesce(parsed(text), parsed(fenced), parsed(between))
    return F.when(found.rlike(r"^\s*\{"), F.concat(F.lit("["), found, F.lit("]"))).otherwise(found)


def parse_responses(responses: DataFrame, response: str = "response") -> DataFrame:
    """L3, L4: one row per item of a response, with its fields and defaults."""
    items = F.from_json(recovered_json(response), f"array<{ITEM}>")
    rows = responses.withColumn("_item", F.explode(items)).drop(response)
    return rows.select(*[c for c in rows.columns if c != "_item"], "_item.*").withColumns({"confidence": F.coalesce("confidence", F.lit(0.8)), "is_negated": F.coalesce("is_negated", F.lit(False))})


def validate(rows: DataFrame, valid_ids: str = "valid_ids") -> tuple[DataFrame, DataFrame]:
    """L4: relations whose fields are there, whose type is in the ontology and whose ends are among the chunk's entities; the others with a reason."""
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | (F.coalesce(F.trim(c), F.lit("")) == "")
    reason = (
        F.when(missing, "missing field")
        .when(~F.upper("relation_type").isin(*RELATION_TYPES), "unknown relation type")
        .when(~F.coalesce(F.array_contains(valid_ids, F.col("subject_id")), F.lit(False)), "unknown subject")
        .when(~F.coalesce(F.array_contains(valid_ids, F.col("object_id")), F.lit(False)), "unknown object")
    )
    judged = rows.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason").withColumn("relation_type", F.upper("relation_type")), judged.filter("reason is not null")


def complete_rows(rows: DataFrame) -> DataFrame:
    """L5"""
    return rows.filter("trim(coalesce(subject_id, '')) <> '' and trim(coalesce(object_id, '')) <> '' and trim(coalesce(relation_type, '')) <> ''")


def to_facts(relations: DataFrame, papers: DataFrame, source: str = "extraction", as_of: str | None = None) -> DataFrame:
    """Open facts from the paper's date (``as_of``, or today, without one), ontology by the kind of id, the rest as metadata."""
    today = F.lit(as_of).cast("date") if as_of else F.current_date()
    ontology = lambda c: F.when(F.col(c).startswith("HASH:"), "CONTENT_HASH").otherwise("UMLS")
    joined = relations.join(papers.select("pmcid", "publication_date"), "pmcid", "left")
    metadata = F.create_map(
        F.lit("pmcid"), F.col("pmcid").cast("string"), F.lit("evidence"), F.col("evidence"), F.lit("is_negated"), F.col("is_negated").cast("string"),
        F.lit("subject_ontology"), ontology("subject_id"), F.lit("object_ontology"), ontology("object_id"),
    )
    return with_ids(
        joined.select(
            "subject_id", "subject_label", "relation_type", "object_id", "object_label", F.coalesce("publication_date", today).alias("valid_from"),
            F.lit(None).cast("date").alias("valid_to"), F.lit(source).alias("source"), "confidence", metadata.alias("metadata"),
        )
    )


def resolve_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose two ends are entities of their paper."""
    ends = entities.select("pmcid", "canonical_id").distinct()
    as_end = lambda c: ends.select("pmcid", F.col("canonical_id").alias(c))
    return relations.join(as_end("subject_id"), ["pmcid", "subject_id"], "left_semi").join(as_end("object_id"), ["pmcid", "object_id"], "left_semi")


def statistics(runs: DataFrame) -> DataFrame:
    """Totals over processed chunks (extracted, tokens, cost, error, failures)."""
    return runs.agg(
        F.count(F.lit(1)).alias("processed"), F.sum("extracted").alias("extracted"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"),
        F.count_if(F.col("error").isNotNull()).alias("errors"), F.sum("failures").alias("failures"),
    )


def distribution(rows: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The k most frequent values; ties by value."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def confidence_histogram(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Number per equal bin of [0, 1], the last closed above."""
    bucket = F.least(F.lit(bins - 1), F.floor(F.round(F.col("confidence") * bins, 9))).cast("int")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
