"""Fact clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.operators.facts import FAMILY
from kairograph.sources.shared import written


def families(facts: DataFrame) -> DataFrame:
    """(FAMILY, n_facts): facts by family. Clusters of relations and entities are made of a family's columns, so their sizes and
    entities follow from these fewer rows, and members need not meet the facts again by id."""
    return written(facts.groupBy(*FAMILY).agg(F.count(F.lit(1)).alias("n_facts")), "families")


def _members(rows: DataFrame, kind: str, anchor: str) -> DataFrame:
    kept = [*FAMILY, "n_facts"] if "n_facts" in rows.columns else ["fact_id"]
    return rows.select(F.col(anchor).alias("cluster_id"), F.lit(kind).alias("cluster_type"), F.col(anchor).alias("anchor_entity"), *kept)


def _with_ends(members: DataFrame, facts: DataFrame | None) -> DataFrame:
    """Members with FAMILY and n_facts: those made of families have them, others meet their facts by id."""
    if facts is None:
        return members.select("cluster_id", *FAMILY, "n_facts")
    return members.select("cluster_id", "fact_id").join(facts.select("fact_id", *FAMILY, F.lit(1).alias("n_facts")), "fact_id")


def by_relation(facts: DataFrame) -> DataFrame:
    return _members(facts, "relation", "relation_type")


def by_entity(facts: DataFrame) -> DataFrame:
    """Every fact (or family) is in the clusters of its two ends, once if they are the same."""
    return _members(facts.withColumn("entity", F.explode(F.array_distinct(F.array("subject_id", "object_id")))), "entity", "entity")


def custom(members: DataFrame) -> DataFrame:
    """A supplied (cluster_id, fact_id) list."""
    return members.select("cluster_id", F.lit("custom").alias("cluster_type"), F.lit(None).cast("string").alias("anchor_entity"), "fact_id")


def entity_pages(members: DataFrame, facts: DataFrame | None = None, page: int = 1000, slices: int = 64) -> DataFrame:
    """(cluster_id, page, entities): the distinct ends of each cluster's facts in pages of ``page`` ids, in the order of the
    ids within a slice. Members made of ``families`` need no ``facts``, here and below.

    Ends are made distinct by partial aggregates and fall into ``slices`` slices by their hash; each slice of a cluster is
    numbered on its own, so a cluster of a third of all entities is many tasks and no list is longer than a page.
    """
    ends = _distinct_ends(_with_ends(members, facts)).withColumn("slice", F.pmod(F.xxhash64("entity"), F.lit(slices)).cast("int"))
    placed = ends.withColumn("at", F.floor((F.row_number().over(Window.partitionBy("cluster_id", "slice").orderBy("entity")) - 1) / page))
    pages = placed.groupBy("cluster_id", "slice", "at").agg(F.sort_array(F.collect_list("entity")).alias("entities"))
    return pages.select("cluster_id", F.format_string("%04d-%08d", "slice", "at").alias("page"), "entities")


def _distinct_ends(joined: DataFrame) -> DataFrame:
    return joined.select("cluster_id", F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("entity")).distinct()


def sizes(members: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(cluster_id, size, n_entities, relations): facts, distinct ends and sorted relation types of each cluster, from distinct
    (cluster, entity) and (cluster, relation) rows; relation types are those of the ontology, so their list is short."""
    joined = _with_ends(members, facts)
    ends = _distinct_ends(joined).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_entities"))
    counted = joined.groupBy("cluster_id", "relation_type").agg(F.sum("n_facts").alias("n"))
    counted = counted.groupBy("cluster_id").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list("relation_type")).alias("relations"))
    return counted.join(ends.hint("merge"), "cluster_id").select("cluster_id", "size", "n_entities", "relations")


def summary(members: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Size, sorted entity ids and sorted relation types of each cluster, for clusters whose list of entities is wanted
    whole; sizes and entity_pages are the bounded form. The lists are never broadcast, however small their estimate."""
    pages = entity_pages(members, facts).groupBy("cluster_id").agg(F.sort_array(F.flatten(F.collect_list("entities"))).alias("entities"))
    return sizes(members, facts).join(pages.hint("merge"), "cluster_id").select("cluster_id", "size", "entities", "relations")
