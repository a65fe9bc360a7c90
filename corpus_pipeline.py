"""From raw documents to packed training sequences: five operators of kairograph.llm, one stage each.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from kairograph.llm.common import materialize, table


def _wrapped(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that an operator uses, and all of a document's as one: those named like a result are not replaced."""
    return docs.select(*used, F.struct("*").alias("document"))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.quality_rules(_wrapped(docs, "text", "lang")).filter("kept").select("document.*")


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts; n_chars is that of what is left."""
    cut = line_dedup.drop_boilerplate(_wrapped(docs, "text", "source"))
    cut = cut.select(*(F.col("text") if c == "text" else F.col("document")[c].alias(c) for c in docs.columns))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, exact copies included."""
    return simhash.one_per_component(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.decontaminate(_wrapped(docs, "text"), table(spark, sf_dir, "benchmark"))
    return found.filter("not contaminated").select("document.*")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and placed in sequences."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", apply_quality_rules),
    ("line dedup", drop_site_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_documents),
]

#: SimHash components and tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
