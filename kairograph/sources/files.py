"""Other readers and writers: file lists, JSON extracts, prompts, examples and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.functions.text import citation_journal, citation_year
from kairograph.sources.shared import written


def file_list(spark: SparkSession, path: str, min_year: int, max_year: int, journals: Sequence[str] = (), max_documents: int | None = None) -> DataFrame:
    """(file, citation, accession, year, journal) of a CSV list, within years and journals, both file and id given; the first ``max_documents`` in the order of the files."""
    rows = spark.read.csv(path, header=True)
    named = rows.toDF(*[c.strip().lower().replace(" ", "_") for c in rows.columns])
    citation = next(c for c in named.columns if "citation" in c)
    file, accession = named.columns[0], next(c for c in named.columns if "accession" in c or c == "pmcid")
    out = named.select(F.trim(file).alias("file"), F.col(citation).alias("citation"), F.trim(accession).alias("accession"), citation_year(citation).alias("year"), citation_journal(citation).alias("journal"))
    out = out.filter(F.col("year").between(min_year, max_year) & (F.col("file") != "") & (F.col("accession") != ""))
    if journals:
        out = out.filter(F.lower("journal").isin([j.lower() for j in journals]))
    return out if max_documents is None else out.orderBy("file", "accession").limit(max_documents)


def json_arrays(spark: SparkSession, directory: str, schema: str, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Rows of files that hold a JSON array or one object, with the file they came from, and the unreadable files' rows."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("pathGlobFilter", pattern).json(directory).select("*", F.col("_metadata.file_path").alias("source_file"))
    rows = written(rows, "json")  # a read of the corrupt column alone is not allowed
    return rows.filter("_corrupt_record is null").drop("_corrupt_record"), rows.filter("_corrupt_record is not null").select("source_file")


def text_chunks(spark: SparkSession, directory: str, pattern: str = "{chunks,entities}_*.json") -> DataFrame:
    """S4"""
    good, _ = json_arrays(spark, directory, "text string", pattern)
    return good.select("source_file", F.coalesce("text", F.lit("")).alias("text"))


EXAMPLES = """id string, input_ids array<int>, attention_mask array<int>, router_labels array<int>, span_mask array<int>, positive_embedding array<double>,
negative_embeddings array<array<double>>, token_labels array<int>"""


def training_examples(spark: SparkSession, directory: str) -> DataFrame:
    """Examples of .json (one per file) and .jsonl (one per line) files."""
    lines = spark.read.schema(EXAMPLES).option("pathGlobFilter", "*.jsonl").json(directory)
    files = spark.read.schema(EXAMPLES).option("multiLine", True).option("pathGlobFilter", "*.json").json(directory)
    return lines.unionByName(files, allowMissingColumns=True)


def write_examples(examples: DataFrame, path: str, key: str, buckets: int = 64, fmt: str = "json") -> None:
    """Partitioned by a bucket of the document key."""
    examples.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).write.partitionBy("bucket").format(fmt).save(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as a line of JSON."""
    report.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def write_lines(rows: DataFrame, path: str, column: str = "value") -> None:
    """A column of text, one row per line."""
    rows.select(F.col(column).alias("value")).write.text(path)


def prompts(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """Non-empty lines of a text file, or the texts of a JSON list of strings or of {text} objects."""
    if fmt == "text":
        rows = spark.read.text(path).select(F.trim("value").alias("text"))
    else:
        whole = spark.read.option("wholetext", True).text(path)
        items = whole.select(F.explode(F.from_json("value", "array<string>")).alias("x"))
        rows = items.select(F.when(F.col("x").startswith("{"), F.get_json_object("x", "$.text")).otherwise(F.col("x")).alias("text"))
    return rows.filter(F.trim("text") != "")


def file_sizes(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """Paths and sizes; the contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory).select("path", "length")
