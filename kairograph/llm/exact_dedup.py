"""Exact dedup: groups of equal 128-bit content hashes, the smallest id stays, and bytes inside the groups are compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import materialize, text_or_empty

#: A run of white space that isn't one space already.
WHITE_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: Hashes of repeated texts up to which they are broadcast to pick the texts to compare (about 32 bytes each); beyond it all
#: texts are compared, with partial aggregates.
BROADCAST_HASHES = 500_000


def normalised(text: Column) -> Column:
    """Each run of spaces and of \\x09 to \\x0D as one space."""
    return F.regexp_replace(text, WHITE_RUN, " ")


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def _groups(rows: DataFrame, *keys: str) -> DataFrame:
    """Size and first row of each group of two or more; partial aggregates, so a hot text is one row a task."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie", "n")).alias("first")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), first).filter("size > 1")


def _decided(rows: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """Each row with what its group decides. The groups are a written table, so Spark broadcasts them if they are small,
    else splits the rows of a hot text over several tasks of the join."""
    single = F.col("first").isNull()
    return rows.join(groups, [*keys], "left").select(
        *(c for c in rows.columns if c not in ("h", "text", "tie", "n")),
        F.when(single, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("first.n") == F.col("n"))).alias("kept"),
    )


def _collisions(rows: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """Hashes under which texts differ: the least and the greatest text of a group are equal bytes only if all its texts are."""
    texts = rows.select("h", "text")
    if groups.count() <= most:
        texts = texts.join(F.broadcast(groups.select("h")), "h", "left_semi")
    return texts.groupBy("h").agg(F.min("text").alias("low"), F.max("text").alias("high")).filter("low <> high").select("h")


def _marked(docs: DataFrame, id_col: str, text_col: str, carry: bool, digest: Callable[[Column], Column], most: int) -> DataFrame:
    document = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(
        F.col(id_col).alias("id"),
        normalised(text_or_empty(text_col)).alias("text"),
        *([document.alias("document")] if carry else []),
        F.xxhash64(F.to_json(document)).alias("tie") if carry else F.lit(0).cast("long").alias("tie"),
        F.monotonically_increasing_id().alias("n"),
    )
    # written once: row numbers are then fixed, whatever executor is lost, and later passes read only the columns they need
    rows = materialize(rows.withColumns({"h": digest(F.col("text")), "text_sha256": F.sha2("text", 256)}), "texts")
    groups = materialize(_groups(rows, "h"), "groups")
    collided = materialize(_collisions(rows, groups, most), "collisions")
    if collided.isEmpty():
        return _decided(rows.drop("text"), groups, "h")
    odd = rows.join(collided, "h", "left_semi")
    split = materialize(_groups(odd, "h", "text"), "split-groups")
    return _decided(rows.join(collided, "h", "left_anti").drop("text"), groups, "h").unionByName(_decided(odd, split, "h", "text"))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = content_hash, most: int = BROADCAST_HASHES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``: texts are equal if they are after ``normalised``.

    Null texts count as empty ones; texts are not trimmed. Of equal texts one row is kept, that of the smallest id, nulls
    last: keep_id is null if all ids of the group are. Of rows that share this id too one is kept. Very long texts are
    compared whole; an empty table gives no rows; other columns of any name are not looked at. ``digest`` groups the texts;
    where it gives one value to texts of different bytes, these are told apart, and each text has a group of its own.
    """
    return _marked(docs, id_col, text_col, False, digest, most).select("id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = content_hash, most: int = BROADCAST_HASHES) -> DataFrame:
    """``docs`` with one row of each group of ``exact_copies``, columns and texts as they were. Of rows that share the
    smallest id, the one of the smallest hash of the whole row stays."""
    return _marked(docs, id_col, text_col, True, digest, most).filter("kept").select("document.*")


#: The same rows for DuckDB, with whole texts in place of their hashes.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t
"""
