"""Benchmark decontamination: a prefix-filtered join of benchmark windows with documents, DataFrame functions only.

A window that occurs in a document has all its words there, so for exact containment one necessary word is enough as
the prefix: the rarest, by counts over all documents. Its place in the window and the document's length bound where the
window can start; what passes is verified word by word.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import materialize, text_or_empty
from kairograph.llm.quality_rules import let

#: Separators of words, before and after A-Z are lower-cased.
MIXED_BREAK, LOWER_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows (about 50 bytes each) up to which the benchmark's side of a join is broadcast; beyond it Spark's own joins are used.
BROADCAST_WINDOWS = 500_000


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _split(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda w: w != "")


def _keys(text: Column) -> list[Column]:
    """Two hashes of the text: equal texts share their windows, whatever their ids."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """(words, items): distinct windows of ``width`` words, with the sorted ids (as text, null as empty) of their items."""
    words = _split(lower_ascii(text_or_empty(text_col)), LOWER_BREAK)
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1)))
    windows = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("words"))
    return windows.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _prefixes(docs: DataFrame, windows: DataFrame, text_col: str, small: bool) -> DataFrame:
    """(word, offset, words, items): each window under its word with the lowest count over ``docs``; windows with a word that
    no document has are left out. Words are compared in full lower case here, which only adds
    candidates, and word by word on all sides, as the case of a letter may depend on what stands around it (final sigma)."""
    hint = F.broadcast if small else (lambda df: df)
    at = windows.select("words", "items", F.posexplode("words").alias("offset", "w")).select("words", "items", "offset", F.lower("w").alias("word"))
    vocabulary = at.select(F.col("word").alias("known")).distinct()
    spoken = docs.select(F.explode(F.split(text_or_empty(text_col), MIXED_BREAK)).alias("w")).select(F.lower("w").alias("word"))
    counts = spoken.join(hint(vocabulary), F.col("word") == F.col("known"), "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = at.join(counts, "word", "left").groupBy("words", "items").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("rarest"))
    return ranked.filter("rarest.n > 0").select(F.col("rarest.word").alias("prefix"), F.col("rarest.offset").alias("offset"), "words", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items (long), item_ids (array, sorted as text), hit_spans (start, length in words) and
    contaminated; columns of ``docs`` of these names are replaced.

    Words are runs of digits, letters and characters beyond ASCII, in lower-case A-Z; a window is ``width`` words of an
    item in a row, or the whole item if shorter. Null texts have no words and are clean; items without words have no
    window; items that repeat count once. One row per row, repeated ones included; an empty table gives no rows.
    """
    windows = materialize(benchmark_windows(benchmark, item_col, item_text_col, width), "windows")
    small = windows.count() <= BROADCAST_WINDOWS
    hint = F.broadcast if small else (lambda df: df)
    prefixes = _prefixes(docs, windows, text_col, small)
    mixed = _split(text_or_empty(text_col), MIXED_BREAK)
    spoken = docs.select(*_keys(text_or_empty(text_col)), let(mixed, lambda w: F.struct(F.size(w).alias("n"), w.alias("w"))).alias("x"))
    spoken = spoken.select("k1", "k2", F.col("x.n").alias("n"), F.posexplode("x.w").alias("pos", "w")).withColumn("word", F.lower("w"))
    start = F.col("pos") - F.col("offset")
    found = spoken.join(hint(prefixes), F.col("word") == F.col("prefix"))
    found = found.filter((start >= 0) & (start + F.size("words") <= F.col("n")))
    candidates = found.select("k1", "k2", F.struct(start.alias("start"), "words", "items").alias("c")).groupBy("k1", "k2").agg(F.collect_set("c").alias("candidates"))
    own = [c for c in docs.columns if c not in ("n_words", "n_hit", "n_items", "item_ids", "hit_spans", "contaminated")]
    # the documents' columns travel as one, so their names can't clash
    keyed = docs.select(F.struct(*own).alias("own"), *_keys(text_or_empty(text_col)))
    joined = keyed.join(candidates, ["k1", "k2"], "left")
    text = F.coalesce(F.col("own")[text_col].cast("string"), F.lit(""))
    mixed = _split(text, MIXED_BREAK)

    def verified(words: Column) -> Column:
        held = F.filter("candidates", lambda c: F.slice(words, c["start"] + 1, F.size(c["words"])) == c["words"])
        return F.transform(F.array_sort(F.transform(held, lambda c: F.struct(c["start"], F.size(c["words"]).alias("length"), c["items"]))), lambda c: c)

    none = F.array().cast("array<struct<start:int,length:int,items:array<string>>>")
    hits = F.when(F.col("candidates").isNull(), none).otherwise(let(_split(lower_ascii(text), LOWER_BREAK), verified))
    joined = joined.select("own", F.size(mixed).cast("long").alias("n_words"), hits.alias("_hits"))
    ends = F.aggregate(
        "_hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, h: F.struct(
            F.greatest(a["end"], h["start"] + h["length"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), h["start"] + h["length"] - F.greatest(a["end"], h["start"]))).alias("n"),
        ),
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda h: h["items"]))))
    spans = F.transform("_hits", lambda h: F.struct(h["start"].alias("start"), h["length"].alias("length")))
    out = joined.select("own", "n_words", ends["n"].cast("long").alias("n_hit"), items.alias("item_ids"), spans.alias("hit_spans"))
    found = ["n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", "hit_spans", (F.col("n_hit") > 0).alias("contaminated")]
    return out.select(*(F.col("own")[c].alias(c) for c in own), *found)


def items_digest() -> Column:
    return F.sha2(F.array_join("item_ids", ","), 256)


#: The same rows by a plain join of all windows, for DuckDB.
ORACLE_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, list_slice(w, s, s + 9) AS g, len(list_slice(w, s, s + 9)) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, s, n, list_slice(w, s, s + n - 1) AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM words, lengths WHERE len(w) >= n)),
hits AS (SELECT r, s, grams.n, item FROM grams JOIN windows ON grams.g = windows.g),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hits)) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""
