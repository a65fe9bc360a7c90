"""Line dedup by site-relative frequency: lines on too large a share of a host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import materialize

#: Share of a host's pages above which a line is dropped, and pages that a line and a host need for it.
RATIO, MIN_LINE_PAGES, MIN_HOST_PAGES = 0.08, 5, 20


def line_key(line: Column) -> Column:
    """A line without spaces around it, as a 64-bit hash and its length: no line text is shuffled."""
    return F.struct(F.xxhash64(F.trim(line)).alias("h"), F.length(F.trim(line)).alias("n"))


def _lines(text_col: str) -> Column:
    return F.split(F.col(text_col), "\n")


def boilerplate_lines(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_line_pages: int = MIN_LINE_PAGES, min_host_pages: int = MIN_HOST_PAGES
) -> DataFrame:
    """(host, line, pages, host_pages): keys of lines whose pages are more than ``ratio`` of the host's.

    Both counts are grouped with partial sums, so a host with a third of all pages needs no task of its own. A host
    has at most its mean number of lines per page, divided by ``ratio``, of such lines.
    """
    pages = docs.filter(F.col(host_col).isNotNull())
    keys = F.array_distinct(F.transform(F.filter(_lines(text_col), lambda x: F.trim(x) != ""), line_key))
    lines = pages.select(F.col(host_col).alias("host"), F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    totals = pages.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("host_pages"))
    found = lines.filter(F.col("pages") >= min_line_pages).join(totals.filter(F.col("host_pages") >= min_host_pages), "host")
    return found.filter(F.col("pages") > F.col("host_pages") * ratio)


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``, and n_lines, n_dropped (long); columns of these names are replaced.

    A line counts once per page however often it stands there, and goes wherever it stands. Blank lines stay.
    Pages without a host, and null texts, stay as they are (n_lines 0 for null); a text of boilerplate only becomes
    empty, its row stays. Repeated rows are pages of their own; an empty table gives no rows.
    """
    found = boilerplate_lines(docs, host_col, text_col, **limits).groupBy("host").agg(F.collect_list("line").alias("_drop"))
    # written first: Spark then knows its size and broadcasts it if small, else may split a hot host's pages in the join
    found = materialize(found, "boilerplate")
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # the documents' columns travel as one, so their names can't clash
    joined = docs.select(F.struct(*own).alias("own"), F.col(host_col).alias("host")).join(found, "host", "left")
    text, lines = F.col("own")[text_col], F.split(F.col("own")[text_col], "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("_drop"), line_key(x)))
    joined = joined.select("own", F.when(F.col("_drop").isNull(), lines).otherwise(kept).alias("kept"))
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    n_dropped = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("kept")).cast("long")
    columns = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col("own")[c].alias(c) for c in own]
    return joined.select(*columns, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


#: The same rows for DuckDB, with whole lines in place of their keys.
ORACLE_SQL = f"""
WITH lines AS (
  SELECT DISTINCT r, source, trim(line, ' ') AS line
  FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line FROM (SELECT row_number() OVER () AS r, * FROM documents WHERE source IS NOT NULL))
  WHERE trim(line, ' ') <> ''),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
boilerplate AS (
  SELECT source, line FROM lines JOIN totals USING (source) GROUP BY source, line, total
  HAVING count(*) >= {MIN_LINE_PAGES} AND total >= {MIN_HOST_PAGES} AND count(*) > total * CAST({RATIO} AS DOUBLE)),
by_host AS (SELECT source, list(line) AS gone FROM boilerplate GROUP BY source),
cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS all_lines, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(gone, []), trim(x, ' '))) AS kept
  FROM documents LEFT JOIN by_host USING (source))
SELECT doc_id, CAST(len(all_lines) AS BIGINT) AS n_lines, CAST(len(all_lines) - len(kept) AS BIGINT) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM cut
"""
