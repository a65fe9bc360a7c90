"""Sections and word windows of parsed papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.functions.text import words

SECTIONS = ("abstract", "introduction", "methods", "results", "discussion")
SIZE, OVERLAP = 256, 64


def _bound(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def chunk(rows: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP, mode: str = "merge_tail") -> DataFrame:
    """One row per window of ``size`` words: chunk_idx, start_word, end_word, chunk.

    merge_tail stops with the first window that reaches the end; stride starts one every size - overlap words while
    words are left, and keeps a text of ``size`` words or fewer verbatim. Texts without words give no rows.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    if mode not in ("merge_tail", "stride"):
        raise ValueError(f"unknown mode: {mode}")
    step = size - overlap

    def windows(w: Column) -> Column:
        n = F.size(w)
        last = F.greatest(n - size, F.lit(0)) if mode == "merge_tail" else F.when(n <= size, F.lit(0)).otherwise(n - 1)
        count = (F.ceil(last / step) if mode == "merge_tail" else F.floor(last / step)).cast("int")
        starts = F.transform(F.sequence(F.lit(0), count), lambda i: i * step)
        piece = lambda s: F.array_join(F.slice(w, s + 1, size), " ")
        whole = (lambda s: F.when(n <= size, F.col(text)).otherwise(piece(s))) if mode == "stride" else piece
        return F.transform(starts, lambda s: F.struct(s.alias("start_word"), F.least(s + size, n).alias("end_word"), whole(s).alias("chunk")))

    own = [c for c in rows.columns if c != text]
    cut = rows.select(*own, F.when(F.size(words(F.col(text))) > 0, _bound(words(F.col(text)), windows)).alias("_c"))
    return cut.select(*own, F.posexplode("_c").alias("chunk_idx", "_x")).select(*own, "chunk_idx", "_x.*")


def sections_of(papers: DataFrame) -> DataFrame:
    """(pmcid, section_ord, section, text): the abstract (0) and the body sections in order."""
    body = papers.select("pmcid", F.inline("body_sections"))
    body = body.select("pmcid", F.col("ord").alias("section_ord"), F.col("name").alias("section"), "text")
    abstract = papers.filter("abstract is not null and abstract <> ''").select("pmcid", F.lit(0).alias("section_ord"), F.lit("abstract").alias("section"), F.col("abstract").alias("text"))
    return abstract.unionByName(body)


def first_match(sections: DataFrame, wanted: tuple[str, ...] = SECTIONS) -> DataFrame:
    """Sections whose title holds a wanted name, under the first such name."""
    listed = F.array(*map(F.lit, wanted))
    name = F.get(F.filter(listed, lambda w: F.contains(F.lower("section"), w)), F.lit(0))
    return sections.withColumn("wanted", name).filter("wanted is not null")


#: Names that may be requested at once: every distinct title is compared with each.
MOST_REQUESTS = 1000


def _matched(sections: DataFrame, requests: DataFrame) -> DataFrame:
    """Sections with each requested name (wanted) that their title holds: distinct titles meet the short list of names, and the
    sections meet their titles in an equi-join."""
    wanted = [r.wanted for r in requests.select(F.lower("name").alias("wanted")).filter("wanted is not null").distinct().limit(MOST_REQUESTS + 1).collect()]
    if len(wanted) > MOST_REQUESTS:
        raise ValueError(f"more than {MOST_REQUESTS} names")
    titles = sections.select(F.col("section").alias("_title")).distinct()
    names = F.filter(F.array(*map(F.lit, sorted(wanted))).cast("array<string>"), lambda w: F.contains(F.lower("_title"), w))
    titles = titles.select("_title", F.explode(names).alias("wanted"))
    return sections.join(titles, F.col("section") == F.col("_title")).drop("_title")


def per_request(sections: DataFrame, requests: DataFrame) -> DataFrame:
    """For each requested name (at most MOST_REQUESTS) and paper, the first section whose title holds it."""
    first = _matched(sections, requests).groupBy("pmcid", "wanted").agg(F.min_by(F.struct("section_ord", "section", "text"), "section_ord").alias("s"))
    return first.select("pmcid", "wanted", "s.*")


def all_matches(sections: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Every section whose title holds a requested name, once for each such name; all sections without a list."""
    return sections.withColumn("wanted", F.col("section")) if requests is None else _matched(sections, requests)


def references_of(papers: DataFrame) -> DataFrame:
    """One row per cited reference."""
    return papers.select("pmcid", F.inline("references"))
