"""Source divergence audit: how the word shares of each source of a language differ from every other source's and from the
language's, priced over hash-consed segment trees of term counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.llm.common import materialize, utf8

#: Documents of its language that a term needs, parts of the whole in which shares are given, and ranks of the term part.
MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Terms of a segment tree and sources of one side of a tile, as means over hashed blocks and chunks: a task holds
#: 2 * SOURCES * TERMS counts or so, however many terms, sources and rows there are.
TERMS, SOURCES = 8192, 48
#: Words after which a task hands on its counts.
FLUSH = 2_000_000

#: Bytes of terms, A-Z in lower case; a space for all others. Bytes from 0x80 on belong to characters beyond ASCII.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
_PRICED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents of each term so far, and a null term for each group."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    words = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            k = len(n) + 1
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array([source] * k), pa.array([None, *n], pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())], schema=_COUNTED)

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            terms = text.translate(_TERM_BYTES).split()
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            n.update(terms)
            docs.update(set(terms))
            words += len(terms)
            if words >= FLUSH:
                yield from rows()
                found, words = {}, 0
    yield from rows()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Four tables: kept terms (lang, term, total); their counts (lang, source, term, n, total), total being the language's;
    groups (lang, source, size), size being the sum of n; languages (lang, terms, size, sources).

    Tasks hand on sums already, so terms are dealt by language and term at once and meet no other exchange: of a term there
    is a row for each task and source at most, few beside the others' rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    seen = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), utf8(text_col).alias("text")).mapInArrow(_count_terms, "lang string, source string, term binary, n long, docs long")
    seen = seen.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    own = Window.partitionBy("lang", "term")
    seen = seen.withColumns({"total": F.sum("n").over(own), "in_docs": F.sum("docs").over(own), "first": F.min("source").over(own) == F.col("source")})
    seen = seen.filter(F.col("term").isNull() | (F.col("in_docs") >= min_docs))
    seen = materialize(seen.select("lang", "source", F.col("term").cast("string").alias("term"), "n", "total", "first"), "term-counts")
    counts = seen.filter("term IS NOT NULL").drop("first")
    kept = seen.filter("term IS NOT NULL AND first").select("lang", "term", "total")
    groups = materialize(seen.groupBy("lang", "source").agg(F.sum("n").alias("size")), "groups")
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    langs = groups.groupBy("lang").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("sources")).join(terms, "lang", "left")
    return kept, counts, groups, materialize(langs.select("lang", F.coalesce("terms", F.lit(0)).cast("long").alias("terms"), "size", "sources"), "languages")


def _trees(leaves: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Segment trees over the rows of ``leaves`` (a power of two wide), bottom up: leaf values; each level's nodes as (left,
    right) of the level below; the rows' roots. Equal subtrees of any rows at any places are one node."""
    values, ids = np.unique(leaves, return_inverse=True)
    ids, levels, n = ids.reshape(leaves.shape), [], len(values)
    while ids.shape[1] > 1:
        nodes, below = np.unique(ids[:, ::2] * np.int64(n) + ids[:, 1::2], return_inverse=True)
        levels.append((nodes // n, nodes % n))
        ids, n = below.reshape(len(ids), -1), len(nodes)
    return values, levels, ids[:, 0]


def _price(a: int, b: int, levels: list, p: np.ndarray, q: np.ndarray) -> tuple[int, int]:
    """Sums of (p - q)^2 / q and (p - q)^2 / p over the leaves of the trees at roots a and b, floored leaf by leaf; p and q
    are the leaves' prices. Both trees are walked at once, level by level, and a pair of nodes that was met is not met again."""
    left, right, places = np.array([a]), np.array([b]), []
    for lower, upper in reversed(levels):
        n = np.int64(lower.max(initial=0) + upper.max(initial=0) + 1)
        pairs, met = np.unique(np.concatenate([lower[left] * n + lower[right], upper[left] * n + upper[right]]), return_inverse=True)
        places.append(met)
        left, right = pairs // n, pairs % n
    p, q = p[left], q[right]
    there = (p > 0) & (q > 0)
    square = (p - q) ** 2
    one, other = (np.where(there, square // np.where(there, x, 1), 0) for x in (q, p))
    for met in reversed(places):
        one, other = (v[met[: len(met) // 2]] + v[met[len(met) // 2 :]] for v in (one, other))
    return int(one[0]), int(other[0])


def _price_tile(scale: int):
    def price(table: pa.Table) -> pa.Table:
        lang, low, high = (table.column(c)[0].as_py() for c in ("lang", "low", "high"))
        source = table.column("source").combine_chunks().dictionary_encode()
        term = table.column("term").combine_chunks().dictionary_encode()
        names, row = source.dictionary.to_pylist(), source.indices.to_numpy()
        n, size, chunk, block_terms = (table.column(c).to_numpy() for c in ("n", "size", "chunk", "block_terms"))
        sizes, chunks = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        sizes[row], chunks[row] = size, chunk
        at = term.indices.fill_null(-1).to_numpy()
        real = at >= 0
        counts = np.zeros((len(names), block_terms.max()), np.int64)  # terms that none of these sources has stay at zero
        counts[row[real], at[real]] = n[real]
        counts = counts[:, np.argsort(-counts.sum(0), kind="stable")]  # rare terms side by side: their subtrees are alike
        width = 1 << max(0, counts.shape[1] - 1).bit_length()
        leaves = np.full((len(names), width), -1, np.int64)  # -1: no term, priced at nothing
        leaves[:, : counts.shape[1]] = counts
        values, levels, roots = _trees(leaves)
        terms = int(table.column("terms")[0].as_py())
        shares = np.array([[1 + scale * (int(v) + 1) // (int(s) + terms) if v >= 0 else 0 for v in values] for s in sizes], np.int64)
        out: list[tuple] = []
        firsts, seconds = np.flatnonzero(chunks == low), np.flatnonzero(chunks == high)
        for a in firsts:
            for b in seconds:
                if low != high or a < b:
                    one, other = _price(roots[a], roots[b], levels, shares[a], shares[b])
                    out += [(lang, names[a], names[b], one), (lang, names[b], names[a], other)]
        return pa.table(list(zip(*out, strict=True)) if out else [[]] * 4, schema=_PRICED)

    return price


def pair_divergences(kept: DataFrame, counts: DataFrame, groups: DataFrame, langs: DataFrame, scale: int = SCALE, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, both ways.

    Terms are dealt over blocks and sources over chunks by their hashes; a task prices the pairs of two chunks over one
    block, and what the blocks give is added up. A source without terms in a block stands there with counts of zero.
    """
    shape = langs.select("lang", "terms", F.ceil(F.greatest(F.col("terms"), F.lit(1)) / terms).cast("int").alias("blocks"), F.ceil(F.col("sources") / sources).cast("int").alias("chunks"))
    part = lambda c, n: F.pmod(F.xxhash64(F.lit(11), c), F.col(n)).cast("int")
    own = groups.join(shape, "lang").withColumn("chunk", part("source", "chunks"))
    dealt = kept.join(shape, "lang").groupBy("lang", part("term", "blocks").alias("block")).agg(F.count(F.lit(1)).alias("block_terms"))
    present = own.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(dealt, ["lang", "block"], "left").withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long"), "block_terms": F.coalesce("block_terms", F.lit(0))})
    rows = counts.join(own, ["lang", "source"]).withColumns({"block": part("term", "blocks"), "block_terms": F.lit(0).cast("long")})
    rows = rows.select(*present.columns).unionByName(present)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    rows = rows.select("*", other).withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
    rows = rows.select("lang", "block", "low", "high", "source", "chunk", "size", "terms", "block_terms", "term", "n")
    priced = rows.groupBy("lang", "block", "low", "high").applyInArrow(_price_tile(scale), "lang string, source string, item string, value long")
    return priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _share(n: Column, size: Column, terms: Column, scale: int) -> Column:
    whole = lambda c: c.cast("decimal(18,0)")
    return (F.lit(1) + F.call_function("div", whole(F.lit(scale)) * whole(n + 1), whole(size + terms))).cast("long")


def term_divergences(counts: DataFrame, groups: DataFrame, langs: DataFrame, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """(lang, source, item, value): terms that a source uses more than its language, the first ``top`` of each group at least."""
    whole = langs.select("lang", "terms", F.col("size").alias("lang_size"))
    found = counts.join(groups, ["lang", "source"]).join(whole, "lang")
    found = found.withColumns({"p": _share(F.col("n"), F.col("size"), F.col("terms"), scale), "q": _share(F.col("total"), F.col("lang_size"), F.col("terms"), scale)}).filter("p > q")
    found = found.select("lang", "source", F.col("term").alias("item"), F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    # a group's terms are ranked by parts first, so that no task sorts all terms of a large group
    part = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(8))).orderBy(F.desc("value"), "item")
    return found.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= top).drop("place")


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) by the registered contract's arithmetic, which is exact.

    Part ``pair``: every other source of the language; part ``term``: the terms that stand out most against the language,
    up to ``top``. Null texts, languages and sources count as ''; a language without kept terms gives pairs of value 0;
    repeated rows count each; ties of values go by the item's bytes; an empty table gives no rows; other columns are not
    looked at. Counts to 10^17 are exact.
    """
    kept, counts, groups, langs = term_counts(docs, lang_col, source_col, text_col, min_docs)
    pairs = pair_divergences(kept, counts, groups, langs, scale).withColumn("part", F.lit("pair"))
    terms = term_divergences(counts, groups, langs, scale, top).withColumn("part", F.lit("term"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    found = pairs.unionByName(terms).withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))
    return found.select("lang", "source", "part", "item", "value", "rank")


#: The same rows for DuckDB.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
o AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS terms, sum(n) AS size FROM kept GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (g.size + l.terms)::HUGEINT AS p,
    1 + {SCALE}::HUGEINT * (k.n + 1) // (l.size + l.terms)::HUGEINT AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= {TOP}
"""
