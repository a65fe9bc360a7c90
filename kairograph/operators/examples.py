"""Training examples: token tables, labels, positives, negatives, padding and splits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from kairograph.operators.spans import merge_spans
from kairograph.operators.vectors import hash_uniform, mean_vectors

IGNORED = -100


_WORD = r"(?U)\w+|[^\w\s]"


def _rows_of(values: pa.Array) -> np.ndarray:
    """The row of each element of a list array."""
    return np.repeat(np.arange(len(values)), np.diff(values.offsets.to_numpy()))


def _elements(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False)


#: Tokens of a batch of texts that are worked on at once, but for a longer text.
TOKENS = 1 << 18


def _in_pieces(work: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """``work`` of list arrays, the first of which has an element a token, on some TOKENS at a time, however long a batch's texts are."""
    ends = columns[0].offsets.to_numpy().astype(np.int64)
    at, out = 0, []
    while at < len(columns[0]):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOKENS, side="right")) - 1)
        out.append(work(*(c.slice(at, to - at) for c in columns)))
        at = to
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))


def _token_starts(lengths: pa.Array, gaps: pa.Array) -> pa.Array:
    """Starts of a text's tokens from their lengths and what stands before each: running sums, a text at a time."""
    own, row = _elements(lengths).astype(np.int64), _rows_of(lengths)
    ends = np.cumsum(own + _elements(gaps))
    first = lengths.offsets.to_numpy()[:-1] - lengths.offsets[0].as_py()
    before = np.r_[0, ends][first]
    offsets = pa.array((lengths.offsets.to_numpy() - lengths.offsets[0].as_py()).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array((ends - own - before[row]).astype(np.int32)))


def _mostly_inside(starts: pa.Array, lengths: pa.Array, lows: pa.Array, highs: pa.Array) -> pa.Array:
    """1 for tokens with more than half of their characters in their text's islands, which are disjoint and in order: characters in
    islands before a place come from running sums over all texts of a batch, whose places are set apart by row."""
    row, start, size = _rows_of(starts), _elements(starts).astype(np.int64), _elements(lengths).astype(np.int64)
    low, high, owner = _elements(lows).astype(np.int64), _elements(highs).astype(np.int64), _rows_of(lows)
    floor = min(low.min(initial=0), 0)
    apart = max((start + size).max(initial=0), high.max(initial=0)) - floor + 1
    first, sums = low - floor + owner * apart, np.r_[0, np.cumsum(high - low)]
    widths = np.r_[high - low, 0]

    def covered(place: np.ndarray) -> np.ndarray:
        place = place - floor + row * apart
        k = np.searchsorted(first, place, side="right") - 1
        return np.where(k >= 0, sums[k] + np.minimum(place - np.r_[first, 0][k], widths[k]), 0)

    more = 2 * (covered(start + size) - covered(start)) > size
    offsets = pa.array((starts.offsets.to_numpy() - starts.offsets[0].as_py()).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(more.astype(np.int32)))


@F.arrow_udf(ArrayType(IntegerType()))
def _starts(lengths: pa.Array, gaps: pa.Array) -> pa.Array:
    return _in_pieces(_token_starts, lengths, gaps)


@F.arrow_udf(ArrayType(IntegerType()))
def _labels(starts: pa.Array, lengths: pa.Array, lows: pa.Array, highs: pa.Array) -> pa.Array:
    return _in_pieces(_mostly_inside, starts, lengths, lows, highs)


def _token_arrays(chunks: DataFrame, key: str, text: str, most: int | None) -> DataFrame:
    """(key, words, lengths, starts): a text's words and marks with their places, one row a text; none where there is no token."""
    words = F.regexp_extract_all(F.col(text), F.lit(_WORD), F.lit(0))
    gaps = F.transform(F.split(F.col(text), _WORD), lambda g: F.length(g))
    held = chunks.select(key, (words if most is None else F.slice(words, 1, most)).alias("words"), gaps.alias("_gaps")).filter(F.size("words") > 0)
    held = held.select(key, "words", F.transform("words", lambda w: F.length(w)).alias("lengths"), F.slice("_gaps", F.lit(1), F.size("words")).alias("_gaps"))
    return held.select(key, "words", "lengths", _starts("lengths", "_gaps").alias("starts"))


def _token_id(word: Column | str, vocabulary: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(vocabulary)).cast("int")


def token_table(chunks: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: int = 32_000, most: int | None = 512) -> DataFrame:
    """(key, token, word, token_id, start_char, end_char): words and marks with their places, at most ``most`` per chunk, all for None."""
    held = _token_arrays(chunks, key, text, most)
    rows = held.select(key, F.posexplode(F.arrays_zip(F.col("words").alias("word"), F.col("starts").alias("start_char"))).alias("token", "x"))
    rows = rows.select(key, "token", F.col("x.word").alias("word"), F.col("x.start_char").alias("start_char"))
    return rows.withColumns({"token_id": _token_id("word", vocabulary), "end_char": F.col("start_char") + F.length("word")})


def router_examples(tokens: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, input_ids, attention_mask, router_labels) in token order; chunks without tokens have no row."""
    rows = tokens.join(labels.select(key, "token", "label"), [key, "token"], "left")
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("token", "token_id", F.coalesce("label", F.lit(0)).alias("label")))).alias("x"))
    return grouped.select(key, F.transform("x", lambda v: v["token_id"]).alias("input_ids"), F.transform("x", lambda v: F.lit(1)).alias("attention_mask"), F.transform("x", lambda v: v["label"]).alias("router_labels"))


def router_examples_of(chunks: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: int = 32_000, most: int | None = 512) -> DataFrame:
    """D2 from texts and their spans (B7): the rows of router_examples over token_table and token_labels, for one text a key.

    A text's tokens and its islands of factual characters meet as arrays of one row, so that no row a token is made or dealt.
    """
    islands = merge_spans(spans.filter("label = 'factual'").select(key, "start_char", "end_char"), [key])
    held = islands.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char"))).alias("_x"))
    part = lambda name: F.coalesce(F.col("_x")[name].cast("array<int>"), F.array().cast("array<int>"))
    rows = _token_arrays(chunks.join(held, key, "left").select("*", F.struct(F.col(key), part("start_char").alias("low"), part("end_char").alias("high")).alias("_own")), "_own", text, most)
    ids = F.transform("words", lambda w: _token_id(w, vocabulary))
    labels = _labels("starts", "lengths", "_own.low", "_own.high")
    return rows.select(F.col(f"_own.{key}").alias(key), ids.alias("input_ids"), F.transform("words", lambda w: F.lit(1)).alias("attention_mask"), labels.alias("router_labels"))


def factual_mentions(mentions: DataFrame, spans: DataFrame, text: str = "mention") -> DataFrame:
    """D3: mentions whose text, without case, some span labels factual."""
    names = spans.filter("label = 'factual'").select(F.lower("text").alias("_n")).distinct()
    return mentions.withColumn("_n", F.lower(text)).join(names, "_n", "left_semi").select(mentions.columns)


def positives(keys: DataFrame, mentions: DataFrame, vectors: DataFrame, dim: int, key: str = "doc_id") -> DataFrame:
    """(key, positive_embedding): unit mean of the factual mentions' vectors, zeros where there are none."""
    found = mean_vectors(mentions.join(vectors.select("canonical_id", "embedding"), "canonical_id").select(F.col(key).alias("key"), "embedding"))
    joined = keys.select(key).distinct().join(found.select(F.col("key").alias(key), "embedding"), key, "left")
    return joined.select(key, F.coalesce("embedding", F.array_repeat(F.lit(0.0), dim)).alias("positive_embedding"))


def retrieval_examples(router: DataFrame, positive: DataFrame, negatives: DataFrame, vectors: DataFrame, n: int, dim: int, key: str = "doc_id") -> DataFrame:
    """Router examples with their span mask, positive and ``n`` negative vectors (key, rank, id), padded with zeros."""
    held = negatives.join(vectors.select(F.col("canonical_id").alias("id"), "embedding"), "id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "embedding"))).alias("x"))
    zero = F.array_repeat(F.lit(0.0), dim)
    vs = F.transform(F.slice(F.coalesce("x", F.array().cast("array<struct<rank:int,embedding:array<double>>>")), 1, n), lambda v: v["embedding"].cast("array<double>"))
    joined = router.join(positive, key, "left").join(held, key, "left")
    padded = F.concat(vs, F.array_repeat(zero, F.lit(n) - F.size(vs)))
    return joined.select(*router.columns, F.col("router_labels").alias("span_mask"), F.coalesce("positive_embedding", zero).alias("positive_embedding"), padded.alias("negative_embeddings"))


def joint_examples(retrieval: DataFrame) -> DataFrame:
    """With the next token of each place as its label."""
    return retrieval.withColumn("token_labels", F.concat(F.slice("input_ids", 2, F.size("input_ids")), F.array(F.lit(IGNORED))))


def fit_length(values: Column | str, length: int, fill: int = 0) -> Column:
    """Cut or padded to ``length``; null counts as empty."""
    v = F.coalesce(F.col(values) if isinstance(values, str) else values, F.array().cast("array<int>"))
    cut = F.slice(v, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(fill), F.lit(length) - F.size(cut)))


def fit_vectors(values: Column | str, n: int, dim: int) -> Column:
    """``n`` vectors of ``dim``; wrong lengths become zeros."""
    zero = F.array_repeat(F.lit(0.0), dim)
    v = F.coalesce(F.col(values) if isinstance(values, str) else values, F.array().cast("array<array<double>>"))
    cut = F.transform(F.slice(v, 1, n), lambda x: F.when(F.size(x) == dim, x.cast("array<double>")).otherwise(zero))
    return F.concat(cut, F.array_repeat(zero, F.lit(n) - F.size(cut)))


def processed(examples: DataFrame, length: int, n: int, dim: int) -> DataFrame:
    """D7 on whole examples."""
    return examples.withColumns({
        "input_ids": fit_length("input_ids", length), "attention_mask": fit_length("attention_mask", length), "router_labels": fit_length("router_labels", length), "span_mask": fit_length("span_mask", length),
        "token_labels": fit_length("token_labels", length, IGNORED), "negative_embeddings": fit_vectors("negative_embeddings", n, dim), "positive_embedding": fit_vectors(F.array("positive_embedding"), 1, dim)[0],
    })


def augmented(examples: DataFrame, key: str = "doc_id", seed: int = 0, p: float = 0.5, cut: float = 0.2, least: int = 10, mask_rate: float = 0.12, mask_id: int = 0) -> DataFrame:
    """Half of the rows lose up to a fifth of their right end (at least ``least`` tokens stay), half get some tokens of label 0
    masked. Chances are hashes of the row's key, so a rerun gives the same rows."""
    u = lambda k: hash_uniform(F.lit(k), key, seed=seed)
    n = F.size("input_ids")
    kept = F.when((u(1) < p) & (n > least), F.greatest(F.lit(least), F.floor(n * (1 - cut * u(2))).cast("int"))).otherwise(n)
    out = examples.withColumn("_n", kept)
    for c in ("input_ids", "attention_mask", "router_labels"):
        out = out.withColumn(c, F.slice(c, 1, F.col("_n")))
    pairs = F.arrays_zip("input_ids", "router_labels")
    masked = F.transform(pairs, lambda x, i: F.when((x["router_labels"] == 0) & (hash_uniform(F.lit(3), F.col(key), i, seed=seed) < mask_rate), F.lit(mask_id)).otherwise(x["input_ids"]))
    return out.withColumn("input_ids", F.when(u(4) < p, masked).otherwise(F.col("input_ids"))).drop("_n")


def exact_split(rows: DataFrame, key: str, fraction: float = 0.2, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """Split 'val' for exactly floor(n * fraction) rows in the order of a seeded hash, 'train' for the rest; per stratum with ``by``.

    Over all rows the cut is a quantile of the hash found by counting, and within a stratum rows are ranked by ranges of the hash,
    each shifted by the counts before it, so no task sorts all rows, or all of a stratum. A null stratum is one of its own.
    """
    from kairograph.operators.metrics import dense_position

    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), key))
    if by:
        ranged = hashed.withColumn("_range", F.shiftright("_h", 56))  # 256 of them, in the order of the hash
        counts = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
        stratum_rows = Window.partitionBy(*by)
        before = F.sum("_n").over(stratum_rows.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
        cut = F.floor(F.sum("_n").over(stratum_rows) * fraction)
        shifts = counts.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col("_range").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"), cut.alias("_cut"))
        same = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]
        own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_h", key))
        ranked = ranged.withColumn("_own", own).join(shifts, [F.col("_range") == F.col("_at"), *same]).withColumn("_pos", F.col("_before") + F.col("_own") - 1)
    else:
        total = hashed.agg(F.floor(F.count(F.lit(1)) * fraction).alias("_cut"))
        ranked = dense_position(hashed, "_h", "_pos").crossJoin(F.broadcast(total))
    return ranked.withColumn("split", F.when(F.col("_pos") < F.col("_cut"), "val").otherwise("train")).select(*rows.columns, "split")


def stratum(rows: DataFrame, ratio: str, strata: int = 5) -> DataFrame:
    """Rows with the equal-width band of a ratio in [0, 1] as their stratum."""
    return rows.withColumn("stratum", F.least(F.lit(strata - 1), F.floor(F.col(ratio) * strata).cast("int")))


def example_counts(**kinds: DataFrame) -> DataFrame:
    """D11"""
    out = None
    for name, df in kinds.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        out = n if out is None else out.unionAll(n)
    return out


def nearest_facts(positive: DataFrame, corpus: DataFrame, key: str = "doc_id", k: int = 3) -> DataFrame:
    """The k nearest facts of each positive vector; zero vectors have none."""
    from kairograph.functions.vectors import norm
    from kairograph.operators.vectors import knn_exact

    asking = positive.filter(norm("positive_embedding") >= 1e-6).select(F.col(key).alias("query_id"), F.col("positive_embedding").alias("embedding"))
    return knn_exact(asking, corpus, k)


def lm_labels(ids: Column | str = "input_ids", mask: Column | str = "attention_mask") -> Column:
    """Ids, with padded places ignored."""
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i).otherwise(F.lit(IGNORED)))
