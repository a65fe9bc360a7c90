"""Vector search and aggregation at four levels: facts, pairs, entities and clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairograph.functions.vectors import DESCENDING, argmax, normalise
from kairograph.operators.search import QUERY_BLOCK, distances, ivf_index, ivf_search, knn_exact, knn_sql, matrix, pq_search, product_codes, search, use_exact
from kairograph.sources.shared import written

__all__ = ["ivf_index", "ivf_search", "knn_exact", "knn_sql", "pq_search", "product_codes", "search", "use_exact"]

def id_positions(corpus: DataFrame) -> DataFrame:
    """(id, position): places from 0 in the order of the ids."""
    from kairograph.operators.metrics import dense_position

    return dense_position(corpus.select("id"), "id")


def ids_at(positions: DataFrame, placed: DataFrame) -> DataFrame:
    """``positions`` (position, …) with the id there, null out of range."""
    return positions.join(placed.select("position", "id"), "position", "left")


def positions_of(ids: DataFrame, placed: DataFrame) -> DataFrame:
    """``ids`` (id, …) with its position, null where the id is unknown."""
    return ids.join(placed.select("id", "position"), "id", "left")


def mean_vectors(rows: DataFrame, key: str = "key") -> DataFrame:
    """(key, embedding, n): the unit mean vector of each key: components are averaged with partial sums and put in order."""
    parts = rows.select(key, F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    whole = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("v"), F.max("n").alias("n"))
    return whole.select(key, normalise(F.transform("v", lambda x: x["m"])).alias("embedding"), "n")


def pool(tokens: DataFrame, key: str = "id", how: str = "mean") -> DataFrame:
    """V2: (key, embedding): unit pooled vectors of (key, pos, mask, embedding) rows: the first, the mean or the maximum over the mask."""
    if how == "cls":
        first = tokens.groupBy(key).agg(F.min_by("embedding", "pos").alias("embedding"))
        return first.select(key, normalise("embedding").alias("embedding"))
    kept = tokens.filter(F.col("mask") == 1)
    if how == "mean":
        return mean_vectors(kept, key).select(key, "embedding")
    parts = kept.select(key, F.posexplode("embedding").alias("dim", "x")).groupBy(key, "dim").agg(F.max("x").alias("m"))
    whole = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("v"))
    return whole.select(key, normalise(F.transform("v", lambda x: x["m"])).alias("embedding"))


def encode_texts(rows: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None, id_col: str = "id", text_col: str = "text", dim: int = 256, batch: int = 256) -> DataFrame:
    """V3: (id, embedding) by a supplied encoder (made once per task), or hashed word counts as the built-in default."""
    if encoder is None:
        from pyspark.ml.feature import HashingTF
        from pyspark.ml.functions import vector_to_array

        tokens = rows.withColumn("_w", F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"\s+"))
        counted = HashingTF(inputCol="_w", outputCol="_v", numFeatures=dim).transform(tokens)
        return counted.select(F.col(id_col).alias("id"), normalise(vector_to_array("_v")).alias("embedding"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                v = np.asarray(encode(part["text"].fillna("").tolist()), dtype=float)
                yield pd.DataFrame({"id": part["id"], "embedding": list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300))})

    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, embedding array<double>")


# --- levels (V9 to V15) ---


def build_levels(facts: DataFrame, vectors: DataFrame, clusters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """level_vectors (level, key, embedding) and level_members (level, key, fact_id, pos): 0 facts, 1 pairs, 2 entities, 3 clusters."""
    rows = facts.join(vectors.select("fact_id", "embedding"), "fact_id")
    pair = F.concat_ws("||", "subject_id", "object_id")
    levels = [(0, rows.select(F.col("fact_id").alias("key"), "fact_id", "embedding")), (1, rows.select(pair.alias("key"), "fact_id", "embedding"))]
    levels.append((2, rows.select(F.explode(F.array("subject_id", "object_id")).alias("key"), "fact_id", "embedding")))
    if clusters is not None:
        named = clusters.select(F.coalesce("cluster_id", "anchor_entity").alias("key"), "fact_id").filter("key is not null and key <> ''")
        levels.append((3, named.join(vectors.select("fact_id", "embedding"), "fact_id")))
    out_vectors, out_members = None, None
    for level, df in levels:
        means = df.select("key", F.col("embedding").cast("array<double>").alias("embedding")) if level == 0 else mean_vectors(df).select("key", "embedding")
        members = df.select("key", "fact_id").withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("fact_id")) - 1)
        v, m = means.select(F.lit(level).alias("level"), "key", "embedding"), members.select(F.lit(level).alias("level"), "key", "fact_id", "pos")
        out_vectors, out_members = (v, m) if out_vectors is None else (out_vectors.unionAll(v), out_members.unionAll(m))
    return out_vectors, out_members


def search_at_level(queries: DataFrame, level_vectors: DataFrame, level: int, k: int = 10, metric: str = "l2sq") -> DataFrame:
    """V13"""
    return knn_exact(queries, level_vectors.filter(F.col("level") == level).select(F.col("key").alias("id"), "embedding"), k, metric)


def expand(found: DataFrame, members: DataFrame, level: int) -> DataFrame:
    """(query_id, fact_id, position): members of the found keys by rank and place, the first occurrence of each fact. Its rows are
    those of all members, for each query; ``expansion_ends`` gives their number and ends without."""
    rows = found.join(members.filter(F.col("level") == level).select(F.col("key").alias("id"), "fact_id", "pos"), "id")
    first = rows.groupBy("query_id", "fact_id").agg(F.min(F.struct("rank", "pos")).alias("at"))
    return first.select("query_id", "fact_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "fact_id")).alias("position"))


def expansion_ends(found: DataFrame, members: DataFrame, level: int) -> DataFrame:
    """V14 by query: (query_id, n, first, last): how many facts ``expand`` gives, the first and the last, without its rows.

    Facts that are members of the same keys are one kind, whose number and ends under each of these keys are found once; queries
    meet kinds and not facts. A query has a kind where its first key of it stands.
    """
    own = members.filter(F.col("level") == level).groupBy("fact_id", "key").agg(F.min("pos").alias("pos"))
    held = own.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("key", "pos"))).alias("at"))
    held = held.select("fact_id", F.col("at.key").alias("kind"), F.explode("at").alias("at"))
    held = held.select("kind", F.col("at.key").alias("id"), F.struct("at.pos", "fact_id").alias("place"))
    kinds = held.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))
    met = found.select("query_id", "rank", "id").join(kinds, "id").groupBy("query_id", "kind").agg(F.min(F.struct("rank", "n", "first", "last")).alias("met"))
    met = met.select("query_id", "met.*").select("query_id", "n", F.struct("rank", "first").alias("first"), F.struct("rank", "last").alias("last"))
    ends = met.groupBy("query_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return ends.select("query_id", "n", F.col("first.first.fact_id").alias("first"), F.col("last.last.fact_id").alias("last"))


def _signed(queries: DataFrame) -> DataFrame:
    """Queries with level and mode by argmax of their logits."""
    from kairograph.operators.temporal import MODES

    mode = F.element_at(F.array(*map(F.lit, MODES)), argmax("temporal_logits") + 1)
    return queries.select("query_id", "embedding", argmax("granularity_logits").alias("level"), mode.alias("mode"), "as_of")


def resolved_counts(queries: DataFrame, level_vectors: DataFrame, members: DataFrame, facts: DataFrame, k: int = 10) -> DataFrame:
    """V15, G5 by query: (query_id, n, least): how many facts ``resolve_queries`` gives and the least of their ids, without its rows.

    Facts of the same keys at a level are one kind; queries meet kinds and not facts. What is valid on a day (as_of is a date) comes from
    counts by kind and aligned piece of time: a fact is in some pieces of each size, a query asks one piece of each size.
    """
    from kairograph.operators.temporal import aligned_pieces

    signed = _signed(queries)
    named = written(members.groupBy("level", "fact_id").agg(F.array_sort(F.collect_set("key")).alias("kind")), "kinds")
    found = None
    for level in range(4):
        at = search_at_level(signed.filter(F.col("level") == level), level_vectors, level, k).select("query_id", F.lit(level).alias("level"), F.col("id").alias("key"))
        found = at if found is None else found.unionAll(at)
    keys = named.select("level", "kind").distinct().withColumn("key", F.explode("kind"))
    asked = found.join(keys, ["level", "key"]).select("query_id", "level", "kind").distinct()
    day = F.unix_date("as_of")
    asked = written(asked.join(signed.select("query_id", "mode", day.alias("day")), "query_id"), "asked")
    held = named.join(facts.select("fact_id", F.unix_date("valid_from").alias("start"), F.unix_date("valid_to").alias("end")), "fact_id")
    counts = (F.count(F.lit(1)).alias("n"), F.min("fact_id").alias("least"))
    modes = F.when(F.col("end").isNull(), F.array(F.lit("CURRENT"), F.lit("HISTORY"))).otherwise(F.array(F.lit("HISTORY")))
    out = asked.join(held.withColumn("mode", F.explode(modes)).groupBy("level", "kind", "mode").agg(*counts), ["level", "kind", "mode"]).select("query_id", "n", "least")
    dated = asked.filter("mode = 'AT_TIMESTAMP' and day is not null")
    low, high = dated.agg(F.min("day"), F.max("day")).first()
    if low is not None:
        sizes, stop = (high + 1 - low).bit_length(), F.lit(high + 1)
        start, end = F.greatest("start", F.lit(low)) - low, F.least(F.coalesce("end", stop), stop) - low
        known = held.filter("start is not null").join(dated.select("level", "kind").distinct(), ["level", "kind"], "left_semi")
        known = known.select("level", "kind", "fact_id", F.explode(aligned_pieces(start, end, sizes)).alias("piece")).groupBy("level", "kind", "piece").agg(*counts)
        on = F.explode(F.array(*(F.struct(F.lit(j).alias("size"), F.shiftright(F.col("day") - low, j).alias("at")) for j in range(sizes))))
        out = out.unionAll(dated.select("query_id", "level", "kind", on.alias("piece")).join(known, ["level", "kind", "piece"]).select("query_id", "n", "least"))
    return out.groupBy("query_id").agg(F.sum("n").alias("n"), F.min("least").alias("least"))


def resolve_queries(queries: DataFrame, level_vectors: DataFrame, members: DataFrame, facts: DataFrame, k: int = 10) -> DataFrame:
    """Search, expand, fetch and filter in time for a table of queries, level and mode by argmax of their logits. Its rows
    are those of all facts found, for each query; ``resolved_counts`` counts them without."""
    from kairograph.operators.temporal import resolve_rows

    signed = _signed(queries)
    out = None
    for level in range(4):
        at = expand(search_at_level(signed.filter(F.col("level") == level), level_vectors, level, k), members, level)
        out = at if out is None else out.unionAll(at)
    rows = out.join(signed.select("query_id", "mode", "as_of"), "query_id").join(facts, "fact_id")
    return resolve_rows(rows)


# --- negatives and analysis (V17 to V25) ---


def rank_window_negatives(queries: DataFrame, corpus: DataFrame, n: int, metric: str = "l2sq") -> DataFrame:
    """Ranks 2 to n + 1 of the neighbours."""
    return knn_exact(queries, corpus, n + 1, metric).filter("rank >= 2")


def hash_uniform(*parts: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) from a hash of the row's keys: the same on every run and partitioning."""
    return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def hard_negatives(queries: DataFrame, corpus: DataFrame, positives: DataFrame, k: int = 100, n: int = 15, metric: str = "l2sq", seed: int = 0) -> DataFrame:
    """N of the k nearest that are no positives (query_id, id), drawn without replacement by weight: a key u ** (1 / w) per row."""
    near = knn_exact(queries, corpus, k, metric).join(positives.select("query_id", "id"), ["query_id", "id"], "left_anti")
    weight = F.greatest(F.col("distance"), F.lit(1e-8)) if metric in DESCENDING else 1 / (F.col("distance") + 1e-8)
    drawn = near.withColumn("_key", F.log(hash_uniform("query_id", "id", seed=seed)) / weight)
    order = Window.partitionBy("query_id").orderBy(F.desc("_key"), "id")
    return drawn.withColumn("draw", F.row_number().over(order)).filter(F.col("draw") <= n).select("query_id", "id", "distance", "draw")


def random_negatives(queries: DataFrame, corpus: DataFrame, n: int = 5, seed: int = 0) -> DataFrame:
    """N different random rows per query, never the one with the query's own id (all others where they are fewer).

    The dense positions of the other rows, in the order of a hash, fall into n even parts, and each draw takes one place of its part:
    an equi-join on the position, so no pairs are made.
    """
    from kairograph.operators.metrics import dense_position

    placed = dense_position(corpus.select("id", F.xxhash64(F.lit(seed), "id").alias("_h")), "_h").select("id", "position")
    own = placed.select(F.col("id").alias("query_id"), F.col("position").alias("_own"))
    others = queries.select("query_id").join(own, "query_id", "left")
    others = others.withColumn("_m", F.lit(corpus.count()) - F.col("_own").isNotNull().cast("long"))
    draws = others.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    low, high = (F.floor(F.col("_m") * (F.col("draw") - d) / n) for d in (1, 0))
    at = low + F.floor(hash_uniform("query_id", "draw", seed=seed) * (high - low))
    draws = draws.filter(high > low).withColumn("position", at + F.coalesce(at >= F.col("_own"), F.lit(False)).cast("long"))
    return draws.select("query_id", "draw", "position").join(placed, "position").select("query_id", "draw", "id")


def similarity_counts(queries: DataFrame, corpus: DataFrame, bins: int = 20, low: float = 0.3, high: float = 0.8, block: int = QUERY_BLOCK) -> DataFrame:
    """(bucket, n, n_inside, total) of the cosines of each (query_id, embedding) with every row of (id, embedding) of another id.

    Buckets are of equal width over [-1, 1], from 1; ``n_inside`` counts cosines of ``low`` to ``high``. Blocks of queries are broadcast
    and tasks add up their cosines: a row per bucket and task is shuffled, never a pair. Zero vectors have cosine 0.
    """
    spark = corpus.sparkSession
    parts = max(1, -(-queries.count() // block))
    keyed = queries.select("query_id", "embedding").withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    out = None
    for b in range(parts):
        held = keyed.filter(F.col("_b") == b).select("query_id", "embedding").toArrow()
        shared = spark.sparkContext.broadcast((held.column(0).to_pylist(), matrix(held.column(1).combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            place, sums = {}, np.zeros((3, bins + 2))
            for k, name in enumerate(names):
                place.setdefault(name, []).append(k)
            for batch in batches:
                for at in range(0, batch.num_rows if names else 0, 1024):
                    piece = batch.slice(at, 1024)
                    c = -distances(q, matrix(piece.column(1)), "cosine")
                    other = np.ones(c.shape, bool)
                    for j, name in enumerate(piece.column(0).to_pylist()):
                        other[place.get(name, []), j] = False
                    c = c[other]
                    bucket = np.clip(np.floor((c + 1) * bins / 2).astype(np.int64) + 1, 1, bins + 1)
                    inside = (c >= low) & (c <= high)
                    for row, weights in enumerate((None, inside, c)):
                        sums[row] += np.bincount(bucket, weights, minlength=bins + 2)
            seen = np.flatnonzero(sums[0])
            columns = [pa.array(seen), *(pa.array(sums[r, seen].astype(np.int64)) for r in (0, 1)), pa.array(sums[2, seen])]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "n", "n_inside", "total"])

        found = corpus.select("id", "embedding").mapInArrow(run, "bucket long, n long, n_inside long, total double")
        out = found if out is None else out.unionAll(found)
    return out.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("n", "n_inside", "total")))


def similarity_share(counts: DataFrame) -> DataFrame:
    """The share of cosines inside the bounds of ``similarity_counts``; null without any."""
    sums = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_inside", "n")))
    return sums.select(F.try_divide("n_inside", "n").alias("share"), "n_inside", "n")


def similarity_histogram(counts: DataFrame) -> DataFrame:
    """V21"""
    return counts.select("bucket", "n", (F.col("total") / F.col("n")).alias("mean"))


def pca(corpus: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """(id, projection) and the cumulative share of variance."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = corpus.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(rows)
    return model.transform(rows).select("id", vector_to_array("p").alias("projection")), np.cumsum(model.explainedVariance.toArray()).tolist()


def elbow(corpus: DataFrame, ks=range(2, 12), seed: int = 42) -> DataFrame:
    """(k, inertia) of k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = corpus.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).cache()
    costs = [(k, float(KMeans(k=k, seed=seed).fit(rows).summary.trainingCost)) for k in ks]
    rows.unpersist()
    return corpus.sparkSession.createDataFrame(costs, "k int, inertia double")


def index_statistics(level_vectors: DataFrame) -> DataFrame:
    """V24"""
    return level_vectors.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim"))


def check_dimensions(rows: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the right length, and the others."""
    good = F.coalesce(F.size("embedding") == dim, F.lit(False))
    return rows.filter(good), rows.filter(~good)


def save_levels(vectors: DataFrame, members: DataFrame, path: str) -> None:
    """Both tables, partitioned by level."""
    vectors.write.partitionBy("level").parquet(f"{path}/vectors")
    members.write.partitionBy("level").parquet(f"{path}/members")


def load_levels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/members")
