"""Ranking, classification and language-model metrics over prediction tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.functions.vectors import dot, log_sum_exp, total
from kairograph.sources.shared import written

MODES, LEVELS, KS = (0, 1, 2), (0, 1, 2, 3), (1, 5, 10, 20)
THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- ranking (E1 to E7) ---


def precision_at_k(predicted: Column | str, truth: Column | str, k: int) -> Column:
    """Hits in the first k, divided by k even if fewer came; without truth 0."""
    if k <= 0:
        raise ValueError("k must be positive")
    hits = F.size(F.filter(F.slice(_c(predicted), 1, k), lambda p: F.array_contains(_c(truth), p)))
    return F.when(F.size(_c(truth)) > 0, hits / F.lit(k)).otherwise(F.lit(0.0))


def judged(found: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """(query_id, key, predicted, truth): the ids found by rank, and those of them that are true, from rows (query_id, key, rank, id)
    and true rows (key, id).

    Each id found is looked up with its key, so what is true of a key is never one list: the lists are as long as what was
    found. For precision and reciprocal rank that is as good as all that is true.
    """
    known = truth.select(key, "id").distinct().withColumn("_true", F.lit(True))
    marked = found.join(known, [key, "id"], "left")
    lists = marked.groupBy("query_id", key).agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.coalesce("_true", F.lit(False)).alias("hit")))).alias("_x"))
    ids = lambda x: F.transform(x, lambda v: v["id"])
    return lists.select("query_id", key, ids("_x").alias("predicted"), ids(F.filter("_x", lambda v: v["hit"])).alias("truth"))


def reciprocal_rank(predicted: Column | str, truth: Column | str) -> Column:
    first = F.array_position(F.transform(_c(predicted), lambda p: F.array_contains(_c(truth), p)), True)
    return F.when(first > 0, 1.0 / first).otherwise(F.lit(0.0))


def class_accuracy(rows: DataFrame, predicted: str, true: str, classes: Sequence[int]) -> DataFrame:
    """(class, accuracy, n) for each class, 0 where it has no rows, and overall (class null)."""
    both = rows.filter(F.col(predicted).isNotNull() & F.col(true).isNotNull())
    hit = F.avg((F.col(predicted) == F.col(true)).cast("double"))
    found = both.rollup(F.col(true).alias("class")).agg(hit.alias("accuracy"), F.count(F.lit(1)).alias("n"))
    wanted = rows.sparkSession.createDataFrame([(c,) for c in classes] + [(None,)], "wanted int")
    joined = F.broadcast(wanted).join(found, F.col("wanted").eqNullSafe(F.col("class")), "left")
    return joined.select(F.col("wanted").alias("class"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), F.coalesce("n", F.lit(0)).alias("n"))


def retrieval_report(rows: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """E5: mean P@k, MRR, mode and level accuracy and the number of queries, in one aggregation; null optional columns skip only their metric."""
    hit = lambda p, t: F.coalesce(F.avg(F.when(F.col(p).isNotNull() & F.col(t).isNotNull(), (F.col(p) == F.col(t)).cast("double"))), F.lit(0.0))
    return rows.agg(
        *[F.avg(precision_at_k("predicted", "truth", k)).alias(f"p_at_{k}") for k in ks],
        F.avg(reciprocal_rank("predicted", "truth")).alias("mrr"),
        hit("predicted_temporal", "true_temporal").alias("temporal_accuracy"),
        hit("predicted_granularity", "true_granularity").alias("granularity_accuracy"),
        F.count(F.lit(1)).alias("num_queries"),
    )


def stratified_report(rows: DataFrame, strata: Sequence[str] = ("relation_type", "entity_frequency_bin", "temporal_complexity")) -> DataFrame:
    """P@1, MRR and number by each stratum on its own; rows where it is null are left out."""
    scored = rows.select(*strata, precision_at_k("predicted", "truth", 1).alias("p1"), reciprocal_rank("predicted", "truth").alias("rr"))
    long = scored.select("p1", "rr", F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("value")) for s in strata])).alias("s"))
    long = long.select("p1", "rr", "s.*").filter("value is not null")
    return long.groupBy("stratum", "value").agg(F.avg("p1").alias("p_at_1"), F.avg("rr").alias("mrr"), F.count(F.lit(1)).alias("n"))


def contrastive_metrics(rows: DataFrame, ks: Sequence[int] = (1, 5)) -> DataFrame:
    """hit@k and MRR of the positive among the negatives by dot product (columns query, positive, negatives)."""
    rank = F.size(F.filter(F.transform("negatives", lambda n: dot("query", n)), lambda s: s > F.col("_positive"))) + 1
    ranked = rows.withColumn("_positive", dot("query", "positive")).withColumn("_rank", rank)
    return ranked.agg(*[F.avg((F.col("_rank") <= k).cast("double")).alias(f"hit_at_{k}") for k in ks], F.avg(1.0 / F.col("_rank")).alias("mrr"), F.count(F.lit(1)).alias("n"))


# --- classification (E8 to E12) ---


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(rows: DataFrame, predicted: str = "predicted", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Counts and ratios, 0 where undefined."""
    p, y = F.col(predicted).cast("boolean"), F.col(label).cast("boolean")
    counts = rows.groupBy(*by).agg(F.count_if(p & y).alias("tp"), F.count_if(~p & ~y).alias("tn"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.select(
        *by, "tp", "tn", "fp", "fn", _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        _ratio(2 * precision * recall, precision + recall).alias("f1"), _ratio(tn, tn + fp).alias("specificity"),
    )


def metrics_at_threshold(rows: DataFrame, threshold: float, prob: str = "prob", label: str = "label", strict: bool = False) -> DataFrame:
    """A row is positive at or above the threshold, above it if ``strict``."""
    p = F.col(prob) > threshold if strict else F.col(prob) >= threshold
    return confusion(rows.withColumn("predicted", p), label=label)


def threshold_sweep(rows: DataFrame, thresholds: Sequence[float] = THRESHOLDS, prob: str = "prob", label: str = "label") -> DataFrame:
    """Metrics at each of a short list of thresholds, and which is best by F1 (the first wins ties)."""
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("position"), F.lit(float(t)).alias("threshold")) for k, t in enumerate(thresholds)]))
    spread = rows.select(prob, label, at.alias("t")).select(prob, label, "t.*").withColumn("predicted", F.col(prob) >= F.col("threshold"))
    swept = confusion(spread, label=label, by=["position", "threshold"])
    best = swept.agg(F.min_by("position", F.struct(-F.col("f1"), F.col("position"))).alias("best"))
    return swept.crossJoin(F.broadcast(best)).withColumn("is_best", F.col("position") == F.col("best")).drop("best", "position")


def calibration_error(rows: DataFrame, bins: int = 10, prob: str = "prob", label: str = "label") -> DataFrame:
    """Expected calibration error over equal bins, closed below, the last closed above too."""
    edges = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    at = F.size(F.filter(edges, lambda e: e <= F.col(prob))).alias("bin")
    binned = rows.filter(F.col(prob).between(0, 1)).groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("p"), F.avg(F.col(label).cast("double")).alias("y"))
    return binned.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), F.lit(0.0)).alias("ece"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def error_quartiles(rows: DataFrame, position: str, prob: str = "prob", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Error rate by quartile of the dense position from 0 (see ``dense_position``)."""
    n = rows.agg(F.count(F.lit(1)).alias("total"))
    quartile = F.least(F.lit(3), F.floor(4 * F.col(position) / F.col("total"))).cast("int")
    wrong = ((F.col(prob) >= threshold) != F.col(label).cast("boolean")).cast("double")
    return rows.crossJoin(F.broadcast(n)).groupBy(quartile.alias("quartile")).agg(F.avg(wrong).alias("error_rate"), F.count(F.lit(1)).alias("n"))


def first_errors(rows: DataFrame, position: str, prob: str = "prob", label: str = "label", threshold: float = 0.5, k: int = 50) -> DataFrame:
    """The first k false positives and k false negatives by position: a top-k, not a full sort."""
    p, y = F.col(prob) >= threshold, F.col(label).cast("boolean")
    pick = lambda where, kind: rows.filter(where).orderBy(position).limit(k).withColumn("kind", F.lit(kind))
    return pick(p & ~y, "false_positive").unionAll(pick(~p & y, "false_negative"))


def dense_position(rows: DataFrame, order: str, name: str = "position") -> DataFrame:
    """Positions from 0 in the order of a column: range-partitioned, numbered within partitions and shifted by the rows before."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order)
    return _numbered(dealt, order, name)


def _numbered(dealt: DataFrame, order: str, name: str) -> DataFrame:
    # written: ranges come from a sample, and each plan that deals the rows anew may draw another one and cut elsewhere
    tagged = written(dealt.withColumn("_part", F.spark_partition_id()), "dealt")
    ranked = tagged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    shifts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return ranked.join(F.broadcast(shifts.select("_part", "_shift")), "_part").withColumn(name, F.col("_shift") + F.col("_rank") - 1).drop("_part", "_rank", "_shift")


# --- language modelling (E13 to E15, E20 to E22) ---


def _perplexity(loss: Column, where: Column | None = None) -> Column:
    mean = F.avg(loss if where is None else F.when(where, loss))
    return F.coalesce(F.exp(mean), F.lit(float("inf")))


def perplexity_split(losses: DataFrame, loss: str = "loss", retrieval: str = "is_retrieval") -> DataFrame:
    """Perplexity over all tokens, generated and retrieved ones; infinite without tokens."""
    own, where = F.col(loss), F.col(retrieval)
    return losses.agg(_perplexity(own).alias("overall"), _perplexity(own, ~where).alias("generation"), _perplexity(own, where).alias("retrieval"), F.count(F.lit(1)).alias("n"), F.count_if(where).alias("n_retrieval"))


def token_nll(rows: DataFrame, ignore: int = -100) -> DataFrame:
    """Summed loss and number of tokens from (seq_id, pos, logits, label): the logits of a position predict the next one's label."""
    following = F.lead("label").over(Window.partitionBy("seq_id").orderBy("pos"))
    nll = log_sum_exp(F.col("logits")) - F.element_at("logits", F.col("next") + 1)
    kept = rows.withColumn("next", following).filter(F.col("next").isNotNull() & (F.col("next") != ignore))
    return kept.agg(F.coalesce(F.sum(nll), F.lit(0.0)).alias("loss_sum"), F.count(F.lit(1)).alias("n"))


def compare_with_baseline(ours: DataFrame, baseline: DataFrame) -> DataFrame:
    """Reduction of perplexity against a baseline, in percent too; 0 where the baseline is 0."""
    joined = ours.select(F.col("overall").alias("ours")).crossJoin(baseline.select(F.col("overall").alias("base")))
    change = F.col("base") - F.col("ours")
    return joined.select("ours", "base", change.alias("reduction"), F.when(F.col("base") == 0, 0.0).otherwise(100 * change / F.col("base")).alias("improvement_percent"))


def info_nce(rows: DataFrame, temperature: float = 0.07) -> DataFrame:
    """Mean loss of the positive among its negatives."""
    sims = F.concat(F.array(dot("query", "positive")), F.transform("negatives", lambda n: dot("query", n)))
    scaled = rows.withColumn("_s", F.transform(sims, lambda s: s / temperature))
    return scaled.agg(F.avg(log_sum_exp(F.col("_s")) - F.col("_s")[0]).alias("loss"), F.count(F.lit(1)).alias("n"))


def weighted_bce(rows: DataFrame, positive_weight: float = 1.0, smoothing: float = 0.0, logit: str = "logit", label: str = "label", mask: str = "mask") -> DataFrame:
    """Masked mean of the binary cross-entropy, label-smoothed, positives weighted."""
    x, y, m = F.col(logit), F.col(label) * (1 - smoothing) + 0.5 * smoothing, F.col(mask).cast("double")
    softplus = lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))
    loss = positive_weight * y * softplus(-x) + (1 - y) * softplus(x)
    return rows.agg((F.sum(loss * m) / F.greatest(F.sum(m), F.lit(1.0))).alias("loss"))


def combined_loss(router: DataFrame | None, retrieval: DataFrame | None, generation: DataFrame | None, weights: Sequence[float] = (1.0, 2.0, 1.0)) -> DataFrame:
    """Weighted sum of the parts that are there (one-row frames with column loss)."""
    parts = [(w, p) for w, p in zip(weights, (router, retrieval, generation)) if p is not None]
    terms = [p.select((F.col("loss") * w).alias("loss")) for w, p in parts]
    every = terms[0]
    for t in terms[1:]:
        every = every.unionAll(t)
    return every.agg(F.sum("loss").alias("loss"))


# --- text checks and scores (E16 to E19, E23 to E27) ---


def factual_accuracy(rows: DataFrame, text: str = "text", facts: str = "facts") -> DataFrame:
    """Share of expected facts (structs of subject, object, relation) whose two labels stand in the text, by relation and overall (null)."""
    each = rows.select(F.lower(text).alias("t"), F.explode(facts).alias("f"))
    said = F.contains("t", F.lower("f.subject")) & F.contains("t", F.lower("f.object"))
    relation = F.coalesce(F.nullif("f.relation", F.lit("")), F.lit("UNKNOWN"))
    return each.rollup(relation.alias("relation")).agg(F.avg(said.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


#: Words that mark the present and the past.
PRESENT_WORDS = ("is", "are", "has", "currently", "now", "present")
PAST_WORDS = ("was", "were", "had", "previously", "formerly", "historical")


def temporal_consistency(rows: DataFrame, text: str = "text", mode: str = "mode") -> DataFrame:
    """Share of texts whose words fit their mode, by mode and overall (null)."""
    own = F.split(F.lower(text), r"(?U)\s+")
    among = lambda listed: F.arrays_overlap(own, F.array(*map(F.lit, listed)))
    fits = (
        F.when(F.col(mode) == "CURRENT", among(PRESENT_WORDS) | ~among(PAST_WORDS))
        .when(F.col(mode) == "HISTORY", among(PAST_WORDS) | (F.length(text) < 20))
        .when(F.col(mode) == "AT_TIMESTAMP", F.length(text) > 0)
        .otherwise(F.lit(True))
    )
    return rows.rollup(mode).agg(F.avg(fits.cast("double")).alias("consistency"), F.count(F.lit(1)).alias("n"))


def overall_score(*parts: Column | str) -> Column:
    """Mean of the parts that are there."""
    there = F.filter(F.array(*map(_c, parts)), lambda x: x.isNotNull())
    return F.coalesce(F.try_divide(total(there), F.size(there)), F.lit(0.0))


def perplexity_part(perplexity: Column | str) -> Column:
    return 1 / (1 + F.log(_c(perplexity)))


def if_positive(score: Column | str) -> Column:
    return F.when(_c(score) > 0, _c(score))


def rolling_mean(rows: DataFrame, value: str, order: str, by: Sequence[str], width: int = 10) -> DataFrame:
    """Trailing mean of up to ``width`` rows, per run."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - width, 0)
    return rows.withColumn("rolling", F.avg(value).over(window))


def block_means(rows: DataFrame, value: str, step: str, by: Sequence[str], width: int = 10) -> DataFrame:
    """Mean per block of ``width`` steps."""
    return rows.groupBy(*by, F.floor(F.col(step) / width).alias("block")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def patience(rows: DataFrame, run: str, step: str, value: str, patience: int = 3, min_delta: float = 0.0, mode: str = "max") -> DataFrame:
    """(run, step, value, best, bad, stop): best so far beyond min_delta, evaluations since, and whether to stop.

    The rule depends on every earlier step, so a run's evaluations are folded in the order of their steps. They come sorted, in batches,
    and a task holds the state of one run only, however long the run. A null or NaN is no improvement.
    """
    sign = 1.0 if mode == "max" else -1.0
    schema = f"run {rows.schema[run].dataType.simpleString()}, step long, value double, best double, bad long, stop boolean"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, bad, stopped = object(), None, 0, False
        for batch in batches:
            out = []
            for name, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if name != now:
                    now, best, bad, stopped = name, None, 0, False
                if v is not None and v == v and (best is None or sign * v > sign * best + min_delta):
                    best, bad = v, 0
                else:
                    bad += 1
                    stopped = stopped or bad >= patience
                out.append((best, bad, stopped))
            states = zip(*out) if out else ([], [], [])
            columns = [pa.array(x, t) for x, t in zip(states, (pa.float64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["run", "step", "value", "best", "bad", "stop"])

    given = rows.select(F.col(run).alias("run"), F.col(step).cast("long").alias("step"), F.col(value).cast("double").alias("value"))
    return given.repartition("run").sortWithinPartitions("run", "step", "value").mapInArrow(fold, schema)


def confidence_margins(rows: DataFrame, threshold: float, width: float = 0.1, prob: str = "prob", label: str = "label") -> DataFrame:
    """Histogram of the distance from the threshold, by whether the row is right."""
    right = (F.col(prob) >= threshold) == F.col(label).cast("boolean")
    bucket = F.floor(F.round(F.abs(F.col(prob) - threshold) / width, 9)).cast("long")
    return rows.groupBy(right.alias("correct"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def summary_table(report: DataFrame, component: str) -> DataFrame:
    """A one-row report as (component, metric, value) rows."""
    numbers = [c for c, t in report.dtypes if t in ("double", "float", "int", "bigint")]
    values = report.select(*[F.col(c).cast("double").alias(c) for c in numbers])
    return values.unpivot([], numbers, "metric", "value").select(F.lit(component).alias("component"), "metric", "value")
