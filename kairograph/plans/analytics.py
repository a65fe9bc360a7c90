"""Queries on predictions, traces, usage and coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kairograph.operators import accounting as A
from kairograph.operators import metrics as M
from kairograph.operators import traces as G
from kairograph.operators import vectors as V
from kairograph.plans.fixtures import table


def neighbours(spark, sf_dir, k=20):
    """Every tenth vector asks for its nearest among all others; truth is the same label."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    queries = e.filter("id % 10 = 0").select(F.col("id").alias("query_id"), "embedding", "label")
    found = V.knn_exact(queries, e, k + 1).withColumn("self", F.col("id") == F.col("query_id"))
    ahead = F.max(F.when(F.col("self"), F.col("rank"))).over(Window.partitionBy("query_id"))  # k + 1 rows
    found = found.withColumn("rank", F.col("rank") - (F.col("rank") > F.coalesce(ahead, F.lit(k + 1))).cast("int")).filter(f"not self and rank <= {k}")
    return found.join(queries.select("query_id", "label"), "query_id").select("query_id", "label", "rank", "id"), e.select("label", "id")


def predictions(spark, sf_dir):
    rows = M.judged(*neighbours(spark, sf_dir), "label")
    q = F.col("query_id")
    return rows.select(
        "query_id", "predicted", "truth", (q % 3).cast("int").alias("predicted_temporal"), F.when(q % 7 != 0, (q % 2).cast("int")).alias("true_temporal"),
        (q % 4).cast("int").alias("predicted_granularity"), (F.floor(q / 10) % 4).cast("int").alias("true_granularity"), F.when(q % 20 == 0, F.concat(F.lit("rel"), F.col("label"))).alias("relation_type"),
        F.when(q % 3 == 0, "rare").otherwise("frequent").alias("entity_frequency_bin"), F.lit(None).cast("string").alias("temporal_complexity"),
    )


def router_scores(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", ((F.col("doc_id") * 37 % 101) / 100).alias("prob"), (F.col("quality") == 1).alias("label"))


def losses(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("value") / 100).alias("loss"), F.col("event_type").isin("click", "view").alias("is_retrieval"))


def retrieval_report(spark, sf_dir):
    return M.retrieval_report(predictions(spark, sf_dir))


def retrieval_strata(spark, sf_dir):
    return M.stratified_report(predictions(spark, sf_dir))


def mode_accuracy(spark, sf_dir):
    return M.class_accuracy(predictions(spark, sf_dir), "predicted_temporal", "true_temporal", M.MODES)


def level_accuracy(spark, sf_dir):
    return M.class_accuracy(predictions(spark, sf_dir), "predicted_granularity", "true_granularity", M.LEVELS)


def contrastive(spark, sf_dir):
    """Each vector's positive is the next id, its negatives the ones after that."""
    return M.contrastive_metrics(_contrastive_rows(spark, sf_dir))


def _contrastive_rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    near = e.select(F.col("vec_id").alias("other"), F.col("embedding").alias("v"))
    wanted = e.select("vec_id", "embedding", F.posexplode(F.array(*[F.col("vec_id") + k for k in range(1, 6)])).alias("pos", "other"))
    rows = wanted.join(near, "other").groupBy("vec_id").agg(F.any_value("embedding").alias("query"), F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("vs"))
    rows = rows.filter(F.size("vs") == 5)
    return rows.select("vec_id", "query", F.col("vs")[0]["v"].alias("positive"), F.transform(F.slice("vs", 2, 4), lambda x: x["v"]).alias("negatives"))


def info_nce(spark, sf_dir):
    return M.info_nce(_contrastive_rows(spark, sf_dir))


def router_confusion(spark, sf_dir):
    return M.metrics_at_threshold(router_scores(spark, sf_dir), 0.5)


def router_strict(spark, sf_dir):
    return M.metrics_at_threshold(router_scores(spark, sf_dir), 0.5, strict=True)


def router_sweep(spark, sf_dir):
    return M.threshold_sweep(router_scores(spark, sf_dir))


def calibration(spark, sf_dir):
    return M.calibration_error(router_scores(spark, sf_dir))


def error_quartiles(spark, sf_dir):
    return M.error_quartiles(M.dense_position(router_scores(spark, sf_dir), "doc_id"), "position")


def first_errors(spark, sf_dir):
    return M.first_errors(router_scores(spark, sf_dir), "doc_id").select("doc_id", "kind")


def confidence_margins(spark, sf_dir):
    return M.confidence_margins(router_scores(spark, sf_dir), 0.5)


def perplexity_split(spark, sf_dir):
    return M.perplexity_split(losses(spark, sf_dir))


def baseline_comparison(spark, sf_dir):
    own = losses(spark, sf_dir)
    return M.compare_with_baseline(M.perplexity_split(own), M.perplexity_split(own.withColumn("loss", F.col("loss") * 1.1)))


def summary_table(spark, sf_dir):
    return M.summary_table(M.metrics_at_threshold(router_scores(spark, sf_dir), 0.5), "router")


def weighted_bce(spark, sf_dir):
    rows = router_scores(spark, sf_dir).select((F.col("prob") * 8 - 4).alias("logit"), F.col("label").cast("double").alias("label"), (F.col("doc_id") % 5 != 0).alias("mask"))
    return M.weighted_bce(rows, positive_weight=2.0, smoothing=0.1)


def token_nll(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 10).alias("seq_id"), F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("logits"), F.when(F.col("vec_id") % 4 == 0, -100).otherwise(F.col("label")).alias("label"))
    return M.token_nll(rows)


def metric_rolling(spark, sf_dir):
    return M.rolling_mean(losses(spark, sf_dir), "loss", "event_id", ["user_id"]).select("event_id", F.round("rolling", 9).alias("rolling"))


def metric_blocks(spark, sf_dir):
    return M.block_means(losses(spark, sf_dir), "loss", "event_id", ["user_id"], 100).withColumn("mean", F.round("mean", 9))


def patience(spark, sf_dir):
    return M.patience(losses(spark, sf_dir), "user_id", "event_id", "loss", 3, 0.1, "min")


def factual_accuracy(spark, sf_dir):
    words = F.split("text", " ")
    fact = F.struct(F.upper(F.coalesce(F.get(words, F.lit(0)), F.lit(""))).alias("subject"), F.when(F.col("turn") % 2 == 0, F.coalesce(F.get(words, F.lit(2)), F.lit(""))).otherwise("zzz").alias("object"), F.when(F.col("turn") % 3 > 0, F.col("role")).alias("relation"))
    return M.factual_accuracy(table(spark, sf_dir, "conversations").select("text", F.array(fact).alias("facts")))


def temporal_consistency(spark, sf_dir):
    modes = F.element_at(F.array(F.lit("CURRENT"), F.lit("HISTORY"), F.lit("AT_TIMESTAMP"), F.lit("OTHER")), (F.col("turn") % 4 + 1).cast("int"))
    return M.temporal_consistency(table(spark, sf_dir, "conversations").withColumn("mode", modes))


def trace_fractions(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    rows = turns.groupBy(F.col("conv_id").alias("response_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "user", "retrieval").otherwise("0.2").alias("d")))).alias("x"))
    decisions = G.normalise_decisions(rows.select("response_id", F.transform("x", lambda v: v["d"]).alias("decisions")))
    return G.routing_fractions(decisions, rows)


def trace_loops(spark, sf_dir):
    tokens = F.split("text", " ")
    return table(spark, sf_dir, "documents").select("doc_id", G.repeated_ngram(tokens, 3).alias("repeated"), G.degenerate_loop(tokens).alias("looping"))


def usage_window(spark, sf_dir):
    return A.usage_window(table(spark, sf_dir, "events").withColumn("t", F.length("props").cast("long")), "user_id", "ts", "t", 3600, 2, 60).select("event_id", "requests", "tokens", "over_limit")


def usage_cost(spark, sf_dir):
    model = F.element_at(F.array(F.lit("x-haiku-4-5"), F.lit("haiku-3"), F.lit("sonnet"), F.lit("")), (F.col("event_id") % 4 + 1).cast("int"))
    return A.usage_cost(table(spark, sf_dir, "events").select(model.alias("model"), F.length("props").alias("input_tokens"), F.length("event_type").alias("output_tokens"))).withColumn("cost", F.round("cost", 6))


def coverage(spark, sf_dir):
    docs, done = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return A.coverage(docs, done, "doc_id", "labels", 0.9)


def pending(spark, sf_dir):
    return A.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


def chunk_estimate(spark, sf_dir):
    return A.chunk_estimate(table(spark, sf_dir, "documents"), "n_chars")


def relation_cost(spark, sf_dir):
    return A.relation_cost(table(spark, sf_dir, "documents"), model="haiku")


def label_cost(spark, sf_dir):
    return A.label_cost(table(spark, sf_dir, "documents"))


def size_profile(spark, sf_dir):
    return A.size_profile(table(spark, sf_dir, "documents"), "n_chars")


_NAMES = """retrieval_report retrieval_strata mode_accuracy level_accuracy contrastive info_nce router_confusion router_strict router_sweep calibration error_quartiles first_errors
confidence_margins perplexity_split baseline_comparison summary_table weighted_bce token_nll metric_rolling metric_blocks patience factual_accuracy temporal_consistency trace_fractions trace_loops
usage_window usage_cost coverage pending chunk_estimate relation_cost label_cost size_profile""".split()
QUERIES = {k: globals()[k] for k in _NAMES}

_KNN = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
near AS (
  SELECT q.vec_id AS query_id, q.label AS ql, c.label AS cl, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, c.v), c.vec_id) AS rank
  FROM e q, e c WHERE q.vec_id % 10 = 0 AND c.vec_id <> q.vec_id),
scored AS (
  SELECT query_id, any_value(ql) AS label, count(*) FILTER (rank <= 1 AND ql = cl) / 1 AS p1, count(*) FILTER (rank <= 5 AND ql = cl) / 5 AS p5, count(*) FILTER (rank <= 10 AND ql = cl) / 10 AS p10,
    count(*) FILTER (rank <= 20 AND ql = cl) / 20 AS p20, coalesce(1.0 / min(rank) FILTER (rank <= 20 AND ql = cl), 0.0) AS rr
  FROM near GROUP BY query_id)"""
_SCORES = "s AS (SELECT doc_id, (doc_id * 37 % 101) / 100 AS prob, quality = 1 AS label FROM labels)"
_CONFUSION = """tp, tn, fp, fn, coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0.0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0.0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1, coalesce(tn / nullif(tn + fp, 0), 0.0) AS specificity"""
_COUNTS = "count(*) FILTER (p AND label) AS tp, count(*) FILTER (NOT p AND NOT label) AS tn, count(*) FILTER (p AND NOT label) AS fp, count(*) FILTER (NOT p AND label) AS fn"
_LOSS = "l AS (SELECT event_id, user_id, value / 100 AS loss, event_type IN ('click', 'view') AS r FROM events)"
_CONTRAST = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sims AS (SELECT a.vec_id, b.vec_id - a.vec_id AS k, list_inner_product(a.v, b.v) AS s FROM e a JOIN e b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 5),
rows AS (SELECT vec_id, max(s) FILTER (k = 1) AS pos, list(s) AS ss FROM sims GROUP BY vec_id HAVING count(*) = 5)"""
_ACCURACY = """SELECT w.class, coalesce(avg(CAST(p = t AS INT)), 0.0) AS accuracy, count(t) AS n FROM (SELECT unnest({classes}) AS class) w LEFT JOIN ({rows}) x ON x.t = w.class GROUP BY w.class
UNION ALL SELECT NULL, coalesce(avg(CAST(p = t AS INT)), 0.0), count(*) FROM ({rows}) WHERE t IS NOT NULL"""
_PPL = "exp(avg(loss)) AS overall, exp(avg(loss) FILTER (NOT r)) AS generation, exp(avg(loss) FILTER (r)) AS retrieval, count(*) AS n, count(*) FILTER (r) AS n_retrieval"
SQL = {
    "retrieval_report": f"""WITH {_KNN} SELECT avg(p1) AS p_at_1, avg(p5) AS p_at_5, avg(p10) AS p_at_10, avg(p20) AS p_at_20, avg(rr) AS mrr,
      avg(CASE WHEN query_id % 7 <> 0 THEN CAST(query_id % 3 = query_id % 2 AS INT) END) AS temporal_accuracy, avg(CAST(query_id % 4 = query_id // 10 % 4 AS INT)) AS granularity_accuracy, count(*) AS num_queries FROM scored""",
    "retrieval_strata": f"""WITH {_KNN}, s AS (SELECT p1, rr, 'relation_type' AS stratum, CASE WHEN query_id % 20 = 0 THEN 'rel' || CAST(label AS VARCHAR) END AS value FROM scored
      UNION ALL SELECT p1, rr, 'entity_frequency_bin', CASE WHEN query_id % 3 = 0 THEN 'rare' ELSE 'frequent' END FROM scored) SELECT stratum, value, avg(p1) AS p_at_1, avg(rr) AS mrr, count(*) AS n FROM s WHERE value IS NOT NULL GROUP BY stratum, value""",
    "mode_accuracy": _ACCURACY.format(classes="[0, 1, 2]", rows="SELECT vec_id % 3 AS p, CASE WHEN vec_id % 7 <> 0 THEN vec_id % 2 END AS t FROM embeddings WHERE vec_id % 10 = 0"),
    "level_accuracy": _ACCURACY.format(classes="[0, 1, 2, 3]", rows="SELECT vec_id % 4 AS p, vec_id // 10 % 4 AS t FROM embeddings WHERE vec_id % 10 = 0"),
    "contrastive": f"WITH {_CONTRAST}, r AS (SELECT 1 + len(list_filter(ss, lambda x: x > pos)) AS rank FROM rows) SELECT avg(CAST(rank <= 1 AS INT)) AS hit_at_1, avg(CAST(rank <= 5 AS INT)) AS hit_at_5, avg(1.0 / rank) AS mrr, count(*) AS n FROM r",
    "info_nce": f"WITH {_CONTRAST} SELECT avg(ln(list_sum(list_transform(ss, lambda x: exp((x - pos) / 0.07))))) AS loss, count(*) AS n FROM rows",
    "router_confusion": f"WITH {_SCORES}, c AS (SELECT {_COUNTS} FROM (SELECT *, prob >= 0.5 AS p FROM s)) SELECT {_CONFUSION} FROM c",
    "router_strict": f"WITH {_SCORES}, c AS (SELECT {_COUNTS} FROM (SELECT *, prob > 0.5 AS p FROM s)) SELECT {_CONFUSION} FROM c",
    "router_sweep": f"""WITH {_SCORES}, t AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE AS threshold), c AS (SELECT threshold, {_COUNTS} FROM (SELECT *, prob >= threshold AS p FROM s, t) GROUP BY threshold), m AS (SELECT threshold, {_CONFUSION} FROM c)
      SELECT *, threshold = (SELECT threshold FROM m ORDER BY round(f1, 12) DESC, threshold LIMIT 1) AS is_best FROM m""",
    "calibration": f"WITH {_SCORES}, b AS (SELECT count(*) AS n, avg(prob) AS p, avg(CAST(label AS INT)) AS y FROM s GROUP BY len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[], lambda e: e <= prob))) SELECT sum(n * abs(p - y)) / sum(n) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b",
    "error_quartiles": f"WITH {_SCORES}, r AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS total FROM s) SELECT CAST(least(3, 4 * pos // total) AS INT) AS quartile, avg(CAST((prob >= 0.5) <> label AS INT)) AS error_rate, count(*) AS n FROM r GROUP BY 1",
    "first_errors": f"WITH {_SCORES} (SELECT doc_id, 'false_positive' AS kind FROM s WHERE prob >= 0.5 AND NOT label ORDER BY doc_id LIMIT 50) UNION ALL (SELECT doc_id, 'false_negative' FROM s WHERE prob < 0.5 AND label ORDER BY doc_id LIMIT 50)",
    "confidence_margins": f"WITH {_SCORES} SELECT (prob >= 0.5) = label AS correct, CAST(floor(round(abs(prob - 0.5) / 0.1, 9)) AS BIGINT) AS bucket, count(*) AS n FROM s GROUP BY 1, 2",
    "perplexity_split": f"WITH {_LOSS} SELECT {_PPL} FROM l",
    "baseline_comparison": f"WITH {_LOSS}, c AS (SELECT exp(avg(loss)) AS ours, exp(avg(loss * 1.1)) AS base FROM l) SELECT ours, base, base - ours AS reduction, 100 * (base - ours) / base AS improvement_percent FROM c",
    "summary_table": f"""WITH {_SCORES}, c AS (SELECT {_COUNTS} FROM (SELECT *, prob >= 0.5 AS p FROM s)), m AS (SELECT {_CONFUSION} FROM c)
      SELECT 'router' AS component, metric, value FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM m) ON COLUMNS(*) INTO NAME metric VALUE value)""",
    "weighted_bce": f"WITH {_SCORES}, r AS (SELECT prob * 8 - 4 AS x, CAST(label AS DOUBLE) * 0.9 + 0.05 AS y FROM s WHERE doc_id % 5 <> 0) SELECT sum(2 * y * ln(1 + exp(-x)) + (1 - y) * ln(1 + exp(x))) / count(*) AS loss FROM r",
    "token_nll": """WITH r AS (SELECT CAST(embedding AS DOUBLE[]) AS x, lead(CASE WHEN vec_id % 4 = 0 THEN -100 ELSE label END) OVER (PARTITION BY vec_id % 10 ORDER BY vec_id) AS y FROM embeddings)
      SELECT sum(ln(list_sum(list_transform(x, lambda v: exp(v)))) - x[y + 1]) AS loss_sum, count(*) AS n FROM r WHERE y IS NOT NULL AND y <> -100""",
    "metric_rolling": f"WITH {_LOSS} SELECT event_id, round(avg(loss) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9) AS rolling FROM l",
    "metric_blocks": f"WITH {_LOSS} SELECT user_id, event_id // 100 AS block, round(avg(loss), 9) AS mean, count(*) AS n FROM l GROUP BY 1, 2",
    "factual_accuracy": """WITH f AS (SELECT lower(text) AS t, lower(coalesce(string_split(text, ' ')[1], '')) AS s, lower(CASE WHEN turn % 2 = 0 THEN coalesce(string_split(text, ' ')[3], '') ELSE 'zzz' END) AS o, CASE WHEN turn % 3 > 0 THEN role ELSE 'UNKNOWN' END AS relation FROM conversations)
      SELECT relation, avg(CAST(contains(t, s) AND contains(t, o) AS INT)) AS accuracy, count(*) AS n FROM f GROUP BY ROLLUP (relation)""",
    "temporal_consistency": """WITH f AS (SELECT string_split_regex(lower(text), '\\s+') AS w, text, ['CURRENT', 'HISTORY', 'AT_TIMESTAMP', 'OTHER'][turn % 4 + 1] AS mode FROM conversations),
      h AS (SELECT mode, CASE mode WHEN 'CURRENT' THEN list_has_any(w, ['is', 'are', 'has', 'currently', 'now', 'present']) OR NOT list_has_any(w, ['was', 'were', 'had', 'previously', 'formerly', 'historical'])
        WHEN 'HISTORY' THEN list_has_any(w, ['was', 'were', 'had', 'previously', 'formerly', 'historical']) OR length(text) < 20 WHEN 'AT_TIMESTAMP' THEN length(text) > 0 ELSE TRUE END AS hit FROM f)
      SELECT mode, avg(CAST(hit AS INT)) AS consistency, count(*) AS n FROM h GROUP BY ROLLUP (mode)""",
    "trace_fractions": "SELECT conv_id AS response_id, count(*) AS steps, count(*) FILTER (role = 'user') AS retrievals, count(*) FILTER (role = 'user') / count(*) AS retrieval_fraction, count(*) FILTER (role <> 'user') / count(*) AS generation_fraction FROM conversations GROUP BY conv_id",
    "trace_loops": """WITH t AS (SELECT doc_id, string_split(text, ' ') AS w, len(string_split(text, ' ')) AS n FROM documents),
      g AS (SELECT doc_id, max(CAST(list_slice(w, i, i + 2) = list_slice(w, n - 2, n) AS INT)) = 1 AS repeated FROM (SELECT *, unnest(range(1, n - 4)) AS i FROM t WHERE n >= 6) GROUP BY doc_id),
      p AS (SELECT doc_id, bool_or(n >= greatest(12, 4 * k) AND list_slice(w, n - 4 * k + 1, n - k) = list_slice(w, n - 3 * k + 1, n)) AS pat FROM t, (SELECT unnest([2, 3, 4, 5, 6]) AS k) GROUP BY doc_id)
      SELECT doc_id, coalesce(repeated, FALSE) AS repeated, (n >= 6 AND len(list_distinct(list_slice(w, n - 5, n))) = 1) OR coalesce(pat, FALSE) AS looping FROM t LEFT JOIN g USING (doc_id) LEFT JOIN p USING (doc_id)""",
    "usage_window": """WITH w AS (SELECT event_id, count(*) OVER x AS requests, CAST(sum(length(props)) OVER x AS BIGINT) AS tokens FROM events WINDOW x AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW))
      SELECT *, requests > 2 OR tokens > 60 AS over_limit FROM w""",
    "usage_cost": """WITH u AS (SELECT ['x-haiku-4-5', 'haiku-3', 'sonnet', ''][event_id % 4 + 1] AS model, length(props) AS i, length(event_type) AS o FROM events)
      SELECT model, count(*) AS requests, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens,
        round(sum(i * CASE model WHEN 'x-haiku-4-5' THEN 1.0 WHEN 'haiku-3' THEN 0.25 ELSE 3.0 END + o * CASE model WHEN 'x-haiku-4-5' THEN 5.0 WHEN 'haiku-3' THEN 1.25 ELSE 15.0 END)::DOUBLE / 1e6, 6) AS cost FROM u GROUP BY model""",
    "coverage": "WITH d AS (SELECT DISTINCT doc_id FROM documents), l AS (SELECT DISTINCT doc_id FROM labels), c AS (SELECT count(*) AS total, count(l.doc_id) AS done FROM d LEFT JOIN l USING (doc_id)) SELECT 'labels' AS stage, total, done, total - done AS missing, done / total AS fraction, done / total >= 0.9 AS complete FROM c",
    "pending": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "chunk_estimate": "SELECT CAST(sum(ceil(n_chars / 192)) AS BIGINT) AS chunks, count(*) AS docs FROM documents",
    "relation_cost": "WITH c AS (SELECT count(*) AS texts, (sum(length(text)) + count(*) * 3000)::BIGINT // 4 AS input_tokens, count(*) * 500 AS output_tokens FROM documents) SELECT texts, input_tokens, output_tokens, input_tokens * 0.25 / 1e6 + output_tokens * 1.25 / 1e6 AS cost FROM c",
    "label_cost": """WITH c AS (SELECT count(*) AS texts, floor(count(*) * (1 - 0.55::DOUBLE))::BIGINT AS remote, avg(length(text)) AS chars FROM documents), d AS (SELECT *, greatest(1, remote // 10) AS calls FROM c)
      SELECT texts, remote, calls, floor(calls * 1250 + remote * chars / 4)::BIGINT AS input_tokens, remote * 8 AS output_tokens, floor(calls * 1250 + remote * chars / 4)::BIGINT * 3.0 / 1e6 + remote * 8 * 15.0 / 1e6 AS cost FROM d""",
    "size_profile": "SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS total, avg(n_chars) AS mean, median(n_chars) AS median FROM documents",
}
