"""Quality by hierarchical empirical Bayes: a document's classifier evidence with the posteriors of its host and path."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import materialize, text_or_empty
from kairograph.llm.quality_rules import CLASSES, COMMON_WORDS, let, words_of

#: Labelled rows the classifier is fitted on at most: those with the smallest hashes of their ids, about as many where there are more.
MAX_LABELLED = 20_000
FEATURES = ("log_words", "word_length", "distinct", "common", "new_lines", "dup_lines", *CLASSES)


def features(text_col: str = "text") -> Column:
    """Twelve rates of a text, as an array in the order of FEATURES; a text without words has zeros."""
    text = text_or_empty(text_col)
    common = sorted({w for x in COMMON_WORDS.values() for w in x})
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")

    def of_words(words: Column) -> Column:
        n = F.greatest(F.size(words), F.lit(1)).cast("double")
        lines = F.split(text, "\n")
        rates = [
            F.log1p(F.size(words).cast("double")),
            F.length(F.array_join(words, "")) / n / 10,
            F.size(F.array_distinct(words)) / n,
            F.size(F.filter(words, lambda w: w.isin(common))) / n,
            F.size(lines) / n,
            1 - F.size(F.array_distinct(lines)) / F.size(lines),
            *(F.regexp_count(text, F.lit(p)) / chars * 10 for p in CLASSES.values()),
        ]
        return F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in rates])

    return let(words_of(text), of_words)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression by Newton's method; with no rows all zero."""
    mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / spread])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[1:] / spread
    return np.concatenate([[w[0] - slopes @ mean], slopes])


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength (pseudo-documents) by moments: how far group means spread beyond what their sizes explain."""
    row = groups.select("s", "q", "n", mean.alias("m")).agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("m"), 2)).alias("between"),
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("groups"),
    ).first()
    if not row.n or row.n <= row.groups:
        return 10.0
    noise = max(row.within / (row.n - row.groups), 1e-9)
    spread = max((row.between - noise * row.groups) / row.n, noise / 1e4)
    return min(max(noise / spread, 1.0), 1e4)


def quality_posteriors(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
    threshold: float = 0.5,
) -> DataFrame:
    """(id, host, path, evidence, host_posterior, path_posterior, posterior, kept), one row per row of ``docs``.

    evidence: the classifier's probability for the text. Its sums by host and path are shrunk, hosts toward the
    mean of all and paths toward their host, by prior strengths estimated from the spread of the groups; a document is
    taken out of its own groups. posterior: log-odds of evidence and path posterior added, less those of the mean.
    Null texts count as empty, null hosts and paths as one group each; repeated ids get the label of their id; without
    labels every evidence is 0.5. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), features(text_col).alias("x"))
    rows = materialize(rows, "features")
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("y")).filter("label_id is not null and y in (0, 1)")
    labelled = materialize(rows.join(known, F.col("id") == F.col("label_id")).select("x", "y", F.xxhash64("id").alias("h")), "labelled")
    # the smallest hashes, by a threshold that leaves about as many as are wanted: nothing else reaches the driver
    share = min(1.0, max_labelled / max(1, labelled.count()))
    sample = labelled.filter(F.col("h").cast("double") <= (2 * share - 1) * 2.0**63).collect()
    sample = sorted(sample, key=lambda r: (r.h, r.y, r.x))[:max_labelled]
    x = np.array([r.x for r in sample], dtype=float).reshape(-1, len(FEATURES))
    weights = fit(x, np.array([r.y for r in sample], dtype=float))
    dot = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(w)) for w in weights[1:]]), lambda a, b: a * b), F.lit(float(weights[0])), lambda s, v: s + v)
    p = (1 / (1 + F.exp(-dot))).alias("p")
    scored = rows.select("id", "host", "path", F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p)).alias("p"))
    sums = [F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"), F.count(F.lit(1)).alias("n")]
    paths = materialize(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    whole = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = whole.s / whole.n if whole.n else 0.5
    host_k = _strength(hosts, F.lit(mean))
    host_sums = hosts.select("host", F.col("s").alias("host_s"), F.col("n").alias("host_n"))
    path_k = _strength(paths.join(host_sums, "host"), F.col("host_s") / F.col("host_n"))
    groups = paths.join(host_sums, "host").select("host", "path", "s", "n", "host_s", "host_n")
    joined = scored.join(groups, ["host", "path"])
    host_post = (F.col("host_s") - F.col("p") + F.lit(host_k * mean)) / (F.col("host_n") - 1 + F.lit(host_k))
    path_post = (F.col("s") - F.col("p") + F.lit(path_k) * F.col("host_posterior")) / (F.col("n") - 1 + F.lit(path_k))
    logit = lambda c: F.log(c / (1 - c))
    inside = lambda c: F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), c))
    out = joined.withColumn("host_posterior", inside(host_post)).withColumn("path_posterior", inside(path_post))
    odds = logit(F.col("p")) + logit(F.col("path_posterior")) - logit(inside(F.lit(mean)))
    out = out.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return out.select("id", "host", "path", F.col("p").alias("evidence"), "host_posterior", "path_posterior", "posterior", (F.col("posterior") >= threshold).alias("kept"))
