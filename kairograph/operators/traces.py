"""Analytics on generation traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten_facts(rows: DataFrame, facts: str = "retrieved") -> DataFrame:
    """G1: one row per retrieved fact of a list of lists, labels and scores with their fallbacks."""
    each = rows.select("response_id", F.posexplode(F.flatten(facts)).alias("pos", "f"))
    pick = lambda *names: F.coalesce(*[F.col(f"f.{n}") for n in names])
    return each.select(
        "response_id", "pos", F.col("f.fact_id").alias("fact_id"), pick("subject_label", "subject").alias("subject"), pick("relation_type", "relation").alias("relation"),
        pick("object_label", "object").alias("object"), pick("confidence", "score").alias("confidence"),
    )


def normalise_decisions(rows: DataFrame, decisions: str = "decisions", threshold: float = 0.5) -> DataFrame:
    """One row per decision of an array of text: a number is a probability, other text the decision itself."""
    each = rows.select("response_id", F.posexplode(decisions).alias("step", "d"))
    p = F.col("d").try_cast("double")
    decision = F.when(p.isNull(), F.lower("d")).when(p >= threshold, "retrieval").otherwise("generation")
    probability = F.coalesce(p, F.when(F.lower("d") == "retrieval", 1.0).otherwise(0.0))
    return each.select("response_id", "step", probability.alias("probability"), decision.alias("decision"))


def routing_fractions(decisions: DataFrame, responses: DataFrame) -> DataFrame:
    """Per response the steps, retrievals and both fractions; a response without steps counts as one of generation."""
    counts = decisions.groupBy("response_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("decision") == "retrieval").alias("retrievals"))
    joined = responses.select("response_id").join(counts, "response_id", "left").fillna(0, ["steps", "retrievals"])
    whole = F.greatest(F.col("steps"), F.lit(1))
    return joined.select("response_id", "steps", "retrievals", (F.col("retrievals") / whole).alias("retrieval_fraction"), ((whole - F.col("retrievals")) / whole).alias("generation_fraction"))


def _bound(tokens: Column | str, body) -> Column:
    """``body`` of the tokens, evaluated once however often the body uses them."""
    return F.transform(F.array(F.col(tokens) if isinstance(tokens, str) else tokens), body)[0]


def repeated_ngram(tokens: Column | str, n: int) -> Column:
    """Whether the last n tokens stand earlier too, without touching themselves; at least 2n tokens are needed."""

    def body(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(t) - (2 * n - 1))
        found = F.transform(F.array(F.slice(t, -n, n)), lambda last: F.exists(starts, lambda i: F.slice(t, i, n) == last))[0]
        return F.when(F.size(t) < 2 * n, F.lit(False)).otherwise(found)

    return _bound(tokens, body)


def degenerate_loop(tokens: Column | str, run: int = 6, least: int = 12, repeats: int = 4, patterns: tuple[int, int] = (2, 6)) -> Column:
    """Whether the tail is one token ``run`` times, or a short pattern ``repeats`` times over (from ``least`` tokens on)."""

    def body(t: Column) -> Column:
        flag = F.when(F.size(t) >= run, F.size(F.array_distinct(F.slice(t, -run, run))) == 1).otherwise(F.lit(False))
        for length in range(patterns[0], patterns[1] + 1):
            whole = repeats * length
            tail, pattern = F.slice(t, -whole, whole), F.slice(t, -length, length)
            flag = flag | F.when(F.size(t) >= max(least, whole), tail == F.flatten(F.array_repeat(pattern, repeats))).otherwise(F.lit(False))
        return flag

    return F.coalesce(_bound(tokens, body), F.lit(False))
