"""What is asked of the members of found keys comes from kinds of facts: no row for each query and member."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kairograph.operators import temporal as T
from kairograph.operators import vectors as V


def day(k):
    return datetime.date(2020, 1, 1) + datetime.timedelta(k)


def small_index(spark, n=60):
    rng = random.Random(5)
    rows = []
    for k in range(n):
        s = f"s{rng.randrange(4)}"
        o = rng.choice([s, "o1", "o2", "o3"])
        end = rng.choice([None, k + 9, k, k - 3])
        rows.append((f"f{k:02d}", s, o, None if k % 13 == 5 else day(k), None if end is None else day(end), [rng.random() for _ in range(3)]))
    facts = spark.createDataFrame(rows, "fact_id string, subject_id string, object_id string, valid_from date, valid_to date, embedding array<double>")
    clusters = facts.select(F.when(F.col("subject_id") != "s3", F.col("subject_id")).alias("cluster_id"), F.lit("rest").alias("anchor_entity"), "fact_id")
    clusters = clusters.union(facts.filter("object_id = 'o1'").selectExpr("'more'", "null", "fact_id"))
    return facts, *V.build_levels(facts.drop("embedding"), facts.select("fact_id", "embedding"), clusters)


@pytest.mark.parametrize("level", [0, 2, 3])
def test_ends_are_those_of_the_rows(spark, level):
    facts, vectors, members = small_index(spark)
    found = V.search_at_level(facts.select(F.col("fact_id").alias("query_id"), "embedding"), vectors, level, 3)
    rows = V.expand(found, members, level).groupBy("query_id").agg(F.count(F.lit(1)), F.min_by("fact_id", "position"), F.max_by("fact_id", "position"))
    want = sorted(map(tuple, rows.collect()))
    assert len(want) == 60 and sorted(map(tuple, V.expansion_ends(found, members, level).collect())) == want


def test_counts_are_those_of_the_rows(spark):
    facts, vectors, members = small_index(spark)
    one = lambda n, at: [float(i == at) for i in range(n)]
    v = [r.embedding for r in facts.orderBy("fact_id").collect()]
    rows = [(k, v[k % 60], one(4, k % 4), one(3, k // 4 % 3), None if k == 116 else day(k % 90 - 10)) for k in range(240)]
    queries = spark.createDataFrame(rows, "query_id long, embedding array<double>, granularity_logits array<double>, temporal_logits array<double>, as_of date")
    for asked in (queries, queries.filter("temporal_logits[1] = 0"), queries.limit(0)):
        want = V.resolve_queries(asked, vectors, members, facts.drop("embedding"), 3).groupBy("query_id").agg(F.count(F.lit(1)), F.min("fact_id"))
        assert sorted(map(tuple, V.resolved_counts(asked, vectors, members, facts.drop("embedding"), 3).collect())) == sorted(map(tuple, want.collect()))


def test_pieces_make_up_the_interval(spark):
    spans = spark.createDataFrame([(a, b) for a in range(23) for b in range(23)], "a int, b int")
    for r in spans.select("a", "b", T.aligned_pieces(F.col("a"), F.col("b"), 5).alias("p")).collect():
        assert sorted(x for p in r.p for x in range(p.at << p.size, (p.at + 1) << p.size)) == list(range(r.a, r.b))


@pytest.mark.parametrize("name", ["level_expand", "resolve_queries"])
def test_no_row_for_each_query_and_member(spark, data, name, monkeypatch):
    monkeypatch.setattr(V, "expand", None)
    assert entry.queries()[name](spark, data).count() > 0
