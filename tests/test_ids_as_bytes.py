"""Where facts must be dealt by their ids, these go as bytes and not as hex digits."""

import datetime

import __spark_entry__ as entry
from kairograph.operators import facts as K


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_is_sorted_by_bytes(spark, data):
    found = entry.queries()["fact_history"](spark, data)
    rows = [(r.valid_from, r.fact_id) for r in found.collect()]
    assert "unhex" in plan(found) and len(rows[0][1]) == 64 and rows == sorted(rows)


def test_known_edges_are_met_by_bytes(spark, data):
    found = plan(entry.queries()["version_edges_missing"](spark, data))
    assert "hashpartitioning(newer" not in found and "unhex" in found


def test_known_edges_of_other_ids_stay(spark):
    rows = [("a", "TREATS", "x", datetime.date(2020, 1, k), 0.5) for k in range(1, 9)]
    f = spark.createDataFrame(rows, "subject_id string, relation_type string, object_id string, valid_from date, confidence double")
    edges = sorted(K.version_edges(f, family=K.FAMILY).collect())
    known = [(edges[0].newer, edges[0].older), (edges[1].newer.upper(), edges[1].older), ("none", edges[2].older), (edges[3].newer, None)]
    left = K.version_edges(f, existing=spark.createDataFrame(known, "newer string, older string"), family=K.FAMILY)
    assert sorted(left.collect()) == edges[1:]
