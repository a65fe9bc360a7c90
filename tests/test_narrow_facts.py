"""Facts are dealt by short columns, their hashes made afterwards; least ids are found without sorting pairs."""

import datetime

import pytest

import __spark_entry__ as entry
from kairograph.operators import facts as K
from kairograph.operators import temporal as T
from kairograph.plans.fixtures import names

QUERIES = entry.queries()
DEALT = "fact_at fact_current fact_export envelope_check version_edges_adjacent version_edges_all_pairs version_chain version_pages consistency_report consistency_clean asof_latest".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", DEALT)
def test_no_shuffle_by_hashes(spark, data, name):
    found = plan(QUERIES[name](spark, data))
    assert "hashpartitioning(family_key" not in found and "hashpartitioning(fact_id" not in found


@pytest.mark.parametrize("name", ["asof_join", "fact_resolve_rows"])
def test_pairs_are_not_sorted(spark, data, name):
    assert "SortAggregate" not in plan(QUERIES[name](spark, data))


def test_families_by_columns_are_those_by_key(spark):
    day = lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(k)
    rows = [(s, "TREATS", o, day(7 * k % 31), 0.5) for s in ("a", "b") for o in ("x", "y") for k in range(20)]
    v = K.distinct_versions(spark.createDataFrame(rows, "subject_id string, relation_type string, object_id string, valid_from date, confidence double"))
    ids = K.with_ids(v)
    for cell_rows in (None, 5):
        assert sorted(K.version_edges(v, cell_rows=cell_rows, family=K.FAMILY).collect()) == sorted(K.version_edges(ids).collect())
        assert sorted(K.with_ids(K.close_intervals(v, cell_rows, family=K.FAMILY)).select("fact_id", "valid_to").collect(), key=str) == sorted(K.close_intervals(ids).select("fact_id", "valid_to").collect(), key=str)
    assert sorted(K.chain_pages(v, 3, 5, family=K.FAMILY).collect()) == sorted(K.chain_pages(ids, 3).collect())
    late = K.close_intervals(v, family=K.FAMILY).withColumn("born", v.valid_from).selectExpr("* except (valid_to)", "date_add(valid_to, 3) as valid_to")
    keys = (K.FAMILY, ("born",), names)
    want = T.consistency_report(names(late)).collect()
    assert {r.check for r in want} == {"overlap", "gap"} and sorted(T.consistency_report(late, keys).collect(), key=str) == sorted(want, key=str)
