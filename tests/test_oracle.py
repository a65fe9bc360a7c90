"""Every query with a SQL twin, side by side with DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = sorted(k for k in SQL if not k.startswith("op"))


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in records)


@pytest.mark.parametrize("name", OWN)
def test_twin(spark, data, db, name):
    got = QUERIES[name](spark, data)
    want = db.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(entry.plans.queries()) - set(SQL)))
def test_others_run(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    found = {r.relation_type: r.n for r in entry.entry(spark).collect()}
    assert set(found) == {"ACTIVATES", "INHIBITS", "TREATS"}


@pytest.mark.parametrize("name", ["version_edges_all_pairs", "asof_join", "consistency_report", "token_labels", "kappa", "facts_for_entity", "pair_similarity_share", "random_negatives", "stratified_split"])
def test_no_nested_loops(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_facts_scan_reads_few_columns(spark, data):
    plan = QUERIES["fact_build"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "p_retailprice" not in plan
