"""Facts never pass through the driver, are dealt once and by what they are made of; results of size are never written."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kairograph.operators import clusters as C
from kairograph.operators import facts as K

QUERIES = entry.queries()
D = datetime.date


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_superseding_broadcasts_no_facts(spark, data):
    found = plan(QUERIES["supersede"](spark, data))
    assert "BroadcastExchange" not in found and "hashpartitioning(fact_id" not in found


@pytest.mark.parametrize("name", ["supersede_edges", "fact_import_stats"])
def test_ids_meet_facts_without_broadcast(spark, data, name):
    joins = [line for line in plan(QUERIES[name](spark, data)).splitlines() if "BroadcastHashJoin" in line]
    assert all("p_partkey" in line for line in joins)


def test_superseding_by_columns_is_that_by_ids(spark):
    rows = [(s, "TREATS", o, D(2020, m, 1), 0.5, D(2020, m + 1, 1) if m < 3 else None) for s in "ab" for o in "xy" for m in (1, 2, 3)]
    facts = spark.createDataFrame(rows, "subject_id string, relation_type string, object_id string, valid_from date, confidence double, valid_to date")
    later = [("a", "x", 3, D(2021, 1, 1), 0.7), ("a", "x", 3, D(2021, 1, 1), 0.9), ("a", "x", 3, D(2021, 5, 1), 0.4), ("b", "x", 2, D(2020, 3, 1), 0.1), ("b", "y", 7, D(2021, 1, 1), 0.1), ("c", "x", 1, D(2021, 1, 1), 0.1)]
    updates = [(s, "TREATS", o, D(2020, m, 1), start, c, None) for s, o, m, start, c in later]
    updates = spark.createDataFrame(updates, "subject_id string, relation_type string, object_id string, old_from date, valid_from date, confidence double, valid_to date")
    ids = K.with_ids(updates).withColumn("old_fact_id", K.fact_id(valid_from="old_from")).drop("old_from")
    by_ids, edges, missing = K.supersede(K.with_ids(facts), ids)
    after, pairs, left = K.supersede(facts, updates, K.FAMILY)
    want = by_ids.select(*K.FAMILY, "valid_from", "valid_to", "confidence").collect()
    assert sorted(after.select(*K.FAMILY, "valid_from", "valid_to", "confidence").collect(), key=str) == sorted(want, key=str)
    assert {(r.subject_id, r.object_id, r.valid_from): (r.valid_to, r.confidence) for r in want if r.valid_from >= D(2021, 1, 1)} == {
        ("a", "x", D(2021, 1, 1)): (None, 0.9), ("a", "x", D(2021, 5, 1)): (None, 0.4)}
    assert len(want) == 14 and next(r.valid_to for r in want if r[:4] == ("a", "TREATS", "x", D(2020, 3, 1))) == D(2021, 5, 1)
    assert sorted(pairs.collect()) == sorted(edges.collect()) and edges.count() == 4
    assert sorted(left.select("subject_id", "object_id").collect()) == sorted(missing.select("subject_id", "object_id").collect()) == [("b", "y"), ("c", "x")]


def test_subgraphs_write_no_row_for_a_fact_and_seeds(spark, monkeypatch):
    sizes, written = {}, K.written

    def counted(df, name):
        table = written(df, name)
        sizes[name] = max(sizes.get(name, 0), table.count())
        return table

    monkeypatch.setattr(K, "written", counted)
    facts = spark.createDataFrame([(f"f{k}", f"S{k}", "hub") for k in range(200)], "fact_id string, subject_id string, object_id string")
    assert K.entity_subgraph(facts, facts.selectExpr("subject_id as entity_id"), 2).count() == 200 * 200
    assert max(sizes.values()) <= 2 * 200  # 200 facts and 4 groups of seeds are 800


@pytest.mark.parametrize("slice_rows", [1, 7, 100_000])
def test_subgraphs_by_slices_and_columns(spark, slice_rows):
    r = random.Random(slice_rows)
    rows = [(f"E{r.randrange(60)}", "TREATS", r.choice(["hub", None, f"E{r.randrange(60)}"]), D(2020, 1, 1 + k % 28)) for k in range(150)]
    rows = sorted({x for x in rows if x[2]}) + [x for x in rows if not x[2]][:1]
    facts = spark.createDataFrame(rows, "subject_id string, relation_type string, object_id string, valid_from date")
    named = K.with_ids(facts).withColumn("fact_id", F.coalesce("fact_id", F.lit("no id")))
    seeds = spark.createDataFrame([(f"E{k}",) for k in range(70)], "entity_id string")
    got = sorted(map(tuple, K.entity_subgraph(named.union(named), seeds, 3, slice_rows=slice_rows).collect()))
    want, rows = [], [(x.fact_id, {x.subject_id, x.object_id} - {None}) for x in named.collect()]
    for seed in (f"E{k}" for k in range(70)):
        at, found = {seed}, {}
        for hop in (1, 2, 3):
            near = [f for f in rows if at & f[1]]
            for f in near:
                found.setdefault(f[0], hop)
            at = at.union(*(f[1] for f in near))
        want += [(seed, f, hop) for f, hop in found.items()]
    assert got == sorted(want)
    by_columns = K.entity_subgraph(facts, seeds, 3, K.FAMILY, slice_rows).filter("fact_id is not null").collect()
    assert sorted(map(tuple, by_columns)) == [x for x in got if x[1] != "no id"]


def test_appended_facts_are_dealt_by_columns(spark, data):
    found = plan(QUERIES["fact_append"](spark, data))
    assert "hashpartitioning(fact_id" not in found and "SortAggregate" not in found and "subject_label" not in found


def test_appending_by_columns_is_that_by_ids(spark):
    rows = [("a", "TREATS", "x", D(2020, 1, k % 9 + 1), k / 20) for k in range(20)] + [("b", "TREATS", None, D(2020, 1, 1), 0.5)]
    new = spark.createDataFrame(rows, "subject_id string, relation_type string, object_id string, valid_from date, confidence double")
    known = new.filter("day(valid_from) % 2 = 0 or object_id is null")
    for add in ({}, {"valid_to": F.date_add("valid_from", F.col("confidence").cast("int"))}):
        more, held = new.withColumns(add), known.withColumns(add)
        by_ids = K.append_facts(K.with_ids(more), K.with_ids(held)).select(more.columns)
        got = K.append_facts(more, held, K.FAMILY)
        assert got.columns == more.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, by_ids.collect()), key=str)
        assert {(r.valid_from.day, r.confidence) for r in got.collect() if r.object_id} == {(1, 0.9), (3, 0.55), (5, 0.65), (7, 0.75), (9, 0.85)}


@pytest.mark.parametrize("name", ["cluster_summary", "cluster_by_relation", "cluster_pages"])
def test_members_of_clusters_do_not_meet_facts_by_id(spark, data, name):
    found = plan(QUERIES[name](spark, data))
    assert "fact_id" not in found and "sha2" not in found and "BroadcastExchange" not in found


def test_clusters_of_families_are_those_of_facts(spark):
    r = random.Random(4)
    rows = {(f"E{r.randrange(9)}", r.choice(["TREATS", "CAUSES"]), r.choice([None, *(f"E{k}" for k in range(9))]), D(2020, 1, 1 + r.randrange(28))) for _ in range(120)}
    facts = spark.createDataFrame(sorted(rows, key=str), "subject_id string, relation_type string, object_id string, valid_from date")
    named = facts.withColumn("fact_id", F.monotonically_increasing_id().cast("string")).localCheckpoint()
    few = C.families(facts)
    assert few.count() < len(rows)
    for members in (C.by_entity, C.by_relation):
        for made in (C.sizes, C.summary, lambda *a: C.entity_pages(*a, page=3)):
            assert sorted(map(tuple, made(members(few)).collect()), key=str) == sorted(map(tuple, made(members(named), named).collect()), key=str)
