"""Hot families, clusters and groups: the same results by cells, pages and ranges."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from kairograph.operators import accounting as A
from kairograph.operators import clusters as C
from kairograph.operators import facts as K
from kairograph.operators import spans as B
from kairograph.operators.medians import exact_medians

SCHEMA = "family_key string, fact_id string, valid_from date, subject_id string, object_id string, relation_type string"


def fact_rows(n=300):
    r = random.Random(1)
    return [(r.choice(["hot", "hot", "hot", "a", "b"]), f"f{k:04}", k % 97, f"S{r.randrange(40)}", f"S{r.randrange(60)}", r.choice(["TREATS", "CAUSES"])) for k in range(n)]


def frame(spark, rows):
    made = spark.createDataFrame([(f, i, d, s, o, t) for f, i, d, s, o, t in rows], "family_key string, fact_id string, d int, subject_id string, object_id string, relation_type string")
    return made.withColumn("valid_from", F.date_add(F.lit("2000-01-01").cast("date"), F.col("d"))).drop("d").repartition(3)


def chains(rows):
    out = {}
    for f, i, d, *_ in sorted(rows, key=lambda r: (r[2], r[1])):
        out.setdefault(f, []).append((d, i))
    return out


@pytest.mark.parametrize("cell_rows", [None, 20, 3, 10**6])
def test_versions_by_cells(spark, cell_rows):
    rows = fact_rows()
    facts, want = frame(spark, rows), chains(rows)
    pairs = sorted((b, a) for c in want.values() for (_, a), (_, b) in zip(c, c[1:]))
    assert sorted(map(tuple, K.version_edges(facts, cell_rows=cell_rows).collect())) == pairs
    closed = K.close_intervals(facts, cell_rows)
    assert sorted(closed.columns) == sorted([*facts.columns, "valid_to"])
    ends = {r.fact_id: r.valid_to and (r.valid_to - r.valid_to.replace(year=2000, month=1, day=1)).days for r in closed.collect()}
    assert ends == {i: nxt[0] if nxt else None for c in want.values() for (_, i), nxt in zip(c, [*c[1:], None])}


@pytest.mark.parametrize("cell_rows", [20, 10**6])
def test_chains_in_pages(spark, cell_rows):
    rows = fact_rows()
    facts, want = frame(spark, rows), chains(rows)
    places = {r.fact_id: r.place for r in K.version_places(facts, cell_rows).collect()}
    assert places == {i: k for c in want.values() for k, (_, i) in enumerate(c)}
    pages = K.chain_pages(facts, 7, cell_rows).orderBy("family_key", "page").collect()
    assert all(len(p.fact_ids) <= 7 for p in pages)
    for f, c in want.items():
        assert [i for p in pages if p.family_key == f for i in p.fact_ids] == [i for _, i in c]


def test_a_hot_family_is_many_tasks(spark):
    facts = spark.range(50_000).select(F.lit("hot").alias("family_key"), F.format_string("f%06d", "id").alias("fact_id"), F.timestamp_seconds("id").alias("valid_from"))
    placed = K._by_cells(facts, 1000, 256)
    sizes = [r["count"] for r in placed.groupBy("_cell").count().collect()]
    assert len(sizes) >= 40 and max(sizes) <= 2500
    assert K.version_edges(facts, cell_rows=1000).count() == 49_999


def test_cluster_pages(spark):
    rows = fact_rows()
    facts = frame(spark, rows)
    members = C.by_relation(facts)
    ends = {t: sorted({e for r in rows if r[5] == t for e in r[3:5]}) for t in ("TREATS", "CAUSES")}
    pages = C.entity_pages(members, facts, 4, 3).collect()
    assert all(len(p.entities) <= 4 and p.entities == sorted(p.entities) for p in pages)
    assert {t: sorted(e for p in pages if p.cluster_id == t for e in p.entities) for t in ends} == ends
    sizes = {r.cluster_id: (r.size, r.n_entities, r.relations) for r in C.sizes(members, facts).collect()}
    assert sizes == {t: (sum(r[5] == t for r in rows), len(e), [t]) for t, e in ends.items()}
    assert {r.cluster_id: r.entities for r in C.summary(members, facts).collect()} == ends


@pytest.mark.parametrize("ranges", [2, 3, 1024])
def test_medians(spark, ranges):
    r = random.Random(2)
    rows = [(g, r.choice([-5, 0, 7, r.randrange(-(10**12), 10**12), r.randrange(100)])) for g in "abc" for _ in range(r.randrange(1, 60))]
    rows += [("one", 4), ("two", 4), ("two", 5), ("none", None), ("same", 9), ("same", 9), ("some", None), ("some", 3)]
    got = {x.group: x.median for x in exact_medians(spark.createDataFrame(rows, "g string, v long").repartition(3), "g", "v", ranges).collect()}
    values = {}
    for g, v in rows:
        values.setdefault(g, []).extend([] if v is None else [v])
    assert got == {g: float(statistics.median(v)) if v else None for g, v in values.items()}


def test_profiles_of_few_rows(spark):
    sizes = spark.createDataFrame([(3,), (9,), (4,), (None,)], "length long")
    assert tuple(A.size_profile(sizes).first()) == (4, 16, 16 / 3, 4.0)
    assert tuple(A.size_profile(sizes.limit(0)).first()) == (0, 0, None, None)
    spans = spark.createDataFrame([("a", 0, 4, 0.5), ("a", 2, 9, 1.0), (None, 0, 1, 0.0)], "label string, start_char int, end_char int, confidence double")
    got = sorted(((r.label or "", r.n, r.median_length) for r in B.label_statistics(spans).collect()))
    assert got == [("", 1, 1.0), ("", 3, 4.0), ("a", 2, 5.5)]


def test_confidence_as_text(spark):
    response = '[{"span": "a", "confidence": "0.9"}, {"span": "b", "confidence": " 7 "}, {"span": "c", "confidence": "high"}, {"span": "d", "confidence": 0.25}, {"span": "e", "confidence": null}, {"span": "f", "confidence": "NaN"}]'
    rows = spark.createDataFrame([("a b c d e f", response)], "text string, response string")
    assert [r.confidence for r in B.parse_span_responses(rows).orderBy("span_idx").collect()] == [0.9, 1.0, 0.5, 0.25, 0.5, 0.5]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_subgraphs_by_masks(spark, depth):
    r = random.Random(9)
    rows = [(f"f{k:03}", f"E{r.randrange(150)}", r.choice(["hub", f"E{r.randrange(150)}", f"E{r.randrange(150)}"])) for k in range(140)]
    seeds = [f"E{k}" for k in range(150)] + ["none", None, "E3"]
    facts = spark.createDataFrame(rows, "fact_id string, subject_id string, object_id string")
    got = sorted(map(tuple, K.entity_subgraph(facts, spark.createDataFrame([(s,) for s in seeds], "entity_id string"), depth).collect()))
    want = []
    for seed in {s for s in seeds if s}:
        at, found = {seed}, {}
        for hop in range(1, depth + 1):
            near = [f for f in rows if at & set(f[1:])]
            for f in near:
                found.setdefault(f[0], hop)
            at |= {e for f in near for e in f[1:]}
        want += [(seed, f, hop) for f, hop in found.items()]
    assert got == sorted(want)


def test_a_hub_is_a_row_for_64_seeds(spark):
    facts = spark.createDataFrame([(f"f{k}", f"S{k}", "hub") for k in range(130)], "fact_id string, subject_id string, object_id string")
    seeds = facts.select(F.col("subject_id").alias("entity_id"))
    assert K.entity_subgraph(facts, seeds, 2).groupBy("hop").count().orderBy("hop").collect() == [(1, 130), (2, 130 * 129)]
