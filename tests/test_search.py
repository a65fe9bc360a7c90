"""Search by cells and by codes on clustered vectors, and what is read for it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairograph.operators import search as S


def clustered(spark, n=4000, dim=32, groups=40, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * 0.12
    corpus = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
    return corpus, corpus.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), x


def brute(x, queries, k=10):
    d = ((x[queries][:, None] - x[None]) ** 2).sum(-1)
    return {(q, int(i)) for q, row in zip(queries, np.argsort(d, axis=1, kind="stable")[:, :k], strict=True) for i in row}


def pairs(df):
    return {(r.query_id, r.id) for r in df.collect()}


def test_blocks_and_tiles_equal_one_scan(spark, monkeypatch):
    corpus, queries, x = clustered(spark, 600, 8)
    whole = sorted(map(tuple, S.knn_exact(queries, corpus, 7).collect()))
    grid = S._grid(queries.withColumn("cell", F.lit(0)), corpus.withColumn("cell", F.lit(0)), "embedding", 7, S.exact_measure("l2sq"), block=7, tile=50)
    assert [r[:3] for r in sorted(map(tuple, S.ranked(grid, 7, "l2sq").collect()))] == [r[:3] for r in whole]
    assert {r[:1] + r[2:3] for r in whole} == brute(x, list(range(0, 600, 20)), 7)
    found = S.knn_exact(queries, corpus, 7, block=4)
    assert [r[:3] for r in sorted(map(tuple, found.collect()))] == [r[:3] for r in whole]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "FlatMapCoGroups" in plan


def test_string_ids_ties_and_few_rows(spark):
    rows = [("é", [1.0, 0.0]), ("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("z", [0.0, 1.0])]
    corpus = spark.createDataFrame(rows, "id string, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("p", [0.0, 1.0]), ("p", [0.0, 1.0])], "query_id string, embedding array<float>")
    for block in (4096, 1):
        got = S.knn_exact(queries.limit(2), corpus, 3, block=block).collect()
        assert {(r.query_id, r["rank"], r.id) for r in got} >= {("q", 1, "a"), ("q", 2, "b"), ("q", 3, "é"), ("p", 1, "z"), ("p", 2, "a")}
        assert S.knn_exact(queries, corpus.limit(0), 3, block=block).collect() == []
        assert S.knn_exact(queries.limit(0), corpus, 3, block=block).collect() == []


def test_a_tenth_of_the_cells(spark, tmp_path):
    corpus, queries, x = clustered(spark)
    index, centres = S.ivf_index(corpus, 40)
    stored = S.write_cells(index, str(tmp_path / "cells"))
    assert stored.count() == 4000
    curve = S.recall_by_probes(queries, corpus, stored, centres, [1, 4, 40])
    print("recall by probes of 40 cells:", curve)
    recalls = [r for _, r in curve]
    assert recalls == sorted(recalls) and recalls[1] >= 0.9 and recalls[2] == 1.0
    assert pairs(S.ivf_search(queries, stored, centres, 10, 40)) == brute(x, list(range(0, 4000, 20)))


def test_only_the_cells_asked_for_are_read(spark, tmp_path):
    corpus, queries, _ = clustered(spark, 1000, 8, 10)
    index, centres = S.ivf_index(corpus, 10)
    stored = S.write_cells(index, str(tmp_path / "cells"))
    found = S.ivf_search(queries.limit(1), stored, centres, 5, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert found.count() == 5


def test_a_large_cell_is_many_tasks(spark):
    corpus, queries, x = clustered(spark, 900, 8, 3)
    one = corpus.withColumn("cell", F.lit(0)), queries.withColumn("cell", F.lit(0))
    found = S._grid(one[1], one[0], "embedding", 5, S.exact_measure("l2sq"), block=10, tile=100)
    assert found.groupBy("query_id").count().agg(F.min("count")).first()[0] >= 5 * 8
    assert pairs(S.ranked(found, 5, "l2sq")) == brute(x, list(range(0, 900, 20)), 5)


@pytest.mark.parametrize("block", [4096, 50])
def test_codes_alone(spark, block):
    corpus, queries, x = clustered(spark)
    coded, books = S.product_codes(corpus, 32, 256)
    row = coded.first()
    assert coded.columns == ["id", "codes"] and len(row.codes) == 32
    want = brute(x, list(range(0, 4000, 20)))
    found = S.pq_search(queries, coded, books, 10, block=block)
    assert len(pairs(found) & want) >= 0.9 * len(want)
    again = S.pq_search(queries, coded, books, 10, corpus, 5, block=block)
    assert len(pairs(again) & want) >= 0.99 * len(want)


def test_distances_by_table_are_those_to_the_decoded_row():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    books, q = [rng.normal(size=(7, 3)) for _ in range(4)], rng.normal(size=(5, 12))
    codes = rng.integers(0, 7, (11, 4)).astype(np.uint8)
    decoded = np.concatenate([books[p][codes[:, p]] for p in range(4)], axis=1)
    got = S.code_measure(books)(q)(pa.array([c.tobytes() for c in codes], pa.binary()))
    assert np.allclose(got, ((q[:, None] - decoded[None]) ** 2).sum(-1), atol=1e-4)


def test_few_vectors_for_codes(spark):
    corpus = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(9)], "id long, embedding array<double>")
    coded, books = S.product_codes(corpus, 2)
    assert [len(b) for b in books] == [3, 1] and coded.count() == 9
