"""What a search holds doesn't grow with its queries or cells."""

import numpy as np
import pyarrow as pa
import pytest

from kairograph.operators import search as S


def vectors(spark, n=600):
    x = np.random.default_rng(3).normal(size=(n, 4))
    corpus = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
    return corpus, corpus.filter("id % 10 = 0").selectExpr("id as query_id", "embedding")


def test_all_cells_need_no_copies(spark, monkeypatch):
    corpus, queries = vectors(spark)
    want = sorted(S.knn_exact(queries, corpus, 5).collect())
    index, centres = S.ivf_index(corpus, 4)
    monkeypatch.setattr(S, "written", None)  # no probes
    assert sorted(S.ivf_search(queries, index, centres, 5, 4).collect()) == want
    monkeypatch.setattr(S, "ivf_index", None)  # no cells
    assert sorted(S.search(queries, corpus, 5, nlist=300, nprobe=300).collect()) == want


def test_copies_are_made_some_at_a_time(spark, monkeypatch):
    corpus, queries = vectors(spark)
    index, centres = S.ivf_index(corpus, 8)
    want = sorted(S.ivf_search(queries, index, centres, 5, 6).collect())
    monkeypatch.setattr(S, "COPIES", 7)
    assert sorted(S.ivf_search(queries, index, centres, 5, 6).collect()) == want


@pytest.mark.parametrize("k", [1, 4])
def test_a_measure_holds_few_queries(k):
    rng, held = np.random.default_rng(4), []
    q, x = rng.normal(size=(2 * S.QUERY_STEP + 9, 3)), rng.normal(size=(50, 3))

    def measure(part):
        held.append(len(part))
        return S.exact_measure("l2sq")(part)

    found = S._Blocks(list(range(len(q))), q, k, measure)
    for at in (0, 20):
        found.scan(pa.array(range(at, at + 30 if at else 20)), pa.array(x[at : at + 30 if at else 20].tolist(), pa.list_(pa.float64())))
    rows = pa.Table.from_batches(found.batches(pa.int64(), pa.int64())).to_pylist()
    d = ((q[:, None] - x[None]) ** 2).sum(-1)
    assert max(held) <= S.QUERY_STEP and {(r["query_id"], r["id"]) for r in rows} == {(i, int(j)) for i in range(len(q)) for j in np.argsort(d[i])[:k]}
