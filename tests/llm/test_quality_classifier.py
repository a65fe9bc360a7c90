import math

import numpy as np

from kairograph.llm import quality_classifier as q
from kairograph.llm import queries

CLEAN = "the cat and the dog of a man in the house was on it for some time, and by now is with us again number"


def test_held_out_accuracy(spark, data):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    labels = read("labels")
    found = q.quality_posteriors(read("documents"), labels.filter("doc_id % 3 <> 0"))
    rows = found.join(labels.filter("doc_id % 3 = 0"), found.id == labels.doc_id).select("kept", "quality").collect()
    assert len(rows) > 100 and sum(r.kept == bool(r.quality) for r in rows) >= 0.95 * len(rows)


def test_against_plain_python(spark):
    rows = [(k, CLEAN + f" {k}", f"h{k % 3}", "p" if k % 2 else None) for k in range(30)]
    rows += [(k, f"### {k} $$$ " * 30, "bad" if k % 4 else None, "p") for k in range(30, 60)]
    rows += [(60, None, "h0", "p"), (61, "", "solo", "p"), (5, rows[5][1], "h2", "p"), (5, rows[5][1], "h2", "p"), (None, CLEAN, "h1", "p"), (70, "word " * 40_000, "h0", "p")]
    docs = spark.createDataFrame([(*r, "clash", 2.0) for r in rows], "doc_id long, text string, source string, lang string, kept string, p double")
    labels = spark.createDataFrame([(k, int(k < 30), 0) for k in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = q.quality_posteriors(docs, labels).collect()
    assert len(got) == len(rows)
    by = lambda key: {k: [r.evidence for r in got if key(r) == k] for k in {key(r) for r in got}}
    hosts, paths = by(lambda r: r.host), by(lambda r: (r.host, r.path))
    mean = sum(r.evidence for r in got) / len(got)
    for r in got:
        host, path = hosts[r.host], paths[r.host, r.path]
        k = [(sum(host) - r.evidence + s * mean) / (len(host) - 1 + s) for s in (1.0, 1e4)]
        assert min(k) - 1e-6 <= r.host_posterior <= max(k) + 1e-6 or r.host_posterior in (1e-4, 1 - 1e-4)
        k = [(sum(path) - r.evidence + s * r.host_posterior) / (len(path) - 1 + s) for s in (1.0, 1e4)]
        assert min(k) - 1e-6 <= r.path_posterior <= max(k) + 1e-6 or r.path_posterior in (1e-4, 1 - 1e-4)
        logit = lambda x: math.log(x / (1 - x))
        assert math.isclose(logit(r.posterior), logit(r.evidence) + logit(r.path_posterior) - logit(mean), abs_tol=1e-6)
        assert r.kept == (r.posterior >= 0.5)
    good = [r.kept for r in got if r.id is not None and r.id < 30]
    assert all(good) and not any(r.kept for r in got if r.id in range(30, 60))


def test_features(spark):
    row = spark.createDataFrame([("The the, AB 12\nx #\nx #",)], "text string").select(q.features().alias("f")).first().f
    words = "The the, AB 12 x # x #".split()
    want = [math.log1p(8), sum(map(len, words)) / 80, 6 / 8, 0.0, 3 / 8, 1 / 3]
    assert np.allclose(row[:6], want) and len(row) == len(q.FEATURES)


def test_empty_and_no_labels(spark):
    docs = spark.createDataFrame([(1, CLEAN, "h", "p")], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.quality_posteriors(docs.limit(0), none).collect() == []
    assert [r.evidence for r in q.quality_posteriors(docs, none).collect()] == [0.5]


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert queries.op6_quality_classifier(spark, data).count() == docs.count()
