"""Queries without a twin in SQL against brute force."""

import json
import math
import re
from collections import Counter

import numpy as np
import regex

from kairograph.operators import spans as B
from kairograph.operators import vectors as V
from kairograph.plans import spans as P
from kairograph.plans import text as T
from kairograph.plans import vectors as W


def rule(text):
    """The rules again, by another engine over the same fixed patterns."""
    own = text.strip()
    if not own:
        return None
    if len(own) > 80:
        return "deferred"
    if regex.fullmatch("(?i)(?:" + "|".join(B.LINGUISTIC) + ")", own):
        return "linguistic"
    return "factual" if any(regex.search(p, own) for p in B.FACTUAL) else "deferred"


def test_rules_over_chunks(spark, data):
    rows = [(r.doc_id, r.chunk, r.text) for r in P.chunks(spark, data).collect()]
    parts = [(k, piece) for k, (*_, t) in enumerate(rows) for piece in (t, t[:30], t[:60].upper(), "However", f"{t[:9]} 10 mg", " in  summary ", "EGFR")]
    given = spark.createDataFrame([(k, i, p) for i, (k, p) in enumerate(parts)], "k long, i long, text string")
    got = {r.i: r.outcome for r in given.select("i", B.rule_label("text").alias("outcome")).collect()}
    assert got == {i: rule(p) for i, (_, p) in enumerate(parts)}
    counts = Counter(x for x in (rule(t) for *_, t in rows) if x)
    assert {r.outcome: r.n for r in P.heuristic_stats(spark, data).collect()} == counts
    want = sorted((d, c, "left" if rule(t) == "deferred" else "settled") for d, c, t in rows if rule(t))
    assert sorted(map(tuple, P.hybrid_split(spark, data).collect())) == want


def test_router_examples(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    want = {}
    for d, text in docs.items():
        factual = np.zeros(len(text) + 400, bool)
        for i in range(-(-len(text) // 40)):
            if (i + d) % 5:
                start = i * 40 + d % 7
                factual[start : start + 15 + i % 3 * 40] = True
        places = [m.span() for m in re.finditer(r"\w+|[^\w\s]", text)]
        if places:
            want[d] = len(places), sum(2 * int(factual[a:b].sum()) > b - a for a, b in places)
    assert {r.doc_id: (r.n, r.ones) for r in T.router_examples(spark, data).collect()} == want


def test_hard_negatives(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x, label = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])
    asked = [k for k in range(len(ids)) if ids[k] % 10 == 0]
    pairs = []
    for q in asked:
        d = ((x[q] - x) ** 2).sum(1)
        near = sorted(range(len(ids)), key=lambda j: (round(d[j], 9), ids[j]))[:100]
        pairs += [(int(ids[q]), int(ids[j]), float(d[j])) for j in near if label[j] != label[q]]
    frame = spark.createDataFrame(pairs, "query_id long, id long, d double").withColumn("u", V.hash_uniform("query_id", "id", seed=0))
    drawn = {}
    for r in frame.collect():
        drawn.setdefault(r.query_id, []).append((-math.log(r.u) * (r.d + 1e-8), r.id))
    want = {(q, k, i) for q, found in drawn.items() for k, (_, i) in enumerate(sorted(found)[:15], 1)}
    got = {(r.query_id, r.draw, r.id) for r in W.hard_negatives(spark, data).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.999 * len(want)  # but for ties in the last digits


def test_pca(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    _, axes = np.linalg.eigh(np.cov(x.T))
    want = np.abs(x @ axes[:, ::-1][:, :2])
    got = {r.id: np.abs(np.array(r.projection)) for r in W.pca(spark, data).collect()}
    assert np.allclose([got[r.vec_id] for r in rows], want, atol=1e-6)


def test_elbow(spark, data):
    rows = W.elbow(spark, data).orderBy("k").collect()
    x = np.array([r.embedding for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()], float)
    total = ((x - x.mean(0)) ** 2).sum()
    assert [r.k for r in rows] == list(range(2, 12)) and total > rows[0].inertia > rows[-1].inertia > 0


def test_encoded_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.id: np.array(r.embedding) for r in W.encoded_texts(spark, data).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys() and all(len(v) == 256 and abs(np.linalg.norm(v) - 1) < 1e-9 for v in got.values())
    for d in list(texts)[:50]:
        assert np.count_nonzero(got[d]) <= len({w for w in re.split(r"\s+", texts[d].lower())})


def test_review_tasks(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    spans = {}
    for r in P.annotator(spark, data, 400, 90, 7).collect():
        spans.setdefault(r.doc_id, []).append((r.span_idx, r.start_char, r.end_char, r.label, r.confidence))
    got = {r.doc_id: json.loads(r.value) for r in P.review_tasks(spark, data).collect()}
    assert got.keys() == spans.keys()
    for d, task in got.items():
        assert task["data"] == {"text": docs[d], "source_id": str(d)} and len(task["annotations"]) == 1
        found = [(x["id"], x["value"]["start"], x["value"]["end"], x["value"]["labels"], x["score"]) for x in task["annotations"][0]["result"]]
        assert found == [(f"span_{k}", a, b, [label], c) for k, a, b, label, c in sorted(spans[d])]
