"""Literal cases of the operators' edges."""

import datetime as dt
import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairograph.functions import ids, text, vectors
from kairograph.operators import chunks, clusters, entities, examples, facts, metrics, relations, spans, temporal, traces
from kairograph.operators import vectors as V

D = dt.date


def fact_rows(spark, *intervals, subjects=None):
    rows = [((subjects or ["C0001"] * len(intervals))[k], "TREATS", "C0002", a, b) for k, (a, b) in enumerate(intervals)]
    return facts.with_ids(spark.createDataFrame(rows, "subject_id string, relation_type string, object_id string, valid_from date, valid_to date"))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_fact_id(spark):
    got = fact_rows(spark, (D(2024, 1, 1), None)).first().fact_id
    assert got == "749b28a4815ae2aa2b296bc239783fc345904b5ac9646157936d32cf34363a5e"
    assert len(value(spark, ids.joined_digest(F.lit("a"), F.lit("b"), separator="|", algorithm="md5"))) == 32


def test_intervals(spark):
    closed = fact_rows(spark, (D(2024, 1, 1), D(2024, 6, 1)))
    assert [temporal.resolve_at(closed, d).count() for d in ("2024-01-01", "2024-06-01")] == [1, 0]
    assert temporal.resolve_at(fact_rows(spark, (D(2024, 1, 1), None)), "2099-12-31").count() == 1
    three = fact_rows(spark, (D(2024, 1, 1), None), (D(2023, 1, 1), D(2025, 1, 1)), (D(2025, 1, 1), None), subjects=["C0001", "C0099", "C0088"])
    assert sorted(r.subject_id for r in temporal.resolve(three, "at_timestamp", "2024-06-01").collect()) == ["C0001", "C0099"]
    for mode, moment in (("never", None), ("AT_TIMESTAMP", None)):
        with pytest.raises(ValueError):
            temporal.resolve(three, mode, moment)


@pytest.mark.parametrize(
    "intervals,checks",
    [
        ([(D(2023, 1, 1), D(2024, 1, 1)), (D(2024, 1, 1), D(2025, 1, 1)), (D(2025, 1, 1), None)], set()),
        ([(D(2024, 1, 1), None), (D(2024, 6, 1), None)], {"multiple_current", "overlap"}),
        ([(D(2024, 1, 1), D(2024, 8, 1)), (D(2024, 6, 1), None)], {"overlap", "gap"}),
        ([(D(2023, 1, 1), D(2024, 1, 1)), (D(2024, 3, 1), None)], {"gap"}),
        ([(D(2024, 3, 1), D(2024, 1, 1))], {"inverted"}),
    ],
)
def test_consistency(spark, intervals, checks):
    assert {r.check for r in temporal.consistency_report(fact_rows(spark, *intervals)).collect()} == checks


def test_cluster(spark):
    rows = [("C0001", "TREATS", "C0002"), ("C0001", "INHIBITS", "C0003")]
    f = facts.with_ids(spark.createDataFrame([(*r, D(2024, 1, 1)) for r in rows], "subject_id string, relation_type string, object_id string, valid_from date"))
    r = clusters.summary(clusters.custom(f.select(F.lit("c").alias("cluster_id"), "fact_id")), f).first()
    assert (r["size"], r.entities, r.relations) == (2, ["C0001", "C0002", "C0003"], ["INHIBITS", "TREATS"])


def test_flatten_and_back(spark):
    flat = spark.createDataFrame([("f", "a", None, "TREATS", "b", "B", "2024-01-01", None, "s", 0.5, '{"k":"v"}'), ("g", "a", "A", None, "b", "B", "bad", None, None, None, "no json")], "fact_id string, subject_id string, subject_label string, relation_type string, object_id string, object_label string, valid_from string, valid_to string, source string, confidence double, metadata string")
    nested = facts.inflate(flat)
    back = {r.fact_id: r for r in facts.flatten(nested).collect()}
    assert back["f"].metadata == '{"k":"v"}' and back["f"].valid_from == "2024-01-01" and back["f"].subject_label == "a"
    assert (back["g"].valid_from, back["g"].relation_type, back["g"].confidence, back["g"].metadata) == ("2000-01-01", "ASSOCIATED_WITH", 1.0, "{}")


def span_rows(spark):
    return spark.createDataFrame([("d", 0, 0, 47, "factual", 0.98), ("d", 1, 48, 110, "linguistic", 0.95), ("d", 2, 111, 130, "factual", 0.60)], "doc_id string, span_idx int, start_char int, end_char int, label string, confidence double")


def test_span_statistics(spark):
    got = {r.label: r for r in spans.label_statistics(span_rows(spark)).collect()}
    assert got[None].n == 3 and got["factual"].n == 2 and round(got[None].mean_confidence, 4) == 0.8433
    assert [spans.low_confidence(span_rows(spark), t).count() for t in (0.7, 0.96)] == [1, 2]


@pytest.mark.parametrize("a,b,tp,fn,sign", [((0, 10), (0, 15), 10, 5, "between"), ((0, 10), (10, 20), 0, 10, "negative"), ((0, 10), (0, 10), 10, 0, "one")])
def test_kappa(spark, a, b, tp, fn, sign):
    one = lambda s: spark.createDataFrame([("d", *s, "factual")], "doc_id string, start_char int, end_char int, label string")
    r = spans.kappa(spark.createDataFrame([("d", 20)], "doc_id string, n int"), one(a), one(b)).first()
    assert (r.tp, r.fn) == (tp, fn)
    assert {"between": 0 < r.kappa < 1, "negative": r.kappa < 0, "one": r.kappa == 1.0}[sign]


@pytest.mark.parametrize("chars,valid", [(5, False), (90, False), (40, True)])
def test_ratio_bounds(spark, chars, valid):
    s = spark.createDataFrame([("d", 0, chars, "factual")], "doc_id string, start_char int, end_char int, label string")
    assert spans.validate(spark.createDataFrame([("d", 100)], "doc_id string, n int"), s).first().valid is valid


def test_alignment(spark):
    body = "Moreover, drug X inhibits Y."
    s = spark.createDataFrame([("d", 0, 9, "linguistic"), ("d", 10, len(body), "factual")], "doc_id string, start_char int, end_char int, label string")
    words = [(0, 9), (10, 14), (15, 16), (17, 25), (26, 28)]
    t = spark.createDataFrame([("d", k, a, b) for k, (a, b) in enumerate(words)], "doc_id string, token int, start_char int, end_char int")
    assert [r.label for r in spans.token_labels(t, s).orderBy("token").collect()] == [0, 1, 1, 1, 1]


@pytest.mark.parametrize("body,want", [("  ", None), ("However", "linguistic"), ("In  contrast", "linguistic"), ("EGFR", "factual"), ("10 mg daily", "factual"), ("the lung", "factual"), ("hello there", "deferred"), ("EGFR " * 20, "deferred"), ("p53 binds", "factual")])
def test_rules(spark, body, want):
    assert value(spark, spans.rule_label(F.lit(body))) == want


def test_location(spark):
    t = "The cat saw the Cat and a dog"
    assert value(spark, spans.locate_spans(F.lit(t), F.array(*map(F.lit, ("cat", "cat", "dog", "The", "zzz"))))) == [4, 16, 26, 0, None]


def test_ranking(spark):
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert value(spark, metrics.precision_at_k(arr("a", "b"), arr("a", "b", "c"), 5)) == 0.4
    assert value(spark, metrics.precision_at_k(arr("a", "a", "a"), arr("a"), 3)) == 1.0
    assert value(spark, metrics.precision_at_k(arr("a"), arr(), 3)) == 0.0
    assert value(spark, metrics.reciprocal_rank(arr("x", "a", "b"), arr("a", "b"))) == 0.5
    with pytest.raises(ValueError):
        metrics.precision_at_k("a", "b", 0)


@pytest.mark.parametrize("labels,want", [(True, 0.0), (False, 1.0)])
def test_calibration(spark, labels, want):
    rows = spark.createDataFrame([(1.0, labels)] * 100, "prob double, label boolean")
    assert metrics.calibration_error(rows).first().ece == want


def test_confusion(spark):
    rows = spark.createDataFrame([(10.0, True), (10.0, False), (-10.0, True), (-10.0, False)], "prob double, label boolean")
    r = metrics.metrics_at_threshold(rows, 0.0).first()
    assert (r.tp, r.tn, r.fp, r.fn, r.accuracy) == (1, 1, 1, 1, 0.5)
    none = metrics.metrics_at_threshold(rows.filter("prob > 99"), 0.0).first()
    assert none.f1 == 0.0 and none.accuracy == 0.0


def test_factual_accuracy(spark):
    said = "aspirin treats HEADACHE"
    schema = "text string, facts array<struct<subject:string,object:string,relation:string>>"
    for pairs, want in (([("Aspirin", "headache", "TREATS")], 1.0), ([("x", "y", None)], 0.0), ([("Aspirin", "headache", "A"), ("x", "y", "B")], 0.5), ([("", "", None)], 1.0)):
        got = {r.relation: r.accuracy for r in metrics.factual_accuracy(spark.createDataFrame([(said, pairs)], schema)).collect()}
        assert got[None] == want


def test_scores(spark):
    assert value(spark, metrics.overall_score(F.lit(0.5), F.lit(None).cast("double"), F.lit(1.0))) == 0.75
    assert value(spark, metrics.perplexity_part(F.lit(1.0))) == 1.0
    assert value(spark, metrics.if_positive(F.lit(0.0))) is None
    empty = metrics.perplexity_split(spark.createDataFrame([], "loss double, is_retrieval boolean")).first()
    assert math.isinf(empty.overall) and empty.n == 0
    parts = [spark.createDataFrame([(x,)], "loss double") for x in (1.0, 2.0)]
    assert metrics.combined_loss(parts[0], parts[1], None).first().loss == 5.0


def test_patience(spark):
    rows = spark.createDataFrame([("r", k, v) for k, v in enumerate([1.0, 1.05, 1.2, 1.2, 1.1, 1.0, 2.0])], "run string, step int, value double")
    got = [(r.best, r.bad, r.stop) for r in metrics.patience(rows, "run", "step", "value", 3, 0.1).orderBy("step").collect()]
    assert got == [(1.0, 0, False), (1.0, 1, False), (1.2, 0, False), (1.2, 1, False), (1.2, 2, False), (1.2, 3, True), (2.0, 0, True)]


@pytest.mark.parametrize("tokens,n,want", [([1, 2, 3, 1, 2, 3], 3, True), ([1, 2, 3, 4, 2, 3], 3, False), ([1, 2], 2, False), ([1, 1, 1], 1, True)])
def test_repeated_ngram(spark, tokens, n, want):
    assert value(spark, traces.repeated_ngram(F.array(*map(F.lit, tokens)), n)) is want


@pytest.mark.parametrize("tokens,want", [([7] * 6, True), ([7] * 5, False), ([0, 0, 0, 0] + [1, 2, 3] * 4, True), ([1, 2] * 4, False), ([0] * 4 + [1, 2] * 4, True)])
def test_loops(spark, tokens, want):
    assert value(spark, traces.degenerate_loop(F.array(*map(F.lit, tokens)))) is want


def test_traces(spark):
    rows = spark.createDataFrame([("r", ["0.9", "generation", "0.1"]), ("e", [])], "response_id string, decisions array<string>")
    steps = traces.normalise_decisions(rows)
    got = {r.response_id: (r.retrieval_fraction, r.generation_fraction) for r in traces.routing_fractions(steps, rows).collect()}
    assert np.allclose(got["r"], (1 / 3, 2 / 3)) and got["e"] == (0.0, 1.0)
    nested = spark.createDataFrame([("r", [[("f", None, "s", None, "r", "o", None, None, 0.4)], []])], "response_id string, retrieved array<array<struct<fact_id:string,subject_label:string,subject:string,relation_type:string,relation:string,object_label:string,object:string,confidence:double,score:double>>>")
    assert tuple(traces.flatten_facts(nested).first()) == ("r", 0, "f", "s", "r", "o", 0.4)


def vector_frame(spark, n=100, dim=64, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(f"fact_{k:04d}", row.tolist()) for k, row in enumerate(x)], "id string, embedding array<float>"), x


@pytest.mark.parametrize("metric", ["l2sq", "l2", "ip", "cosine"])
@pytest.mark.parametrize("block", [4096, 3])
def test_search_twins(spark, metric, block):
    corpus, _ = vector_frame(spark)
    queries = corpus.limit(9).select(F.col("id").alias("query_id"), "embedding")
    shown = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.distance, 5)) for r in df.collect())
    assert shown(V.knn_exact(queries, corpus, 7, metric, block)) == shown(V.knn_sql(queries, corpus, 7, metric))
    assert V.knn_exact(queries, corpus.limit(3), 7).count() == 27


def test_ivf_recall(spark):
    corpus, _ = vector_frame(spark, 400, 16)
    queries = corpus.limit(40).select(F.col("id").alias("query_id"), "embedding")
    index, centres = V.ivf_index(corpus, 8)
    exact = {(r.query_id, r.id) for r in V.knn_exact(queries, corpus, 10).collect()}
    found = {(r.query_id, r.id) for r in V.ivf_search(queries, index, centres, 10, 6).collect()}
    assert index.count() == 400 and len(exact & found) >= 0.9 * len(exact)
    coded, books = V.product_codes(corpus, 4, 16)
    near = {(r.query_id, r.id) for r in V.pq_search(queries, coded, books, 10, corpus, 10).collect()}
    assert len(exact & near) >= 0.8 * len(exact)


@pytest.mark.parametrize("name", ["ivf_search", "pq_search"])
def test_recall_of_registered_searches(spark, name):
    from kairograph.plans import vectors as plans

    sf_dir = "/root/testdata/sf0.1"
    exact, found = ({(r.query_id, r.id) for r in f(spark, sf_dir).collect()} for f in (plans.knn_exact, getattr(plans, name)))
    recall = len(exact & found) / len(exact)
    print(f"{name}: recall@10 {recall:.4f} of {len(exact)}")
    assert len(found) == len(exact) and recall >= 0.9


def test_vector_functions(spark):
    a, b = (F.array(*map(F.lit, x)) for x in ((3.0, 4.0), (4.0, 3.0)))
    assert value(spark, vectors.normalise(a)) == [0.6, 0.8] and value(spark, vectors.l2sq(a, b)) == 2.0
    assert round(value(spark, vectors.cosine(a, b)), 6) == 0.96 and value(spark, vectors.argmax(F.array(F.lit(1.0), F.lit(5.0), F.lit(5.0)))) == 1
    assert value(spark, vectors.normalise(F.array(F.lit(0.0)))) == [0.0]


def test_pooling(spark):
    rows = spark.createDataFrame([("a", 0, 1, [1.0, 0.0]), ("a", 1, 1, [1.0, 4.0]), ("a", 2, 0, [9.0, 9.0])], "id string, pos int, mask int, embedding array<double>")
    got = {h: V.pool(rows, how=h).first().embedding for h in ("cls", "mean", "max")}
    assert np.allclose(got["cls"], [1, 0]) and np.allclose(got["mean"], np.array([1, 2]) / 5**0.5) and np.allclose(got["max"], np.array([1, 4]) / 17**0.5)
    own = V.encode_texts(spark.createDataFrame([(1, "x"), (2, None)], "id int, text string"), lambda: lambda ts: [[len(t) + 1.0, 0.0] for t in ts])
    assert [r.embedding for r in own.collect()] == [[1.0, 0.0], [1.0, 0.0]]


def test_levels(spark, tmp_path):
    rows = [("C0001", "TREATS", "C0002"), ("C0001", "INHIBITS", "C0002"), ("C0001", "TREATS", "C0003"), ("C0002", "CAUSES", "C0003"), ("C0003", "BINDS_TO", "C0004"), ("C0004", "TREATS", "C0001")]
    f = facts.with_ids(spark.createDataFrame([(*r, D(2024, 1, 1)) for r in rows], "subject_id string, relation_type string, object_id string, valid_from date"))
    vec = f.select("fact_id", F.array(*[F.ascii(F.substring("fact_id", k, 1)).cast("double") for k in range(1, 5)]).alias("embedding"))
    v, m = V.build_levels(f, vec)
    assert {r.level: r.n for r in V.index_statistics(v).collect()} == {0: 6, 1: 5, 2: 4}
    V.save_levels(v, m, str(tmp_path / "index"))
    v, m = V.load_levels(spark, str(tmp_path / "index"))
    assert m.filter("level = 1 and key = 'C0001||C0002'").count() == 2


@pytest.mark.parametrize("n,size,overlap,mode,want", [(10, 4, 1, "merge_tail", [(0, 4), (3, 7), (6, 10)]), (10, 4, 1, "stride", [(0, 4), (3, 7), (6, 10), (9, 10)]), (3, 4, 1, "stride", [(0, 3)]), (0, 4, 1, "merge_tail", [])])
def test_chunks(spark, n, size, overlap, mode, want):
    rows = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(n)))], "id int, text string")
    assert [(r.start_word, r.end_word) for r in chunks.chunk(rows, size=size, overlap=overlap, mode=mode).orderBy("chunk_idx").collect()] == want
    with pytest.raises(ValueError):
        chunks.chunk(rows, size=4, overlap=4)


def test_text(spark):
    assert value(spark, text.clean_text(F.lit("  a\n\n b [ ] c ( )  "))) == "a b  c"
    assert value(spark, text.parse_pub_date(F.lit("2023"), F.lit(None).cast("string"), F.lit("40"))) == D(2023, 1, 31)
    assert value(spark, text.parse_pub_date(F.lit("2023"), F.lit("2"), F.lit("30"))) is None
    assert value(spark, ids.content_hash_id(F.lit(" Drug-X  (new) "))) == value(spark, ids.content_hash_id(F.lit("drugx new")))


@pytest.mark.parametrize("types,name,want", [(["T999", "T047"], "x", "disease"), ([], "Rituximab", "drug"), (None, "TP53", "gene"), ([], "lung cancer", "disease"), ([], "word", "unknown"), (["T087"], "x", "protein")])
def test_entity_types(spark, types, name, want):
    row = spark.createDataFrame([(types, name)], "t array<string>, n string")
    assert row.select(entities.entity_type("t", "n")).first()[0] == want


def test_gazetteer_and_model(spark):
    texts = spark.createDataFrame([(1, "The Lung Cancer, lung-cancer drug"), (2, None)], "doc_id int, text string")
    names = spark.createDataFrame([("lung cancer", "C1", "disease"), ("drug", "C2", "drug")], "name string, canonical_id string, label string")
    got = sorted((r.start, r.mention, r.canonical_id) for r in entities.match_gazetteer(texts, names).collect())
    assert got == [(1, "Lung Cancer", "C1"), (3, "lung cancer", "C1"), (5, "drug", "C2")]
    tag = lambda: lambda bodies: [[(0, 3, "X", 0.5)] if b else [] for b in bodies]
    assert [(r.doc_id, r.mention) for r in entities.extract_with(texts, tag).collect()] == [(1, "The")]


@pytest.mark.parametrize("response,want", [('[{"a":1}]', '[{"a":1}]'), ('{"a":1}', '[{"a":1}]'), ('x ```json\n[1]\n``` y', "[1]"), ("so [1, 2] it is", "[1, 2]"), ("nothing", None)])
def test_recovery(spark, response, want):
    assert value(spark, relations.recovered_json(F.lit(response))) == want


def test_prompts_and_cache(spark):
    m = spark.createDataFrame([(1, 0, 0, 5, "cat", "C1"), (1, 0, 0, 1, "dog", None)], "pmcid int, section_ord int, chunk_idx int, start int, mention string, canonical_id string")
    c = spark.createDataFrame([(1, 0, 0, "text")], "pmcid int, section_ord int, chunk_idx int, chunk string")
    p = relations.prompts(relations.mentions_per_chunk(m, c), "Do it.")
    row = p.first()
    assert row.prompt == "Do it.\n\nText:\ntext\n\nEntities:\n- dog (?)\n- cat (C1)" and len(row.prompt_key) == 16
    hit, wait = relations.split_cached(p, p.select("prompt_key", F.lit("[]").alias("response")))
    assert hit.count() == 1 and wait.count() == 0


def test_examples(spark):
    docs = spark.createDataFrame([("d", "A cat, no.")], "doc_id string, text string")
    t = examples.token_table(docs)
    assert [(r.word, r.start_char, r.end_char) for r in t.orderBy("token").collect()] == [("A", 0, 1), ("cat", 2, 5), (",", 5, 6), ("no", 7, 9), (".", 9, 10)]
    r = examples.router_examples(t, spark.createDataFrame([("d", 1, 1)], "doc_id string, token int, label int"))
    v = spark.createDataFrame([("C1", [3.0, 4.0])], "canonical_id string, embedding array<double>")
    pos = examples.positives(docs, spark.createDataFrame([("d", "C1")], "doc_id string, canonical_id string"), v, 2)
    neg = spark.createDataFrame([("d", 2, "C1")], "doc_id string, rank int, id string")
    row = examples.processed(examples.joint_examples(examples.retrieval_examples(r, pos, neg, v, 3, 2)), 7, 4, 2).first()
    assert row.router_labels == [0, 1, 0, 0, 0, 0, 0] and row.positive_embedding == [0.6, 0.8]
    assert row.negative_embeddings == [[3.0, 4.0], [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]] and row.token_labels[:4] == row.input_ids[1:5] and row.token_labels[4:] == [-100] * 3
    a, b = (examples.augmented(r, seed=5).first() for _ in range(2))
    assert a == b
    assert examples.positives(docs, spark.createDataFrame([], "doc_id string, canonical_id string"), v, 2).first().positive_embedding == [0.0, 0.0]
    assert value(spark, examples.lm_labels(F.array(F.lit(4), F.lit(5)), F.array(F.lit(1), F.lit(0)))) == [4, -100]


def test_split_is_exact_and_stable(spark):
    rows = spark.range(103).withColumn("ratio", F.col("id") / 103)
    one, two = (examples.exact_split(rows.repartition(k), "id", 0.2) for k in (1, 5))
    val = lambda d: sorted(r.id for r in d.filter("split = 'val'").collect())
    assert len(val(one)) == 20 and val(one) == val(two)
    assert examples.exact_split(examples.stratum(rows, "ratio"), "id", 0.2, by=("stratum",)).filter("split = 'val'").count() == 20


def test_usage_stream_and_ingest(spark, tmp_path):
    from kairograph.streaming import jobs

    schema = "subject_id string, relation_type string, object_id string, valid_from date, confidence double"
    rows = [(f"s{k}", "TREATS", "o", D(2024, 1, 1 + k % 3), 0.5) for k in range(9)]
    incoming, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame(rows, schema).write.parquet(incoming)
    for _ in range(2):
        jobs.ingest_facts(spark, incoming, spark.createDataFrame([], schema).schema, target, state).awaitTermination()
        spark.createDataFrame(rows[:4] + [("new", "TREATS", "o", D(2024, 5, 1), 0.1)], schema).write.mode("append").parquet(incoming)
    jobs.ingest_facts(spark, incoming, spark.createDataFrame([], schema).schema, target, state).awaitTermination()
    assert spark.read.parquet(target).count() == 10
    events = spark.createDataFrame([("u", dt.datetime(2024, 1, 1, 0, 0, s), 10) for s in (1, 5, 50)], "user string, ts timestamp, n long")
    events.write.parquet(str(tmp_path / "events"))
    stream = jobs.usage_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), "user", "ts", "n", max_requests=2)
    q = stream.writeStream.format("memory").queryName(f"usage{int(time.time())}").outputMode("update").start()
    q.processAllAvailable()
    got = {(r.start.minute, r.start.second): (r.requests, r.over_limit) for r in spark.table(q.name).collect()}
    q.stop()
    assert got[(0, 0)] == (3, True) and got[(0, 10)] == (1, False)


PAPER = """<article><front><journal-meta><journal-title>J Test</journal-title></journal-meta><article-meta><article-id pub-id-type="pmid">7</article-id>{pmc}
<title-group><article-title>On <italic>x</italic> and y</article-title></title-group><contrib-group><contrib><name><surname>Doe</surname><given-names>A B</given-names></name></contrib></contrib-group>
<pub-date><year>2023</year></pub-date><abstract><sec><title>Aim</title><p>To see.</p></sec><sec><title>End</title><p>Seen [ ].</p></sec></abstract><kwd-group><kwd>k1</kwd></kwd-group></article-meta></front>
<body>{body}</body><back><ref-list><ref id="r1"><name><surname>Roe</surname></name><article-title>Old</article-title><source>S</source><year>1999</year></ref></ref-list></back></article>"""


def test_papers(spark, tmp_path):
    import gzip

    from kairograph.sources import jats

    sections = "<sec><title>Methods</title><p>One <b>bold</b> two.</p></sec><sec><title>methods</title><p>More.</p></sec><sec><p>Loose.</p></sec>"
    (tmp_path / "a.xml").write_text(PAPER.format(pmc='<article-id pub-id-type="pmc">12</article-id>', body=sections))
    (tmp_path / "pmc34.nxml").write_text(PAPER.format(pmc="", body="<p>Only this.</p>"))
    (tmp_path / "bad.xml").write_text("<article>")
    (tmp_path / "PMC56.xml.gz").write_bytes(gzip.compress(PAPER.format(pmc="", body="").encode()))
    (tmp_path / "other.txt").write_text("x")
    papers, bad = jats.scan(spark, str(tmp_path))
    rows = {r.pmcid: r for r in papers.collect()}
    assert sorted(rows) == ["PMC12", "PMC34", "PMC56"] and bad.count() == 1
    r = rows["PMC12"]
    assert (r.title, r.abstract, r.publication_date, r.authors) == ("On x and y", "Aim: To see. End: Seen .", D(2023, 1, 1), ["A B Doe"])
    assert [(s.name, s.text) for s in r.body_sections] == [("methods", "One bold two. More."), ("unnamed", "Loose.")]
    assert [s.text for s in rows["PMC34"].body_sections] == ["Only this."] and rows["PMC56"].body_sections == []
    s = chunks.sections_of(papers)
    assert chunks.first_match(s).filter("pmcid = 'PMC12'").count() == 2
    wanted = spark.createDataFrame([("Methods",), ("abstract",)], "name string")
    assert chunks.per_request(s, wanted).filter("pmcid = 'PMC12'").count() == 2 and chunks.all_matches(s).count() == s.count()
    assert chunks.references_of(papers).count() == 3
    assert jats.scan(spark, str(tmp_path), max_papers=1)[0].count() == 1


def test_files(spark, tmp_path):
    from kairograph.sources import files

    (tmp_path / "list.csv").write_text("File,Article Citation,Accession ID\na.gz,J One. 2020 Jan,PMC1\nb.gz,J Two. 1990,PMC2\n,J One. 2021,PMC3\nc.gz,No year,PMC4\n")
    got = files.file_list(spark, str(tmp_path / "list.csv"), 2000, 2030, ["j one"]).collect()
    assert [(r.accession, r.year, r.journal) for r in got] == [("PMC1", 2020, "J One")]
    folder = tmp_path / "json"
    folder.mkdir()
    (folder / "chunks_1.json").write_text('[{"text": "a"}, {"text": null}]')
    (folder / "chunks_2.json").write_text('{"text": "b"}')
    (folder / "chunks_3.json").write_text("{broken")
    good, bad = files.json_arrays(spark, str(folder), "text string", "chunks_*.json")
    assert good.count() == 3 and bad.count() == 1
    assert sorted(r.text for r in files.text_chunks(spark, str(folder)).collect()) == ["", "a", "b"]
    ex = tmp_path / "ex"
    ex.mkdir()
    (ex / "a.json").write_text(json.dumps({"id": "1", "input_ids": [1]}, indent=1))
    (ex / "b.jsonl").write_text("\n".join(json.dumps({"id": str(k), "input_ids": [k]}) for k in range(3)))
    assert files.training_examples(spark, str(ex)).count() == 4
    files.write_examples(files.training_examples(spark, str(ex)), str(tmp_path / "written"), "id", 4)
    assert spark.read.json(str(tmp_path / "written")).count() == 4
    (tmp_path / "p.txt").write_text("one\n\n  two \n")
    (tmp_path / "p.json").write_text('["x", {"text": "y"}, ""]')
    assert [r.text for r in files.prompts(spark, str(tmp_path / "p.txt")).collect()] == ["one", "two"]
    assert sorted(r.text for r in files.prompts(spark, str(tmp_path / "p.json"), "json").collect()) == ["x", "y"]
    files.write_report(spark.createDataFrame([(1, 0.5)], "n int, f1 double"), str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report")).first().value) == {"n": 1, "f1": 0.5}
    assert files.file_sizes(spark, str(folder), "*.json").count() == 3
    f = fact_rows(spark, (D(2024, 1, 1), None)).withColumns({"subject_label": F.lit(None).cast("string"), "object_label": F.lit("B"), "source": F.lit("s"), "confidence": F.lit(None).cast("double")})
    rows = facts.exported(f).unionByName(facts.exported(f).withColumn("relation_type", F.lit("LIKES"))).unionByName(facts.exported(f).withColumn("valid_from", F.lit("soon")))
    rows.write.json(str(tmp_path / "export"))
    good, bad = facts.import_export(spark, str(tmp_path / "export"))
    assert good.count() == 1 and bad.count() == 2 and good.first().fact_id == f.first().fact_id


def brute_spans(items, text):
    """Spans of one text, looked up in order: from the last end, without case, from the start."""
    out, at = [], 0
    for k, item in enumerate(items):
        span = item.get("span") or ""
        start = text.find(span, at)
        if start < 0:
            start = text.lower().find(span.lower(), at)
        if start < 0:
            start = text.find(span)
        if start < 0:
            continue
        label = (item.get("label") or "linguistic").lower().strip()
        c = item.get("confidence")
        out.append((k, start, start + len(span), span, "factual" if label in ("factual", "retrieval") else "linguistic", min(max(0.5 if c is None else c, 0.0), 1.0)))
        at = start + len(span)
    return out


ITEMS_A = [{"span": "Drug A", "label": " Retrieval ", "confidence": 1.7}, {"span": "DRUG b", "label": "odd"}, {"span": "nowhere", "label": "factual"}, {"span": "helps", "confidence": -1.0}, {"span": "Drug A"}]


def test_span_responses(spark):
    import json

    from kairograph.operators import spans as B

    text, body = "Drug A and drug b helps. However", json.dumps(ITEMS_A)
    rows = [(1, text, body), (2, text, f"Sure:\n```json\n{body}\n```\nDone"), (3, text, f"x {body} y"), (4, text, "none"), (5, text, None), (6, "", body), (7, text, "[]")]
    got = B.parse_span_responses(spark.createDataFrame(rows, "k long, text string, response string")).collect()
    want = brute_spans(ITEMS_A, text)
    assert len(want) == 4
    by = {k: sorted((r.span_idx, r.start_char, r.end_char, r.span, r.label, r.confidence) for r in got if r.k == k) for k in range(1, 8)}
    assert by == {1: want, 2: want, 3: want, 4: [], 5: [], 6: [], 7: []}


def test_batch_span_responses(spark):
    import json

    from kairograph.operators import spans as B

    texts = [("a", 0, "Drug A and drug b helps."), ("a", 1, "However"), ("b", 0, "Drug A"), ("c", 0, "helps"), ("c", 1, "x"), ("d", 0, "Drug A")]
    results = {"0": ITEMS_A, "1": [{"span": "However", "label": "generation"}], "7": ITEMS_A}
    responses = [("a", "```json\n" + json.dumps({"results": results}) + "\n```"), ("b", json.dumps(ITEMS_A)), ("c", json.dumps(ITEMS_A)), ("d", "It is " + json.dumps({"results": {"0": ITEMS_A}}) + "!")]
    got = B.parse_batch_responses(spark.createDataFrame(responses, "batch_id string, response string"), spark.createDataFrame(texts, "batch_id string, text_idx int, text string")).collect()
    want = [("a", 0, *x) for x in brute_spans(ITEMS_A, texts[0][2])] + [("a", 1, *x) for x in brute_spans(results["1"], "However")]
    want += [(b, 0, *x) for b in "bd" for x in brute_spans(ITEMS_A, "Drug A")]
    assert sorted((r.batch_id, r.text_idx, r.span_idx, r.start_char, r.end_char, r.span, r.label, r.confidence) for r in got) == sorted(want)


def test_response_spans_of_the_table(spark, data):
    """Every word of each turn in order, by brute force."""
    from pyspark.sql import functions as F

    from kairograph.plans import spans as P

    labels = ("factual", "Retrieval ", "generation", "unheard of")
    turns = spark.read.parquet(f"{data}/conversations.parquet").withColumn("kind", F.expr("pmod(xxhash64(conv_id, turn), 4)")).collect()
    want = []
    for r in turns:
        if r.text is not None and r.kind < 3:
            items = [{"span": "@@@" if i % 7 == 6 else w.upper() if i % 3 == 2 else w, "label": labels[i % 4] if i % 5 < 4 else None, "confidence": i / 4 if i % 2 == 0 else None} for i, w in enumerate(r.text.split(" "))]
            want += [(r.conv_id, r.turn, k, s, e, label, c) for k, s, e, _, label, c in brute_spans(items, r.text)]
    assert want and sorted(map(tuple, P.response_spans(spark, data).collect())) == sorted(want)


def test_search_by_cells_when_there_are_enough(spark):
    import numpy as np

    from kairograph.operators import vectors as V

    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(400, 8)))]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = corpus.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    exact, cells = (sorted((r.query_id, r.rank, r.id) for r in V.search(queries, corpus, 5, nlist, 8).collect()) for nlist in (4096, 8))
    assert exact == cells


def test_patience_of_many_runs(spark):
    rng = np.random.default_rng(5)
    data = [(k % 7 or None, k, None if k % 11 == 0 else float(rng.integers(0, 20))) for k in range(300)]
    rows = spark.createDataFrame(data, "run int, step int, value double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        got = {(r.run, r.step): (r.best, r.bad, r.stop) for r in metrics.patience(rows, "run", "step", "value", 4, 0.5, "min").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 300
    for run in {r for r, _, _ in data}:
        best, bad, stop = None, 0, False
        for _, step, v in sorted((d for d in data if d[0] == run), key=lambda d: d[1]):
            better = v is not None and (best is None or v < best - 0.5)
            best, bad = (v, 0) if better else (best, bad + 1)
            stop = stop or bad >= 4
            assert got[run, step] == (best, bad, stop)


def test_random_negatives_leave_out_the_query_itself(spark):
    rows = spark.range(60).select("id", F.array(F.lit(1.0)).alias("embedding"))
    queries = spark.range(0, 90, 3).select(F.col("id").alias("query_id"))
    got = V.random_negatives(queries, rows, 7, seed=3).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.id)
    assert len(by) == 30 and all(len(v) == len(set(v)) == 7 and q not in v for q, v in by.items())
    assert len({tuple(sorted(v)) for v in by.values()}) == 30 and len({x for v in by.values() for x in v}) > 50
    again = V.random_negatives(queries.repartition(3), rows.repartition(5), 7, seed=3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    few = V.random_negatives(spark.range(3).select(F.col("id").alias("query_id")), rows.filter("id < 3"), 7).collect()
    assert sorted((r.query_id, r.id) for r in few) == [(a, b) for a in range(3) for b in range(3) if a != b]
    assert V.random_negatives(queries, rows.filter("id < 0"), 7).count() == 0


def test_similarity_counts_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6))
    x[7] = 0
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
    queries = rows.filter("id % 4 = 0").withColumnRenamed("id", "query_id")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    c = np.array([unit[a] @ unit[b] for a in range(0, 80, 4) for b in range(80) if a != b])
    for block in (4096, 6):
        counts = V.similarity_counts(queries, rows, block=block)
        got = {r.bucket: (r.n, r["mean"]) for r in V.similarity_histogram(counts).collect()}
        bucket = np.floor((c + 1) * 10).astype(int) + 1
        assert got == {int(b): (int((bucket == b).sum()), pytest.approx(c[bucket == b].mean(), abs=1e-9)) for b in set(bucket)}
        share = V.similarity_share(counts).first()
        inside = int(((c >= 0.3) & (c <= 0.8)).sum())
        assert (share.n, share.n_inside, share.share) == (len(c), inside, pytest.approx(inside / len(c)))
    assert tuple(V.similarity_share(V.similarity_counts(queries.filter("false"), rows)).first()) == (None, 0, 0)


def test_exact_split_of_strata(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 2 > 0, F.lit("cold")).alias("s"))
    h = {r.id: r.h for r in rows.select("id", F.xxhash64(F.lit(42), "id").alias("h")).collect()}
    want = set()
    members = {}
    for r in rows.collect():
        members.setdefault(r.s, []).append(r.id)
    for ids_ in members.values():
        want |= set(sorted(ids_, key=lambda k: (h[k], k))[: int(len(ids_) * 0.2)])
    got = examples.exact_split(rows.repartition(3), "id", 0.2, by=("s",)).collect()
    assert len(got) == 3000 and {r.id for r in got if r.split == "val"} == want


def test_ingest_raises_on_what_is_no_missing_path(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from kairograph.streaming import jobs

    kind = fact_rows(spark, (D(2024, 1, 1), None)).schema
    assert jobs._read_or_empty(spark, f"file://{tmp_path}/none", kind).count() == 0
    spark.range(1).write.parquet(f"file://{tmp_path}/there")
    with pytest.raises(AnalysisException):
        jobs._read_or_empty(spark, f"file://{tmp_path}/there", type(kind)([*kind.fields, kind.fields[0]])).count()


def test_token_places_of_a_long_text(spark):
    text_ = " ".join(f"w{k}," if k % 3 else f"  w{k}" for k in range(1500))
    rows = spark.createDataFrame([(1, text_), (2, ""), (3, None), (4, "one  two")], "doc_id long, text string")
    for most in (None, 512, 700):
        got = examples.token_table(rows, most=most).collect()
        long = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.token)
        assert [r.token for r in long] == list(range(2500 if most is None else most))
        assert all(text_[r.start_char : r.end_char] == r.word for r in long) and all(a.end_char <= b.start_char for a, b in zip(long, long[1:]))
        assert sorted((r.word, r.start_char) for r in got if r.doc_id != 1) == [("one", 0), ("two", 5)]
