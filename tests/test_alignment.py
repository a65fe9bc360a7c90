"""Spans of long texts by cells, and names of several words in texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kairograph.operators import entities as N
from kairograph.operators import spans as B


def marks(seed, docs=6, length=2000):
    r = random.Random(seed)
    out = []
    for d in range(docs):
        for k in range(r.randrange(60)):
            s = r.randrange(-5, length)
            out.append((d, k, s, s + r.choice([-1, 0, 1, 5, 40, 700]), r.choice(["factual", "factual", "linguistic"])))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, span_idx int, start_char int, end_char int, label string")


def covered(rows, d):
    return {c for doc, _, s, e, label in rows if doc == d and label == "factual" for c in range(s, e)}


@pytest.mark.parametrize("cell", [1, 7, 256])
def test_tokens_and_kappa_equal_characters(spark, monkeypatch, cell):
    monkeypatch.setattr(B, "CELL", cell)
    rows, other = marks(1), marks(2)
    r = random.Random(3)
    tokens = [(d, k, 11 * k, 11 * k + r.choice([0, 1, 3, 11, 30])) for d in range(6) for k in range(180)]
    got = B.token_labels(spark.createDataFrame(tokens, "doc_id long, token int, start_char int, end_char int"), frame(spark, rows)).collect()
    inside = {d: covered(rows, d) for d in range(6)}
    want = sorted((d, k, int(2 * len(inside[d] & set(range(s, e))) > e - s)) for d, k, s, e in tokens)
    assert sorted(map(tuple, got)) == want
    texts = spark.createDataFrame([(d, 2000) for d in range(6)], "doc_id long, n int")
    whole = set(range(2000))
    found = {x.doc_id: (x.tp, x.fp, x.fn, x.tn) for x in B.kappa(texts, frame(spark, rows), frame(spark, other)).collect()}
    for d in range(6):
        a, b = covered(rows, d) & whole, covered(other, d) & whole
        assert found[d] == (len(a & b), len(a - b), len(b - a), 2000 - len(a | b))


def test_rows_of_a_long_text_follow_its_spans(spark):
    """20,000 words, a span on each: the pieces' join makes rows in proportion, not words times spans."""
    tokens = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("token"), (F.col("id") * 7).cast("int").alias("start_char"), (F.col("id") * 7 + 6).cast("int").alias("end_char"))
    spans = tokens.withColumns({"label": F.lit("factual"), "span_idx": F.col("token")})
    left, right = B._pieces(tokens, ["doc_id", "token"]), B._pieces(spans, ["doc_id"])
    met = left.select("_cell").join(right.groupBy("_cell").count(), "_cell").agg(F.sum("count")).first()[0]
    assert met < 50 * 20_000
    assert B.token_labels(tokens, spans).agg(F.sum("label")).first()[0] == 20_000


def mentions(texts, names, most):
    out = []
    for d, t in texts:
        words = re.findall(r"\w+", t or "")
        for n in range(1, most + 1):
            for i in range(len(words) - n + 1):
                run = " ".join(words[i : i + n])
                out += [(d, i, run, c) for name, c in names if name.lower() == run.lower()]
    return sorted(out)


@pytest.mark.parametrize("most", [0, 10**6])
@pytest.mark.parametrize("max_words", [1, 2, 3, 5])
def test_names_in_texts(spark, most, max_words):
    r = random.Random(4)
    words = ["Lung", "cancer", "of", "the", "É", "x1", "IL", "2", "und_er"]
    texts = [(k, " ".join(r.choice(words) + r.choice(["", ",", " -", "\n"]) for _ in range(r.randrange(40)))) for k in range(40)] + [(98, None), (99, "")]
    names = [("lung cancer", "C1"), ("LUNG", "C2"), ("lung", "C3"), ("cancer of the lung", "C4"), ("il 2", "C5"), ("IL-2", "C6"), ("é x1", "C7"), ("", "C8"), ("of the", "C9"), ("lung  cancer", "C10")]
    found = N.match_gazetteer(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(*n, "T") for n in names], "name string, canonical_id string, label string"), max_words=max_words, most=most)
    assert found.columns == ["doc_id", "start", "mention", "canonical_id", "label"]
    assert sorted((x.doc_id, x.start, x.mention, x.canonical_id) for x in found.collect()) == mentions(texts, names, max_words)
