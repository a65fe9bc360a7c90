"""Tokens and rules in one pass: no row a token, no rule tried twice, lists of words as trees of letters."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kairograph.operators import examples as D
from kairograph.operators import spans as B

QUERIES = entry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_router_examples_deals_no_tokens(spark, data):
    found = plan(QUERIES["router_examples"](spark, data))
    assert found.count("Generate ") == 1 and "hashpartitioning(doc_id" in found and ", token" not in found  # the spans' own


@pytest.mark.parametrize("most", [None, 3])
@pytest.mark.parametrize("tokens", [1, 1 << 18])
def test_examples_from_arrays_are_those_from_rows(spark, most, tokens, monkeypatch):
    monkeypatch.setattr(D, "TOKENS", tokens)
    texts = [(1, "ab, cde  fgh. x"), (2, None), (3, "  "), (4, "ünï çödé\n-- z" * 3), (5, ""), (6, "none here"), (None, "a b")]
    spans = [(1, 0, 3), (1, 2, 6), (1, 6, 6), (1, 9, 40), (4, -5, 2), (4, 4, 9), (4, 30, 31), (9, 0, 5), (5, 0, 9)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    marked = spark.createDataFrame([(*s, label) for s in spans for label in ("factual", "linguistic")] + [(6, 0, 9, "linguistic")], "doc_id long, start_char int, end_char int, label string")
    table = D.token_table(docs, most=most)
    for r in table.collect():
        text = dict(texts)[r.doc_id]
        assert text[r.start_char : r.end_char] == r.word
        assert len(re.findall(r"\w+|[^\w\s]", text[: r.start_char])) == r.token
    want = D.router_examples(table, B.token_labels(table, marked)).filter("doc_id is not null")
    got = D.router_examples_of(docs, marked, most=most)
    assert got.columns == want.columns and sorted(got.filter("doc_id is not null").collect()) == sorted(want.collect())
    assert got.filter("doc_id is null").first().router_labels == [0, 0]


def test_rules_are_tried_once(spark, data):
    found = plan(QUERIES["hybrid_split"](spark, data))
    assert found.count("FileScan parquet") == 1 and found.count(r"C\d{7}") == 1


def test_word_lists_as_trees(spark):
    words = sorted({w for p in B.FACTUAL for w in re.findall(r"[A-Za-z0-9κμαβ&-]{2,}", p)})
    cases = [t for w in words for t in (w, f"x{w}", f"{w}x", f" a {w.upper()} b", f"{w[:-1]}", f"{w}1 mg", f"stage {w}")]
    raw = F.lit(False)
    for p in B.FACTUAL:
        raw = raw | F.col("t").rlike("(?U)" + p)
    tree = F.lit(False)
    for p in B._factual_tests():
        tree = tree | F.col("t").rlike("(?U)" + p)
    found = spark.createDataFrame([(c,) for c in cases], "t string").select("t", raw.alias("raw"), tree.alias("tree")).collect()
    assert [r.t for r in found if r.raw != r.tree] == [] and {r.raw for r in found} == {True, False}
    assert len(B._factual_tests()) < len(B.FACTUAL)
