import hashlib
import re

import pytest
from pyspark.sql import functions as F

from kairograph.llm import exact_dedup as d


def brute(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = {}
    for k, t in enumerate(norm):
        groups.setdefault(t, []).append(k)
    out = []
    for k, t in enumerate(norm):
        first = min(groups[t], key=lambda g: (rows[g][0] is None, rows[g][0] or 0, g))
        out.append((rows[k][0], rows[first][0], len(groups[t]), k == first, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


ODD = [
    (5, "a b"), (3, "a \t\n b"), (9, "a\x0bb"), (9, "a\rb"), (1, " a b"), (2, "a b "), (None, "a b"), (4, None), (6, ""), (8, " "), (8, "\x0c"),
    (None, "only"), (None, "only"), (7, "x y"), (10, "x y"), (11, "\x1cz"), (12, "z"), (13, "w " * 300_000), (14, "w\n" * 300_000), (15, "A b"),
]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("digest", [d.content_hash, lambda t: F.length(t) % 3, lambda t: F.lit(1)], ids=["md5", "weak", "one"])
@pytest.mark.parametrize("most", [0, 1000])
def test_odd_rows(spark, digest, most):
    docs = spark.createDataFrame([(*r, *["clash"] * 6) for r in ODD], "doc_id long, text string, id string, h string, n string, tie string, size string, keep_id string")
    assert collected(d.exact_copies(docs, digest=digest, most=most)) == brute(ODD)
    kept = d.drop_copies(docs, digest=digest, most=most)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _, _, k, _ in brute(ODD) if k)


def test_tie_of_ids_does_not_hang_on_the_order(spark):
    rows = [(1, "a  b", x) for x in "zyxw"] + [(1, "a b", "v"), (2, "a b", "u")]
    kept = {tuple(d.drop_copies(spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(p)).collect()) for p in (1, 4) for r in (rows, rows[::-1])}
    assert len(kept) == 1 and len(kept.pop()) == 1


def test_hot_text_and_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(k, "hot\ntext") for k in range(10_000, 10_400)]
    assert collected(d.exact_copies(spark.createDataFrame(rows, docs.schema))) == brute(rows)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert d.exact_copies(empty).collect() == [] and d.drop_copies(empty).collect() == []


def test_no_python_in_the_plan(spark, data):
    plan = d.exact_copies(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
