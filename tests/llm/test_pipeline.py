import random
import zlib
from collections import Counter

import numpy as np
import pytest
import test_decontaminate
import test_line_dedup
import test_quality_rules
from pyspark.sql import functions as F
from test_tokens_packing import check_packing, ids, library  # noqa: F401

import corpus_pipeline
from kairograph.llm import line_dedup


def brute_near_duplicates(rows):
    """(doc_id, text) rows that stay: the smallest id of each component of texts whose sets of five-word shingles have a
    Jaccard similarity of 0.8 or more (A-Z lower-cased; fewer words are one shingle, no words an empty set)."""
    texts = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in texts]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            every = len(sets[a] | sets[b])
            if (not every or 10 * len(sets[a] & sets[b]) >= 8 * every) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        least[g] = min(i, least.get(g, i))
    return [(i, t) for g, (i, t) in zip(group, rows) if least[g] == i]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_each_stage_against_brute_force(spark, sf, library):  # noqa: F811
    sf_dir = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, now = docs.columns, [tuple(r) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = corpus_pipeline.STAGES
    assert [n for n, _ in stages] == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for k, (_, stage) in enumerate(stages[:-1]):
        got = stage(spark, docs, sf_dir)
        assert got.columns == columns
        rows = sorted(map(tuple, got.collect()))
        if k == 0:
            kept = {r[0] for r in test_quality_rules.brute([(d, t, lang) for d, t, lang, _, _ in now]) if r[-1]}
            want = [r for r in now if r[0] in kept]
        elif k == 1:
            cut = {r[0]: r[1] for r in test_line_dedup.brute([(d, s, t) for d, t, _, s, _ in now], line_dedup.RATIO, line_dedup.MIN_LINE_PAGES, line_dedup.MIN_HOST_PAGES)}
            want = [(d, cut[d], lang, s, len(cut[d])) for d, _, lang, s, _ in now]
        elif k == 2:
            stay = {i for i, _ in brute_near_duplicates([(d, t) for d, t, *_ in now])}
            want = [r for r in now if r[0] in stay]
        else:
            clean = {r[0] for r in test_decontaminate.brute([(d, t) for d, t, *_ in now], items) if not r[-1]}
            want = [r for r in now if r[0] in clean]
        assert rows == sorted(want)
        now, docs = want, spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.run(spark, sf_dir).withColumnRenamed("doc_id", "id").collect()
    want = Counter()
    for d, t, *_ in now:
        every = np.array([*ids(library, t), 1], dtype="<u4")
        for piece, at in enumerate(range(0, len(every), 4096)):
            part = every[at : at + 4096]
            want[d, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    check_packing(packed, want, 4096)


def test_near_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(3)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    base = [fresh(200) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base[:20]):
        words = t.split()
        words[100] = "changed"
        rows += [(100 + k, " ".join(words)), (200 + k, t)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == list(range(40))


def test_stages_take_clashing_columns(spark, data):
    names = ["k1", "k2", "k", "own", "host", "_host", "_drop", "kept", "candidates", "n", "x", "word", "node", "component", "_row_key", "pieces", "salt", "rank", "piece", "contaminated", "n_words", "n_lines", "document"]
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    for name in names:
        docs = docs.withColumn(name, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, data)
        assert got.columns == docs.columns, name
        assert {tuple(r[c] for c in names) for r in got.collect()} == {("clash",) * len(names)}, name
    assert corpus_pipeline.pack_documents(spark, docs, data).count() >= 60


def test_stages_take_odd_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 30_000, None, "s", 7), (3, "the cat and the dog of a man in the house was on it for some time and by now is with us", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, sf_dir).collect()


def test_rows_of_equal_id_and_text_do_not_hang_on_the_order(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, lang, "s") for lang in "xyzvw"]
    kept = {tuple(corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(r, "doc_id long, text string, lang string, source string").repartition(p), "").collect()) for p in (1, 4) for r in (rows, rows[::-1])}
    assert len(kept) == 1 and len(kept.pop()) == 1
