import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kairograph.llm import source_divergence as d


def brute(rows, min_docs=3, scale=10**9, top=200):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = {t for t, k in docs[lang].items() if k >= min_docs}
        whole = Counter()
        for s in sources:
            whole.update({t: c for t, c in n[lang, s].items() if t in kept})
        share = lambda c: {t: 1 + scale * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: share(n[lang, s]) for s in sources}, share(whole)
        price = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(price(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(price(p[s][t], q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


ROWS = [
    ("en", "a", "The cat, the DOG"), ("en", "a", "the cat_dog 3cat"), ("en", "b", "the the the dog dog dog"), ("en", "b", None), ("en", None, "cat dog Été été Été"), ("en", "", "Été cat"),
    ("en", "c", ""), ("en", "d", "12 34"), ("en", "e", "Été " * 50_000), ("fr", "a", "un"), ("fr", "b", "deux"), (None, "a", "un un"), ("", "b", "un"), ("", "c", "un deux"), ("de", "a", "eins"),
]
CLASH = "lang string, source string, text string, term string, n string, size string, item string, rank string"


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("limits", [(d.TERMS, d.SOURCES, d.FLUSH), (2, 2, 3), (1, 1, 10)])
def test_odd_rows(spark, monkeypatch, limits):
    rows = ROWS + [ROWS[0]] * 2
    docs = spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], CLASH)
    kept, counts, groups, langs = d.term_counts(docs)
    got = collected(d.pair_divergences(kept, counts, groups, langs, terms=limits[0], sources=limits[1]))
    assert got == sorted(x[:2] + x[3:5] for x in brute(rows) if x[2] == "pair")
    assert collected(d.source_divergence(docs)) == brute(rows)
    assert collected(d.source_divergence(docs, top=1, min_docs=1)) == brute(rows, 1, top=1)


def test_counts_are_handed_on_early(monkeypatch):
    import pyarrow as pa

    batch = pa.record_batch([["en"] * 4, ["a"] * 4, [b"x y", b"x", b"X z", b"x"]], names=["lang", "source", "text"])
    whole = pa.Table.from_batches(d._count_terms([batch]))
    monkeypatch.setattr(d, "FLUSH", 2)
    parts = pa.Table.from_batches(d._count_terms([batch]))
    total = lambda t: sorted(t.group_by("term").aggregate([("n", "sum"), ("docs", "sum")]).to_pylist(), key=str)
    assert len(parts) > len(whole) and total(parts) == total(whole)


def test_equal_subtrees_are_one_node_and_priced_once():
    leaves = np.array([[1, 0, 1, 0, 1, 0, 1, 0], [1, 0, 1, 0, 2, 0, 1, 0]])
    values, levels, roots = d._trees(leaves)
    assert len(values) == 3 and [len(x) for x, _ in levels] == [2, 2, 2]
    p, q = np.array([3, 7, 11]), np.array([2, 5, 13])
    got = d._price(roots[0], roots[1], levels, p, q)
    a, b = p[leaves[0]], q[leaves[1]]
    assert got == (((a - b) ** 2 // b).sum(), ((a - b) ** 2 // a).sum())


def test_table_in_blocks(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    kept, counts, groups, langs = d.term_counts(docs.repartition(7))
    got = collected(d.pair_divergences(kept, counts, groups, langs, terms=100, sources=7))
    assert got == sorted(x[:2] + x[3:5] for x in brute(rows) if x[2] == "pair")


def test_empty(spark):
    assert d.source_divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
