import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from kairograph.llm import phrases as d


def brute(rows, longest=5, min_count=100, inside=100, top=2000):
    f, size = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            size[lang] += len(words)
            f[lang].update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, n in size.items():
        cand = {p: a for p, a in f[lang].items() if a >= min_count and len(p) > 1}
        found = []
        for p, a in cand.items():
            longer = (q for q, b in cand.items() if len(q) > len(p) and 100 * b >= inside * a)
            if any(p == q[i : i + len(p)] for q in longer for i in range(len(q) - len(p) + 1)):
                continue
            score, _, left, right = min((1000 * a * n // (f[lang][p[:k]] * f[lang][p[k:]]), k, f[lang][p[:k]], f[lang][p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts(seed, n=120):
    r = random.Random(seed)
    word = lambda: r.choice("a b c A été . d, \t e; \n x-y 12 \x1c \x0c".split(" "))
    return [(r.choice(["en", "en", "de", None, ""]), " ".join(word() for _ in range(r.randrange(60)))) for _ in range(n)]


ROWS = [*texts(1), ("en", None), ("en", ""), (None, None), ("en", "...,,,\n\n"), ("fr", "solo"), ("de", "lang b " * 40_000), *[("en", "a b c d e f")] * 30]
CLASH = "lang string, text string, n string, size string, phrase string, rank string, words string"


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    "limits",
    [dict(), dict(most=40), dict(top=3, inside=60), dict(longest=2), dict(longest=3, min_count=2), dict(min_count=10**6), dict(min_count=1, longest=4)],
)
def test_odd_rows(spark, limits):
    args = {"min_count": 5} | limits
    docs = spark.createDataFrame([(*r, *["clash"] * 5) for r in ROWS], CLASH).repartition(3)
    assert collected(d.collocations(docs, **args)) == brute(ROWS, **{k: v for k, v in args.items() if k != "most"})


def test_map_of_few_bits(spark, monkeypatch):
    monkeypatch.setattr(d, "BITS", 15)
    docs = spark.createDataFrame(ROWS, "lang string, text string")
    assert collected(d.collocations(docs, min_count=5)) == brute(ROWS, min_count=5)


@pytest.mark.parametrize("step, chunk, distinct", [(1, 1, 1), (300, 200, 3), (10**6, 10**6, 10**6)])
def test_parts_of_a_task(monkeypatch, step, chunk, distinct):
    for name, v in (("STEP", step), ("CHUNK", chunk), ("DISTINCT", distinct)):
        monkeypatch.setattr(d, name, v)
    monkeypatch.setattr(d._by_lang, "__defaults__", (step,))
    rows = [("und" if lang is None else lang, (t or "").encode()) for lang, t in ROWS]
    batches = lambda: [pa.record_batch([*map(list, zip(*rows[k : k + 50], strict=True))], names=["lang", "text"]) for k in range(0, len(rows), 50)]
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(b"[.,;:!?\x0a-\x0d]", text.lower()):
            words = piece.replace(b"\t", b" ").split(b" ")
            words = [w for w in words if w]
            f[lang].update(b" ".join(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    words, sizes = Counter(), Counter()
    for batch in d._count_words(iter(batches())):
        for lang, w, n in zip(*batch.to_pydict().values(), strict=True):
            (sizes if w is None else words).update({lang if w is None else (lang, w): n})
    assert words == Counter({(lang, w): n for lang, c in f.items() for w, n in c.items() if b" " not in w})
    all_set = SimpleNamespace(value=np.full(1 << 10, 255, np.uint8))
    hashes = Counter()
    for pairs in (None, all_set):
        for b in d._count_hashes(all_set, pairs, 5 if pairs else 2)(iter(batches())):
            hashes.update(dict(zip(*b.to_pydict().values(), strict=True)))
    likely = {r for b in d._texts_of(all_set, all_set, all_set, 5)(iter(batches())) for r in zip(*b.to_pydict().values(), strict=True)}
    runs = {(lang, w): n for lang, c in f.items() for w, n in c.items() if b" " in w}
    assert {(lang, w): hashes[h] for lang, w, h in likely} == runs and len(hashes) == len(runs)
    likely = {r[:2] for r in likely}
    found = sorted(likely)
    trie = SimpleNamespace(value=d.Trie([(lang, w.split(b" ")) for lang, w in found]))
    blocks = sorted((r for _ in range(2) for b in d._count_by(trie)(iter(batches())) for r in zip(*b.to_pydict().values(), strict=True)), key=lambda r: r[0])
    summed = d._sum_blocks(iter([pa.record_batch([[r[0]], pa.array([r[1]], pa.binary())], names=["block", "n"]) for r in blocks]))
    counted = {found[k]: n // 2 for b in summed for k, n in zip(*b.to_pydict().values(), strict=True)}  # of two tasks
    assert counted == {x: f[x[0]][x[1]] for x in found}


def test_large_counts_are_exact(spark):
    big = 10**15
    cut = spark.createDataFrame([(big, big - 1, big - 2, big - 3)], "a long, n long, l long, r long")
    whole = lambda c, n: f"CAST({c} AS decimal({n},0))"
    got = cut.selectExpr(f"{whole('a * 1000', 19)} * {whole('n', 18)} div ({whole('l', 18)} * {whole('r', 18)}) AS s").first().s
    assert got == 1000 * big * (big - 1) // ((big - 2) * (big - 3))


def test_trie_holds_its_phrases_and_no_other():
    r = random.Random(7)
    words = [b"%d" % k for k in range(80)]
    found = sorted({(r.choice("xy"), tuple(r.choice(words[: r.choice([3, 20, 80])]) for _ in range(r.randrange(1, 6)))) for _ in range(3000)})
    trie = d.Trie([(lang, list(p)) for lang, p in found])
    place = {p: k for k, p in enumerate(found)}
    for lang, p in found + [(r.choice("xy"), tuple(r.choice(words) for _ in range(r.randrange(1, 6)))) for _ in range(3000)]:
        state = np.array([trie.roots[lang]], np.int32)
        for w in p:
            _, state = trie.advance(state, np.array([trie.words[w]], np.int32))
            if not len(state):
                break
        assert (int(trie.accepts[state[0]]) if len(state) else -1) == place.get((lang, p), -1)


def test_empty(spark):
    assert d.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
