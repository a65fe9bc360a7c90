import hashlib
import random
from collections import Counter

import pytest

from kairograph.llm import queries
from kairograph.llm import suffix_dedup as s


def brute(rows, length=400):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(hashlib.md5(b[p : p + length]).digest() for _, b in data for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b) + 1)
        for p in range(len(b) - length + 1):
            if seen[hashlib.md5(b[p : p + length]).digest()] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        kept = bytes(c for k, c in enumerate(b) if not gone[k])
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def odd_rows():
    rng = random.Random(5)
    fresh = lambda n: "".join(rng.choice("abcdefghij klmnopé") for _ in range(n))
    passage, border = fresh(700), "x" + fresh(399)
    border = border[: len(border) - (len(border.encode()) - 400)] if len(border.encode()) > 400 else border
    while len(border.encode()) > 400:
        border = border[:-1]
    border += "y" * (400 - len(border.encode()))
    rows = [(1, None), (2, ""), (3, "a" * 399), (4, "a" * 399), (5, "b" * 400), (6, "c" * 401), (7, "d" * 1000), (8, fresh(50) + passage + fresh(60)), (9, passage[:500] + fresh(10)), (10, fresh(300) + passage[100:] + fresh(5))]
    rows += [(11, fresh(20) + border), (12, border + fresh(20)), (13, fresh(30) + border[1:] + "!"), (14, fresh(900)), (15, fresh(900) + "end"), (16, passage), (16, passage), (None, fresh(500)), (None, "ab" * 600)]
    copied = fresh(1200)
    rows += [(20 + k, copied) for k in range(6)] + [(30, copied + "."), (31, copied[:600] + "Q" + copied[601:])]
    twice = fresh(450)
    rows += [(40, twice + fresh(100) + twice), (41, fresh(3000) + passage[250:660] + fresh(3000) + passage[:450])]
    rows += [(50 + k, fresh(rng.randrange(100)) + passage[:460] + fresh(rng.randrange(100))) for k in range(40)]
    return rows


@pytest.mark.parametrize("hot", [2000, 3])
def test_odd_rows(spark, hot):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, k1 string, bytes int")
    assert got(s.remove_repeats(docs, hot=hot)) == brute(rows)


def test_chunks_and_long_texts(spark, monkeypatch):
    rows = odd_rows()
    monkeypatch.setattr(s, "CHUNK", 64)
    found = {}
    texts = [(t or "").encode() for _, t in rows]
    for r, h, p, a, b in s._runs(texts, 400):
        for w in range(a, b + 1):
            found.setdefault((r, w), set()).add((h, p - w))
    monkeypatch.setattr(s, "CHUNK", 1 << 20)
    whole = {}
    for r, h, p, a, b in s._runs(texts, 400):
        for w in range(a, b + 1):
            whole.setdefault((r, w), set()).add((h, p - w))
    assert found == whole and set(whole) == {(r, w) for r, t in enumerate(texts) for w in range(len(t) - 399)}


def test_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = brute(rows)
    assert got(queries.op4_suffix_dedup(spark, data).withColumnRenamed("doc_id", "id")) == want
    assert sum(r[2] > 0 for r in want) > 5


def test_kept_text(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in s.remove_repeats(docs, with_text=True).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def test_bucket_sort_against_all_pairs():
    rng = random.Random(2)
    for _ in range(30):
        base = bytes(rng.choice(b"ab") for _ in range(120))
        members = []
        for _ in range(rng.randrange(1, 9)):
            x = bytearray(base)
            for _ in range(rng.randrange(3)):
                x[rng.randrange(120)] = rng.choice(b"abc")
            low, high = rng.randrange(30), rng.randrange(80, 121)
            members.append((50 - low, bytes(x[low:high])))
        members = list(dict.fromkeys(members))
        want = []
        for m, (at, data) in enumerate(members):
            want.append([p for p in range(len(data) - 39) if any(0 <= at2 - at + p and data2[at2 - at + p :][:40] == data[p : p + 40] for n, (at2, data2) in enumerate(members) if n != m)])
        assert [sorted(x) for x in s.tied_suffixes(members, 40, 16)] == want


def test_empty(spark):
    assert s.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_shared(rows, words):
    """Words of each row in windows that another row holds too."""
    texts = [(t or "").encode().split() for _, t in rows]
    held = {}
    for r, w in enumerate(texts):
        for p in range(len(w) - words + 1):
            held.setdefault(tuple(w[p : p + words]), set()).add(r)
    out = []
    for (i, _), w in zip(rows, texts):
        hit = {q for p in range(len(w) - words + 1) if len(held[tuple(w[p : p + words])]) > 1 for q in range(p, p + words)}
        out.append((i, len(hit)))
    return sorted(out, key=str)


def passage_rows():
    rng = random.Random(6)
    fresh = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmno") + str(rng.randrange(9)) for _ in range(n))
    passage, other, copied = fresh(51), fresh(50), fresh(120)
    rows = [(1, None), (2, ""), (2, ""), (3, "w " * 49), (3, "w " * 49), (4, "v " * 300), (5, "v " * 60), (None, "u " * 70)]
    rows += [(10 + k, fresh(rng.randrange(60)) + "\n" + passage.replace(" ", " \t"[k % 2]) + " " + fresh(rng.randrange(60))) for k in range(5)]
    rows += [(20 + k, fresh(20) + " " + other + " " + fresh(k)) for k in range(2)] + [(23, other.rsplit(" ", 1)[0] + " " + fresh(30))]
    rows += [(30, copied), (30, copied), (31, copied + " x"), (32, fresh(10) + " " + copied[10:]), (33, fresh(400)), (34, passage + " " + passage)]
    return rows


@pytest.mark.parametrize("words", [50, 12])
def test_shared_passages(spark, words):
    rows = passage_rows()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, k1 string")
    got_ = sorted(((r.id, r.n_shared_words) for r in s.remove_repeats(docs, passage=words).collect()), key=str)
    assert got_ == brute_shared(rows, words)
    assert s.remove_repeats(docs.limit(0), passage=words).collect() == []


def test_shared_passages_of_the_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = brute_shared(rows, s.PASSAGE)
    assert sorted(((r.doc_id, r.n_shared_words) for r in queries.op4_suffix_dedup(spark, data).collect()), key=str) == want
    assert sum(n > 0 for _, n in want) > 5
