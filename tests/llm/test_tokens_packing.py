import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kairograph.llm import packing, queries, tokens

ODD = ["", None, "a\x1cb don't  ''s *'s", "x<|endoftext|>y <|ENDOFTEXT|>", "É É é ́ Σας ΣΑΣ 12 3½ İ ß", "\x00\x07 \x7f a b c\u0085d", "one", "one", "z" * 3000 + " word" * 6000]


@pytest.fixture(scope="module")
def library():
    return tokens.load_tokenizer("word_bpe_49k.json")


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_of_odd_texts(spark, library):
    docs = spark.createDataFrame([(k if k else None, t, "old") for k, t in enumerate(ODD)], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, tokens.token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str)
    want = []
    for k, t in enumerate(ODD):
        n = len(ids(library, t))
        want.append((k if k else None, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want, key=str)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.token_counts(none).collect() == []
    assert packing.pack(none).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_other_tokenizers(spark, data, name):
    library = tokens.load_tokenizer(name)
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(30)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, tokenizer=name).collect()}
    assert got == {k: len(ids(library, t)) for k, t in texts.items()}


@pytest.mark.parametrize("part", ["normalizer", "pre_tokenizer"])
def test_tokenizers_that_prepare_texts_otherwise_are_not_taken_apart(tmp_path, library, part):
    import json

    spec = json.loads(library.to_str())
    if part == "normalizer":
        spec["normalizer"] = None
    else:
        spec["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec))
    other = tokens.load_tokenizer(str(tmp_path / "other.json"))
    encoder = tokens.Encoder(str(tmp_path / "other.json"))
    for text in ["Hello THE World and NATO", *filter(None, ODD)]:
        assert encoder.value(text) == len(ids(other, text))
    assert tokens.Encoder("word_bpe_49k.json").by_piece


def test_pieces_that_are_alike_are_dealt_over_salts(spark, monkeypatch):
    docs = spark.createDataFrame([(None, "")] * 3000, "doc_id long, text string")
    seen, packing_materialize = [], packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df, name: seen.append(packing_materialize(df, name)) or seen[-1])
    rows = packing.pack(docs).collect()
    assert len(rows) == 3000
    salts = seen[0].select((packing.F.pmod(packing.F.xxhash64("number"), packing.F.lit(32))).alias("salt")).groupBy("salt").count().collect()
    assert len(salts) == 32 and max(r["count"] for r in salts) < 200
    check_packing(rows, Counter({(None, 0, 0, 1, zlib.crc32(np.array([1], "<u4").tobytes())): 3000}), 4096)


def test_counts_of_the_table(spark, data, library):
    want = {r.doc_id: len(ids(library, r.text)) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in queries.op8_token_counts(spark, data).collect()} == want


def test_frequent_table_covers_all_rows(spark):
    docs = spark.createDataFrame([(k, "the " * 20 + f"rare{k}") for k in range(200)], "doc_id long, text string")
    assert {r.pre_token: r.n for r in tokens.frequent_pre_tokens(docs, share=0.01).collect()} == {"the": 4000}


def check_packing(rows, want, cap):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for runs in places.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= cap
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(places)


@pytest.mark.parametrize("cap", [4096, 64])
def test_packing_of_the_table(spark, data, library, cap):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(k if k else None, t) for k, t in enumerate(ODD)], docs.schema))
    want, total = Counter(), 0
    for r in docs.collect():
        all_ids = np.array([*ids(library, r.text), 1], dtype="<u4")
        total += len(all_ids)
        for piece, at in enumerate(range(0, len(all_ids), cap)):
            part = all_ids[at : at + cap]
            want[r.doc_id, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    used = check_packing(packing.pack(docs, cap=cap).collect(), want, cap)
    assert used <= 1.02 * total / cap + 2


def test_ids_are_returned(spark, library):
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    assert packing.pack(docs, with_ids=True).first().ids == [*ids(library, "hello world"), 1]


@pytest.mark.parametrize("counts", [{}, {4096: 3}, {1: 10_000}, {2049: 5, 2048: 5, 2047: 5}, {1366: 7, 1365: 9, 1000: 50, 3: 1}])
def test_plan_uses_every_item_once(counts):
    plan = packing.make_plan(counts)
    room = defaultdict(list)
    taken = Counter()
    for length, runs in plan.runs.items():
        ends = [r[0] for r in runs[1:]] + [counts[length]]
        for (rank, sequence, offset), end in zip(runs, ends):
            taken[length] += end - rank
            for k in range(end - rank):
                room[sequence + k].append((offset, length))
    assert +taken == Counter({k: n for k, n in counts.items() if n})
    for runs in room.values():
        runs.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(runs, runs[1:])) and sum(runs[-1]) <= 4096
    assert len(room) == plan.sequences
