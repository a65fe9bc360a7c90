import math
import zlib
from collections import Counter

import numpy as np
import pytest

from kairograph.llm import brown_lm as b
from kairograph.llm import queries


def tokens(text):
    return [*(text or "").encode().lower().split(), b.END]


def is_held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute_base(rows):
    counts = Counter()
    for i, t in rows:
        if not is_held_out(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        out.append((i, is_held_out(i), len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)))
    return sorted(out, key=str)


def got_base(df):
    rows = df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()
    return sorted(((*r[:5], round(r[5], 6)) for r in rows), key=str)


def brute_score(model, training, text):
    """From the class map alone: transitions and emissions counted again."""
    classes = {bytes(r.word): r["class"] for r in model.words.collect()}
    unseen = lambda w: 0 if w == b.END else int(model.classes[model.items.value.first_bucket + b.bucket(w)])
    cls = lambda w: classes[w] if w in classes else unseen(w)
    pairs, emitted, counts = Counter(), Counter(), Counter()
    for t in training:
        seq = [b.END, *tokens(t)]
        pairs.update((cls(x), cls(y)) for x, y in zip(seq, seq[1:]))
        counts.update(seq[1:])
    kinds = Counter(cls(w) for w in counts)
    for w, n in counts.items():
        emitted[cls(w)] += n
    before = Counter()
    for (x, _), n in pairs.items():
        before[x] += n
    total = 0.0
    seq = [b.END, *tokens(text)]
    for x, y in zip(seq, seq[1:]):
        c, d = cls(x), cls(y)
        total += math.log10((pairs[c, d] + 0.5) / (before[c] + 0.5 * b.CLASSES)) + math.log10((counts[y] + 1) / (emitted[d] + kinds[d] + 1))
    return total


@pytest.fixture(scope="module")
def scored(spark, data):
    return queries.op1_brown_lm(spark, data).cache()


def test_base_of_the_table(spark, data, scored):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert got_base(scored) == brute_base(rows)


def test_model_beats_the_base_on_held_out_texts(scored):
    held = scored.filter("held_out").groupBy().sum("score", "base_score").first()
    assert held[0] > held[1]


def test_odd_rows(spark):
    long = " ".join(f"w{k % 700}" for k in range(30_000))
    rows = [(1, "the cat sat"), (2, None), (3, ""), (4, " \n\t "), (5, "The CAT  ran\x0bÉ é"), (6, long), (6, long), (None, "the dog"), (None, None), (20, "unseen words only"), (21, "the the the")]
    rows += [(k, f"the cat {k % 5} ran to the dog") for k in range(30, 60)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, word string, score double")
    assert got_base(b.split_and_score(spark, docs)) == brute_base(rows)
    training = [t for i, t in rows if not is_held_out(i)]
    model = b.train(docs.filter(~b.held_out()))
    got = b.score(docs.select("doc_id", "text"), model).collect()
    want = sorted(brute_score(model, training, t) for _, t in rows)
    assert np.allclose(sorted(r.score for r in got), want, atol=1e-6)
    assert len(got) == len(rows) and all(math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens)) for r in got)


def test_emissions_and_transitions_are_distributions(spark):
    docs = spark.createDataFrame([(k, f"a b c d{k % 3} e") for k in range(20)], "doc_id long, text string")
    model = b.train(docs)
    transition = (model.pairs + 0.5) / (model.pairs.sum(axis=1, keepdims=True) + 0.5 * b.CLASSES)
    assert np.allclose(transition.sum(axis=1), 1)
    assert model.class_tokens.sum() == model.tokens == 120 and model.class_words.sum() == model.distinct == 8
    assert np.allclose(((model.class_tokens + model.class_words) + 1) / (model.class_tokens + model.class_words + 1), 1)


def test_exchange_raises_the_likelihood(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")

    def likelihood(rounds):
        m = b.train(docs, rounds=rounds)
        p = m.pairs
        x = lambda a: float(b._xlogx(a).sum())
        return x(p) - x(p.sum(axis=0)) - x(p.sum(axis=1))

    assert likelihood(2) > likelihood(0)


def test_no_round_lowers_the_likelihood(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    fits = b.learn_classes(docs, rounds=8).likelihoods
    print("log likelihood by round:", [round(x) for x in fits])
    assert len(fits) >= 3 and all(later >= earlier for earlier, later in zip(fits, fits[1:])) and fits[-1] > fits[0] + 0.03 * abs(fits[0])
    assert fits[-1] - fits[-3] < b.GAIN * abs(fits[-1]) or len(fits) == 9


def test_leaders_move_one_by_one_by_exact_counts(spark):
    rng = np.random.default_rng(6)
    texts = [[0, *np.minimum(rng.zipf(1.3, n), 60).tolist(), 0] for n in rng.integers(0, 80, 60)]
    encoded = spark.createDataFrame([(t,) for t in texts], "items array<int>").repartition(3)
    among = b.leader_pairs(encoded, 20)
    want = np.zeros((21, 21))
    for t in texts:
        for x, y in zip(t, t[1:]):
            if 0 < x <= 20 and 0 < y <= 20:
                want[x, y] += 1
    assert (among == want).all()
    classes = np.r_[0, rng.integers(1, b.CLASSES, 60)]
    pairs = b._pairs_of(encoded, [classes])[0]
    left, right = np.zeros((2, 21, b.CLASSES))
    for t in texts:
        for x, y in zip(t, t[1:]):
            if y <= 20:
                left[y, classes[x]] += 1
            if x <= 20:
                right[x, classes[y]] += 1
    led, after = b.sweep(classes, pairs, left, right, among)
    assert (led[21:] == classes[21:]).all() and (led != classes).any()
    assert (after == b._pairs_of(encoded, [led])[0]).all()
    assert b.log_likelihood(after) > b.log_likelihood(pairs)


def test_pairs_of_several_maps_in_one_pass(spark):
    rng = np.random.default_rng(4)
    texts = [[0, *rng.integers(1, 50, n).tolist(), 0] for n in rng.integers(0, 30, 40)]
    encoded = spark.createDataFrame([(t,) for t in texts], "items array<int>").repartition(3)
    maps = [rng.integers(0, b.CLASSES, 50) for _ in range(3)]
    want = np.zeros((3, b.CLASSES, b.CLASSES))
    for t in texts:
        for x, y in zip(t, t[1:]):
            for k, m in enumerate(maps):
                want[k, m[x], m[y]] += 1
    assert (b._pairs_of(encoded, maps) == want).all()
    assert (b._pairs_of(encoded.limit(0), maps) == 0).all()


def test_empty(spark):
    assert b.split_and_score(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_best_class_is_the_one_of_most_gain():
    rng = np.random.default_rng(5)
    x = lambda a: float(b._xlogx(a).sum())
    for _ in range(20):
        pairs = rng.integers(0, 40, (b.CLASSES, b.CLASSES)).astype(float) * rng.integers(0, 2, (b.CLASSES, b.CLASSES))
        left, right = (rng.choice([0, 1, 2, 30], b.CLASSES).astype(float) * (rng.random(b.CLASSES) < 0.1) for _ in range(2))
        own = int(rng.integers(1, b.CLASSES))
        pairs[own] += right
        pairs[:, own] += left

        def gain(k, sign):
            after, before = pairs.copy(), pairs.copy()
            after[k] = np.maximum(after[k] + sign * right, 0)
            before[:, k] = np.maximum(before[:, k] + sign * left, 0)
            rows = x(after.sum(axis=1)) - x(pairs.sum(axis=1))
            columns = x(before.sum(axis=0)) - x(pairs.sum(axis=0))
            return x(after) + x(before) - 2 * x(pairs) - rows - columns

        gains = [gain(k, 1.0) + gain(own, -1.0) for k in range(b.CLASSES)]
        gains[0], gains[own] = -math.inf, 0.0
        got = int(b.best_classes(np.array([own]), left[None], right[None], b.gain_tables(pairs))[0])
        assert math.isclose(gains[got], max(gains), abs_tol=1e-6)


def test_words_of_the_tail_are_exchanged_one_by_one(spark, data, monkeypatch):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(b, "SLOT", 700)  # many ranges and parts
    model = b.train(docs, rounds=1, share=0.005, floor=2)
    items = model.items.value
    seqs = [[b.END, *tokens(r.text)] for r in rows]
    counts = Counter(w for seq in seqs for w in seq[1:])
    item = lambda w: 0 if w == b.END else items.item(w)
    kind = lambda w: int(model.classes[item(w)])
    pairs, lefts, rights = np.zeros((b.CLASSES, b.CLASSES)), {}, {}
    for seq in seqs:
        for v, w in zip(seq, seq[1:]):
            pairs[kind(v), kind(w)] += 1
            lefts.setdefault(w, np.zeros(b.CLASSES))[kind(v)] += 1
            rights.setdefault(v, np.zeros(b.CLASSES))[kind(w)] += 1
    known = b.gain_tables(pairs)
    want = {}
    for w, n in counts.items():
        alone = w != b.END and w not in items.words and n >= 2
        want[w] = int(b.best_classes(np.array([kind(w)]), lefts[w][None], rights[w][None], known)[0]) if alone else kind(w)
    got = {bytes(r.word): (r["class"], r.n) for r in model.words.collect()}
    assert got == {w: (k, counts[w]) for w, k in want.items()}
    assert sum(k != kind(w) for w, k in want.items()) > len(want) / 10
    found = b.score(docs, model, count_share=0.005).collect()
    more = {r.doc_id: r.score for r in b.score(docs, model).collect()}  # with all words in the broadcast table
    texts = [r.text for r in rows]
    assert all(math.isclose(r.score, more[r.doc_id], abs_tol=1e-6) for r in found)
    assert all(math.isclose(more[r.doc_id], brute_score(model, texts, r.text), abs_tol=1e-6) for r in rows[:10])
