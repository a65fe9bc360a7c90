from collections import defaultdict

import pytest
import xxhash

from kairograph.llm import queries, simhash

DOCS = "doc_id long, text string, fp string, node string"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) > 2 else [words] * bool(words)
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


def brute(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    group = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = defaultdict(list)
    for g, (i, _) in zip(group, fps):
        if i is not None:
            least[g].append(i)
    return sorted(((i, f"{f:016x}", min(least[g], default=None)) for g, (i, f) in zip(group, fps)), key=str)


def run(docs):
    out = simhash.near_duplicates(docs).withColumn("hex", simhash.hex_digits())
    return sorted(((r.id, r.hex, r.component) for r in out.collect()), key=str)


def test_edge_cases(spark):
    long = " ".join(f"w{k}" for k in range(5000))
    rows = [(1, "A b C"), (2, "a B c"), (3, None), (4, ""), (5, "  \n "), (6, "one"), (6, "one"), (None, "x y z w"), (7, long), (8, long + " end"), (None, None), (9, "é É é")]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], DOCS)
    assert run(docs) == brute(rows)


def test_empty(spark):
    assert run(spark.createDataFrame([], DOCS)) == []
    assert simhash.one_per_component(spark.createDataFrame([], DOCS)).collect() == []


def test_whole_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = queries.op9_simhash(spark, data)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("parts,radius,block", [(4, 2, 8192), (4, 2, 3), (1, 5, 7), (2, 4, 8192)])
def test_links_lose_nothing(spark, parts, radius, block):
    import random

    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for b in base for _ in range(6)})
    signed = [f - (1 << 64) * (f >> 63) for f in fps]
    frame = spark.createDataFrame([(s, s, 0) for s in signed], "node long, fp long, fp2 long")
    edges = simhash.similar_fingerprints(frame, radius, None, parts, block).collect()
    assert len(edges) < len(fps) * 100

    def groups(pairs):
        up = {f: f for f in fps}
        for a, b in pairs:
            x, y = up[a], up[b]
            up = {k: (x if v == y else v) for k, v in up.items()}
        out = defaultdict(set)
        for k, v in up.items():
            out[v].add(k)
        return sorted(map(sorted, out.values()))

    every = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= radius]
    assert groups((e.a % 2**64, e.b % 2**64) for e in edges) == groups(every)


def test_one_per_component(spark):
    text = " ".join(f"word{k}" for k in range(300))
    near = text.replace("word150", "other")
    rows = [(5, text, "x"), (3, near, "y"), (3, near, "y"), (9, text, "z"), (1, "quite another short text about nothing much", "w"), (None, text, "n"), (2, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]


def shingle_set(text):
    words = text.lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}


def test_near_copies_by_true_similarity(spark):
    """Pairs at a similarity of 0.80 to 0.85 lose a document, pairs at 0.70 to 0.80 keep both."""
    import random

    rng, rows, near, apart = random.Random(5), [], [], []
    for k in range(160):
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
        changed = list(words)
        for at in rng.sample(range(2, 298, 5), rng.randint(6, 10)):  # far enough apart to change five shingles each
            changed[at] = "changed" + str(at)
        a, b = " ".join(words), " ".join(changed)
        x, y = shingle_set(a), shingle_set(b)
        share = len(x & y) / len(x | y)
        if 0.8 <= share < 0.85:
            near.append(k)
        elif 0.7 <= share < 0.8:
            apart.append(k)
        else:
            continue
        rows += [(k, a), (1000 + k, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_per_component(docs).collect()}
    assert len(near) > 20 and len(apart) > 20
    assert {k for k, _ in rows if k < 1000} <= kept
    assert sum(1000 + k not in kept for k in near) >= 0.97 * len(near)
    assert all(1000 + k in kept for k in apart)


def test_failed_links_hide_no_confirmed_ones(spark):
    """In groups of candidates where the forest's links fail, all other candidates are tried: components are those of all pairs."""
    import random

    rng, rows = random.Random(9), []
    for g in range(6):
        base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
        for k in range(12):
            words = list(base)
            for at in rng.sample(range(2, 298, 5), rng.randint(0, 7)):
                words[at] = f"changed{k}x{at}"
            rows.append((100 * g + k, " ".join(words)))
    rng.shuffle(rows)
    sets = {k: shingle_set(t) for k, t in rows}
    group = {k: k for k, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    kept = {r.doc_id for r in simhash.one_per_component(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(group.values())
    assert 6 < len(kept) < len(rows)


def test_stage_keeps_what_true_similarity_keeps(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sets = {r.doc_id: set(simhash.shingles((r.text or "").encode(), 5).tolist()) for r in docs.collect()}
    group = {k: k for k in sets}
    for a in sets:
        for b in sets:
            every = len(sets[a] | sets[b])
            if a < b and (not every or len(sets[a] & sets[b]) / every >= 0.8) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    assert {r.doc_id for r in simhash.one_per_component(docs).collect()} == set(group.values())


@pytest.mark.parametrize("block", [8192, 5])
def test_size_ranges_skip_no_link(spark, block):
    """Tiles by ranges of population counts and sizes: links of all pairs at the radius with sizes of the ratio or more."""
    import random

    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(8))) for b in base for _ in range(8)})
    sizes = [rng.choice([1, 4, 5, 8, 10, 64, 80, 99, 100, 125, 10**6]) for _ in fps]
    signed = [f - (1 << 64) * (f >> 63) for f in fps]
    frame = spark.createDataFrame([(s, s, 0, n) for s, n in zip(signed, sizes)], "node long, fp long, fp2 long, size long")
    edges = simhash.similar_fingerprints(frame, 10, None, 1, block, similarity=0.8).collect()
    near = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 10 and 10 * min(sizes[a], sizes[b]) >= 8 * max(sizes[a], sizes[b])]

    def groups(pairs):
        up = {k: k for k in signed}
        for a, b in pairs:
            x, y = up[a], up[b]
            up = {k: (x if v == y else v) for k, v in up.items()}
        out = defaultdict(set)
        for k, v in up.items():
            out[v].add(k)
        return sorted(map(sorted, out.values()))

    assert near and groups((e.a, e.b) for e in edges) == groups((signed[a], signed[b]) for a, b in near)


def test_forest_of_many_links():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 500, 6000).astype(np.uint64), rng.integers(500, 1000, 6000).astype(np.uint64)
    whole, forest = simhash._Forest(), simhash._Forest()
    for x, y in zip(a.tolist(), b.tolist()):
        whole.link(x, y)
    forest.link_all(a, b)
    assert len(forest.edges) == len(whole.edges)
    assert {(x, y) for x, y in forest.edges} <= set(zip(a.tolist(), b.tolist()))


def test_shared_counts():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(20)]
    got = simhash.shared_counts(sets[:7], sets[7:], 16)
    assert got.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in sets[7:]] for x in sets[:7]]


def test_open_groups_are_confirmed_in_blocks(spark):
    """A dense group of candidates, many of which fail: a forest between labels with the components of all confirmed pairs."""
    import random

    import numpy as np

    rng = random.Random(13)
    base = list(range(100))
    sets = [np.array(sorted(set(rng.sample(base, 100 - rng.choice([3, 8, 13, 18])) + [1000 + 50 * k + x for x in range(rng.randrange(10))])), dtype=np.uint64) for k in range(120)]
    rows = [(k, 0, 0, len(v), k // 2 * 2, v.tobytes()) for k, v in enumerate(sets)]
    frame = spark.createDataFrame(rows, "node long, fp long, fp2 long, size long, label long, hashes binary")
    near = [(a, b) for a in range(120) for b in range(a) if 10 * len(np.intersect1d(sets[a], sets[b])) >= 8 * len(np.union1d(sets[a], sets[b]))]

    def groups(pairs):
        up = {k: k // 2 * 2 for k in range(120)}
        for a, b in pairs:
            x, y = up[a], up[b]
            up = {k: (x if v == y else v) for k, v in up.items()}
        return len(set(up.values())), sorted(sorted(k for k in up if up[k] == v) for v in set(up.values()))

    for block in (1024, 16):
        edges = [(e.a, e.b) for e in simhash.similar_fingerprints(frame, 18, 32, 1, block, similarity=0.8).collect()]
        assert set(edges) <= set(near) | {(b, a) for a, b in near}
        assert groups(edges) == groups(near)
        assert 1 < groups(near)[0] < 60
