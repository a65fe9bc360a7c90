"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Fingerprints are cut into equal parts; a tile is the set of fingerprints with the same population counts of these parts.
The summed differences of those counts never exceed the Hamming distance, so tile pairs further apart than the radius
are skipped without losing a link. Where links need a similarity of sets, tiles hold a range of population counts and one of
set sizes, and pairs of ranges too far apart in either are skipped. What is left is compared whole: exclusive-or and bit
counts in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import materialize, tasks_for, text_or_empty, utf8
from kairograph.llm.components import connected_components



def _majority(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def shingles(text: bytes, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Hashes of lower-cased (A-Z) word shingles, repeats included; fewer words are one shingle, no words give none."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = [words] if len(words) < shingle else zip(*(words[k:] for k in range(shingle)))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, seed) for x in map(b" ".join, parts)], dtype=np.uint64)


def fingerprints(text: bytes, shingle: int = 3, second: bool = False, seed: int = 42) -> tuple[int, int]:
    """SimHash of the shingles of a text; no words give zero.

    ``second`` adds an independent fingerprint (their hashes mixed anew), else it is zero. With it, both are those of
    the distinct shingles, whose expected distance follows from their Jaccard similarity.
    """
    hashes = shingles(text, shingle, seed)
    return _both(np.unique(hashes)) if second else (_majority(hashes) if len(hashes) else 0, 0)


def _both(hashes: np.ndarray) -> tuple[int, int]:
    if not len(hashes):
        return 0, 0
    mixed = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return _majority(hashes), _majority(mixed ^ (mixed >> np.uint64(31)))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, second: bool = False) -> DataFrame:
    """(id, fp, fp2): one row per row of ``docs``; fingerprints as signed longs. Null text counts as empty."""
    narrow = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("b"))
    id_type = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprints(x.as_buffer().to_pybytes(), shingle, second) for x in batch.column(1)]
            fps = np.array(fps, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps[:, 0]), pa.array(fps[:, 1])], ["id", "fp", "fp2"])

    return narrow.mapInArrow(run, f"id {id_type}, fp long, fp2 long")


def with_shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, node, fp, fp2, size): one row per row of ``docs``; node names the set of distinct shingles, size counts it."""
    narrow = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("b"))
    id_type = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for x in batch.column(1):
                own = np.unique(shingles(x.as_buffer().to_pybytes(), shingle))
                rows.append((xxhash.xxh64_intdigest(own.tobytes()), *_both(own), len(own)))
            rows = np.array(rows, dtype=np.uint64).reshape(-1, 4).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T.copy())], ["id", "node", "fp", "fp2", "size"])

    return narrow.mapInArrow(run, f"id {id_type}, node long, fp long, fp2 long, size long")


def _offsets(radius: int, parts: int) -> list[tuple[int, ...]]:
    """Steps to tiles that may hold a link, one of each opposite pair; the tile itself is not among them."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    return [d for d in steps if d > (0,) * parts]


class _Forest:
    """Union-find over the rows of one tile comparison: links leave as a spanning forest, never as all pairs."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def link(self, a: int, b: int, group_a: int | None = None, group_b: int | None = None) -> None:
        """A link between ``a`` and ``b``, which stand for groups if these are given."""
        x, y = self.find(a if group_a is None else group_a), self.find(b if group_b is None else group_b)
        if x != y:
            self.up[x] = y
            self.edges.append((a, b))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs aren't connected yet."""
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        roots = np.array([self.find(x) for x in nodes.tolist()], dtype=np.uint64)[at]
        return roots[: len(a)] != roots[len(a) :]

    def link_all(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links in turns of doubling length; before each turn those between rows that are connected by now go."""
        turn = 1024
        while len(a):
            for x, y in zip(a[:turn].tolist(), b[:turn].tolist()):
                self.link(x, y)
            a, b, turn = a[turn:], b[turn:], 2 * turn
            if len(a):
                apart = self.apart(a, b)
                a, b = a[apart], b[apart]


def _compare(home: np.ndarray, probe: np.ndarray, radius: int, confirm: int | None, similarity: float, forest: _Forest) -> None:
    """Rows of ``home`` and ``probe``: node, fp, fp2, and size where it is given."""
    for i, j, a, b in _near(home, probe, radius, confirm, similarity):
        forest.link_all(home[0, i + a], probe[0, j + b])


def _near(home: np.ndarray, probe: np.ndarray, radius: int, confirm: int | None, similarity: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pairs near enough, square by square: the square's corner, and rows from there."""
    for i in range(0, home.shape[1], 256):
        for j in range(0, probe.shape[1], 1024):
            far = np.bitwise_count(home[1, i : i + 256, None] ^ probe[1, None, j : j + 1024])
            a, b = np.nonzero(far <= radius)
            if confirm is not None and len(a):
                both = far[a, b].astype(int) + np.bitwise_count(home[2, i + a] ^ probe[2, j + b])
                a, b = a[both <= confirm], b[both <= confirm]
            if len(home) > 3 and len(a):  # sets whose sizes differ more can't be similar enough
                x, y = home[3, i + a], probe[3, j + b]
                close = np.minimum(x, y) / np.maximum(np.maximum(x, y), 1) >= similarity
                mix = np.random.default_rng(42).permutation(int(close.sum()))  # no row becomes the hub of its group
                a, b = a[close][mix], b[close][mix]
            if len(a):
                yield i, j, a, b


def shared_counts(x: list[np.ndarray], y: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many elements each set of ``x`` shares with each of ``y``: products of incidence matrices of ``width`` elements each."""
    every = np.concatenate([*x, *y])
    owner = np.repeat(np.arange(len(x) + len(y)), [len(v) for v in (*x, *y)])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    start = np.ones(len(every), bool)
    start[1:] = every[1:] != every[:-1]
    number = np.cumsum(start) - 1
    often = np.bincount(number)[number] > 1  # an element of one set only is shared with none
    owner, number = owner[often], number[often]
    if not len(number):
        return np.zeros((len(x), len(y)), np.int64)
    number = np.cumsum(np.r_[0, number[1:] != number[:-1]])
    out = np.zeros((len(x), len(y)), np.float64)
    for low in range(0, int(number[-1]) + 1, width):
        a, b = np.searchsorted(number, (low, low + width))
        held = np.zeros((len(x) + len(y), width), np.float32)
        held[owner[a:b], number[a:b] - low] = 1
        out += held[: len(x)] @ held[len(x) :].T  # sums of at most 4096 ones: exact
    return out.astype(np.int64)


def _confirm(home: np.ndarray, home_sets: list, probe: np.ndarray, probe_sets: list, radius: int, confirm: int | None, similarity: float, forest: _Forest) -> None:
    """Links of exact similarity between rows of different labels (row 4), as a forest of the labels."""

    def still(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = forest.apart(home[4, a], probe[4, b])
        return a[apart], b[apart]

    def link(a: np.ndarray, b: np.ndarray, shared) -> None:
        for x, y, n in zip(a.tolist(), b.tolist(), shared):
            if n >= similarity * max(len(home_sets[x]) + len(probe_sets[y]) - n, 1) - 1e-9:
                forest.link(int(home[0, x]), int(probe[0, y]), int(home[4, x]), int(probe[4, y]))

    def one_by_one(a: np.ndarray, b: np.ndarray) -> None:
        link(a, b, (len(np.intersect1d(home_sets[x], probe_sets[y], assume_unique=True)) for x, y in zip(a, b)))

    for i, j, a, b in _near(home, probe, radius, confirm, similarity):
        a, b = still(i + a, j + b)
        one_by_one(a[:256], b[:256])
        a, b = a[256:], b[256:]
        if len(a):
            a, b = still(a, b)
        if len(a) > 1000:
            link(a, b, shared_counts(home_sets[i : i + 256], probe_sets[j : j + 1024])[a - i, b - j].tolist())
        elif len(a):
            one_by_one(a, b)


def _groups(batches: Iterator[pa.RecordBatch], numbers: int) -> Iterator[tuple[tuple[int, int, int], np.ndarray, list]]:
    """Runs of equal (tile, block, probe) of a sorted partition, cut where a batch ends: ``numbers`` columns and, after them, sets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
        fps = np.stack([batch.column(k).to_numpy() for k in range(3, 3 + numbers)]).view(np.uint64)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(3 + numbers)] if batch.num_columns > 3 + numbers else []
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield tuple(keys[:, a].tolist()), fps[:, a:b], sets[a:b]


def similar_fingerprints(fps: DataFrame, radius: int = 2, confirm: int | None = None, parts: int = 4, block: int = 8192, similarity: float = 0.0) -> DataFrame:
    """Edges (a, b) between nodes of ``fps`` (node, fp, fp2: long) at ``radius`` or fewer differing bits of fp.

    With ``confirm``, a link must also hold at that many bits of fp and fp2 together. Tiles are the fingerprints of
    the same population counts of ``parts`` equal parts (4 parts suit a small radius, 1 a large one). Per tile and
    block the links are returned as a spanning forest: components are those of all links, rows never exceed the
    compared fingerprints. A tile of more than ``block`` fingerprints is dealt in blocks by hash, and the
    fingerprints that look into it are sent to each block: no task holds more than one block at a time.

    With a column size, a link also needs sizes of at least the ratio ``similarity``; tiles then are ranges of radius + 1
    population counts and of sizes within that ratio, so links lie between tiles next to each other. With the
    columns label and hashes (binary, a sorted set of size longs) besides, a link also needs that exact Jaccard similarity and
    different labels, and a forest of the labels is returned.
    """
    spark, width = fps.sparkSession, 64 // parts
    held = ["node", "fp", "fp2", *(c for c in ("size", "label", "hashes") if c in fps.columns)]
    numbers = len(held) - ("hashes" in held)
    if "size" in held and 0 < similarity < 1:
        ratio = -log(similarity) * (1 + 1e-6)  # a little more than the ratio: rounding loses no neighbour
        own = [F.floor(F.bit_count("fp") / (radius + 1)), F.floor(F.log(F.greatest("size", F.lit(1))) / ratio)]
        side = max(66, int(63 * log(2) / ratio) + 2)  # above any range's number: 197 for 0.8
        steps = [d for d in product((-1, 0, 1), repeat=2) if d > (0, 0)]
    else:
        mask = F.lit(-1 if width == 64 else (1 << width) - 1).cast("long")
        own = [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(mask)) for k in range(parts)]
        side, steps = width + 1, _offsets(radius, parts)
    own_parts = [F.col(f"p{k}") for k in range(len(own))]
    number = lambda cols: sum((c * (side**k) for k, c in enumerate(cols)), F.lit(0)).cast("int")
    at = fps.select(*held, *(c.cast("int").alias(f"p{k}") for k, c in enumerate(own))).withColumn("tile", number(own_parts))
    # at most (width + 1) ** parts tiles (83,521): small enough to broadcast whatever the number of fingerprints
    sizes = at.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    step = F.explode(F.array(*[F.array(*map(F.lit, d)) for d in steps]))
    out = at.select(*held, *own_parts, step.alias("d"))
    moved = [c + F.col("d")[k] for k, c in enumerate(own_parts)]
    inside = F.lit(True)
    for c in moved:
        inside = inside & (c >= 0) & (c < side)
    out = out.filter(inside).select(*held, number(moved).alias("tile"), F.lit(1).alias("probe"))
    homes = at.select(*held, "tile", F.lit(0).alias("probe"))
    every = homes.union(out).join(F.broadcast(sizes), "tile")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # a home row sits in its own block and also visits the later blocks of its tile; a probe visits all
    visits = F.when(F.col("probe") == 0, F.sequence(own, F.col("blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    every = every.select("tile", F.explode(visits).alias("block"), "probe", *held, own.alias("own"))
    visiting = F.when(F.col("block") == F.col("own"), F.col("probe")).otherwise(1).alias("probe")
    dealt = every.select("tile", "block", visiting, *held)
    dealt = dealt.repartition(tasks_for(spark), "tile", "block").sortWithinPartitions("tile", "block", "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, home_sets, forest = None, np.empty((numbers, 0), np.uint64), [], _Forest()

        def out() -> pa.RecordBatch:
            pairs = np.array(forest.edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        def compare(home: np.ndarray, home_sets: list) -> None:
            if numbers < len(held):
                _confirm(home, home_sets, rows, sets, radius, confirm, similarity, forest)
            else:
                _compare(home, rows, radius, confirm, similarity, forest)

        for (tile, blk, probe), rows, sets in _groups(batches, numbers):
            if (tile, blk) != key:
                if forest.edges:
                    yield out()
                key, home, home_sets, forest = (tile, blk), np.empty((numbers, 0), np.uint64), [], _Forest()
            if home.shape[1]:
                compare(home, home_sets)
            if not probe:
                compare(rows, sets)
                home, home_sets = np.concatenate([home, rows], axis=1), home_sets + sets
        if forest.edges:
            yield out()

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, confirm: int | None = None, parts: int = 4
) -> DataFrame:
    """(id, fp, component): one row per row of ``docs``; component is the smallest id reachable over links.

    Fingerprints link at ``radius`` or fewer differing bits (and, with ``confirm``, at that many bits of two
    independent fingerprints together). Texts without words have fingerprint zero and link like any other; null texts
    count as empty; equal texts always share a component; a null id is no candidate for the smallest (a component of
    null ids only has component null); repeated rows give repeated rows. An empty table gives no rows.
    """
    found = with_fingerprints(docs, id_col, text_col, shingle, confirm is not None)
    found = found.withColumn("node", F.col("fp") if confirm is None else F.xxhash64("fp", "fp2"))
    found = materialize(found, "fingerprints")
    distinct = found.groupBy("node").agg(F.min("fp").alias("fp"), F.min("fp2").alias("fp2"), F.min("id").alias("least"))
    distinct = materialize(distinct, "distinct")
    roots = connected_components(similar_fingerprints(distinct.select("node", "fp", "fp2"), radius, confirm, parts))
    roots = roots.select(F.col("node").alias("linked"), "root")
    named = distinct.join(roots, distinct.node == roots.linked, "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "roots")
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    by_node = named.join(smallest, "root").select("node", "component")
    return found.join(by_node, "node").select("id", "fp", "component")


def hex_digits(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _similar(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similar): ``edges`` with the verdict of the exact Jaccard similarity of their ends' sets (node, hashes)."""
    ends = [sets.select(F.col("node").alias(k), F.col("hashes").alias(f"set_{k}")) for k in "ab"]
    both = edges.join(ends[0], "a").join(ends[1], "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            says = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                says.append(shared / max(len(x) + len(y) - shared, 1) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(says, pa.bool_())], ["a", "b", "similar"])

    return both.mapInArrow(run, "a long, b long, similar boolean")


def similar_texts(
    docs: DataFrame, key: str, id_col: str, text_col: str = "text", shingle: int = 5, radius: int = 18, confirm: int = 32, parts: int = 1, similarity: float = 0.8, open_block: int = 1024
) -> DataFrame:
    """(id, component): one row per row of ``docs``, component is the smallest id reachable over links.

    Texts of equal shingle sets are linked; others are where the fingerprints are near enough and the exact Jaccard
    similarity of the sets is ``similarity`` or more. The candidates are first taken as spanning forests, whose
    links are each confirmed. A group of candidates without a failed link is connected by confirmed ones, whatever else
    its pairs are; of the other groups all candidates between parts that aren't connected yet are tried where they are
    compared, in blocks of ``open_block`` sets, which hand on a forest of the confirmed ones. The components are thus those of
    all confirmed candidates, without a row for each pair of a large group. ``key`` (long, a field of the ids as well)
    names id and text.
    """
    found = materialize(with_shingle_sets(docs, id_col, text_col, shingle), "fingerprints")
    distinct = found.groupBy("node").agg(*(F.min(c).alias(c) for c in ("fp", "fp2", "size")), F.min("id").alias("least"))
    distinct = materialize(distinct, "distinct")
    held = ("node", "fp", "fp2", "size")
    tried = materialize(similar_fingerprints(distinct.select(*held), radius, confirm, parts, similarity=similarity), "candidates")
    ends = tried.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = distinct.join(ends, "node").select("node", F.col(f"least.{key}").alias("key"))
    texts = docs.select(F.col(f"{id_col}.{key}").alias("key"), utf8(text_col).alias("b")).join(wanted, "key").select("node", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(x.as_buffer().to_pybytes(), shingle)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    sets = materialize(texts.mapInArrow(run, "node long, hashes binary").dropDuplicates(["node"]), "shingle-sets")
    tried = materialize(_similar(tried, sets, similarity), "tried")
    links, failed = tried.filter("similar").select("a", "b"), tried.filter("not similar")
    if not failed.isEmpty():
        groups = connected_components(tried)
        again = groups.join(failed.select(F.col("a").alias("node")).distinct(), "node").select("root").distinct()
        open_nodes = groups.join(again, "root", "left_semi").select("node")
        labels = connected_components(links).select("node", F.col("root").alias("label"))
        rest = distinct.select(*held).join(open_nodes, "node", "left_semi").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        rest = materialize(rest.join(sets, "node"), "open")
        links = links.union(similar_fingerprints(rest, radius, confirm, parts, open_block, similarity))
    roots = connected_components(links).select(F.col("node").alias("linked"), "root")
    named = distinct.join(roots, distinct.node == roots.linked, "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "roots")
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    by_node = named.join(smallest, "root").select("node", "component")
    return found.join(by_node, "node").select("id", "component")


def one_per_component(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 18, confirm: int = 32, parts: int = 1, similarity: float = 0.8
) -> DataFrame:
    """``docs`` without near-duplicates: the row with the smallest id of each component stays, columns unchanged.

    Defaults: shingles of five words and a similarity of 0.8. Shingle sets of Jaccard similarity 0.8 have cosine
    2 * 0.8 / 1.8 = 0.89, an angle of 0.15 half-turns, so 9.7 of 64 and 19.4 of 128 bits are expected to differ, with
    deviations of 2.9 and 4.1. Candidates are pairs at 18 bits of the first fingerprint and 32 of both, three deviations
    more; a link also needs the exact similarity. Rows of equal smallest id are told apart by a hash of id and text, and by
    one of their other columns where these are equal too; of fully repeated rows one stays. Rows of null id lose to any other
    and are told apart alike.
    """
    key = F.xxhash64(F.col(id_col), text_or_empty(text_col))
    who = F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("i"), key.alias("k"))
    found = similar_texts(docs.select(who.alias("doc"), F.col(text_col).alias("text")), "k", "doc", "text", shingle, radius, confirm, parts, similarity)
    winners = found.select(F.col("component.k").alias("k")).distinct()
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    rest = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")
    keyed = docs.select(F.struct("*").alias("own"), key.alias("k"), rest.alias("rest"))  # the documents' columns travel as one, so their names can't clash
    return keyed.join(winners, "k", "left_semi").groupBy("k").agg(F.min_by("own", "rest").alias("own")).select("own.*")
