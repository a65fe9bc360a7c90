"""Brown class-based n-grams: exchange clustering of words, class transitions and word emissions.

Every word of FLOOR or more training occurrences gets its class by exchange, however many there are. The head (words of SHARE
or more of the tokens, at most 1 / SHARE) is exchanged in rounds that never lower the likelihood, until they add little; its map is broadcast. The tail, which
grows with the corpus, meanwhile stands in BUCKETS by the words' endings; then each tail word is exchanged on its own from
its contexts, and its class is a row of a table that texts meet in a join. Rarer words keep the class of their bucket.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm.common import materialize, utf8, with_fields

CLASSES, BUCKETS = 64, 4096
#: The head's rounds end when two of them, which try each half of the items, add less than GAIN of the log likelihood, and at
#: ROUNDS at the latest. Of the moves of a round, in the order of their gains, these shares are weighed against each other.
ROUNDS, GAIN, TRIED = 4, 0.002, (1.0, 0.3, 0.1, 0.02)
#: The most frequent items, which are moved one after the other: their moves would undo each other otherwise.
LEADERS, SWEEPS = 512, 5
#: Of the training tokens: words of the head, and words whose counts and classes are broadcast for scoring.
SHARE, COUNT_SHARE = 2.0**-16, 2.0**-19
#: Occurrences from which a word of the tail is exchanged on its own.
FLOOR = 3
#: Occurrences of the tail that a task brings into order at a time.
SLOT = 2**19
#: Items, or bytes of text, that a task works on at a time: a batch of long texts takes many times its own size otherwise.
PART = 2**18
END = b""  # no word is empty: stands for the end of a text


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


@dataclass
class _Items:
    """Ids of items: 0 the end, then frequent words, then buckets."""

    words: dict[bytes, int]

    @property
    def first_bucket(self) -> int:
        return 1 + len(self.words)

    @property
    def number(self) -> int:
        return self.first_bucket + BUCKETS

    def item(self, word: bytes) -> int:
        return self.words[word] if word in self.words else self.first_bucket + bucket(word)

    def of(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        rare = np.flatnonzero(out < 0)
        out[rare] = self.first_bucket + np.fromiter((zlib.crc32(words[k][-3:]) for k in rare.tolist()), np.int64, len(rare)) % BUCKETS
        return out


def _parts(batches: Iterator[pa.RecordBatch], column: int, most: int = PART) -> Iterator[pa.RecordBatch]:
    """Slices of batches that hold ``most`` items (of a column of lists) or bytes (of texts) at most, beyond one text."""
    for batch in batches:
        x = batch.column(column)
        sizes = x.value_lengths() if pa.types.is_list(x.type) else pc.binary_length(x)
        ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _hash(word: bytes) -> int:
    """As Spark's xxhash64 of a binary column, unsigned."""
    return xxhash.xxh64_intdigest(word, 42)


def _numbered(batch: pa.RecordBatch, column: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, the number of each occurrence's word, words of each text): what is worked out for a word is so once a batch."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(batch.column(column).view(pa.string())))
    flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
    there = pc.greater(pc.binary_length(flat), 0)  # white space at the ends of a text leaves empty words
    before = np.r_[0, np.cumsum(there.to_numpy(zero_copy_only=False))][np.r_[0, ends]]
    coded = flat.filter(there).dictionary_encode()
    return coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.diff(before)


def word_counts(training: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, n) of all training texts, the end of each text included (empty word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in _parts(batches, 0):
            words, number, sizes = _numbered(batch, 0)
            for word, n in zip(words, np.bincount(number, minlength=len(words)).tolist()):
                counts[word] = counts.get(word, 0) + n
            counts[END] = counts.get(END, 0) + len(sizes)
            if len(counts) > 500_000:  # partial counts: the memory of a task stays bounded
                yield out()
                counts.clear()
        yield out()

    return training.select(utf8(text_col)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _start_classes(items: _Items) -> np.ndarray:
    """Class 0 is the end's own; the others begin with the classes of their words' endings."""
    classes = np.zeros(items.number, dtype=np.int64)
    for w, k in items.words.items():
        classes[k] = 1 + zlib.crc32(w[-2:]) % (CLASSES - 1)
    classes[items.first_bucket :] = 1 + np.arange(BUCKETS) % (CLASSES - 1)
    return classes


def _encoded(training: DataFrame, text_col: str, items) -> DataFrame:
    """(items array<int>, tail array<long>): the training texts, written once, read by every round.

    Items have an end on both sides; tail has the words that stand in buckets, in order, as 64-bit hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = items.value.first_bucket
        for batch in _parts(batches, 0):
            words, number, sizes = _numbered(batch, 0)
            found, hashes = items.value.of(words), np.zeros(len(words), np.uint64)
            rare = np.flatnonzero(found >= first)
            hashes[rare] = np.fromiter((_hash(words[k]) for k in rare.tolist()), np.uint64, len(rare))
            ends = np.r_[0, np.cumsum(sizes + 2)]
            flat, inside = np.zeros(ends[-1], np.int32), np.ones(ends[-1], bool)
            inside[ends[:-1]] = inside[ends[1:] - 1] = False
            flat[inside] = found[number]
            in_tail = flat >= first
            cuts = np.r_[0, np.cumsum(in_tail)][ends]
            tail = hashes[number[in_tail[inside]]].view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for at, x in ((ends, flat), (cuts, tail))]
            yield pa.RecordBatch.from_arrays(lists, ["items", "tail"])

    return materialize(training.select(utf8(text_col)).mapInArrow(run, "items array<int>, tail array<long>"), "encoded")


def _contexts(encoded: DataFrame, number: int, classes: np.ndarray) -> DataFrame:
    """(item, left, right): how often each class stands before and after the item, over all training texts.

    A task adds up its rows in two arrays of items by classes (bounded) and hands on the items it has seen.
    """
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, size = shared.value, number * CLASSES
        left, right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in _parts(batches, 0):
            lists = batch.column(0)
            flat = lists.flatten().to_numpy().astype(np.int64)
            inside = np.ones(max(0, len(flat) - 1), bool)
            joints = np.cumsum(lists.value_lengths().to_numpy())[:-1] - 1  # one text's last end and the next one's first
            inside[joints] = False
            a, b = flat[:-1][inside], flat[1:][inside]
            left += np.bincount(b * CLASSES + classes[a], minlength=size)
            right += np.bincount(a * CLASSES + classes[b], minlength=size)
        left, right = left.reshape(-1, CLASSES), right.reshape(-1, CLASSES)
        seen = np.flatnonzero(left.any(axis=1) | right.any(axis=1))
        for at in range(0, len(seen), 4096):
            part = seen[at : at + 4096]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[part].ravel().astype(np.int32)), CLASSES).cast(pa.list_(pa.int32())) for x in (left, right)]
            yield pa.RecordBatch.from_arrays([pa.array(part), *lists], ["item", "left", "right"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, sums = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"item": [item], "left": [sums[0]], "right": [sums[1]]}, schema=kind)

        kind = pa.schema([("item", pa.int64()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))])
        for batch in batches:
            rows = np.stack([batch.column(c).flatten().to_numpy().reshape(-1, CLASSES) for c in (1, 2)], axis=1).astype(np.int64)
            for now, pair in zip(batch.column(0).to_pylist(), rows):
                if now != item:
                    if item is not None:
                        yield out()
                    item, sums = now, pair.copy()
                else:
                    sums += pair
        if item is not None:
            yield out()

    parts = encoded.select("items").mapInArrow(run, "item long, left array<int>, right array<int>")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(partitions, "item").sortWithinPartitions("item").mapInArrow(total, "item long, left array<long>, right array<long>")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def _pairs_of(encoded: DataFrame, choices: list[np.ndarray]) -> np.ndarray:
    """Counts of class pairs under each of a few class maps, in one pass: matrices of fixed size from each task, added up by rows."""
    shared = encoded.sparkSession.sparkContext.broadcast(np.stack(choices))
    size = CLASSES * CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = shared.value
        pairs = np.zeros((len(maps), size), np.int64)
        for batch in _parts(batches, 0):
            lists = batch.column(0)
            flat = lists.flatten().to_numpy()
            inside = np.ones(max(0, len(flat) - 1), bool)
            inside[np.cumsum(lists.value_lengths().to_numpy())[:-1] - 1] = False  # one text's last end and the next one's first
            for k, classes in enumerate(maps):
                kinds = classes[flat]
                pairs[k] += np.bincount((kinds[:-1] * CLASSES + kinds[1:])[inside], minlength=size)
        rows = list(pairs.reshape(-1, CLASSES))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(rows, pa.list_(pa.int64()))], ["row", "n"])

    rows = encoded.select("items").mapInArrow(run, "row long, n array<long>").selectExpr("row", "posexplode(n) as (after, n)")
    out = np.zeros((len(choices) * CLASSES, CLASSES))
    for r in rows.groupBy("row", "after").agg(F.sum("n").alias("n")).collect():
        out[r.row, r.after] = r.n
    return out.reshape(len(choices), CLASSES, CLASSES)


def log_likelihood(pairs: np.ndarray) -> float:
    """Of the class bigrams, without the words' own constant term."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(axis=0)).sum() - _xlogx(pairs.sum(axis=1)).sum())


def gain_tables(pairs: np.ndarray) -> list[tuple]:
    """For the classes after and before an item: pair counts by (other class, own class), their x log x, sums, and steps of up to 16."""
    out = []
    for table in (pairs.T, pairs):
        logs = _xlogx(table)
        out.append((table, logs, table.sum(axis=0), np.stack([_xlogx(table + c) - logs for c in range(1, 17)])))
    return out


def best_classes(own: np.ndarray, left: np.ndarray, right: np.ndarray, tables: list[tuple]) -> np.ndarray:
    return best_moves(own, left, right, tables)[0]


def best_moves(own: np.ndarray, left: np.ndarray, right: np.ndarray, tables: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Per item, the class where its contexts add most to the likelihood of the class bigrams, its own unless one is better, and how much.

    Contexts are rows of counts by class. The rest of an item's own place is as it was. Class 0 is the end's alone.
    """
    every, most = [], []
    for a in range(0, len(own), 256):
        kind, sides = own[a : a + 256], (right[a : a + 256], left[a : a + 256])
        gains, leaving = np.zeros((len(kind), CLASSES)), np.zeros(len(kind))
        for counts, (table, logs, sums, steps) in zip(sides, tables):
            w, x = np.nonzero(counts)
            c = counts[w, x].astype(np.int64)
            change = steps[np.minimum(c, len(steps)) - 1, x]
            large = np.flatnonzero(c > len(steps))
            change[large] = _xlogx(table[x[large]] + c[large, None]) - logs[x[large]]
            less = _xlogx(np.maximum(table[x, kind[w]] - c, 0)) - logs[x, kind[w]]
            if len(w):
                starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                gains[w[starts]] += np.add.reduceat(change, starts, axis=0)
                leaving[w[starts]] += np.add.reduceat(less, starts)
            n = counts.sum(axis=1)
            gains -= _xlogx(sums + n[:, None]) - _xlogx(sums)
            leaving -= _xlogx(np.maximum(sums[kind] - n, 0)) - _xlogx(sums[kind])
        gains += leaving[:, None]
        gains[:, 0] = -np.inf
        gains[np.arange(len(kind)), kind] = 0.0
        every.append(gains.argmax(axis=1))
        most.append(gains.max(axis=1))
    return np.concatenate([np.empty(0, np.int64), *every]), np.concatenate([np.empty(0), *most])


def _turn(item: int, turn: int) -> bool:
    """Whether the item is tried in this round: half of them are, else words would swap in step."""
    return item != 0 and (zlib.crc32(str(item).encode()) + turn) % 2 == 0


def proposed_moves(contexts: DataFrame, classes: np.ndarray, pairs: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items, classes, gains) of the items whose turn it is that would move, each against the counts of the round's beginning;
    the greatest gains first."""
    shared = contexts.sparkSession.sparkContext.broadcast((classes, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, pairs = shared.value
        tables = gain_tables(pairs)
        for batch in batches:
            tried = np.array([_turn(item, turn) for item in batch.column(0).to_pylist()], bool)
            items = batch.column(0).to_numpy()[tried]
            lefts, rights = (batch.column(c).flatten().to_numpy().reshape(-1, CLASSES)[tried] for c in (1, 2))
            new, gains = best_moves(classes[items], lefts, rights, tables)
            moved = new != classes[items]
            yield pa.RecordBatch.from_arrays([pa.array(items[moved]), pa.array(new[moved]), pa.array(gains[moved])], ["item", "class", "gain"])

    rows = contexts.select("item", "left", "right").mapInArrow(run, "item long, class long, gain double").collect()  # bounded by the items
    rows.sort(key=lambda r: (-r.gain, r.item))
    return tuple(np.array([r[c] for r in rows], kind) for c, kind in (("item", np.int64), ("class", np.int64), ("gain", float)))


def leader_pairs(encoded: DataFrame, leaders: int = LEADERS) -> np.ndarray:
    """How often each of the items 1 to ``leaders`` (the most frequent words) stands before each: a matrix of fixed size."""
    size = leaders + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(size * size, np.int64)
        for batch in _parts(batches, 0):
            flat = batch.column(0).flatten().to_numpy().astype(np.int64)  # ends are items of their own, so no pair crosses texts
            both = (flat[:-1] > 0) & (flat[:-1] < size) & (flat[1:] > 0) & (flat[1:] < size)
            pairs += np.bincount(flat[:-1][both] * size + flat[1:][both], minlength=size * size)
        seen = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(pairs[seen])], ["pair", "n"])

    found = encoded.select("items").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


def sweep(classes: np.ndarray, pairs: np.ndarray, left: np.ndarray, right: np.ndarray, among: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Classes and pair counts after the leaders have moved one by one, each against the counts as they then are.

    ``left`` and ``right`` are the leaders' contexts by class, ``among`` their own pairs. A move is made if the likelihood rises by it.
    """
    classes, pairs, left, right = classes.copy(), pairs.copy(), left.astype(float), right.astype(float)
    fit, n = log_likelihood(pairs), len(among)
    for _ in range(sweeps):
        moved = False
        for item in range(1, n):
            old = classes[item]
            new = int(best_classes(np.array([old]), left[item][None], right[item][None], gain_tables(pairs))[0])
            if new == old:
                continue
            own, after = among[item, item], pairs.copy()
            before, behind = left[item].copy(), right[item].copy()
            after[:, old] -= before
            after[old] -= behind
            after[old, old] += own
            for side in (before, behind):
                side[old] -= own
                side[new] += own
            after[:, new] += before
            after[new] += behind
            after[new, new] -= own
            raised = log_likelihood(after)
            if raised > fit:
                classes[item], pairs, fit, moved = new, after, raised, True
                right[:n, old] -= among[:, item]  # what stands before the item has it behind
                right[:n, new] += among[:, item]
                left[:n, old] -= among[item]
                left[:n, new] += among[item]
        if not moved:
            break
    return classes, pairs


def exchange(encoded: DataFrame, contexts: DataFrame, classes: np.ndarray, pairs: np.ndarray, turn: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes and their pair counts after one round: the leaders one by one, and of the others half at once.

    Moves of many items that raise the likelihood one by one may lower it together. So the first TRIED shares of them, in the
    order of their gains, are counted, and what is best is taken: the leaders' moves alone, if all are worse.
    """
    items, new, _ = proposed_moves(contexts, classes, pairs, turn)
    left, right = np.zeros((2, len(among), CLASSES))
    for r in contexts.filter(F.col("item") < len(among)).select("item", "left", "right").collect():  # as many as there are leaders
        left[r["item"]], right[r["item"]] = r["left"], r["right"]
    led, led_pairs = sweep(classes, pairs, left, right, among)
    items, new = items[items >= len(among)], new[items >= len(among)]
    choices = []
    for share in TRIED if len(items) else ():
        choice, n = led.copy(), math.ceil(share * len(items))
        choice[items[:n]] = new[:n]
        choices.append(choice)
    if not choices:
        return led, led_pairs
    counted = _pairs_of(encoded, choices)
    fits = [log_likelihood(p) for p in counted]
    best = int(np.argmax(fits))
    return (choices[best], counted[best]) if fits[best] > log_likelihood(led_pairs) else (led, led_pairs)


def exchange_tail(encoded: DataFrame, items, classes: np.ndarray, pairs: np.ndarray, tokens: int, floor: int = FLOOR) -> DataFrame:
    """(h long, class int): each word of the tail with ``floor`` or more occurrences goes to its best class.

    A task brings SLOT occurrences at a time into the order of their hashes and hands on, for each range of hashes, the words
    with the classes around them. There are as many ranges as the corpus has SLOT tokens, and no word of the tail has SHARE of
    the tokens, so no range is large. Neighbours that are in the tail too count under the class of their bucket.
    """
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast((classes, pairs))
    slots = 1 + tokens // SLOT
    kinds_ = (np.uint64, np.int32, np.uint8, np.uint16)  # of a range: words, occurrences of each, own class of each; class pair of each occurrence
    names = ["slot", "h", "times", "own", "near"]

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, first = shared.value[0], items.value.first_bucket
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            h, near, own = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(h)
            h, near, own = h[order], near[order], own[order]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            ends, words = np.r_[starts[1:], len(h)], h[starts]
            slot = (words >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)  # rises with the hash
            cuts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            columns = [[], [], [], []]
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(words)]):
                for column, x, kind in zip(columns, (words[a:b], ends[a:b] - starts[a:b], own[starts[a:b]], near[starts[a] : ends[b - 1]]), kinds_):
                    column.append(x.astype(kind).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(slot[cuts].astype(np.int64)), *(pa.array(x, pa.binary()) for x in columns)], names)

        waiting = 0
        for batch in _parts(batches, 0):
            flat = batch.column(0).flatten().to_numpy()
            at, kinds = np.flatnonzero(flat >= first), classes[flat]  # never first or last: the ends are no words
            if len(at):
                near = (kinds[at - 1] * CLASSES + kinds[at + 1]).astype(np.uint16)
                held.append((batch.column(1).flatten().to_numpy().view(np.uint64), near, kinds[at].astype(np.uint8)))
                waiting += len(at)
            if waiting >= SLOT:
                yield out()
                waiting = 0
        if waiting:
            yield out()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = gain_tables(shared.value[1])

        def out(packs: list[tuple]) -> pa.RecordBatch:
            words, times, own, near = (np.concatenate([np.frombuffer(p[c], kind) for p in packs]) for c, kind in enumerate(kinds_))
            unique, first, number = np.unique(words, return_index=True, return_inverse=True)
            enough = np.flatnonzero(np.bincount(number, times) >= floor)
            number = np.repeat(number, times)
            order = np.argsort(number, kind="stable")
            number, near, found = number[order], near[order].astype(np.int64), []
            for a in range(0, len(enough), 4096):
                part = enough[a : a + 4096]
                low, high = np.searchsorted(number, (part[0], part[-1] + 1))
                place = (number[low:high] - part[0]) * CLASSES
                size = (part[-1] - part[0] + 1) * CLASSES
                left, right = (np.bincount(place + x, minlength=size).reshape(-1, CLASSES)[part - part[0]] for x in np.divmod(near[low:high], CLASSES))
                found.append(best_classes(own[first[part]].astype(np.int64), left, right, tables))
            found = np.concatenate([np.empty(0, np.int64), *found]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(unique[enough].view(np.int64)), pa.array(found)], ["h", "class"])

        slot, packs = None, []
        for batch in batches:
            for now, *pack in zip(batch.column(0).to_pylist(), *(batch.column(c).to_pylist() for c in range(1, 5))):
                if now != slot and packs:
                    yield out(packs)
                    packs = []
                slot = now
                packs.append(pack)
        if packs:
            yield out(packs)

    rows = encoded.mapInArrow(around, "slot long, h binary, times binary, own binary, near binary")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "slot").sortWithinPartitions("slot").mapInArrow(best, "h long, class int")


@dataclass
class BrownModel:
    """Counts and classes. log10 P(text) sums, over tokens, the class's transition and the word's emission.

    Transition: (pairs + 0.5) / (row + 0.5 * classes). Emission: (count + 1) / (class tokens + class words + 1): each class
    keeps one share for the words it has not seen, which have the class of their bucket.
    """

    items: object  # broadcast _Items
    classes: np.ndarray  # of items
    words: DataFrame  # word, n, class: all of them, written to the shared folder
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    pairs: np.ndarray | None = None
    likelihoods: list[float] | None = None  # of the head's class bigrams, before the first round and after each

    def step_log10(self) -> np.ndarray:
        """What each pair of classes adds to a text's log10 probability, beside log10(count + 1)."""
        transition = (self.pairs + 0.5) / (self.pairs.sum(axis=1, keepdims=True) + 0.5 * CLASSES)
        return np.log10(transition) - np.log10(self.class_tokens + self.class_words + 1.0)[None, :]


def learn_classes(training: DataFrame, text_col: str = "text", rounds: int = ROUNDS, share: float = SHARE, floor: int = FLOOR) -> BrownModel:
    """Counts and classes of every row of ``training``, without class pairs; null texts count as empty, without rows all is zero."""
    spark = training.sparkSession
    counts = materialize(word_counts(training, text_col), "counts")
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, distinct = totals.n or 0, totals.v
    frequent = counts.filter((F.col("n") >= max(1.0, tokens * share)) & (F.length("word") > 0)).collect()  # 1 / share rows at most
    frequent.sort(key=lambda r: (-r.n, bytes(r.word)))
    items = _Items({bytes(r.word): 1 + k for k, r in enumerate(frequent)})
    held = spark.sparkContext.broadcast(items)
    classes = _start_classes(items)
    encoded = _encoded(training, text_col, held)
    pairs = _pairs_of(encoded, [classes])[0]
    fits, before = [log_likelihood(pairs)], None
    among = leader_pairs(encoded, min(LEADERS, len(items.words)))
    for turn in range(rounds):
        if before is None or (before != classes).any():
            before, contexts = classes, materialize(_contexts(encoded, items.number, classes), "contexts")
        classes, pairs = exchange(encoded, contexts, classes, pairs, turn, among)
        fits.append(log_likelihood(pairs))
        if turn and fits[-1] - fits[-3] < GAIN * abs(fits[-1]):
            break
    tail = exchange_tail(encoded, held, classes, pairs, tokens, floor)
    shared = spark.sparkContext.broadcast(classes)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, classes = held.value, shared.value
        for batch in batches:
            kinds = [
                k if k is not None else int(classes[items.item(w) if w != END else 0])
                for w, k in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.int32())], ["word", "n", "class"])

    often = counts.filter(F.col("n") >= floor).withColumn("h", F.xxhash64("word")).join(tail, "h", "left").select("word", "n", "class")
    rare = counts.filter(F.col("n") < floor).withColumn("class", F.lit(None).cast("int"))
    words = materialize(often.union(rare).mapInArrow(placed, "word binary, n long, class int"), "words")
    sizes = np.zeros((CLASSES, 2))
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        sizes[r["class"]] = r.n, r.v
    return BrownModel(held, classes, words, tokens, distinct, sizes[:, 0], sizes[:, 1], likelihoods=fits)


def classified(docs: DataFrame, model: BrownModel, text_col: str = "text", count_share: float = COUNT_SHARE) -> DataFrame:
    """``docs`` without ``text_col``, in a struct ``own``, with what scores need: n_tokens, known, counts (sum of log10(count + 1)), and
    the classes of its tokens, a byte each, an end on both sides. Written to the shared folder.

    Frequent words are looked up in a broadcast table; the others meet the words' table in a join, a row per text and word.
    """
    spark = docs.sparkSession
    common = model.words.filter(F.col("n") >= max(1.0, model.tokens * count_share)).collect()  # 1 / count_share rows at most
    numbers = {bytes(r.word): k for k, r in enumerate(common)}
    table = spark.sparkContext.broadcast((numbers, np.array([r["class"] for r in common] + [0], np.uint8), np.array([math.log10(r.n + 1) for r in common] + [0.0])))
    held, shared = model.items, spark.sparkContext.broadcast(model.classes)
    own = [F.col(c) for c in docs.columns if c != text_col] or [F.lit(0).alias("n_tokens")]  # a struct has a field: one that results replace
    given = docs.select(F.struct(*own).alias("own"), utf8(text_col).alias("bytes"), F.monotonically_increasing_id().alias("key"))
    schema = with_fields(given.select("own").schema, "key long, n_tokens long, known long, counts double, kinds binary, rare array<struct<word: binary, at: array<int>>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, kinds, logs = table.value
        items, classes = held.value, shared.value
        last = len(logs) - 1
        for batch in _parts(batches, 1):
            words, number, sizes = _numbered(batch, 1)
            words.append(END)
            place = np.fromiter(map(numbers.get, words, repeat(last)), np.int64, len(words))
            kind = kinds[place]
            rare = np.flatnonzero(place[:-1] == last)
            kind[rare] = classes[items.of([words[k] for k in rare.tolist()])]
            stops = np.cumsum(sizes + 1)  # behind each text's end, which is a token
            starts = stops - sizes - 1
            token = np.full(batch.num_rows and stops[-1], len(words) - 1)
            inside = np.ones(len(token), bool)
            inside[stops - 1] = False
            token[inside] = number
            found, text = place[token], np.repeat(np.arange(batch.num_rows), sizes + 1)
            log = logs[found]
            sums = [log[a:b].sum() for a, b in zip(starts.tolist(), stops.tolist())]
            seqs = np.zeros(len(token) + batch.num_rows, np.uint8)  # an end before each text
            seqs[np.arange(len(token)) + text + 1] = kind[token]
            cuts = np.r_[0, stops + np.arange(1, batch.num_rows + 1)].astype(np.int32)
            results = (
                pa.array(sizes + 1), pa.array(np.bincount(text, found != last, batch.num_rows).astype(np.int64)), pa.array(sums, pa.float64()),
                pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(cuts), pa.py_buffer(seqs)]),
            )
            rare = np.flatnonzero(found == last)
            rare = rare[np.lexsort((token[rare], text[rare]))]  # by text and word, in order
            of_text, of_word = text[rare], token[rare]
            first = np.flatnonzero(np.r_[True, (of_text[1:] != of_text[:-1]) | (of_word[1:] != of_word[:-1])][: len(rare)])
            ends = np.searchsorted(of_text[first], np.arange(batch.num_rows + 1))
            at = pa.ListArray.from_arrays(pa.array(np.r_[first, len(rare)], pa.int32()), pa.array((rare - starts[of_text] + 1).astype(np.int32)))
            pairs = pa.StructArray.from_arrays([pa.array([words[k] for k in of_word[first].tolist()], pa.binary()), at], ["word", "at"])
            rare_lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *results, rare_lists], schema.names)

    local = materialize(given.mapInArrow(run, schema), "looked-up")  # keys are made once: what follows reads what was written
    words = local.select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.at")
    found = words.join(model.words, "word").select("key", F.explode(F.col("at").cast("array<long>")).alias("at"), "class", "n")
    codes = F.collect_list(F.col("at") * CLASSES + F.col("class")).alias("codes")  # of one text
    found = found.groupBy("key").agg(codes, F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("logs"))
    added = [(F.col(c) + F.coalesce(x, F.lit(0))).alias(c) for c, x in (("known", "more"), ("counts", "logs"))]
    both = local.drop("rare").join(found, "key", "left").select("own", "n_tokens", *added, "kinds", "codes")
    schema2 = both.drop("codes").schema

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, codes = batch.column(4), batch.column(5)
            starts = np.cumsum([0, *(n + 1 for n in batch.column(1).to_pylist())])
            flat = np.frombuffer(b"".join(seqs.to_pylist()), np.uint8).copy()
            text = np.repeat(np.arange(batch.num_rows), codes.value_lengths().fill_null(0).to_numpy())
            at, kind = np.divmod(codes.flatten().to_numpy(), CLASSES)
            flat[starts[text] + at] = kind
            new = [flat[a:b].tobytes() for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(new, pa.binary())], schema2.names)

    return materialize(both.mapInArrow(settle, schema2), "classified")


def class_pairs(texts: DataFrame) -> np.ndarray:
    """Counts of class pairs in the texts of ``classified``: a matrix of fixed size from each task, added on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for x in batch.column(0):
                seq = np.frombuffer(x.as_buffer(), np.uint8).astype(np.int64)
                pairs += np.bincount(seq[:-1] * CLASSES + seq[1:], minlength=len(pairs))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs))), pa.array(pairs)], ["pair", "n"])

    out = np.zeros(CLASSES * CLASSES)
    for r in texts.select("kinds").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return out.reshape(CLASSES, CLASSES)


def train(training: DataFrame, text_col: str = "text", rounds: int = ROUNDS, share: float = SHARE, floor: int = FLOOR) -> BrownModel:
    """Learn from every row of ``training``; null texts count as empty. Without rows all counts are zero."""
    model = learn_classes(training, text_col, rounds, share, floor)
    model.pairs = class_pairs(classified(training.select(text_col), model, text_col))
    return model


def score(docs: DataFrame, model: BrownModel, text_col: str = "text", count_share: float = COUNT_SHARE) -> DataFrame:
    """``docs`` without ``text_col``, with n_tokens, n_known, train_tokens (long), base_score, score and perplexity.

    base_score is the sum of log10((count + 1) / (N + V + 1)); perplexity is that of the model per token. Columns
    of ``docs`` with these names are replaced. Null text counts as empty (one token, the end). One row per row, repeated ones
    included.
    """
    return score_classified(classified(docs, model, text_col, count_share), model)


def score_classified(texts: DataFrame, model: BrownModel) -> DataFrame:
    """The result of ``score`` for the texts of ``classified``."""
    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
    shared = texts.sparkSession.sparkContext.broadcast(model.step_log10().ravel())
    given = texts.select("own", "n_tokens", "known", "counts", "kinds")
    schema = with_fields(given.drop("kinds").schema, "steps double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        for batch in batches:
            seqs = (np.frombuffer(x.as_buffer(), np.uint8).astype(np.int64) for x in batch.column(4))
            sums = [float(steps[seq[:-1] * CLASSES + seq[1:]].sum()) for seq in seqs]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(sums, pa.float64())], schema.names)

    floor = math.log10(model.tokens + model.distinct + 1)
    scored: Column = F.col("counts") + F.col("steps")
    own = [F.col("own")[c].alias(c) for c in texts.schema["own"].dataType.names if c not in results]
    return given.mapInArrow(run, schema).select(
        *own,
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("counts") - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        scored.alias("score"),
        F.pow(F.lit(10.0), -scored / F.col("n_tokens")).alias("perplexity"),
    )


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    """Whether a row is kept from training: by crc32 of its id as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds)) == fold


def split_and_score(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows that aren't held out and score all of them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out("doc_id"))
    model = learn_classes(rows.filter(~F.col("held_out")))
    texts = classified(rows, model)
    model.pairs = class_pairs(texts.filter(~F.col("own.held_out")))  # the training texts are among them
    return score_classified(texts, model)
