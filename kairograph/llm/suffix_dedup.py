"""Removal of long repeated byte strings: blockwise suffix sorting with a cover of sample suffixes.

A suffix bucket holds the suffixes that start at one distance before one anchor, the anchor being the smallest rolling
hash of a short string within the suffix's first ``length`` bytes. Equal strings have equal anchors at equal distances, so suffixes of
different buckets never tie, and an anchor that occurs once needs no sorting at all. Buckets are sorted one at a time:
by the bytes up to the next sample position, then by the rank of the sample suffix there. Samples stand every STRIDE bytes
from the anchor, so between suffixes of a bucket the same shift always leads from both to a sample: the property that
a difference cover gives for any two suffixes, here with fewer samples. Their ranks are found once per anchor. What a
task holds at a time is one anchor's surroundings; anchors with more than HOT of them are dealt by suffix instead.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import materialize, tasks_for, text_or_empty

LENGTH, GRAM, STRIDE, HOT = 400, 64, 64, 2000
#: Words of a passage, and of the strings whose least hash is its anchor.
PASSAGE, PASSAGE_GRAM = 50, 20
CHUNK = 1 << 20  # bytes whose hashes are worked out at once
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTERS = np.frombuffer(hashlib.shake_256(b"letters").digest(8 * 256), dtype=np.uint64)


class _Powers:
    """Powers of the rolling hash's base and of its inverse, kept as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full(n, _BASE), np.full(n, _INVERSE)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.cumprod(s, dtype=np.uint64) for s in steps)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _rolled(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` values (uint64) in a row."""
    n = len(values)
    if n < size:
        return np.empty(0, np.uint64)
    up, down = _POWERS.to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up, out=sums[1:])
    hashes = (sums[size:] - sums[:-size]) * down[: n - size + 1]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(32))


def anchors(values: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the ``gram`` values at each position, anchor position of each window of ``length`` values)."""
    n = len(values)
    if n < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = _rolled(values, gram)
    low = np.uint64((1 << 26) - 1)  # chunks are shorter than that: the leftmost of equal hashes is the smallest
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width = length - gram + 1
    padded = np.full(-(-len(keys) // width) * width, ~np.uint64(0))
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(after[:windows], before[width - 1 : width - 1 + windows])
    return hashes, (least & low).astype(np.int64)


def _runs(texts: list[bytes], length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, anchor's hash, anchor, first window, last window): positions within the text."""

    def of(group: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int, int, int]]:
        data = np.frombuffer(b"".join(x for _, _, x in group), dtype=np.uint8)
        hashes, at = anchors(_LETTERS[data], length)
        ends = np.cumsum([len(x) for _, _, x in group])
        for (row, shift, x), end in zip(group, ends.tolist()):
            start, windows = end - len(x), len(x) - length + 1
            if windows < 1:
                continue
            own = at[start : start + windows]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            firsts = np.concatenate([[0], cuts])
            lasts = np.concatenate([cuts - 1, [windows - 1]])
            where = own[firsts]
            for h, p, a, b in zip(hashes[where].view(np.int64).tolist(), (where - start).tolist(), firsts.tolist(), lasts.tolist()):
                yield row, h, p + shift, a + shift, b + shift

    group, size = [], 0
    for row, text in enumerate(texts):
        for shift in range(0, max(1, len(text)), 8 * CHUNK):  # parts of very long texts share all but one byte of a window
            part = text[shift : shift + 8 * CHUNK + length - 1] if len(text) > 8 * CHUNK else text
            group.append((row, shift, part))
            size += len(part)
            if size >= CHUNK:
                yield from of(group)
                group, size = [], 0
    if group:
        yield from of(group)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in batch.column(column)]


def _all_anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([(r, h, p) for r, h, p, _, _ in _runs(_texts(batch, 2), length)], dtype=np.int64).reshape(-1, 3)
            rows = pa.array(found[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 1]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found[:, 2])], ["gram", "k1", "k2", "pos"])

    return docs.mapInArrow(run, "gram long, k1 long, k2 long, pos long")


def _once_per_task(docs: DataFrame) -> DataFrame:
    """Copies of a text that one task reads leave it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            new = []
            for row, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key not in seen:
                    seen.add(key)
                    new.append(row)
            yield batch.take(pa.array(new, pa.int64()))

    return docs.mapInArrow(run, docs.schema)


def _surroundings(texts: DataFrame, length: int) -> DataFrame:
    """(gram, c1, c2, at, context, k1, k2, first): for each repeated anchor of a text, the bytes of its windows."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("at", pa.int64()), ("context", pa.binary()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64())])
        for batch in batches:
            data = _texts(batch, 2)
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            wanted = [set(x or ()) for x in batch.column(3).to_pylist()]
            rows = []
            for r, h, p, a, b in _runs(data, length):
                if p in wanted[r]:
                    context = data[r][a : b + length]
                    digest = np.frombuffer(xxhash.xxh3_128_digest(context + (p - a).to_bytes(8, "little")), "<i8").tolist()
                    rows.append((h, *digest, p - a, context, *keys[r], a))
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema.names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema.names)

    return texts.mapInArrow(run, "gram long, c1 long, c2 long, at long, context binary, k1 long, k2 long, first long")


def tied_suffixes(members: list[tuple[int, bytes]], length: int = LENGTH, stride: int = STRIDE) -> list[list[int]]:
    """For the (anchor position, bytes) surroundings of one anchor: starts whose first ``length`` bytes occur in another one.

    Buckets are the distances before the anchor, sorted one after the other.
    """
    samples = []
    for m, (at, data) in enumerate(members):
        samples += [(data[q:], m, (q - at) // stride) for q in range(at % stride, len(data), stride)]
    samples.sort()
    ranks, rank, last = {}, -1, None
    for data, m, j in samples:
        rank += data != last
        last = data
        ranks[m, j] = rank
    out: list[list[int]] = [[] for _ in members]
    buckets = defaultdict(list)
    for m, (at, data) in enumerate(members):
        for start in range(len(data) - length + 1):
            buckets[at - start].append(m)
    for distance, inside in buckets.items():
        if len(inside) < 2:
            continue
        shift = distance % stride  # to the next sample
        j = -(distance // stride)
        order = []
        for m in inside:
            start = members[m][0] - distance
            order.append((members[m][1][start : start + shift], ranks[m, j], m, start))
        order.sort()
        held = False
        for (prefix, r, m, start), (prefix_2, r_2, m_2, start_2) in zip(order, order[1:]):
            tie = prefix == prefix_2 and (r == r_2 or members[m][1][start : start + length] == members[m_2][1][start_2 : start_2 + length])
            if tie:
                if not held:
                    out[m].append(start)
                out[m_2].append(start_2)
            held = tie
    return out


def _spans(starts: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        if out and s == out[-1][1] + 1:
            out[-1] = out[-1][0], s
        else:
            out.append((s, s))
    return out


def _sorted_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """(gram, c1, c2, low, high): starts within a context whose strings occur in another context of its anchor."""
    dealt = contexts.select("gram", "c1", "c2", "at", "context").repartition(tasks_for(contexts.sparkSession), "gram").sortWithinPartitions("gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, keys, members, out = None, [], [], []

        def close() -> None:
            if len(members) > 1:
                for key, starts in zip(keys, tied_suffixes(members, length)):
                    out.extend((gram, *key, a, b) for a, b in _spans(starts))

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["gram", "c1", "c2", "low", "high"])

        for batch in batches:
            for g, c1, c2, at, data in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if g != gram:
                    close()
                    gram, keys, members = g, [], []
                    if len(out) >= 10_000:
                        yield made()
                        out = []
                keys.append((c1, c2))
                members.append((at, data))
        close()
        yield made()

    return dealt.mapInArrow(run, "gram long, c1 long, c2 long, low long, high long")


def _dealt_by_suffix(contexts: DataFrame, length: int) -> DataFrame:
    """As _sorted_buckets, for anchors with very many surroundings: each suffix goes by the 128-bit name of its bytes.

    A name's least and greatest owner, a grouped aggregate with partial sums, tell whether it has two; no group is collected.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, c1, c2, data in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4))):
                n = len(data) - length + 1
                names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[s : s + length]) for s in range(n)), "<i8").reshape(-1, 2)
                same = [pa.array(np.full(n, x)) for x in (g, c1, c2)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n)), pa.array(names[:, 0]), pa.array(names[:, 1])], ["gram", "c1", "c2", "start", "n1", "n2"])

    suffixes = contexts.select("gram", "c1", "c2", "at", "context").mapInArrow(run, "gram long, c1 long, c2 long, start long, n1 long, n2 long")
    owner = F.struct("gram", "c1", "c2", "start")
    names = suffixes.groupBy("n1", "n2").agg(F.min(owner).alias("least"), F.max(owner).alias("most")).filter("least != most").select("n1", "n2")
    found = suffixes.join(names, ["n1", "n2"])
    return found.select("gram", "c1", "c2", F.col("start").alias("low"), F.col("start").alias("high"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT, passage: int | None = None) -> tuple[DataFrame, ...]:
    """From (k1, k2, bytes) rows: texts with candidates (k1, k2, bytes, pos, grams), spans (k1, k2, low, high) of repeated strings
    in different places of different texts or of one, copies (k1, k2, n) of texts that stand more than once and, with
    ``passage``, (k1, k2, n_shared_words)."""
    found = materialize(_all_anchors(docs, length), "anchors")
    place = F.xxhash64("k1", "k2", "pos")  # one long to a side of the shuffle
    repeated = found.groupBy("gram").agg(F.min(place).alias("least"), F.max(place).alias("most")).filter("least != most").select("gram")
    repeated = materialize(repeated, "repeated")  # the semi join's sides are plain shuffles then: Spark can split a hot anchor's rows
    wanted = found.join(repeated, "gram", "left_semi").groupBy("k1", "k2").agg(F.collect_set("pos").alias("pos"))
    if passage:
        held = materialize(_passage_anchors(docs, passage), "passage-anchors")
        held = held.join(_held_by_two(held, ["gram"], "passage-grams"), "gram", "left_semi")
        held = held.groupBy("k1", "k2").agg(F.collect_set("gram").alias("grams"))
        wanted = wanted.join(held, ["k1", "k2"], "full")  # the texts are shuffled once for both
    else:
        wanted = wanted.withColumn("grams", F.lit(None).cast("array<long>"))
    texts = _once_per_task(docs).join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    texts = materialize(texts.select("k1", "k2", "bytes", "pos", "grams"), "candidates")
    members = materialize(_surroundings(texts.filter("pos is not null"), length), "surroundings")
    contexts = members.select("gram", "c1", "c2", "at", "context").dropDuplicates(["gram", "c1", "c2"])
    owners = materialize(members.groupBy("gram", "c1", "c2").agg(F.count(F.lit(1)).alias("n")), "owners")
    # written, so that Spark broadcasts it if small (it mostly is empty) and else may split a hot anchor's rows
    many = owners.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") > hot).select("gram")
    many = materialize(many, "hot-anchors")
    tied = _sorted_buckets(contexts.join(many, "gram", "left_anti"), length).union(_dealt_by_suffix(contexts.join(many, "gram", "left_semi"), length))
    narrow = members.select("gram", "c1", "c2", "k1", "k2", "first", F.length("context").alias("n"))
    key = ["gram", "c1", "c2"]
    part = narrow.join(tied, key).select("k1", "k2", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high") + length).alias("high"))
    whole = narrow.join(owners.filter("n > 1").select(*key), key).select("k1", "k2", F.col("first").alias("low"), (F.col("first") + F.col("n")).alias("high"))
    copies = docs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = _shared_words(texts.filter("grams is not null").select("k1", "k2", "bytes", "grams"), passage) if passage else None
    return texts, part.union(whole), copies, shared


def _passage_runs(text: bytes, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, anchor's hash, first and last window) for the runs of windows of ``words`` words with one anchor.

    Windows of equal words have equal anchors in them, whatever stands around.
    """
    import xxhash

    values = np.array([xxhash.xxh64_intdigest(w) for w in text.split()], dtype=np.uint64)
    parts, step = [], 1 << 24  # anchors of so many windows are found at once, whose neighbours then join again
    for shift in range(0, max(1, len(values) - words + 1), step):
        hashes, at = anchors(values[shift : shift + step + words - 1], words, min(PASSAGE_GRAM, words))
        parts.append((hashes[at], at + shift))
    names, at = (np.concatenate(x) for x in zip(*parts))
    cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
    firsts = np.concatenate([[0], cuts]) if len(at) else cuts
    lasts = np.concatenate([cuts - 1, [len(at) - 1]]) if len(at) else cuts
    return values, names[firsts].view(np.int64), firsts, lasts


def _passage_anchors(docs: DataFrame, words: int) -> DataFrame:
    """(gram, k1, k2): each anchor of a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.unique(_passage_runs(t, words)[1]) for t in _texts(batch, 2)]
            own = pa.array(np.repeat(np.arange(len(grams)), [len(g) for g in grams]))
            flat = np.concatenate([np.empty(0, np.int64), *grams])
            yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column(0).take(own), batch.column(1).take(own)], ["gram", "k1", "k2"])

    return docs.mapInArrow(run, "gram long, k1 long, k2 long")


def _passages(texts: DataFrame, words: int, each: bool) -> DataFrame:
    """(gram, name, k1, k2, low, high): for the anchors in ``grams`` of a text, its runs of windows by the hash of all their
    words, or ``each`` window by that of its own; low and high in words."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lengths = [np.empty((4, 0), np.int64)], []
            for text, wanted in zip(_texts(batch, 2), batch.column(3)):
                values, grams, firsts, lasts = _passage_runs(text, words)
                here = np.flatnonzero(np.isin(grams, wanted.values.to_numpy()))
                low, high, grams = firsts[here], lasts[here] + words, grams[here]
                if each:
                    numbers = high - low - words + 1
                    low = np.repeat(low - np.cumsum(numbers) + numbers, numbers) + np.arange(numbers.sum())
                    high, grams, names = low + words, np.repeat(grams, numbers), _rolled(values, words)[low]
                else:
                    names = np.array([xxhash.xxh3_64_intdigest(values[a:b]) for a, b in zip(low.tolist(), high.tolist())], dtype=np.uint64)
                out.append(np.stack([grams, names.view(np.int64), low, high]))
                lengths.append(len(low))
            rows, own = np.concatenate(out, axis=1), pa.array(np.repeat(np.arange(len(lengths)), lengths))
            ends = [pa.array(x.astype(np.int32)) for x in rows[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), batch.column(0).take(own), batch.column(1).take(own), *ends], ["gram", "name", "k1", "k2", "low", "high"])

    return texts.mapInArrow(run, "gram long, name long, k1 long, k2 long, low int, high int")


def _held_by_two(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Values of ``by`` that stand in two texts or more; written, so that a join with them can split a hot one's rows."""
    held = rows.groupBy(*by).agg(F.min("k1").alias("least"), F.max("k1").alias("most")).filter("least != most")
    return materialize(held.select(*by), name)


def _shared_words(texts: DataFrame, words: int) -> DataFrame:
    """(k1, k2, n_shared_words) of (k1, k2, bytes, grams) rows: the words of a text in passages of ``words`` words in a row that
    another text holds too; texts without any are left out.

    Runs of windows are compared as a whole first. Where one stands in one text only and its anchor in others, it may
    share windows with any other run of the anchor; for each of those, the windows of two of its texts are compared.
    """
    runs = materialize(_passages(texts, words, False), "passage-runs")
    text = F.struct("k1", "k2")
    distinct = materialize(runs.groupBy("gram", "name").agg(F.min(text).alias("least"), F.max(text).alias("most")), "passages-distinct")
    whole = materialize(distinct.filter("least != most").select("gram", "name"), "passages-whole")
    lone = distinct.groupBy("gram").agg(F.max(F.expr("least = most")).alias("lone"), F.count(F.lit(1)).alias("n")).filter("lone and n > 1")
    lone = materialize(lone.select("gram"), "passages-lone")
    ends = distinct.join(lone, "gram", "left_semi").select("gram", F.explode(F.array("least", "most")).alias("t"))
    rest = ends.groupBy(F.col("t.k1").alias("k1"), F.col("t.k2").alias("k2")).agg(F.collect_set("gram").alias("grams"))
    windows = materialize(_passages(texts.drop("grams").join(rest, ["k1", "k2"]), words, True).drop("high"), "passage-windows")
    shared = windows.join(_held_by_two(windows, ["gram", "name"], "passages"), ["gram", "name"], "left_semi").withColumn("high", F.col("low") + words)
    kept = ["k1", "k2", F.struct("low", "high").alias("s")]
    spans = runs.join(whole, ["gram", "name"], "left_semi").select(*kept).union(shared.select(*kept))
    spans = spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("s")).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["high"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["high"] - F.greatest(a["end"], s["low"]))).alias("n")),
    )
    return spans.select("k1", "k2", covered["n"].cast("long").alias("n_shared_words"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, with_text: bool = False, passage: int | None = None
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary][, n_shared_words]), one row per row of ``docs``.

    Each byte goes that a string of ``length`` bytes covers which also starts at another place, in the same text or
    any other row, repeated rows included; overlaps count, and strings are judged on the input. Null text counts as
    empty; texts shorter than ``length`` stay whole; null and repeated ids are rows like any other. An empty table
    gives no rows. ``kept`` may cut characters apart, so it is binary.

    With ``passage``, n_shared_words counts the words that stand in that many words in a row which another row holds
    too, repeated rows included; nothing is removed for it. Passages may be shorter than ``length`` bytes.
    """
    text = text_or_empty(text_col)
    keys = F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")
    rows = docs.select(*keys, text.cast("binary").alias("bytes"))
    texts, spans, copies, shared = repeated_spans(rows, length, hot, passage)
    spans = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "high")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, spans in zip(_texts(batch, 2), batch.column(3).to_pylist()):
                kept, at, removed, number = [], 0, 0, 0
                end = -1
                for s in sorted(spans, key=lambda s: (s["low"], s["high"])):
                    if s["low"] > end:
                        number += 1
                        kept.append(data[at : s["low"]])
                        removed += s["high"] - s["low"]
                    elif s["high"] > end:
                        removed += s["high"] - end
                    end = max(end, s["high"])
                    at = end
                kept.append(data[at:])
                whole = b"".join(kept)
                out.append((removed, number, hashlib.sha256(whole).hexdigest(), whole if with_text else None))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary())))], ["k1", "k2", "removed", "spans", "sha", "kept"])

    cut = texts.join(spans, ["k1", "k2"]).select("k1", "k2", "bytes", "spans").mapInArrow(run, "k1 long, k2 long, removed long, spans long, sha string, kept binary")
    own = [F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own_sha")]
    if passage:
        own.append(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long").alias("n_words"))
    narrow = docs.select(F.col(id_col).alias("id"), *keys, *own, *([text.cast("binary").alias("bytes")] if with_text else []))
    joined = narrow.join(cut, ["k1", "k2"], "left").join(copies, ["k1", "k2"], "left")
    if passage:
        joined = joined.join(shared, ["k1", "k2"], "left")
    copied = F.col("n").isNotNull()
    gone = copied & (F.col("n_bytes") >= length)
    out = joined.select(
        "id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "own_sha")).alias("kept_sha256"),
        *([F.when(gone, F.lit(b"")).otherwise(F.coalesce("kept", "bytes")).alias("kept")] if with_text else []),
        *([F.when(copied & (F.col("n_words") >= passage), F.col("n_words")).otherwise(F.coalesce("n_shared_words", F.lit(0).cast("long"))).alias("n_shared_words")] if passage else []),
    )
    return out
