"""Best-fit packing of tokenised documents into sequences, by a linear grouping scheme on the length histogram.

There are at most ``cap`` different lengths, so the plan is made from counts by length and its size doesn't depend on
the number of documents; documents take their places by rank within their length, without meeting in one task.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.llm.common import materialize, text_or_empty, with_fields
from kairograph.llm.tokens import worker_encoder

#: Schemes that are planned, of which the one with the fewest sequences is taken: items longer than cap / the first take
#: part in the grouping, in as many groups as the second.
SCHEMES = ((2, 48), (3, 24), (3, 192), (4, 96))


def _ids_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Plan:
    """Places by (length, rank): runs of items of one length that go to consecutive sequences at one offset."""

    def __init__(self, counts: dict[int, int], cap: int) -> None:
        self.cap, self.left, self.taken = cap, dict(counts), defaultdict(int)
        self.runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # length: (first rank, first sequence, offset)
        self.sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, number)
        self.rooms: list[int] = []  # sorted keys of open

    def place(self, length: int, number: int, sequence: int, used: int) -> None:
        self.runs[length].append((self.taken[length], sequence, used))
        self.taken[length] += number
        self.left[length] -= number

    def offer(self, room: int, sequence: int, number: int) -> None:
        if room and number:
            if not self.open[room]:
                bisect.insort(self.rooms, room)
            self.open[room].append((sequence, number))

    def best_fit(self, length: int) -> None:
        while self.left[length]:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                number = -(-self.left[length] // (self.cap // length))
                self.offer(self.cap, self.sequences, number)
                self.sequences += number
                continue
            room = self.rooms[at]
            first, number = self.open[room].pop()
            if not self.open[room]:
                self.rooms.pop(at)
            some = min(number, self.left[length])
            self.place(length, some, first, self.cap - room)
            self.offer(room, first + some, number - some)
            self.offer(room - length, first, some)


def _groups(counts: dict[int, int], number: int) -> list[tuple[int, list[list[int]]]]:
    """Linear grouping: (rounded-up length, [[length, count], ...] from long to short) for groups of equal cardinality."""
    total = sum(counts.values())
    each, out, now, room = max(1, -(-total // number)), [], [], 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                now, room = [], each
                out.append((length, now))
            some = min(n, room)
            now.append([length, some])
            n, room = n - some, room - some
    return out


def one_plan(counts: dict[int, int], cap: int, large: int, groups: int) -> _Plan:
    """Large lengths are rounded up within groups, configurations of the few sizes chosen, real documents put in their
    places and the small ones best-fitted into what room is left, the longest first."""
    plan = _Plan(counts, cap)
    grouped = _groups({k: n for k, n in counts.items() if k > cap // large}, groups)
    sizes, stock = [s for s, _ in grouped], [sum(n for _, n in g) for _, g in grouped]

    def fullest(room: int, start: int, most: int) -> tuple[int, list[int]]:
        """The configuration of up to ``most`` groups from ``start`` on that fills ``room`` best."""
        best = (0, [])
        for g in range(start, len(sizes)):
            if sizes[g] > room or not stock[g]:
                continue
            stock[g] -= 1
            rest, more = fullest(room - sizes[g], g, most - 1) if most > 1 else (0, [])
            stock[g] += 1
            if sizes[g] + rest > best[0]:
                best = sizes[g] + rest, [g, *more]
            if best[0] == room:
                break
        return best

    for g in range(len(sizes)):
        while stock[g]:
            stock[g] -= 1
            _, rest = fullest(cap - sizes[g], g, large - 1)
            stock[g] += 1
            configuration = [g, *rest]
            times = min(stock[x] // configuration.count(x) for x in set(configuration))
            segments = [(plan.sequences, times, 0)]  # first sequence, number, used
            plan.sequences += times
            for x in configuration:
                stock[x] -= times
                out, items = [], grouped[x][1]
                for first, number, used in segments:
                    while number:
                        some = min(number, items[0][1])
                        length = items[0][0]
                        plan.place(length, some, first, used)
                        out.append((first, some, used + length))
                        first, number = first + some, number - some
                        items[0][1] -= some
                        if not items[0][1]:
                            items.pop(0)
                segments = out
            for first, number, used in segments:
                plan.offer(cap - used, first, number)
    for length in sorted((k for k in counts if k <= cap // large), reverse=True):
        plan.best_fit(length)
    return plan


def make_plan(counts: dict[int, int], cap: int = 4096) -> _Plan:
    """The best of the SCHEMES."""
    return min((one_plan(counts, cap, *scheme) for scheme in SCHEMES), key=lambda p: p.sequences)


def tokenised_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, cap: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each document's ids and its end id, cut at ``cap``."""
    narrow = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    schema = with_fields(narrow.drop("t").schema, "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
    end = _ids_bytes([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, _ids_bytes, b"".join)
        for batch in batches:
            rows, pieces, starts, lengths, sums, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                data = encoder.value(text) + end
                for piece, at in enumerate(range(0, len(data), 4 * cap)):
                    part = data[at : at + 4 * cap]
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return narrow.mapInArrow(run, schema)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", cap: int = 4096, end_id: int = 1, with_ids: bool = False
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset): one row per piece of each row of ``docs``.

    A document is its ids followed by ``end_id``; only those longer than ``cap`` are cut. Null text counts as empty (its
    end id alone); repeated rows and null ids are documents like any other; an empty table gives no rows. Sequences
    are numbered from 0 and filled without gaps.
    """
    spark = docs.sparkSession
    # numbered before they are written: a number of its own for each piece, however many are alike
    pieces = materialize(tokenised_pieces(docs, id_col, text_col, tokenizer, cap, end_id, with_ids).withColumn("number", F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # cap rows at most
    plan = make_plan(counts, cap)
    runs = spark.sparkContext.broadcast({k: np.array(v, dtype=np.int64).T for k, v in plan.runs.items()})
    # rank within a length: a hot length is dealt over salts, about 50,000 pieces each
    salts = max(32, sum(counts.values()) // 50_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("number"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("number")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["length", "salt"])
    own = [c for c in pieces.columns if c != "number"]
    ranked = ranked.select(*own, (F.col("first") + F.col("rank")).alias("rank"))
    schema = with_fields(pieces.drop("number").schema, "sequence_id long, offset long")
    at_length = own.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        for batch in batches:
            lengths, ranks = batch.column(at_length).to_numpy(), batch.column(len(own)).to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                here = np.flatnonzero(lengths == length)
                first, seq, used = table[int(length)]
                k = np.searchsorted(first, ranks[here], side="right") - 1
                sequence[here], offset[here] = seq[k] + ranks[here] - first[k], used[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(own))), pa.array(sequence), pa.array(offset)], schema.names)

    return ranked.mapInArrow(run, schema)
