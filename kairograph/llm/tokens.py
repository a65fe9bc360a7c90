"""Token counts by a public tokenizer: a two-tier lookup on the map side.

A pre-token here is what stands between white space, which the tokenizers of this kind never cross. Lengths of frequent
pre-tokens are broadcast as a compact hash table; the rest is encoded once per worker, by the tokenizer's own pieces, and kept
in its caches. No pre-token is shuffled: each task hands on one row, its bounded summary.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import tasks_for, text_or_empty, with_fields

#: Python splits at these, the tokenizers don't: such texts are encoded whole.
_ODD = re.compile("[\x1c-\x1f]")
#: Pre-tokens of these characters only are composed already, and Python and the library agree on the case and kind of each.
_PLAIN = re.compile("[\x00-\x1b\x20-\x7f\xa0-\u012f\u0131-\u017f\u2010-\u2027]*")
#: Fixed value: the split of the word-level public tokenizer; its pieces never hold white space.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: How that tokenizer prepares a text, as its file states it. Pre-tokens are lower-cased and split here by the same rules.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _WORD_SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The letters and digits of _PLAIN in lower case.
_LETTERS, _DIGITS = "a-zªµºß-öø-ÿ\u0100-\u017f", "0-9²³¹¼-¾"
#: _WORD_SPLIT for plain pre-tokens in lower case.
_PLAIN_SPLIT = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")
#: Entries in each generation of a worker's caches.
CACHE = 150_000


def load_tokenizer(name: str):
    """A tokenizers file by path, or by its name among the public ones."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(name)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Cache(dict):
    """Values of keys, made at their first use. A full cache becomes the old generation, from which what is used again
    moves to the new one: twice ``room`` entries at most, and frequent ones stay."""

    def __init__(self, make: Callable, room: int) -> None:
        super().__init__()
        self.make, self.room, self.old = make, room, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Values of texts from bounded caches or the library, a value being that of some ids (their number, or their bytes):
    ``of`` the ids, and ``join`` of the values of consecutive parts.

    Only tokenizers that prepare texts by _NORMALIZER and _PRE_TOKENIZER are taken apart; texts of any other are encoded whole.
    """

    def __init__(self, name: str, of: Callable = len, join: Callable = sum, cache: int = CACHE) -> None:
        self.tokenizer, self.of, self.join = load_tokenizer(name), of, join
        self.pre_tokens, self.pieces = _Cache(self._pre_token, cache), _Cache(self._piece, cache)
        spec = json.loads(self.tokenizer.to_str())
        self.by_piece = spec.get("normalizer") == _NORMALIZER and spec.get("pre_tokenizer") == _PRE_TOKENIZER
        special = [t["content"] for t in spec.get("added_tokens") or ()]
        self.mark = os.path.commonprefix(special)
        self.by_piece = self.by_piece and bool(self.mark or not special)
        self.tokenize, self.letters = self.tokenizer.model.tokenize, _byte_letters()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str):
        word = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        return self.of([t.id for t in self.tokenize(word)])

    def _pre_token(self, word: str):
        """Piece by piece where the pieces are sure to be the library's."""
        if not (word.isascii() or _PLAIN.fullmatch(word)) or (self.mark and self.mark in word):
            return self.of(self.whole(word))
        return self.join(map(self.pieces.__getitem__, _PLAIN_SPLIT.findall(word.lower())))

    def value(self, text: str):
        if not self.by_piece or _ODD.search(text):
            return self.of(self.whole(text))
        return self.join(map(self.pre_tokens.__getitem__, text.split()))


#: A worker's encoders outlive its tasks.
_ENCODERS: dict[tuple, Encoder] = {}


def worker_encoder(tokenizer: str, of: Callable, join: Callable) -> Encoder:
    key = tokenizer, of.__name__
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer, of, join)
    return _ENCODERS[key]


class _Summary:
    """Lossy counting: beyond 8 / share counters, those of at most share / 4 of what was seen go, so memory is bounded."""

    def __init__(self, share: float) -> None:
        self.share, self.counts, self.seen = share, Counter(), 0

    def add(self, pre_tokens: list[str] | dict[str, int], number: int) -> None:
        self.counts.update(pre_tokens)
        self.seen += number
        if len(self.counts) > 8 / self.share:  # fewer than 4 / share can have more than share / 4 of what was seen
            least = self.seen * self.share / 4
            self.counts = Counter({k: n for k, n in self.counts.items() if n > least})

    def row(self, part: float) -> pa.RecordBatch:
        """One row: what was seen, and the pre-tokens of ``part`` of it or more."""
        kept = {k: n for k, n in self.counts.items() if n >= self.seen * part}
        lists = pa.array([list(kept)], pa.list_(pa.string())), pa.array([list(kept.values())], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([self.seen], pa.int64()), *lists], ["seen", "pre_tokens", "counts"])


def frequent_pre_tokens(docs: DataFrame, text_col: str = "text", share: float = 2.0**-15) -> DataFrame:
    """(pre_token, n): pre-tokens that make up ``share`` or more of all, so 1 / share of them at most.

    One pass over all rows: each task sums its own up in one row of pre-tokens of share / 2 or more; a tree of tasks, which
    narrows to one, adds such rows up. Each holds 8 / share counters at most. The table only speeds counting up, it
    never changes a count.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = _Summary(share)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = text.split()
                summary.add(words, len(words))
        yield summary.row(share / 2)

    def merge(part: float) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            summary = _Summary(share)
            for batch in batches:
                for row in range(batch.num_rows):
                    seen, words, counts = (batch.column(k)[row].as_py() for k in range(3))
                    summary.add(dict(zip(words, counts)), seen)
            yield summary.row(part)

        return run

    schema = "seen long, pre_tokens array<string>, counts array<long>"
    texts = docs.select(text_or_empty(text_col))
    merged, tasks = texts.mapInArrow(count, schema), tasks_for(docs.sparkSession)
    for number, part in ((tasks, share / 2), (math.isqrt(tasks), share / 2), (1, share)):
        merged = merged.repartition(number).mapInArrow(merge(part), schema)
    return merged.select(F.explode(F.arrays_zip("pre_tokens", "counts")).alias("p")).select(F.col("p.pre_tokens").alias("pre_token"), F.col("p.counts").alias("n"))


def token_counts(docs: DataFrame, text_col: str = "text", tokenizer: str = "word_bpe_49k.json", share: float = 2.0**-15, limit: int = 2048) -> DataFrame:
    """``docs``' other columns with n_bytes, n_tokens (long) and over_limit (n_tokens > ``limit``), one row per row.

    Counts are those of the tokenizers library for the whole text, without added special tokens; special strings inside
    a text count as the library's default has it. Null text counts as empty; an empty table gives no rows. Columns
    of ``docs`` that are named as a result are replaced.
    """
    spark = docs.sparkSession
    rows = frequent_pre_tokens(docs, text_col, share).collect()  # 1 / share rows at most
    encoder = Encoder(tokenizer)
    table = spark.sparkContext.broadcast({r.pre_token: len(encoder.whole(r.pre_token)) for r in rows} if encoder.by_piece else {})
    own = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit", text_col)]
    given = docs.select(*own, text_or_empty(text_col).alias("_text"))
    schema = with_fields(given.drop("_text").schema, "n_tokens long, n_bytes long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, frequent = worker_encoder(tokenizer, len, sum), table.value

        def length(text: str) -> int:
            if not encoder.by_piece or _ODD.search(text):
                return encoder.value(text)
            words = text.split()
            found = list(map(frequent.get, words))
            return sum(filter(None, found)) + sum(encoder.pre_tokens[w] for w, n in zip(words, found) if n is None)

        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            counts = [length(t) for t in texts.to_pylist()]
            sizes = pc.binary_length(texts.cast(pa.binary())).cast(pa.int64())
            arrays = [*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(counts, pa.int64()), sizes]
            yield pa.RecordBatch.from_arrays(arrays, [*own, "n_tokens", "n_bytes"])

    return given.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
