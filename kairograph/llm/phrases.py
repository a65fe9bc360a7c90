"""Phrase collocation mining: candidates by Apriori, counted by broadcast double-array tries, scored by their weakest cut."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.llm.common import materialize, utf8

#: Words of the longest phrase, occurrences that a candidate needs, percentage of a phrase's occurrences inside a longer one
#: at which it goes, and phrases returned for a language.
LONGEST, MIN_COUNT, INSIDE, TOP = 5, 100, 100, 2000
#: Candidates of one trie: some 20 MB of arrays besides its words. More candidates are dealt over several tries.
TRIE = 1 << 19
#: Words that a task gathers candidates from at once, distinct words after which it hands on their counts, and bytes of text
#: whose positions it advances at once.
CHUNK, DISTINCT, STEP = 4_000_000, 400_000, 4_000_000
#: Bits of the maps of frequent hashes that the search for candidates knows.
BITS = 25
#: Bits of a place in the map of the texts that hand on a hash's candidates, and marks of texts. ANY: all texts do.
MARK_BITS, MARKS, ANY = 24, 254, 255

#: A-Z in lower case, a full stop for each mark that ends a piece, a space for a tab.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
#: What stands between two pieces.
_END = b"."
_WORDS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64())])
_HASHES = pa.schema([("h", pa.int64()), ("n", pa.int64())])
_MARKED = _HASHES.append(pa.field("mark", pa.int32()))
_LIKELY = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("h", pa.int64())])
_BLOCKS = pa.schema([("block", pa.int64()), ("n", pa.binary())])
_PLACES = pa.schema([("place", pa.int64()), ("n", pa.int64())])
#: Phrases whose counts a task hands on as one row.
BLOCK = 512


def _tokens(texts: list[bytes]) -> list[bytes]:
    """Words of all texts, and ``_END`` after each piece."""
    return _END.join(texts).translate(_BYTES).replace(b".", b" . ").split()


def _by_lang(batch: pa.RecordBatch, most: int = STEP) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, texts): the texts of a language, some ``most`` bytes at a time."""
    waiting: dict[str, tuple[list[bytes], int]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        texts, size = waiting.get(lang, ([], 0))
        texts.append(text)
        waiting[lang] = texts, size + len(text)
        if size + len(text) >= most:
            yield lang, waiting.pop(lang)[0]
    yield from ((lang, texts) for lang, (texts, _) in waiting.items())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n): occurrences of each word, and of all words under a null phrase."""
    found: dict[str, Counter] = defaultdict(Counter)

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, n in found.items():
            n.pop(_END, None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(n) + 1)), pa.array([None, *n], pa.binary()), pa.array([n.total(), *n.values()], pa.int64())], schema=_WORDS)
        found.clear()

    for batch in batches:
        for lang, texts in _by_lang(batch):
            found[lang].update(_tokens(texts))
            if sum(map(len, found.values())) >= DISTINCT:
                yield from rows()
    yield from rows()


def _map_of(hashes: DataFrame) -> np.ndarray:
    """A bit for each hash: of a fixed size, whatever the number of hashes."""
    place = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1)) + 1
    made = hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros((1 << BITS) // 8, np.uint8)
    for bucket, part in made.collect():  # 2^(BITS - 15) rows of 4 KB at most
        bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(part, np.uint8)
    return bits


def _map_of_marks(hashes: DataFrame) -> np.ndarray:
    """The mark of the hash at each place; ANY where hashes of several share it. Of a fixed size, gathered by parts of it."""
    place = F.col("h").bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    mark = F.when(F.min("mark") == F.max("mark"), F.min("mark")).otherwise(ANY).alias("mark")
    one = hashes.groupBy(place.alias("place")).agg(mark)
    bucket = F.shiftright("place", 12)
    made = one.groupBy(bucket.alias("bucket")).agg(F.collect_list(F.struct((F.col("place") % 4096).cast("int").alias("at"), F.col("mark").cast("int").alias("mark"))).alias("x"))
    marks = np.zeros(1 << MARK_BITS, np.uint8)
    for row in made.select("bucket", F.col("x.at").alias("at"), F.col("x.mark").alias("mark")).toLocalIterator():  # at most 2^(MARK_BITS - 12) rows of 4096 places
        marks[row.bucket * 4096 + np.array(row["at"])] = row["mark"]
    return marks


def _is_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _hash(word: bytes) -> int:
    """Spark's xxhash64 of the same word, unsigned."""
    return xxhash.xxh64_intdigest(word, seed=42)


def _windows(lang: str, ids: np.ndarray, names: list[bytes], words: np.ndarray, pairs: np.ndarray | None, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, starts, hashes) of the runs of 2 to ``longest`` words here that may be frequent by Apriori: all of their words are set
    in ``words``, and of runs of three or more all pairs in ``pairs``."""
    own = np.fromiter(map(_hash, names), np.uint64, len(names))
    own[0] = 0
    often = _is_set(words, own)
    often[0] = False
    own = own ^ np.uint64(_hash(lang.encode()))
    start, odd = np.flatnonzero(often[ids]), np.uint64(0x9E3779B97F4A7C15)
    hashes = own[ids[start]]
    linked = np.zeros(len(ids), bool)  # where a pair starts that may be frequent
    for k in range(2, longest + 1):
        end = start + k - 1
        inside = end < len(ids)
        start, end, hashes = start[inside], end[inside], hashes[inside]
        on = often[ids[end]] if k == 2 else linked[end - 1]
        start, end = start[on], end[on]
        hashes = hashes[on] * odd + own[ids[end]]
        hashes ^= hashes >> np.uint64(29)
        yield k, start, hashes
        if k == 2 and pairs is not None:
            kept = _is_set(pairs, hashes)
            start, hashes = start[kept], hashes[kept]
            linked[start] = True


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes], np.ndarray]]:
    """(lang, ids, names, marks): the tokens of a language, some CHUNK words at a time, numbered by their own list of words, with the
    marks of their texts; 0 ends a piece."""
    waiting: dict[str, tuple[dict, list[np.ndarray], list[np.ndarray], int]] = {}

    def chunk(lang: str) -> tuple[str, np.ndarray, list[bytes], np.ndarray]:
        numbers, parts, marks, _ = waiting.pop(lang)
        return lang, np.concatenate(parts), list(numbers), np.concatenate(marks)

    for batch in batches:
        for lang, texts in _by_lang(batch):
            numbers, parts, marks, n = waiting.get(lang) or (defaultdict(count(1).__next__, {_END: 0}), [], [], 0)
            tokens = [_tokens([text]) for text in texts]
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
            ids = np.fromiter(chain.from_iterable(chain(map(numbers.__getitem__, t), (0,)) for t in tokens), np.int32, int(sizes.sum()))
            own = np.repeat(np.fromiter(map(_mark, texts), np.uint8, len(texts)), sizes)
            waiting[lang] = numbers, [*parts, ids], [*marks, own], n + len(ids)
            if sum(w[3] for w in waiting.values()) >= CHUNK:
                yield chunk(max(waiting, key=lambda x: waiting[x][3]))
    yield from map(chunk, list(waiting))


def _mark(text: bytes) -> int:
    """A text's mark, from the text alone: the same in every pass and however texts are dealt."""
    return xxhash.xxh32_intdigest(text) % MARKS + 1


def _count_hashes(words, pairs, longest: int, marked: bool = False):
    """(h, n): how often the hash of a run of words that may be frequent occurs in a chunk; of pairs, or of longer runs where ``pairs``
    are known. With ``marked`` also the mark of a text that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, names, marks in _chunks(batches):
            for k, start, hashes in _windows(lang, ids, names, words.value, pairs and pairs.value, longest):
                if k > 2 or pairs is None:
                    h, first, n = np.unique(hashes, return_index=True, return_counts=True)
                    columns = [pa.array(h.view(np.int64)), pa.array(n), pa.array(marks[start[first]].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns if marked else columns[:2], schema=_MARKED if marked else _HASHES)

    return run


def _texts_of(words, pairs, wanted, longest: int):
    """(lang, phrase, h): the runs of words of a chunk whose hash is in the map ``wanted``, each once: of a text that has the mark
    there, or of any text where the map has ANY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, names, marks in _chunks(batches):
            for k, start, hashes in _windows(lang, ids, names, words.value, pairs.value, longest):
                asked = wanted.value[hashes & np.uint64(len(wanted.value) - 1)]
                likely = np.flatnonzero((asked == ANY) | ((asked > 0) & (asked == marks[start])))
                runs = np.unique(ids[start[likely][:, None] + np.arange(k)], axis=0, return_index=True)
                phrases = [b" ".join(map(names.__getitem__, row)) for row in runs[0].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()), pa.array(hashes[likely][runs[1]].view(np.int64))], schema=_LIKELY)

    return run


class Trie:
    """A double array over the words of phrases: from state s, symbol c leads to base[s] + c if check is s there.

    ``words`` numbers the words from 1. A word is two symbols, the digits of its number to the root of all numbers, so that
    the states after a state lie close together. ``roots`` has a state for each language; ``accepts`` has a phrase's place in
    the list where it ends, else -1.
    """

    def __init__(self, phrases: list[tuple[str, list[bytes]]]) -> None:
        self.words: dict[bytes, int] = {}
        self.roots = {lang: k for k, lang in enumerate(dict.fromkeys(lang for lang, _ in phrases), 1)}
        longest = max((len(p) for _, p in phrases), default=0)
        words = np.zeros((len(phrases), longest), np.int64)
        for k, (_, p) in enumerate(phrases):
            words[k, : len(p)] = [self.words.setdefault(w, len(self.words) + 1) for w in p]
        self.digits = int(np.sqrt(len(self.words))) + 1
        symbols = np.stack(self.symbols(words), axis=2).reshape(len(phrases), 2 * longest)
        self.used = np.zeros(0, bool)
        self.base, self.check, self.accepts = (np.zeros(0, np.int32) for _ in range(3))
        self.top, self.low = len(self.roots) + 1, 0  # all from ``top`` on is free; families look for room from ``low`` on
        self._grow(self.top)
        self.used[: self.top] = True
        state, lengths = np.array([self.roots[lang] for lang, _ in phrases], np.int64), np.array([2 * len(p) for _, p in phrases], np.int64)
        for k in range(2 * longest):
            own = np.flatnonzero(lengths > k)
            edges, which = np.unique(np.stack([state[own], symbols[own, k]]), axis=1, return_inverse=True)
            state[own] = self._place(*edges)[which.reshape(-1)]
            ends = own[lengths[own] == k + 1]
            self.accepts[state[ends]] = ends
        size = self.top + self.digits + 2
        self._grow(size)
        self.base, self.check, self.accepts = self.base[:size], self.check[:size], self.accepts[:size]
        del self.used, self.top, self.low

    def _grow(self, size: int) -> None:
        if size > len(self.used):
            more = max(size, len(self.used) * 3 // 2) - len(self.used)
            self.used = np.append(self.used, np.zeros(more, bool))
            self.base = np.append(self.base, np.zeros(more, np.int32))
            self.check, self.accepts = (np.append(x, np.full(more, -1, np.int32)) for x in (self.check, self.accepts))

    def _place(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """States for edges, which are sorted by parent: large families first, then the only children into what is free."""
        starts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        sizes = np.diff(np.r_[starts, len(parents)])
        found = np.zeros(len(parents), np.int64)
        for g in sorted(np.flatnonzero(sizes > 1), key=lambda g: -sizes[g]):
            own = slice(starts[g], starts[g] + sizes[g])
            found[own] = self._family(symbols[own])
            self.used[found[own]] = True
            self.top = max(self.top, int(found[own][-1]) + 1)
        alone = starts[sizes == 1]
        self._grow(self.top + len(alone))
        found[alone] = np.flatnonzero(~self.used)[: len(alone)]
        self.used[found[alone]] = True
        self.top, self.low = max(self.top, int(found.max(initial=0)) + 1), 0
        self.check[found] = parents
        self.base[parents] = found - symbols
        return found

    def _family(self, symbols: np.ndarray, tries: int = 1024) -> np.ndarray:
        """Free states as far apart as the children's symbols: the first of some free places that fits, else the end."""
        apart = symbols - symbols[0]
        self._grow(self.top + int(apart[-1]) + 1)
        free = self.low + np.flatnonzero(~self.used[self.low : min(self.top, self.low + 16 * tries)])
        if len(free) < tries:
            self.low = min(self.top, self.low + 4 * tries)
        at = free[: max(1, min(tries, 1_000_000 // len(symbols)))]
        fits = np.flatnonzero(~self.used[at[:, None] + apart].any(1))
        return (int(at[fits[0]]) if len(fits) else self.top) + apart

    def symbols(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return words // self.digits + 1, words % self.digits + 1

    def advance(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states lead on by their word, and where to."""
        high, low = self.symbols(words)
        half = self.base[states] + high
        there = np.flatnonzero(self.check[half] == states)
        half = half[there]
        to = self.base[half] + low[there]
        on = self.check[to] == half
        return there[on], to[on]


def _count_by(broadcast):
    """(block, n): a task's counts of a trie's phrases, BLOCK places a row: all positions' states advance at once, a word a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: Trie = broadcast.value
        totals = np.zeros(len(trie.check), np.int64)
        for batch in batches:
            for lang, texts in _by_lang(batch):
                if lang not in trie.roots:
                    continue
                symbols = np.fromiter(map(trie.words.get, tokens := _tokens(texts), repeat(0)), np.int32, len(tokens))
                at, k = np.flatnonzero(symbols), 0
                states = np.full(len(at), trie.roots[lang], np.int32)
                while len(at):
                    there, states = trie.advance(states, symbols[at + k])
                    totals += np.bincount(states, minlength=len(totals))
                    at, k = at[there], k + 1
                    inside = at + k < len(symbols)
                    at, states = at[inside], states[inside]
                    known = symbols[at + k] > 0
                    at, states = at[known], states[known]
        ends = np.flatnonzero(trie.accepts >= 0)
        counts = np.zeros((len(ends) // BLOCK + 1) * BLOCK, np.int64)
        counts[trie.accepts[ends]] = totals[ends]
        counts = counts.reshape(-1, BLOCK)
        seen = np.flatnonzero(counts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array([row.tobytes() for row in counts[seen]], pa.binary())], schema=_BLOCKS)

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, n) of the phrases that occur, from rows in the order of their blocks: one block is held at a time."""
    block, sums = None, np.zeros(BLOCK, np.int64)

    def out() -> pa.RecordBatch:
        seen = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(seen + BLOCK * block), pa.array(sums[seen])], schema=_PLACES)

    for batch in batches:
        for now, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if now != block:
                if block is not None:
                    yield out()
                block, sums = now, np.zeros(BLOCK, np.int64)
            sums += np.frombuffer(n, np.int64)
    if block is not None:
        yield out()


def count_phrases(docs: DataFrame, candidates: DataFrame, most: int = TRIE) -> DataFrame:
    """(lang, phrase, n) of the candidates that occur in ``docs`` (lang, text as bytes).

    Candidates are dealt over tries of ``most`` or so by their hash. Each trie is made of its own candidates, broadcast, and
    run over all texts; what the tasks have counted is added up. So no more than one trie is held anywhere at a time.
    """
    spark = docs.sparkSession
    tries = max(1, -(-candidates.count() // most))
    dealt = candidates.select("lang", "phrase", F.pmod(F.xxhash64(F.lit(7), "lang", "phrase"), F.lit(tries)).cast("int").alias("trie"))
    dealt = materialize(dealt.withColumn("place", F.row_number().over(Window.partitionBy("trie").orderBy("lang", "phrase")).cast("long") - 1), "candidates")
    counted = None
    for k in range(tries):
        own = dealt.filter(F.col("trie") == k).orderBy("place").toArrow()
        trie = Trie([(lang, phrase.encode().split(b" ")) for lang, phrase in zip(own.column("lang").to_pylist(), own.column("phrase").to_pylist(), strict=True)])
        shared = spark.sparkContext.broadcast(trie)
        blocks = docs.select("lang", "text").mapInArrow(_count_by(shared), "block long, n binary").repartition("block").sortWithinPartitions("block")
        n = blocks.mapInArrow(_sum_blocks, "place long, n long")
        n = materialize(n.select(F.lit(k).alias("trie"), "place", "n"), "trie-counts")
        counted = n if counted is None else counted.unionByName(n)
        shared.unpersist()
    return dealt.join(counted, ["trie", "place"]).select("lang", "phrase", "n")


def counted_phrases(docs: DataFrame, words: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, most: int = TRIE) -> DataFrame:
    """(lang, phrase, n) of phrases of 2 to ``longest`` words that may have ``min_count`` occurrences: none that has is left out.

    Runs of frequent words are counted by 64-bit hashes, pairs first, then longer runs of frequent pairs: phrases that share a
    hash are counted together, so a count is never too small. Only runs whose hash is frequent are handed on as texts, and of
    these only by texts with the mark that the hash was counted with, not by each task that holds them. Phrases that share a hash
    may have other marks: the phrases' own counts then add up to less than the hash's, and such hashes are asked of all texts. What
    tasks know of frequent words, pairs and hashes are maps of a fixed size, which may let more through, never less.
    """
    spark = docs.sparkSession
    share = lambda df: spark.sparkContext.broadcast(_map_of(df))

    def frequent(pairs) -> DataFrame:
        # tasks hand on sums already: dealt by hash at once, a row for each chunk at most
        counted = docs.mapInArrow(_count_hashes(known, pairs, longest if pairs else 2, True), "h long, n long, mark int").repartition("h").groupBy("h").agg(F.sum("n").alias("n"), F.min("mark").alias("mark"))
        return materialize(counted.filter(F.col("n") >= min_count), "hashes")

    known = share(words.select(F.xxhash64("phrase").alias("h")))
    hashes = frequent(None)
    pairs = share(hashes)
    if longest > 2:
        hashes = hashes.unionByName(frequent(pairs))
    hashes = materialize(hashes.groupBy("h").agg(F.sum("n").alias("n"), F.min("mark").alias("mark")), "hashes")

    def likely(asked: DataFrame) -> DataFrame:
        wanted = spark.sparkContext.broadcast(_map_of_marks(asked))
        # distinct before the hashes are met: tasks hand on each candidate that they hold
        texts = docs.mapInArrow(_texts_of(known, pairs, wanted, longest), "lang string, phrase binary, h long").distinct().join(asked.select("h"), "h", "left_semi")
        texts = materialize(texts.select("h", "lang", F.col("phrase").cast("string").alias("phrase")).distinct(), "likely")
        wanted.unpersist()
        return texts

    texts = likely(hashes)
    counted = materialize(count_phrases(docs, texts.select("lang", "phrase"), most), "counts")
    # a hash's own count is that of all its phrases: where they have less, some of another text are missing
    whole = texts.join(counted, ["lang", "phrase"]).groupBy("h").agg(F.sum("n").alias("found"))
    short = materialize(hashes.join(whole, "h", "left").filter("found is null or found <> n").select("h", F.lit(ANY).alias("mark")), "short")
    if not short.isEmpty():
        more = likely(short).select("lang", "phrase").join(counted, ["lang", "phrase"], "left_anti")
        counted = counted.unionByName(count_phrases(docs, more, most))
    for shared in (known, pairs):
        shared.unpersist()
    return counted


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, most: int = TRIE) -> tuple[DataFrame, DataFrame]:
    """Two tables: (lang, phrase, n) of all phrases of 1 to ``longest`` words with ``min_count`` occurrences; (lang, size), the
    words of each language that has any. ``docs`` has lang and text, as bytes."""
    docs = docs.select("lang", "text")
    words = docs.mapInArrow(_count_words, "lang string, phrase binary, n long").groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("n"))
    words = materialize(words.filter((F.col("n") >= min_count) | F.col("phrase").isNull()), "words")
    found = words.filter("phrase IS NOT NULL")
    sizes = materialize(words.filter("phrase IS NULL").select("lang", F.col("n").alias("size")).join(found, "lang", "left_semi"), "sizes")
    if longest < 2:
        return found, sizes
    longer = counted_phrases(docs, found, longest, min_count, most).filter(F.col("n") >= min_count)
    return found.unionByName(materialize(longer, "frequent")), sizes


def _part(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, min_count: int = MIN_COUNT, inside: int = INSIDE, top: int = TOP, most: int = TRIE
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language whose weakest cut scores most.

    A cut after the first words gives l and r, the occurrences of both parts; its score is floor(1000 a n / (l r)), a being the
    phrase's occurrences and n the language's words. A phrase goes if a longer candidate around it has ``inside`` percent of its
    occurrences. Null texts are empty, a null language is ``und``; repeated rows count each; phrases don't cross the marks
    that end a piece, nor documents; ties go by a, then by the phrase's bytes; an empty table, or one without candidates, gives no rows; other
    columns are not looked at. Exact for counts up to 10^15.
    """
    read = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), utf8(text_col).alias("text"))
    frequent, sizes = frequent_phrases(read, longest, min_count, most)
    words = F.split("phrase", " ")
    candidates = frequent.select("lang", "phrase", F.col("n").alias("a"), words.alias("words"), F.size(words).alias("size")).filter("size > 1")
    part = frequent.select("lang", F.col("phrase").alias("part"), "n")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(F.col("words"), F.lit(1), F.col("cut")).alias("left"), _part(F.col("words"), F.col("cut") + 1, F.col("size") - F.col("cut")).alias("right"))
    cuts = cuts.join(part.select("lang", F.col("part").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(part.select("lang", F.col("part").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    cuts = cuts.join(sizes.withColumnRenamed("size", "n"), "lang")
    score = F.call_function("div", whole(F.col("a") * 1000, 19) * whole(F.col("n"), 18), whole(F.col("l"), 18) * whole(F.col("r"), 18))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.cast("long").alias("score"), "cut", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.*")
    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: _part(F.col("words"), i, k)))))
    around = candidates.filter("size > 2").select("lang", spans.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # by parts of a language first: the last task of a language sorts so many times ``top`` rows at most
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))).filter(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows for DuckDB.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
spans AS (SELECT lang, w, unnest(range(1, {LONGEST} + 1)) AS k FROM w),
phrases AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM spans WHERE len(w) >= k)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM phrases GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
cand AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, s.n, CAST(1000 * c.a::HUGEINT * s.n // (x.f::HUGEINT * y.f) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 1000 * c.a::HUGEINT * s.n // (x.f::HUGEINT * y.f), cut) AS place
  FROM cuts c JOIN sizes s USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1 : c.k], ' ')),
kept AS (
  SELECT * FROM scored s WHERE place = 1 AND NOT EXISTS (
    SELECT 1 FROM cand o WHERE o.lang = s.lang AND len(o.phrase) > len(s.phrase) AND 100 * o.a >= {INSIDE} * s.a AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {TOP}
"""
