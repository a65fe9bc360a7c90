"""Quality rules by distribution divergence, with DataFrame functions only.

A document's histograms of character classes and of its language's common words are compared with those of its
language, summed over the whole table, by the Jensen-Shannon distance (base 2, so 0 to 1). Short texts say too little
and are spared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import text_or_empty

#: Very common words of the languages with references.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "be", "with", "as", "by"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a"),
}
WHITE = r"[\x20\x09-\x0D]+"
#: Regular expressions of the counted character classes; white space and the rest (mostly lower-case letters) come from lengths.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "symbol": "[#*$%&|<>]", "point": r"[!-/:-@\[-`{-~&&[^#*$%&|<>]]", "beyond": r"[^\x00-\x7F]"}
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")
#: Distances above these are rejected, for texts of at least so many characters or words.
MAX_CLASS_DISTANCE, MIN_CHARS = 0.24, 500
MAX_WORD_DISTANCE, MIN_WORDS = 0.245, 120


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def _shifted(a: Column) -> Column:
    return F.slice(a, 2, F.size(a))


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words within ``width``-word windows that occur twice or more in the array, the first occurrence included.

    Windows are told apart by 64-bit hashes of their words' hashes.
    """

    def covered(starts: Column) -> Column:
        steps = F.zip_with(starts, _shifted(starts), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda n, x: n + x)

    def same_as_next(pairs: Column) -> Column:
        return F.zip_with(pairs, _shifted(pairs), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))

    def repeated(pairs: Column) -> Column:
        def keep(same: Column) -> Column:
            before = F.concat(F.array(F.lit(False)), same)
            marked = F.zip_with(F.zip_with(pairs, same, lambda p, s: F.struct(p["i"].alias("i"), s.alias("s"))), before, lambda p, s: F.when(p["s"] | s, p["i"]))
            return let(F.array_sort(F.filter(marked, lambda i: i.isNotNull())), covered)

        return let(same_as_next(pairs), keep)

    def of_windows(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, repeated))

    def of_hashes(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (width - 1))
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, width))), of_windows)

    return F.when(F.size(words) < width, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)).cast("long")


def _histograms(text: Column, words: Column, lang: Column) -> Column:
    """Struct of classes (seven counts) and common (counts of the language's words, then of all others; null without a reference)."""
    white = F.length(text) - F.length(F.array_join(words, ""))
    counts = [F.regexp_count(text, F.lit(p)).cast("long") for p in CLASSES.values()]
    listed = F.lit(None).cast("array<string>")
    for name, common in COMMON_WORDS.items():
        listed = F.when(lang == name, F.array(*map(F.lit, common))).otherwise(listed)
    every = sorted({w for x in COMMON_WORDS.values() for w in x})

    def classes(c: Column) -> Column:
        rest = F.length(text) - white - F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x)
        return F.concat(F.array(white.cast("long"), rest.cast("long")), c)

    def histogram(found: Column) -> Column:
        each = F.transform(listed, lambda c: F.size(F.filter(found, lambda w: w == c)).cast("long"))
        return let(each, lambda e: F.concat(e, F.array(F.size(words) - F.aggregate(e, F.lit(0).cast("long"), lambda n, x: n + x))))

    common = F.when(listed.isNotNull(), let(F.filter(words, lambda w: w.isin(every)), histogram))
    return F.struct(let(F.array(*counts), classes).alias("classes"), common.alias("common"))


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, dict[str, list[float]]]:
    """Shares of character classes and common words by language, and of classes over all ("*"): five entries at most."""
    sizes = 2 + len(CLASSES), 1 + len(next(iter(COMMON_WORDS.values())))
    sums = [F.sum(F.col("h.classes")[k]).alias(f"c{k}") for k in range(sizes[0])] + [F.sum(F.col("h.common")[k]).alias(f"w{k}") for k in range(sizes[1])]
    known = F.when(F.col(lang_col).isin(*COMMON_WORDS), F.col(lang_col)).otherwise(F.lit("*")).alias("lang")
    counted = docs.select(known, let(words_of(text_or_empty(text_col)), lambda w: _histograms(text_or_empty(text_col), w, F.col(lang_col))).alias("h"))
    rows = counted.groupBy("lang").agg(*sums).collect()
    out, every = {}, [0] * sizes[0]
    share = lambda counts: [c / max(1, sum(counts)) for c in counts]
    for r in rows:
        classes = [r[f"c{k}"] or 0 for k in range(sizes[0])]
        every = [a + b for a, b in zip(every, classes)]
        if r.lang != "*":
            out[r.lang] = {"classes": share(classes), "words": share([r[f"w{k}"] or 0 for k in range(sizes[1])])}
    return out | {"*": {"classes": share(every)}}


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, base 2, of a histogram of counts from shares; null where either is null or empty."""

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    def distance(total: Column) -> Column:
        terms = F.zip_with(counts, reference, lambda n, q: let(n / total, lambda p: part(p, (p + q) / 2) + part(q, (p + q) / 2)))
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))

    return let(F.aggregate(counts, F.lit(0).cast("double"), lambda n, x: n + x), lambda t: F.when(t > 0, distance(t)))


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, class_distance,
    word_distance (null where spared or without a reference) and kept; columns of ``docs`` of these names are replaced.

    base_failed: under 20 words, or over 30 % of words in repeated 8-word windows. kept: not base_failed and no distance
    above its limit. Null text counts as empty (base_failed). A language without a reference, or null, is compared
    with the classes of all documents and spared the words. Repeated rows are judged alike; an empty table gives no rows.
    """
    found = language_references(docs, text_col, lang_col)
    literal = lambda shares: F.array(*map(F.lit, shares))
    classes, words = literal(found["*"]["classes"]), F.lit(None).cast("array<double>")
    for lang, shares in found.items():
        if lang != "*":
            classes = F.when(F.col(lang_col) == lang, literal(shares["classes"])).otherwise(classes)
            words = F.when(F.col(lang_col) == lang, literal(shares["words"])).otherwise(words)
    text = text_or_empty(text_col)

    def measured(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            _histograms(text, w, F.col(lang_col)).alias("h"),
        )

    def compared(m: Column) -> Column:
        return F.struct(
            m.alias("m"),
            F.when(F.length(text) >= min_chars, js_distance(m["h"]["classes"], classes)).alias("class_distance"),
            F.when(m["n_words"] >= min_words, js_distance(m["h"]["common"], words)).alias("word_distance"),
        )

    def judged(c: Column) -> Column:
        m = c["m"]
        failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
        fits = (F.coalesce(c["class_distance"], F.lit(0.0)) <= max_class_distance) & (F.coalesce(c["word_distance"], F.lit(0.0)) <= max_word_distance)
        shown = [m["n_words"], m["word_chars"], m["h"]["classes"][2 + list(CLASSES).index("symbol")], m["n_dup_lines"], m["n_repeat_words"], failed, c["class_distance"], c["word_distance"], ~failed & fits]
        return F.struct(*[x.alias(name) for x, name in zip(shown, RESULTS)])

    # one expression, each part bound once: a filter on the verdict that is pushed below doesn't work the text out again
    verdict = let(let(let(words_of(text), measured), compared), judged)
    own = [c for c in docs.columns if c not in RESULTS]
    return docs.select(*own, verdict.alias("_verdict")).select(*own, "_verdict.*")


def _oracle_sql() -> str:
    """The rows of op2 for DuckDB, by windows and histograms as tables."""
    counted = {"upper": "[A-Z]", "digit": "[0-9]", "symbol": "[#*$%&|<>]", "point": r"""[!"''()+,\-./:;=?@\[\\\]^_`{}~]""", "beyond": r"[^\x00-\x7F]"}
    number = lambda p: f"length(text) - length(regexp_replace(text, '{p}', '', 'g'))"
    listed = " ".join(f"WHEN '{lang}' THEN [" + ", ".join(f"'{w}'" for w in words) + "]" for lang, words in COMMON_WORDS.items())
    known = ", ".join(f"'{x}'" for x in COMMON_WORDS)
    terms = "CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  CASE lang {listed} END AS common FROM d),
m AS (SELECT r, doc_id, lang, length(text) AS chars, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {number(counted["symbol"])} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  {", ".join(f"{number(p)} AS c_{k}" for k, p in counted.items())}, list_transform(common, lambda c: len(list_filter(w, lambda x: x = c))) AS com FROM w),
g AS (SELECT r, i, list_slice(w, i, i + 7) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM h WHERE k > 1) GROUP BY r),
lists AS (SELECT *, [chars - word_chars, word_chars - c_upper - c_digit - c_symbol - c_point - c_beyond, c_upper, c_digit, c_symbol, c_point, c_beyond] AS cls, list_append(com, n_words - list_sum(com)) AS words FROM m),
cells AS (SELECT r, lang, 'c' AS kind, unnest(cls) AS n, unnest(range(0, 7)) AS k FROM lists UNION ALL SELECT r, lang, 'w', unnest(words), unnest(range(0, 17)) FROM lists WHERE words IS NOT NULL),
sums AS (SELECT CASE WHEN lang IN ({known}) THEN lang ELSE '*' END AS lang, kind, k, sum(n) AS n FROM cells GROUP BY 1, 2, 3),
pooled AS (SELECT '*' AS lang, kind, k, sum(n) AS n FROM sums WHERE kind = 'c' GROUP BY kind, k),
refs AS (SELECT lang, kind, k, n / greatest(1, sum(n) OVER (PARTITION BY lang, kind)) AS q FROM (SELECT * FROM sums WHERE lang <> '*' UNION ALL SELECT * FROM pooled)),
shares AS (SELECT r, CASE WHEN lang IN ({known}) THEN lang ELSE '*' END AS lang, kind, k, n / nullif(sum(n) OVER (PARTITION BY r, kind), 0) AS p FROM cells),
dist AS (SELECT r, kind, sqrt(greatest(0, sum({terms}) / 2)) AS d FROM shares JOIN refs USING (lang, kind, k) WHERE p IS NOT NULL GROUP BY r, kind),
j AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed,
  (SELECT d FROM dist WHERE dist.r = m.r AND kind = 'c') AS cd, (SELECT d FROM dist WHERE dist.r = m.r AND kind = 'w') AS wd FROM m LEFT JOIN rep USING (r))
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND (chars < {MIN_CHARS} OR coalesce(cd, 0) <= {MAX_CLASS_DISTANCE}) AND (n_words < {MIN_WORDS} OR coalesce(wd, 0) <= {MAX_WORD_DISTANCE}) AS kept FROM j
"""


ORACLE_SQL = _oracle_sql()
