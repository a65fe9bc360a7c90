import math
import re
from collections import Counter

from kairograph.llm import queries
from kairograph.llm import quality_rules as q

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = SPLIT.findall(text)
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def class_counts(text):
    white = len(re.findall(r"[\x20\x09-\x0D]", text))
    upper = sum("A" <= c <= "Z" for c in text)
    digit = sum("0" <= c <= "9" for c in text)
    symbol = sum(c in "#*$%&|<>" for c in text)
    point = sum(c.isascii() and c.isprintable() and not c.isalnum() and c not in "#*$%&|<> " for c in text)
    beyond = sum(ord(c) > 127 for c in text)
    rest = len(text) - white - upper - digit - symbol - point - beyond
    return [white, rest, upper, digit, symbol, point, beyond]


def word_counts(text, lang):
    listed = q.COMMON_WORDS.get(lang)
    if listed:
        words = SPLIT.findall(text)
        each = [words.count(w) for w in listed]
        return [*each, len(words) - sum(each)]


def distance(counts, shares):
    total = sum(counts)
    out = 0.0
    for n, s in zip(counts, shares):
        p, m = n / total, (n / total + s) / 2
        out += (p * math.log2(p / m) if p else 0) + (s * math.log2(s / m) if s else 0)
    return math.sqrt(max(0.0, out / 2))


def brute(rows):
    """(id, five measures, base_failed, kept) of (id, text, lang) rows."""
    rows = [(i, t or "", lang) for i, t, lang in rows]
    sums = {}
    for _, t, lang in rows:
        for key in {"*", lang if lang in q.COMMON_WORDS else "*"}:
            c = sums.setdefault(key, [[0] * 7, [0] * 17])
            c[0] = [a + b for a, b in zip(c[0], class_counts(t))]
            if key != "*":
                c[1] = [a + b for a, b in zip(c[1], word_counts(t, lang))]
    share = lambda x: [v / max(1, sum(x)) for v in x]
    out = []
    for i, t, lang in rows:
        m, key = measures(t), lang if lang in q.COMMON_WORDS else "*"
        kept = not m[-1]
        if kept and len(t) >= q.MIN_CHARS:
            kept &= distance(class_counts(t), share(sums[key][0])) <= q.MAX_CLASS_DISTANCE
        if kept and key != "*" and m[0] >= q.MIN_WORDS:
            kept &= distance(word_counts(t, lang), share(sums[key][1])) <= q.MAX_WORD_DISTANCE
        out.append((i, *m, kept))
    return sorted(out, key=str)


COLUMNS = "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def test_table(spark, data):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert got(queries.op2_quality_rules(spark, data)) == brute(rows)


def test_odd_rows(spark):
    prose = "the cat and the dog of a man in the house was on it for some time and by now is with us " * 3
    plain = " ".join(f"word{k} of the" for k in range(60))
    rows = [
        (1, None, "en"), (2, "", None), (3, " \n\t\x0b ", "en"), (4, prose, "en"), (5, prose, "xx"), (5, prose, "xx"), (None, plain, None),
        (7, plain, "en"), (8, "a b\n" * 40, "en"), (9, "é x 𝄞 | # $", "fr"), (10, " ".join(f"w{k}### x{k}$$$" for k in range(200)), "en"),
        (11, " ".join(f"lang{k}" for k in range(30000)), "de"), (12, "one two three four five six seven eight " * 2 + plain, "en"), (13, "x " * 7 + "y", "en"),
    ]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, lang string, kept string, word_distance string")
    assert got(q.quality_rules(docs)) == brute(rows)


def test_overlapping_windows(spark):
    rows = []
    for k, text in enumerate(["a " * 9, "a " * 8, "a b c d e f g h i " * 2, "a b c d e f g h x a b c d e f g h", "a b c d e f g h a b c d e f g h a"]):
        rows.append((k, text + " ".join(f"z{j}" for j in range(k)), "en"))
    assert got(q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"))) == brute(rows)


def test_empty(spark):
    assert q.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_no_python_in_the_plan(spark, data):
    plan = queries.op2_quality_rules(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
