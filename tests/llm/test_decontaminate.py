import hashlib
import re

from kairograph.llm import decontaminate as d
from kairograph.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    windows = set()
    for i, t in items:
        w = words(t)
        windows |= {("" if i is None else str(i), tuple(w[s : s + 10])) for s in range(max(1, len(w) - 9)) if w}
    by_length = {}
    for i, g in windows:
        by_length.setdefault(len(g), {}).setdefault(g, set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n, table in by_length.items():
            for s in range(len(w) - n + 1):
                if ids := table.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(df):
    out = df.withColumn("sha", d.items_digest()).select("doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated")
    return sorted(map(tuple, out.collect()), key=str)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*r, *["clash"] * 6) for r in docs], "doc_id long, text string, words string, n_hit string, k1 string, candidates string, own string, _text string"),
        spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, word string"),
    )


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (3, None), (4, "..."), (2, "short ITEM"), (None, "lonely"), (7, "x x x x x x x x x x x"), (10, "three four five six seven eight nine ten eleven twelve"), (11, "Élan vital ÉCOLE K")]
DOCS = [
    (1, "a ONE two, three four five six seven eight nine ten b"), (1, "a ONE two, three four five six seven eight nine ten b"), (2, "one two three four five six seven eight nine"), (3, None), (4, ""), (5, "short item short-item"),
    (None, "lonely"), (7, "x " * 25), (8, "x " * 9), (9, "élan vital école k"), (10, "Élan vital École k"), (11, "ÉLAN vital École K"), (12, "Élan VITAL ÉCOLE K"), (13, "z " * 20000 + ITEMS[0][1] + " two three four five six seven eight nine ten eleven twelve"), (14, "eleven twelve"),
]


def test_odd_rows(spark):
    docs, items = frames(spark, DOCS, ITEMS)
    assert got(d.decontaminate(docs, items)) == brute(DOCS, ITEMS)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", 0)
    docs, items = frames(spark, DOCS, ITEMS)
    assert got(d.decontaminate(docs, items)) == brute(DOCS, ITEMS)


def test_case_that_depends_on_context(spark):
    """Sigma before a dot is final in its own word, but not in the whole text."""
    items = [(1, "alpha beta ΟΔΟΣ.ΑΒΓ gamma")]
    rows = [(1, "x alpha beta ΟΔΟΣ.ΑΒΓ gamma y"), (2, "alpha beta")]
    docs, bench = frames(spark, rows, items)
    assert got(d.decontaminate(docs, bench)) == brute(rows, items)


def test_empty(spark):
    docs, items = frames(spark, DOCS, ITEMS)
    assert got(d.decontaminate(docs.limit(0), items)) == []
    assert got(d.decontaminate(docs, items.limit(0))) == brute(DOCS, [])


def test_table(spark, data):
    read = lambda t: spark.read.parquet(f"{data}/{t}.parquet")
    docs, items = [(r.doc_id, r.text) for r in read("documents").collect()], [(r.item_id, r.text) for r in read("benchmark").collect()]
    rows = queries.op5_decontaminate(spark, data)
    assert sorted(map(tuple, rows.collect()), key=str) == brute(docs, items)
    assert not re.search("Python|Pandas|Arrow", rows._jdf.queryExecution().executedPlan().toString())
