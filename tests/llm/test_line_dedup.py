from collections import Counter

from kairograph.llm import line_dedup as d


def brute(rows, ratio, line_pages, host_pages):
    pages, counts = Counter(h for _, h, _ in rows), Counter()
    for _, h, t in rows:
        counts.update((h, x) for x in {y.strip(" ") for y in (t or "").split("\n")} if x)
    out = []
    for i, h, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        gone = lambda x: h is not None and x and pages[h] >= host_pages and counts[h, x] >= line_pages and counts[h, x] > ratio * pages[h]
        lines = t.split("\n")
        kept = [x for x in lines if not gone(x.strip(" "))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_odd_rows(spark):
    rows = [(k, "a.example", f"menu\nbody {k}\n  menu  \nmenu\n\nfooter {k % 2}") for k in range(12)]
    rows += [(k, "b.example", f"menu\nother {k}") for k in range(20, 23)]
    rows += [(30, None, "menu\nx"), (31, "a.example", None), (32, "a.example", ""), (33, "a.example", "menu"), (33, "a.example", "menu"), (None, "a.example", "menu\n" * 5000 + "end"), (None, None, None)]
    docs = spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], "doc_id long, source string, text string, host string, n_dropped string, _host string, _drop string, own string")
    got = d.drop_boilerplate(docs, ratio=0.5, min_line_pages=3, min_host_pages=5)
    assert got.columns == ["doc_id", "source", "text", "host", "_host", "_drop", "own", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute(rows, 0.5, 3, 5)


def test_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    for limits in ((0.08, 5, 20), (0.1, 2, 2)):
        got = d.drop_boilerplate(docs, ratio=limits[0], min_line_pages=limits[1], min_host_pages=limits[2]).collect()
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=str) == brute(rows, *limits)


def test_empty(spark):
    assert d.drop_boilerplate(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []
