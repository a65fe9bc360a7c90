"""A candidate is handed on by the texts that bear its hash's mark, not by each task that holds it; none is lost."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kairograph.llm import phrases as d

PHRASES = [f"w{k} v{k} u{k}" for k in range(20)]
TEXTS = [("en", f"{'. '.join(PHRASES)}. own{t}") for t in range(60)]


def test_tasks_hand_on_a_candidate_once_or_so():
    batch = lambda t: iter([pa.record_batch([["en"], pa.array([TEXTS[t][1].encode()], pa.binary())], names=["lang", "text"])])
    all_set, marks = SimpleNamespace(value=np.full(1 << 10, 255, np.uint8)), np.zeros(1 << 20, np.uint8)
    for t in range(60):  # a task a text
        for pairs in (None, all_set):
            for b in d._count_hashes(all_set, pairs, 5 if pairs else 2, True)(batch(t)):
                for h, _, mark in zip(*b.to_pydict().values(), strict=True):
                    at = h & (len(marks) - 1)
                    marks[at] = min(marks[at] or 255, mark)
    found = [r[:2] for t in range(60) for b in d._texts_of(all_set, all_set, SimpleNamespace(value=marks), 5)(batch(t)) for r in zip(*b.to_pydict().values(), strict=True)]
    assert len(set(found)) == 3 * len(PHRASES) and len(found) < 4 * len(set(found))  # 60 times as many before


def test_candidates_of_other_marks_are_asked_of_all(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "lang string, text string").repartition(3)
    found = lambda: sorted(map(tuple, d.collocations(docs, min_count=50).collect()))
    want, real, asked = found(), d._map_of_marks, []

    def wrong(hashes):
        asked.append(hashes.count())
        marks = real(hashes)
        return np.where(marks > 0, marks % 254 + 1, 0).astype(np.uint8) if len(asked) == 1 else marks

    monkeypatch.setattr(d, "_map_of_marks", wrong)
    assert len(want) == len(PHRASES) and found() == want and len(asked) == 2


def test_map_of_marks(spark):
    rows = spark.createDataFrame([(5, 7), (5 + (1 << d.MARK_BITS), 7), (9, 3), (9 - (1 << d.MARK_BITS), 4), (-1, 200)], "h long, mark int").select("h", F.col("mark"))
    marks = d._map_of_marks(rows)
    assert {int(k): int(marks[k]) for k in np.flatnonzero(marks)} == {5: 7, 9: d.ANY, (1 << d.MARK_BITS) - 1: 200}
