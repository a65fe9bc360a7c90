"""A task of op1 works on a part of a batch at a time, however long its texts are."""

import numpy as np
import pyarrow as pa

from kairograph.llm import brown_lm as B


def test_parts_hold_few_items_and_all_rows():
    sizes = [5, 0, 40, 3, 3, 3, 100, 0, 1]
    lists = pa.array([list(range(n)) for n in sizes], pa.list_(pa.int32()))
    texts = pa.array([None if n == 0 else b"x" * n for n in sizes], pa.binary())
    batch = pa.RecordBatch.from_arrays([lists, texts], ["items", "text"])
    for column in (0, 1):
        parts = list(B._parts(iter([batch, batch.slice(0, 0)]), column, 10))
        assert [r for p in parts for r in p.to_pylist()] == batch.to_pylist()
        assert len(parts) > 3 and all(sum(len(x or ()) for x in p.column(column).to_pylist()[1:]) <= 10 for p in parts)


def test_a_batch_of_several_parts_is_counted_whole(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd"], 30_000)) for _ in range(20)]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1)
    assert sum(map(len, texts)) > 3 * B.PART and 30_000 * 20 > 2 * B.PART
    items = B._Items({b"aa": 1, b"bb": 2, b"cc": 3})
    encoded = B._encoded(rows, "text", spark.sparkContext.broadcast(items))
    classes = B._start_classes(items)
    want = np.zeros((B.CLASSES, B.CLASSES))
    for x in texts:
        kinds = [0, *(int(classes[items.item(w)]) for w in x.encode().split()), 0]
        np.add.at(want, (kinds[:-1], kinds[1:]), 1)
    assert (B._pairs_of(encoded, [classes])[0] == want).all()
    found = {r["item"]: r for r in B._contexts(encoded, items.number, classes).collect()}
    assert sum(sum(r["left"]) for r in found.values()) == want.sum() == sum(sum(r["right"]) for r in found.values())
