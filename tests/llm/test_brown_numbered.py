"""What op1 works out for a word, it works out once a part; splitting is that of bytes."""

import math

import numpy as np
import pyarrow as pa

from kairograph.llm import brown_lm as B

TEXTS = [b"", b" ", b"Aa aa\tBB", b"\x0b\x0cx\r\ny\x1cz ", " É é ÀA".encode(), b"aa \xff\xfe aa", b"one", b"\n\nbb bb aa\n"]


def test_words_are_numbered_as_bytes_split():
    batch = pa.RecordBatch.from_arrays([pa.array([b"before it", *TEXTS, b"behind it"], pa.binary())], ["text"]).slice(1, len(TEXTS))
    words, number, sizes = B._numbered(batch, 0)
    want = [x.lower().split() for x in TEXTS]
    assert sizes.tolist() == [len(w) for w in want] and [words[k] for k in number] == [w for ws in want for w in ws]
    assert len(words) == len(set(words))
    assert B._numbered(batch.slice(0, 2), 0)[0] == [] and B._numbered(batch.slice(0, 0), 0)[2].tolist() == []


def test_looked_up_words_and_places(spark):
    texts = [x.decode() for x in TEXTS if b"\xff" not in x] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    model = B.learn_classes(rows, share=0.1)
    classes = {bytes(r.word): (r["class"], r.n) for r in model.words.collect()}
    for share in (B.COUNT_SHARE, 0.1, 2.0):  # all words broadcast, some, none: the end is then met in the join too
        found = {r.own.doc_id: r for r in B.classified(rows, model, count_share=share).collect()}
        for k, text in enumerate(texts):
            words = [*text.encode().lower().split(), B.END]
            assert list(found[k].kinds) == [0, *(classes[w][0] for w in words)]
            assert (found[k].n_tokens, found[k].known) == (len(words), len(words))
            assert np.isclose(found[k].counts, sum(math.log10(classes[w][1] + 1) for w in words))
