"""Usage in a trailing window: the batch form by buckets, and the stream, which gives the same."""

import datetime as dt
import random

import pytest

from kairograph.operators import accounting as A
from kairograph.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def sample(seed, n=400, span=900):
    r = random.Random(seed)
    return [(k, r.choice(["hot", "hot", "hot", "a", "b"]), T0 + dt.timedelta(seconds=r.randrange(span), milliseconds=r.choice([0, 0, 500])), r.randrange(50)) for k in range(n)]


def brute(rows, seconds=60, most=20, most_tokens=500):
    out = []
    for k, user, at, _ in rows:
        near = [n for _, u, t, n in rows if u == user and at - dt.timedelta(seconds=seconds) <= t <= at]
        out.append((k, len(near), sum(near), len(near) > most or sum(near) > most_tokens))
    return sorted(out)


SCHEMA = "event_id long, user string, ts timestamp, n long"


@pytest.mark.parametrize("bucket", [1, 60, 61, 100, 3600])
def test_buckets(spark, bucket):
    rows = sample(1)
    got = A.usage_window(spark.createDataFrame(rows, SCHEMA), "user", "ts", "n", 60, 20, 500, bucket)
    assert got.columns == ["event_id", "user", "ts", "n", "requests", "tokens", "over_limit"]
    assert sorted((r.event_id, r.requests, r.tokens, r.over_limit) for r in got.collect()) == brute(rows)


def test_clashing_names_nulls_and_negative_times(spark):
    rows = [(1, "u", dt.datetime(1969, 12, 31, 23, 59, 30), 5), (2, "u", dt.datetime(1970, 1, 1, 0, 0, 10), 6), (3, None, T0, 1), (4, "u", None, 9)]
    got = A.usage_window(spark.createDataFrame(rows, "requests long, bucket string, at timestamp, tokens long"), "bucket", "at", "tokens", 60, 1, 500, 60)
    assert got.columns == ["bucket", "at", "requests", "tokens", "over_limit"]
    assert sorted((r.requests, r.tokens) for r in got.collect()) == [(1, 1), (1, 5), (1, 9), (2, 11)]


def test_stream_equals_batch_on_replayed_events(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rows = sorted(sample(2, 150, 400), key=lambda r: r[2])
        r = random.Random(3)
        batches = [rows[:60], rows[60:110], rows[110:]]
        batches[1][0], batches[0][-1] = batches[0][-1], batches[1][0]  # out of order across batches, within what may be late
        folder, state = str(tmp_path / "in"), str(tmp_path / "state")
        stream = spark.readStream.schema(SCHEMA).parquet(folder + "/*")
        (tmp_path / "in").mkdir()
        name = f"trailing{r.randrange(10**9)}"
        for k, part in enumerate([*batches, [(9999, "end", T0 + dt.timedelta(days=1), 1)], [(10000, "end", T0 + dt.timedelta(days=1), 1)]]):
            r.shuffle(part)
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/{k}")
            found = jobs.usage_trailing(stream, "user", "ts", "n", "event_id", 60, "2 minutes", 20, 500)
            q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", state).queryName(name).trigger(availableNow=True).start()
            q.awaitTermination()
        got = sorted((r.event_id, r.requests, r.tokens, r.over_limit) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.event_id < 9999)
        assert got == brute(rows)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
