"""Incremental jobs: usage in event time, and fact ingest that survives restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from kairograph.operators.facts import append_facts, with_ids


def usage_stream(events: DataFrame, key: str, ts: str, tokens: str, seconds: int = 60, slide: int = 10, late: str = "2 minutes", max_requests: int = 50, max_tokens: int = 100_000) -> DataFrame:
    """Requests and tokens per key in sliding windows of event time; state is dropped behind the watermark."""
    windows = F.window("_ts", f"{seconds} seconds", f"{slide} seconds")
    counted = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).groupBy(key, windows.alias("window")).agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens"))
    over = (F.col("requests") > max_requests) | (F.col("tokens") > max_tokens)
    return counted.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "requests", "tokens", over.alias("over_limit"))


class _TrailingUsage(StatefulProcessor):
    """State of a key: events that wait for the watermark, and those of the last seconds before it, as (at, tokens, event)."""

    def __init__(self, seconds: int, max_requests: int, max_tokens: int, key: str, event: str, event_kind: str) -> None:
        self.back, self.max_requests, self.max_tokens = seconds * 1_000_000, max_requests, max_tokens
        self.key, self.event, self.schema = key, event, f"at bigint, tokens bigint, event {event_kind}, told boolean"

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)

    def _timer(self, at: int) -> None:
        """One timer a key: when the watermark has passed its first waiting event."""
        due = -(-at // 1000)
        for other in list(self.handle.listTimers()):
            if other > due:
                self.handle.deleteTimer(other)
            else:
                due = None
        if due is not None:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(at), int(n or 0), event, False) for f in rows for at, n, event in zip(f["at"], f["n"], f["event"], strict=True)]
        if new:
            self.rows.appendList(new)
            self._timer(min(r[0] for r in new))
        yield pd.DataFrame(columns=[self.key, "event", "at", "requests", "tokens", "over_limit"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All waiting events that the watermark has passed: no earlier one can come any more."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.rows.get(), key=lambda r: r[0])
        found, first, last, used = [], 0, 0, 0
        for at, _, event, told in rows:
            if at > passed:
                break
            while last < len(rows) and rows[last][0] <= at:  # events of the same moment count
                used += rows[last][1]
                last += 1
            while rows[first][0] < at - self.back:
                used -= rows[first][1]
                first += 1
            if not told:
                found.append((*key, event, at, last - first, used, last - first > self.max_requests or used > self.max_tokens))
        kept = [(at, n, event, at <= passed) for at, n, event, _ in rows if at >= passed - self.back]
        if kept:
            self.rows.put(kept)
        else:
            self.rows.clear()
        waiting = [r[0] for r in kept if not r[3]]
        if waiting:
            self.handle.registerTimer(-(-min(waiting) // 1000))
        yield pd.DataFrame(found, columns=[self.key, "event", "at", "requests", "tokens", "over_limit"])


def usage_trailing(events: DataFrame, key: str, ts: str, tokens: str, event: str, seconds: int = 60, late: str = "2 minutes", max_requests: int = 50, max_tokens: int = 100_000) -> DataFrame:
    """U1 in a stream: (key, event, ts, requests, tokens, over_limit): as usage_window, for each event when the watermark has passed it.

    State holds what waits and the last ``seconds``; it is kept in RocksDB, which the session must be set to use
    (spark.sql.streaming.stateStore.providerClass). Events later than ``late`` are dropped.
    """
    key_kind, event_kind = (events.schema[c].dataType.simpleString() for c in (key, event))
    rows = events.select(key, F.col(event).alias("event"), F.col(tokens).cast("long").alias("n"), F.col(ts).cast("timestamp").alias("_ts")).withWatermark("_ts", late)
    rows = rows.withColumn("at", F.unix_micros("_ts"))
    schema = f"{key} {key_kind}, event {event_kind}, at long, requests long, tokens long, over_limit boolean"
    found = rows.groupBy(key).transformWithStateInPandas(_TrailingUsage(seconds, max_requests, max_tokens, key, event, event_kind), schema, "Append", "EventTime")
    return found.select(key, F.col("event").alias(event), F.timestamp_micros("at").alias(ts), "requests", "tokens", "over_limit")


def _read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # anything else is no empty table
            raise
        return spark.createDataFrame([], schema)


def ingest_facts(spark: SparkSession, incoming: str, schema: StructType, target: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append the new facts of a folder to a Parquet table, once each.

    Ids never expire, so what is known is found by an anti-join with the table, not in state; a batch that is repeated
    after a crash finds its own facts there and adds nothing.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(incoming)

    def write(batch: DataFrame, _: int) -> None:
        new = with_ids(batch)
        append_facts(new, _read_or_empty(batch.sparkSession, target, new.schema)).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
