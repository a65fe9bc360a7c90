"""Positions over ranges that come from a sample."""

from pyspark.sql import functions as F

from kairograph.operators import metrics


def test_positions_hold_where_ranges_are_sampled(spark):
    key = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    rows = spark.range(0, 40_000, numPartitions=7).select(F.pmod(F.col("id") * 7919, F.lit(40_000)).alias("id"), F.col("id").alias("other"))
    spark.conf.set(key, 1)
    try:
        found = metrics.dense_position(rows, "id").collect()  # collected with a column that the counts of ranges don't read
        assert len(found) == 40_000 and all(r.position == r.id for r in found)
    finally:
        spark.conf.unset(key)
