"""Exact medians of groups of any size, by selection from counts of ranges of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.sources.shared import written

#: Ranges of values into which a pass divides what is left of a group.
RANGES = 1024


def exact_medians(rows: DataFrame, group: str, value: str, ranges: int = RANGES) -> DataFrame:
    """(group, median) of whole numbers; of an even number of them the mean of the two in the middle.

    A group's values are counted by ``ranges`` ranges between its bounds, and only the ranges with the one or two in the
    middle are counted again, until they are single values: two passes for bounds up to 10^6 apart. Partial sums are
    shuffled, at most ``ranges`` rows a group and task. Null values don't count; a group of nothing else has a null median.
    """
    known = written(rows.select(F.col(group).alias("group"), F.col(value).cast("long").alias("value")), "values")
    bounds = written(known.groupBy("group").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n")), "bounds")
    div = lambda a, b: F.call_function("div", a, b)
    places = F.explode(F.array_distinct(F.array(div(F.col("n") + 1, F.lit(2)), div(F.col("n"), F.lit(2)) + 1)))
    state = bounds.filter("n > 0").select("group", "low", "high", places.alias("place")).withColumn("middle", F.col("place"))
    done = None
    while True:
        found = state.filter("low = high").select("group", "low")
        done = found if done is None else done.unionByName(found)
        state = state.filter("low < high").withColumn("width", div(F.col("high") - F.col("low"), F.lit(ranges)) + 1)
        if state.isEmpty():
            break
        met = known.join(state, "group").filter("value between low and high").withColumn("range", div(F.col("value") - F.col("low"), F.col("width")))
        counts = met.groupBy("group", "middle", "low", "high", "place", "width", "range").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("group", "middle").orderBy("range"))
        chosen = counts.withColumn("upto", upto).filter("upto >= place and upto - n < place")
        low = F.col("low") + F.col("range") * F.col("width")
        state = written(chosen.select("group", low.alias("low"), F.least("high", low + F.col("width") - 1).alias("high"), (F.col("place") - F.col("upto") + F.col("n")).alias("place"), "middle"), "ranges")
    medians = done.groupBy("group").agg(F.avg("low").alias("median"))
    return medians.unionByName(bounds.filter("n = 0").select("group", F.lit(None).cast("double").alias("median")))
