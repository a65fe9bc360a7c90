"""Coverage, cost and usage accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.operators.medians import exact_medians

#: Dollars per million input and output tokens, by a pattern of the model's name; the first that fits counts.
PRICES = ((r"haiku.*4[-.]5|4[-.]5.*haiku", 1.00, 5.00), (r"haiku", 0.25, 1.25), (r"", 3.00, 15.00))
PROMPT_CHARS, ENTITY_CHARS, OUTPUT_TOKENS = 2000, 100, 500


def price(model: Column | str, output: bool = False) -> Column:
    """Dollars per token of a model."""
    name = F.lower(F.col(model) if isinstance(model, str) else model)
    out = F.lit(None).cast("double")
    for pattern, own, of_output in reversed(PRICES):
        value = F.lit((of_output if output else own) / 1e6)
        out = F.when(name.rlike(pattern), value).otherwise(out)
    return out


def coverage(inputs: DataFrame, outputs: DataFrame, key: str, stage: str, complete_at: float = 1.0) -> DataFrame:
    """Inputs, done and missing of a stage, their share, and whether that is enough."""
    done = outputs.select(F.col(key)).distinct().withColumn("_done", F.lit(1))
    joined = inputs.select(key).distinct().join(done, key, "left")
    n, d = F.count(F.lit(1)), F.count("_done")
    share = F.coalesce(F.try_divide(d, n), F.lit(0.0))
    return joined.agg(n.alias("total"), d.alias("done"), (n - d).alias("missing"), share.alias("fraction"), (share >= complete_at).alias("complete")).select(F.lit(stage).alias("stage"), "*")


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without an output."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def chunk_estimate(docs: DataFrame, tokens: str, size: int = 256, overlap: int = 64) -> DataFrame:
    """Exact number of chunks over all documents."""
    return docs.agg(F.coalesce(F.sum(F.ceil(F.col(tokens) / (size - overlap))), F.lit(0)).alias("chunks"), F.count(F.lit(1)).alias("docs"))


def relation_cost(texts: DataFrame, text: str = "text", entities: int = 10, model: str = "", prompt_chars: int = PROMPT_CHARS) -> DataFrame:
    """Tokens and dollars of relation extraction over all texts."""
    chars = F.coalesce(F.sum(F.length(text)), F.lit(0)) + F.count(F.lit(1)) * (prompt_chars + entities * ENTITY_CHARS)
    counted = texts.agg(F.count(F.lit(1)).alias("texts"), F.floor(chars / 4).alias("input_tokens"), (F.count(F.lit(1)) * OUTPUT_TOKENS).alias("output_tokens"))
    return counted.withColumn("cost", F.col("input_tokens") * price(F.lit(model)) + F.col("output_tokens") * price(F.lit(model), True))


def label_cost(texts: DataFrame, text: str = "text", model: str = "", local_share: float = 0.55, batch: int = 10, overhead: int = 1250, output_per_text: int = 8) -> DataFrame:
    """Tokens and dollars of labelling what the rules don't settle; a call for a batch shares its overhead."""
    counted = texts.agg(F.count(F.lit(1)).alias("texts"), F.avg(F.length(text)).alias("mean_chars"))
    remote = F.floor(F.col("texts") * (1 - local_share))
    calls = F.greatest(F.lit(1), F.floor(remote / max(batch, 1)))
    tokens = F.floor(calls * overhead + remote * F.coalesce("mean_chars", F.lit(0.0)) / 4)
    out = counted.select("texts", remote.alias("remote"), calls.cast("long").alias("calls"), tokens.alias("input_tokens"), (remote * output_per_text).alias("output_tokens"))
    return out.withColumn("cost", F.col("input_tokens") * price(F.lit(model)) + F.col("output_tokens") * price(F.lit(model), True))


def usage_cost(usage: DataFrame) -> DataFrame:
    """P5: requests, tokens and dollars by model (columns model, input_tokens, output_tokens)."""
    dollars = F.sum(F.col("input_tokens") * price("model") + F.col("output_tokens") * price("model", True))
    return usage.groupBy("model").agg(F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), dollars.alias("cost"))


def usage_window(
    events: DataFrame, key: str, ts: str, tokens: str, seconds: int = 60, max_requests: int = 50, max_tokens: int = 100_000, bucket_seconds: int = 3600
) -> DataFrame:
    """Requests and tokens of the last seconds at each event, and whether a limit is passed.

    Time falls into buckets, and an event of a bucket's last ``seconds`` stands in the next one too, where it is counted but
    not returned: a key's events are as many tasks as it has buckets. Events without a time see those without a time.
    """
    width, back = max(bucket_seconds, seconds) * 1_000_000, seconds * 1_000_000
    rows = events.select(F.struct("*").alias("event"), F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(tokens).alias("tokens"))
    bucket = F.floor(F.col("at") / F.lit(width))
    near = F.when(F.col("at") >= (bucket + 1) * width - back, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("step", F.explode(near)).withColumn("bucket", bucket + F.col("step"))
    window = Window.partitionBy("key", "bucket").orderBy("at").rangeBetween(-back, 0)
    out = rows.withColumns({"requests": F.count(F.lit(1)).over(window), "used": F.sum("tokens").over(window)}).filter("step = 0")
    over = (F.col("requests") > max_requests) | (F.col("used") > max_tokens)
    own = (F.col("event")[c].alias(c) for c in events.columns if c not in ("requests", "tokens", "over_limit"))
    return out.select(*own, "requests", F.col("used").alias("tokens"), over.alias("over_limit"))


def size_profile(files: DataFrame, size: str = "length") -> DataFrame:
    """Number, total, mean and median size; the median is exact, by selection."""
    whole = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("total"), F.avg(size).alias("mean"))
    median = exact_medians(files.select(F.lit(0).alias("group"), size), "group", size)
    return whole.withColumn("group", F.lit(0)).join(median, "group", "left").drop("group")
