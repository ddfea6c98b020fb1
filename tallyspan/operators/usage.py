"""How much of a request allowance was used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.functions.expressions import ratio


def throughput_efficiency(requests: DataFrame, limits: DataFrame, by: list[str]) -> DataFrame:
    """(by, efficiency): requests (by, ts) a second as percent of the allowance limit / period, of limits (limit, period) the best.

    0 where no time passed or nothing is allowed. limits is a short list.
    """
    spans = requests.groupBy(*by).agg(F.count("*").alias("n"), F.expr("timestampdiff(MICROSECOND, min(ts), max(ts))").alias("us"))
    rate = ratio(F.col("n") * 1_000_000, F.col("us"))
    best = spans.crossJoin(limits).withColumn("share", ratio(rate, ratio(F.col("limit"), F.col("period"))) * 100)
    return best.groupBy(*by).agg(F.max("share").alias("efficiency"))


def bucket_usage(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit, period, bucket, n, used): requests in each period of each limit, and their share of it."""
    marked = requests.crossJoin(limits).withColumn("bucket", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / F.col("period")))
    return marked.groupBy("limit", "period", "bucket").agg(F.count("*").alias("n")).withColumn("used", ratio(F.col("n"), F.col("limit")))
