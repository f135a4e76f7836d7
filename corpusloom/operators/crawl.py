"""What a crawl left behind: counts of outcomes, and what to try again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failure_kind(status: Column) -> Column:
    """captcha, 403 or other, for a status that isn't success; null for success."""
    return F.when(status == "success", None).when(status == "captcha", "captcha").when(F.contains(status, F.lit("403")), "403").otherwise("other")


def status_summary(log: DataFrame, status: str) -> DataFrame:
    """(outcome, n): success, captcha, 403 and other."""
    return log.groupBy(F.coalesce(failure_kind(F.col(status)), F.lit("success")).alias("outcome")).agg(F.count("*").alias("n"))


def retry_order(log: DataFrame, volume: str, status: str) -> DataFrame:
    """The failures, the likeliest to succeed first: other, then 403, then captcha; then by volume."""
    kind = failure_kind(F.col(status))
    return log.where(kind.isNotNull()).withColumn("kind", kind).withColumn("priority", F.when(kind == "other", 0).when(kind == "403", 1).otherwise(2)).orderBy("priority", volume)


def unprocessed(wanted: DataFrame, done: DataFrame, volume: str) -> DataFrame:
    """What is wanted and not done yet."""
    return wanted.join(done.select(volume).distinct(), volume, "left_anti")
