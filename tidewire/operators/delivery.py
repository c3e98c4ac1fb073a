"""Newsletter and feedback ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ATTEMPTS = 5
RETRY_MINUTES = 30


def active_subscribers(subscribers: DataFrame, before) -> DataFrame:
    return subscribers.where((F.col("status") == "active") & (F.col("confirmed_at") < F.lit(before)))


def claimable(subscribers: DataFrame, deliveries: DataFrame, period: str, now) -> DataFrame:
    """Subscribers of a period that have no mail yet and none under way."""
    own = deliveries.where(F.col("period_key") == period)
    busy = (F.col("status") == "sending") & (F.col("claimed_at") > F.lit(now) - F.expr(f"INTERVAL {RETRY_MINUTES} MINUTES"))
    closed = own.where((F.col("status") == "sent") | (F.col("attempts") >= MOST_ATTEMPTS) | busy)
    return subscribers.join(closed.select("subscriber_id"), "subscriber_id", "left_anti")


def status_overview(subscribers: DataFrame, deliveries: DataFrame) -> DataFrame:
    count = lambda df, kind: df.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "status", "n")
    return count(subscribers, "subscriber").unionByName(count(deliveries, "delivery"))


def failing_sources(sources: DataFrame, least: int = 3) -> DataFrame:
    return sources.where(F.col("is_active") & (F.col("error_count") >= least)).orderBy(F.desc("error_count"), "id")


def recent_feedback(feedback: DataFrame, since, message: str | None = None) -> DataFrame:
    """Number of messages since a time, and of those with the same text."""
    rows = feedback.where(F.col("created_at") >= F.lit(since))
    same = F.count_if(F.col("message") == F.lit(message)) if message is not None else F.lit(0).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("n"), same.alias("same"))
