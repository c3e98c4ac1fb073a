"""Small read models: topics, runs, report lists, statistics, health."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.time import day_bounds, local_day
from tidewire.operators.rank import period_stats

# The focus of a topic page, the list of report days.
FOCUS_DAYS = 14
FOCUS_ITEMS = 5
REPORT_DAYS = 90


def topic_head(items: DataFrame, matches: Column) -> DataFrame:
    """Matching items, selected ones among them, and the local day of the newest selected."""
    chosen = F.col("selected")
    return items.where(matches).agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(chosen).alias("selected_count"),
        local_day(F.max(F.when(chosen, F.col("published_at")))).alias("latest_day"))


def topic_focus(items: DataFrame, matches: Column, *, today: date, days: int = FOCUS_DAYS, limit: int = FOCUS_ITEMS) -> DataFrame:
    """Selected main items of several sources in the last days, most sources first."""
    lower, _ = day_bounds(today - timedelta(days=days - 1), today)
    recent = items.where(matches & F.col("selected") & F.col("is_main") & (F.coalesce("source_count", F.lit(1)) >= 2)
                         & (F.col("published_at") >= F.lit(lower)))
    return recent.orderBy(F.desc("source_count"), F.desc("published_at"), "event_id").limit(limit)


def topic_timeline(items: DataFrame, matches: Column, *, limit: int = 60, offset: int = 0) -> DataFrame:
    """A page of the topic's selected items, newest first."""
    return items.where(matches & F.col("selected")).orderBy(F.desc("published_at"), "event_id").offset(offset).limit(limit)


def dual_stats(items: DataFrame, selected: DataFrame) -> DataFrame:
    """Coverage over all items of a period, beside the size of its selection."""
    return period_stats(items).crossJoin(selected.agg(F.count(F.lit(1)).alias("selected_count")))  # one row each


def empty_report(kind: str, key: str, items: DataFrame) -> DataFrame:
    """A period without a selection: status empty, statistics over all its items."""
    return dual_stats(items, items.limit(0)).select(
        F.lit(kind).alias("kind"), F.lit(key).alias("period_key"), F.lit("empty").alias("status"), "*")


def trailing_items(items: DataFrame, now: datetime, hours: float, *, limit: int, offset: int = 0) -> DataFrame:
    """A page of an exact trailing window, newest first; items without a time are left out."""
    inside = items.where((F.col("published_at") >= F.lit(now - timedelta(hours=hours))) & (F.col("published_at") <= F.lit(now)))
    return inside.orderBy(F.desc("published_at"), F.desc("event_id")).offset(offset).limit(limit)


def date_groups(items: DataFrame, ts: str = "published_at") -> DataFrame:
    """Items of each local day."""
    return items.groupBy(local_day(F.col(ts)).alias("day")).agg(F.count(F.lit(1)).alias("items"))


def report_dates(reports: DataFrame, *, limit: int = REPORT_DAYS) -> DataFrame:
    """Days that have a report, newest first."""
    return reports.select("report_date").distinct().orderBy(F.desc("report_date")).limit(limit)


def latest_finalized(reports: DataFrame) -> DataFrame:
    """The finalized, generated report with the greatest key."""
    return reports.where("is_finalized and status = 'generated'").orderBy(F.desc("period_key")).limit(1)


def report_entries(entries: DataFrame, day: Column) -> DataFrame:
    """One day's entries by position."""
    return entries.where(F.col("report_date") == day).orderBy("position")


def latest_success(runs: DataFrame) -> DataFrame:
    """When a run last succeeded (null if none has)."""
    return runs.where("status = 'succeeded'").agg(F.max("finished_at").alias("finished_at"))


def active_run(runs: DataFrame) -> DataFrame:
    """The run that started last among those still running."""
    return runs.where("status = 'running'").orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def source_health(sources: DataFrame, crawls: DataFrame) -> DataFrame:
    """Every source with its last crawl, last success and crawls since that failed.

    ``crawls``: source_id, ts, ok.
    """
    log = crawls.groupBy("source_id").agg(
        F.max("ts").alias("last_crawled_at"), F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_success_at"))
    failed = crawls.where("not ok").join(log.select("source_id", "last_success_at"), "source_id").where(
        F.col("last_success_at").isNull() | (F.col("ts") > F.col("last_success_at")))
    streak = failed.groupBy("source_id").agg(F.count(F.lit(1)).alias("error_count"))
    return sources.join(log, sources.id == log.source_id, "left").drop("source_id").join(
        streak, sources.id == streak.source_id, "left").drop("source_id").withColumn(
        "error_count", F.coalesce("error_count", F.lit(0).cast("long")))


def label_groups(items: DataFrame) -> DataFrame:
    """Labels in the order in which their first items come, with their sizes.

    ``items``: label, ord.
    """
    return items.groupBy("label").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("items")).orderBy("first")


def slim(items: DataFrame, heavy: list[str]) -> DataFrame:
    """Items without their heavy columns; names that are not there are no error."""
    return items.drop(*heavy)
