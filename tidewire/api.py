"""The query surface: checked parameters in, DataFrames out."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import scoring as S
from tidewire.functions import topics as P
from tidewire.functions.text import contains_all_terms
from tidewire.functions.time import day_bounds, period_range, window_start
from tidewire.operators import rank, views


def _between(name: str, value: int, low: int, high: int) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
        raise ValueError(f"{name} must be a whole number from {low} to {high}: {value!r}")
    return value


def matching(items: DataFrame, *, category=None, focus=None, source=None, tag=None, topic=None, q=None) -> DataFrame:
    """All given conditions hold; each reads the columns that it names."""
    text = F.concat_ws(" ", "title", "one_line_summary", "summary", F.array_join("tags", " "))
    rows = items
    if source:
        rows = rows.where(S.source_bucket(F.col("source_category")) == source)
    if focus:
        wanted = S.resolve_focus(F.lit(focus), F.lit(focus), F.lit(""))
        rows = rows.where(S.resolve_focus(F.col("focus_category"), F.coalesce("scoring_category", "category"), text).eqNullSafe(wanted))
    if category:
        rows = rows.where((F.col("category") == category) | (S.display_category(F.col("category")) == S.display_category(F.lit(category))))
    if tag:
        rows = rows.where(F.exists(F.coalesce("tags", F.array()), lambda t: F.lower(F.trim(t)) == tag.strip().lower()))
    if topic:
        rows = rows.where(P.matches_topic(topic, F.col("topic_ids"), P.item_text(F.col("title"), F.col("one_line_summary"), F.col("tags"))))
    if q:
        rows = rows.where(contains_all_terms(F.concat_ws(" ", text, F.col("source_name")), q))
    return rows


def events(items: DataFrame, *, today: date, days: int = 30, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """The newest matching items of the last local days, one page."""
    _between("days", days, 1, 90)
    _between("limit", limit, 1, 200)
    _between("offset", offset, 0, 2**31 - 1)
    low, high = day_bounds(today - timedelta(days=days - 1), today)
    rows = items.where((F.col("published_at") >= F.lit(low)) & (F.col("published_at") < F.lit(high)))
    return rank.page(matching(rows, **filters), [F.desc("published_at"), "event_id"], limit=limit, offset=offset)


def page_facts(items: DataFrame, **filters) -> DataFrame:
    """Number and newest time of all matching items."""
    return matching(items, **filters).agg(F.count(F.lit(1)).alias("total"), F.max("published_at").alias("updated_at"))


def latest(items: DataFrame, *, today: date, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """Main items of selected events with the event's own facts."""
    rows = items.where("is_main and coalesce(event_selected, status = 'processed')")
    rows = rows.withColumn("final_score", F.coalesce("event_final_score", "final_score"))
    low, high = day_bounds(today - timedelta(days=6), today)
    rows = matching(rows.where((F.col("published_at") >= F.lit(low)) & (F.col("published_at") < F.lit(high))), **filters)
    order = [F.desc("published_at"), F.desc("final_score"), F.desc("source_count"), "event_id"]
    return rank.page(rows, order, limit=_between("limit", limit, 1, 200), offset=_between("offset", offset, 0, 2**31 - 1))


def hotspots(items: DataFrame, reports: DataFrame, *, now: datetime, hours: int = 48, limit: int = 5, **filters) -> DataFrame:
    """The board of the window that ends at ``now``."""
    start = window_start(now, _between("hours", hours, 1, 24 * 30))
    seen = F.coalesce("last_seen_at", "published_at")
    able = matching(items.where("is_main and not coalesce(hidden, false)"), **filters).where(seen >= F.lit(start))
    counts = views.window_coverage(reports, start, now)
    return views.hotspot_board(able.join(counts, "event_id"), _between("limit", limit, 1, 50))


def event(items: DataFrame, event_id: str) -> DataFrame:
    return items.where(F.col("event_id") == event_id)


def period(reports: DataFrame, kind: str, key: str) -> DataFrame:
    """One stored report; the key is checked against the calendar."""
    period_range(kind, key)
    return reports.where((F.col("kind") == kind) & (F.col("period_key") == key))


def archive(reports: DataFrame, kind: str, limit: int = 24) -> DataFrame:
    return reports.where(F.col("kind") == kind).orderBy(F.desc("period_key")).limit(limit)
