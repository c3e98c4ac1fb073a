"""Daily and period reports: bodies, digests, inputs, status."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.scoring import FOCUS_LABELS
from tidewire.functions.text import stable_hash

INPUT_ITEMS = 80
INPUT_CHARACTERS = 12000


def selected_clusters(clusters: DataFrame, members: DataFrame, report_date: date, top: int) -> DataFrame:
    """Events last seen on the local day with a selected member, best first."""
    from tidewire.functions.time import local_day

    chosen = members.where("status = 'processed'").select("event_id").distinct()
    rows = clusters.join(chosen, "event_id", "left_semi").where(local_day(F.col("last_seen_at")) == F.lit(report_date))
    return rows.orderBy(F.desc("final_score"), F.desc("source_count"), F.desc("last_seen_at"), "event_id").limit(top)


def sections(items: DataFrame) -> DataFrame:
    """Items grouped by focus in the fixed order; empty groups are absent."""
    names = list(FOCUS_LABELS)
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("focus"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("slot", "event_id"))), lambda s: s.event_id)
    return items.where(F.col("focus").isin(names)).groupBy("focus").agg(rows.alias("event_ids")).withColumn("place", order)


def resolved_entries(entries: DataFrame, items: DataFrame) -> DataFrame:
    """Report entries with live items; the reason at selection time wins."""
    live = items.drop("reason") if "reason_snapshot" in entries.columns else items
    return entries.join(live, "event_id").withColumn("reason", F.col("reason_snapshot")).drop("reason_snapshot").orderBy("position")


def budgeted_input(items: DataFrame, *, key: str, most: int = INPUT_ITEMS, characters: int = INPUT_CHARACTERS) -> DataFrame:
    """Leading items whose JSON fits the budget; the first always stays."""
    order = Window.partitionBy(key).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    size = F.sum(F.length(F.to_json(F.struct("event_id", "title"))) + 1).over(order)
    return items.withColumn("_size", size).where((F.col("slot") <= most) & ((F.col("_size") <= characters) | (F.col("slot") == 1))).drop("_size")


def input_digest(items: DataFrame, key: str) -> DataFrame:
    """Digest of a report's input: the same items in the same order agree."""
    rows = F.array_sort(F.collect_list(F.struct("slot", "event_id", "title")))
    return items.groupBy(key).agg(stable_hash(F.to_json(rows)).alias("digest"))


def report_status(*, items: int, answered: bool, attempted: bool, complete: bool, previous: str | None) -> str:
    """Where a report stands after one attempt to write it."""
    if items == 0:
        return "empty"
    if answered:
        return "generated" if complete else "partial"
    if previous in ("generated", "stale"):
        return "stale"
    return "fallback" if attempted else "pending"


def touched_periods(since: date, until: date) -> list[tuple[str, str]]:
    """All (kind, key) with a day in [since, until)."""
    found: dict[tuple[str, str], None] = {}
    day = since
    while day < until:
        iso = day.isocalendar()
        found[("weekly", f"{iso[0]}-W{iso[1]:02d}")] = None
        found[("monthly", f"{day:%Y-%m}")] = None
        day += timedelta(days=1)
    return list(found)


def entries_snapshot(roster: DataFrame) -> DataFrame:
    """What a period report stores: ids, order, score and days."""
    return roster.select("slot", "event_id", F.col("final_score").alias("score_at_selection"), "days_covered")


def entry_positions(entries: DataFrame, redirects: DataFrame) -> DataFrame:
    """Entries under their live ids; the first of a merged event keeps the slot."""
    moved = entries.join(redirects.select(F.col("source_id").alias("event_id"), "target_id"), "event_id", "left")
    moved = moved.withColumn("event_id", F.coalesce("target_id", "event_id")).drop("target_id")
    order = Window.partitionBy("report_date").orderBy("position")
    first = moved.groupBy("report_date", "event_id").agg(F.min("position").alias("position"))
    return first.withColumn("position", F.row_number().over(order) - 1)
