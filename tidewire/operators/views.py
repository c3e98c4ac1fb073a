"""The joined event views: all events, selected events, coverage, items by id."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.time import day_bounds

# Ranks of source roles and tiers.
ROLE_RANK = {"authority": 4, "signal": 3, "context": 2, "aggregator": 1}
TIER_RANK = {"T1": 3, "T2": 2, "T3": 1}


def ranked(column: Column, table: dict[str, int]) -> Column:
    value = F.lit(0)
    for name, rank in table.items():
        value = F.when(column == name, F.lit(rank)).otherwise(value)
    return value


def cluster_id(main_article: Column) -> Column:
    return F.concat(F.lit("e"), F.substring(F.sha2(main_article.cast("string").cast("binary"), 256), 1, 12))


def evidence_key(source_id: Column, handle: Column) -> Column:
    """A post counts as its author, anything else as its source."""
    return F.when(handle.isNotNull() & (handle != ""), F.concat(F.lit("x:@"), F.lower(handle))).otherwise(source_id)


def all_events(
    processed: DataFrame, raw: DataFrame, sources: DataFrame, overrides: DataFrame, event_overrides: DataFrame,
    membership: DataFrame, clusters: DataFrame, start: date, end: date, *, include_hidden: bool = False,
    selected_only: bool = False,
) -> DataFrame:
    """One row for each processed article in the window of local days.

    Event facts come from the membership table; event-level overrides hold for
    the main article alone.  The two outer joins on membership are one join
    whose main side is a condition, and "an event with a selected member" is a
    semi-join set, not a correlated lookup.  Both start from the memberships
    of the window's articles and the events these meet.  With ``include_hidden``
    a column ``hidden`` marks the rows that are left out without it.
    """
    lower, upper = day_bounds(start, end)
    window = raw.where((F.col("published_at") >= F.lit(lower)) & (F.col("published_at") < F.lit(upper)))
    inside = membership.join(window.select("article_id"), "article_id", "left_semi")
    met = inside.select("event_id").distinct()
    chosen = (
        membership.join(met, "event_id", "left_semi").select("event_id", F.col("article_id").alias("_a"))
        .join(processed.where("status = 'processed'").select(F.col("article_id").alias("_a")), "_a")
        .select("event_id").distinct().withColumn("event_selected", F.lit(True))
    )
    events = clusters.select("event_id", F.col("source_count").alias("event_source_count"),
                             F.col("last_seen_at").alias("event_last_seen"), F.col("final_score").alias("event_score"))
    facts = (
        inside.select("article_id", "event_id", "is_main")
        .join(events, "event_id")
        .join(chosen, "event_id", "left")
        .join(event_overrides.select("event_id", F.col("hidden").alias("ev_hidden"), F.col("title").alias("ev_title"),
                                     F.col("tags").alias("ev_tags")), "event_id", "left")
    )
    own = overrides.select("article_id", F.col("hidden").alias("ov_hidden"), F.col("title").alias("ov_title"),
                           F.col("tags").alias("ov_tags"))
    rows = (
        processed.join(window, "article_id")
        .join(sources.withColumnRenamed("id", "source_id"), "source_id")
        .join(own, "article_id", "left")
        .join(facts, "article_id", "left")
    )
    main = F.coalesce("is_main", F.lit(False))
    event = lambda c: F.when(main, F.col(c))
    if selected_only:
        rows = rows.where(F.when(F.col("event_id").isNotNull(), F.coalesce("event_selected", F.lit(False)))
                          .otherwise(F.col("status") == "processed"))
    rows = rows.withColumn("hidden", F.coalesce("ov_hidden", F.lit(False)) | F.coalesce(event("ev_hidden"), F.lit(False)))
    if not include_hidden:
        rows = rows.where(~F.col("hidden"))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select(
        "article_id",
        F.when(main, F.col("event_id").cast("string")).otherwise(F.concat(F.lit("a"), F.substring(F.col("article_id").cast("string"), 1, 12))).alias("event_id"),
        F.coalesce(text(event("ev_title")), text(F.col("ov_title")), F.col("title")).alias("title"),
        F.coalesce(event("ev_tags"), F.col("ov_tags"), F.col("tags")).alias("tags"),
        "source_id",
        "final_score",
        "status",
        "published_at",
        (main | F.col("event_id").isNull()).alias("is_main"),
        F.coalesce("event_source_count", F.lit(1)).alias("source_count"),
        F.col("event_last_seen").alias("last_seen_at"),
        F.col("event_score").alias("event_final_score"),
        F.when(F.col("event_id").isNotNull(), F.coalesce("event_selected", F.lit(False))).alias("event_selected"),
        *(["hidden"] if include_hidden else []),
    )


def window_coverage(reports: DataFrame, since: datetime, until: datetime, *, ids: DataFrame | None = None) -> DataFrame:
    """Distinct reports and evidence sources of each event in [since, until]."""
    inside = reports.where((F.col("ts") >= F.lit(since)) & (F.col("ts") <= F.lit(until)))
    counts = inside.groupBy("event_id").agg(
        F.count_distinct("article_id").alias("window_report_count"),
        F.count_distinct("source_key").alias("window_source_count"),
    )
    if ids is None:
        return counts
    zero = F.lit(0).cast("long")
    return ids.select("event_id").distinct().join(counts, "event_id", "left").select(
        "event_id", F.coalesce("window_report_count", zero).alias("window_report_count"),
        F.coalesce("window_source_count", zero).alias("window_source_count"),
    )


def hotspot_board(items: DataFrame, limit: int = 5) -> DataFrame:
    """Events of two or more window sources first; then by the window's facts."""
    return items.orderBy(
        (F.col("window_source_count") >= 2).desc(), F.desc("window_report_count"), F.desc("window_source_count"),
        F.desc("final_score"), F.desc("last_seen_at"), "event_id",
    ).limit(limit)


def items_by_ids(items: DataFrame, requested: DataFrame) -> DataFrame:
    """Items in the order of ``requested`` (pos, id); repeated hits keep the first."""
    hits = requested.join(items, requested.id == items.event_id)
    first = hits.groupBy("event_id").agg(F.min("pos").alias("_pos"))
    return hits.join(first, "event_id").where("pos = _pos").drop("_pos", "id").orderBy("pos")


def choose_main(members: DataFrame) -> DataFrame:
    """The main article of each event: can lead, role, tier, score, time, length."""
    from tidewire.operators.graph import best_by

    rank = [F.col("can_be_main"), ranked(F.col("role"), ROLE_RANK), ranked(F.col("tier"), TIER_RANK),
            F.col("final_score"), F.col("published_at"), F.length("content"), -F.col("ord")]
    return best_by(members, "event_id", rank)


def coverage_list(membership: DataFrame, raw: DataFrame, overrides: DataFrame) -> DataFrame:
    """Visible members of each event, newest first within it."""
    from pyspark.sql import Window

    hidden = overrides.where("hidden").select("article_id")
    rows = membership.join(hidden, "article_id", "left_anti").join(raw, "article_id")
    order = Window.partitionBy("event_id").orderBy(F.desc("published_at"), "article_id")
    return rows.select("event_id", "article_id", "source_id", "published_at", "is_main",
                       F.row_number().over(order).alias("pos"))


def main_flag_drift(clusters: DataFrame, membership: DataFrame) -> DataFrame:
    """Events whose flagged members are not just their main article."""
    facts = membership.groupBy("event_id").agg(
        F.count_if("is_main").alias("flagged"), F.max(F.when(F.col("is_main"), F.col("article_id"))).alias("flag")
    )
    at = clusters.join(facts, "event_id", "left").join(
        membership.select("event_id", F.col("article_id").alias("main_article_id"), F.lit(True).alias("is_member")),
        ["event_id", "main_article_id"], "left",
    )
    flagged = F.coalesce("flagged", F.lit(0))
    good = (flagged == 1) & (F.col("flag") == F.col("main_article_id"))
    status = F.when(F.col("is_member").isNull(), "main_not_member").when(flagged == 0, "none_flagged").otherwise("wrong_flag")
    return at.where(~F.coalesce(good, F.lit(False))).select("event_id", "main_article_id", flagged.alias("flagged"), status.alias("drift"))
