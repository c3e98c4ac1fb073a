"""Ranking, rosters and period reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.positions import with_positions

# Sizes of the rosters.
WEEKLY_FILL = 40
WEEKLY_FLOOR = 2
MONTHLY_MOST = 25
MONTHLY_LEAST = 10
#: Models up to which their sizes are broadcast; joined by key the items of a model would meet in one task.
MOST_MODELS = 100_000


def model_rank(items: DataFrame) -> DataFrame:
    """Rank of each item within its scoring model, and its place over all.

    Scores compare within a model alone, so the key across models is rank over
    group size; then the score, then the event id.  Both places come from
    ranges of the order, so neither a model nor the table has to fit a task.
    """
    score = F.coalesce("final_score", F.lit(0))
    model = F.coalesce("model_used", F.lit(""))
    placed = with_positions(items, [model.asc(), score.desc(), F.col("ord").asc()], "_rank_at")
    sizes = placed.groupBy(model.alias("_model")).agg(F.min("_rank_at").alias("_rank_lo"), F.count(F.lit(1)).alias("_rank_n"))
    rows = (
        placed.join(F.broadcast(sizes) if sizes.count() <= MOST_MODELS else sizes, model == F.col("_model"))
        .withColumn("model_rank", F.col("_rank_at") - F.col("_rank_lo") + 1)
        .withColumn("rank_key", F.col("model_rank") / F.col("_rank_n")).drop("_rank_at", "_model", "_rank_lo", "_rank_n")
    )
    return with_positions(rows, [F.col("rank_key").asc(), score.desc(), F.col("event_id").asc()], "position")


def weekly_roster(items: DataFrame, *, fill: int = WEEKLY_FILL, floor: int = WEEKLY_FLOOR) -> DataFrame:
    """All multi-source events, a floor for each category, then fill by rank.

    ``items``: event_id, model_used, final_score, source_count, days_covered,
    category, ord.  Multi-source events are never cut.
    """
    rows = model_rank(items.where("event_id is not null")).withColumn("multi", F.col("source_count") > 1)
    multi, single = rows.where("multi"), rows.where("not multi")
    order = [F.desc("days_covered"), F.col("position").asc()]
    counts = multi.groupBy(F.col("category").alias("_c")).agg(F.count(F.lit(1)).alias("_m"))
    lead = single.withColumn("_nth", F.row_number().over(Window.partitionBy("category").orderBy(*order))).where(F.col("_nth") <= floor)
    lead = lead.join(counts, F.col("category").eqNullSafe(F.col("_c")), "left").where(
        F.col("_nth") <= F.lit(floor) - F.coalesce("_m", F.lit(0))).drop("_nth", "_c", "_m")
    kept = multi.unionByName(lead)
    left = max(0, fill - kept.count())
    more = single.join(lead.select("event_id"), "event_id", "left_anti").orderBy(*order).limit(left).select(*rows.columns)
    return with_positions(kept.unionByName(more), [F.desc("multi"), *order], "slot")


def monthly_roster(items: DataFrame, *, most: int = MONTHLY_MOST, least: int = MONTHLY_LEAST) -> DataFrame:
    """Events of several sources or days, at most ``most``; filled up to ``least``."""
    rows = model_rank(items.where("event_id is not null")).withColumn("multi", F.col("source_count") > 1)
    able = F.col("multi") | (F.col("days_covered") >= 2)
    order = [F.desc("multi"), F.desc("days_covered"), F.col("position").asc()]
    chosen = rows.where(able).orderBy(*order).limit(most).withColumn("_in", F.lit(True))
    left = max(0, least - chosen.count())
    more = rows.where(~F.coalesce(able, F.lit(False))).orderBy("position").limit(left).withColumn("_in", F.lit(False))
    own = [F.desc("_in"), *[F.when(F.col("_in"), c).desc() for c in (F.col("multi"), F.col("days_covered"))], F.col("position").asc()]
    slots = Window.orderBy(*own)  # at most ``most`` or ``least`` rows
    return chosen.unionByName(more).withColumn("slot", F.row_number().over(slots)).drop("_in")


def daily_order(items: DataFrame) -> DataFrame:
    """Several sources first, then score, then event id."""
    order = Window.partitionBy("report_date").orderBy((F.col("source_count") > 1).desc(), F.desc("final_score"), "event_id")
    return items.withColumn("slot", F.row_number().over(order))


def merge_dailies(items: DataFrame) -> DataFrame:
    """One row for each event: its copy in the last report, and its days."""
    names = [c for c in items.columns if c not in ("event_id", "report_date", "pos")]
    return (
        items.where("event_id is not null").groupBy("event_id")
        .agg(F.max_by(F.struct(*names, "report_date"), F.struct("report_date", "pos")).alias("_last"),
             F.count_distinct("report_date").alias("days_covered"))
        .select("event_id", *[F.col(f"_last.{n}").alias(n) for n in names],
                F.col("_last.report_date").alias("last_report_date"), "days_covered")
    )


def period_stats(items: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Sources covered, share of multi-source events, number of items."""
    return items.groupBy(*keys).agg(
        F.count_distinct("source_id").alias("source_coverage_count"),
        F.count_if(F.col("source_count") > 1).alias("multi_source_count"),
        F.count(F.lit(1)).alias("coverage_count"),
    ).withColumn("multi_source_ratio", F.when(F.col("coverage_count") > 0, F.col("multi_source_count") / F.col("coverage_count")).otherwise(0.0))


def storylines(clusters: DataFrame, *, limit: int = 5) -> DataFrame:
    """Events reported on two or more local days: sources, days, last day."""
    from tidewire.functions.time import local_day

    days = F.datediff(local_day(F.col("last_seen_at")), local_day(F.col("first_seen_at"))) + 1
    return (
        clusters.withColumn("days", days).withColumn("last_day", local_day(F.col("last_seen_at"))).where("days >= 2")
        .orderBy(F.desc("source_count"), F.desc("days"), F.desc("last_day"), "event_id").limit(limit)
        .select("event_id", "source_count", "days", "last_day")
    )


def sitemap(items: DataFrame) -> DataFrame:
    """One entry for each visible main event with a title and a summary."""
    good = "not hidden and is_main and event_id is not null and trim(coalesce(title, '')) <> '' and trim(coalesce(summary, '')) <> ''"
    return items.where(good).groupBy("event_id").agg(F.max("last_modified").alias("last_modified")).orderBy(F.desc("last_modified"), "event_id")


def page(items: DataFrame, order: list, *, limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order."""
    return items.orderBy(*order).offset(offset).limit(limit)


def topic_index(matches: DataFrame, topics: DataFrame, today: str) -> DataFrame:
    """Per topic: items, those of this and the week before, latest day; zeros kept."""
    day, last = F.col("day"), F.to_date(F.lit(today))
    counts = matches.groupBy("topic").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(day >= F.date_sub(last, 6)).alias("week_count"),
        F.count_if((day < F.date_sub(last, 6)) & (day >= F.date_sub(last, 13))).alias("prev_week_count"),
        F.max("day").alias("latest"),
    )
    zero = F.lit(0).cast("long")
    return topics.join(counts, "topic", "left").select(
        "topic", *[F.coalesce(c, zero).alias(c) for c in ("count", "week_count", "prev_week_count")], "latest"
    )
