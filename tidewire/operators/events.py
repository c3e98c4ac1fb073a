"""Upkeep of events: reconcile, fold, recluster, delete, recount."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.views import ROLE_RANK, TIER_RANK, ranked


def span_fits(first: Column, last: Column, other_first: Column, other_last: Column, hours: float) -> Column:
    """Whether two events together last no longer than ``hours``."""
    micros = F.unix_micros(F.greatest(last, other_last)) - F.unix_micros(F.least(first, other_first))
    return micros <= F.lit(int(hours * 3600 * 10**6))


def keep_rank() -> Column:
    """What decides which of several events the others fold into."""
    return F.struct(F.col("can_be_main").cast("int").alias("lead"), ranked(F.col("role"), ROLE_RANK).alias("role"),
                    ranked(F.col("tier"), TIER_RANK).alias("tier"), "final_score", "source_count", "last_seen_at", "event_id")


def reconcile(events: DataFrame, citations: DataFrame, *, since: datetime, span_hours: float | None = None) -> DataFrame:
    """(source_id, target_id): recent events that cite a source together.

    ``events``: event_id, first_seen_at, last_seen_at and the rank columns;
    ``citations``: event_id, key.  Per key the best event is the target, so a
    key that very many events cite is one partial aggregate and one row to
    join; an event that several keys send away takes the best target.  A
    target may be sent on itself: ``graph.follow_redirects`` gives the ends.
    """
    live = events.where(F.col("last_seen_at") >= F.lit(since)).withColumn("rank", keep_rank())
    cited = citations.select("event_id", "key").distinct().join(
        live.select("event_id", "first_seen_at", "last_seen_at", "rank"), "event_id")
    best = cited.groupBy("key").agg(F.max_by(
        F.struct(F.col("event_id").alias("target_id"), F.col("first_seen_at").alias("lo"), F.col("last_seen_at").alias("hi"),
                 F.col("rank").alias("target_rank")), "rank").alias("best")).select("key", "best.*")
    links = cited.join(best, "key").where(F.col("event_id") != F.col("target_id"))
    if span_hours is not None:
        links = links.where(span_fits(F.col("first_seen_at"), F.col("last_seen_at"), F.col("lo"), F.col("hi"), span_hours))
    return links.groupBy(F.col("event_id").alias("source_id")).agg(F.max_by("target_id", "target_rank").alias("target_id"))


def event_facts(members: DataFrame) -> DataFrame:
    """Sources, span and score of each event from its members."""
    return members.groupBy("event_id").agg(
        F.count_distinct("source_id").alias("source_count"), F.min("published_at").alias("first_seen_at"),
        F.max("published_at").alias("last_seen_at"), F.max("final_score").alias("final_score"),
        F.count_distinct("article_id").alias("members"))


def apply_merges(members: DataFrame, redirects: DataFrame) -> DataFrame:
    """Facts of the events that are left when members follow the redirects."""
    to = redirects.select(F.col("source_id").alias("event_id"), "target_id")
    moved = members.join(to, "event_id", "left").withColumn("event_id", F.coalesce("target_id", "event_id"))
    return event_facts(moved)


def recluster_plan(before: DataFrame, after: DataFrame) -> DataFrame:
    """New events that hold members of several old ones: what would merge.

    ``before``, ``after``: event_id, article_id.  The old events of a new one
    come as a sorted list; the members of neither are collected.
    """
    pairs = after.select(F.col("event_id").alias("new_id"), "article_id").join(
        before.select(F.col("event_id").alias("old_id"), "article_id"), "article_id").select("new_id", "old_id").distinct()
    return pairs.groupBy("new_id").agg(F.array_sort(F.collect_list("old_id")).alias("old_ids")).where(F.size("old_ids") > 1)


def recount_drift(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Events whose stored source count is not the number of raw source ids."""
    counts = members.groupBy("event_id").agg(F.count_distinct("source_id").alias("found"))
    return clusters.join(counts, "event_id", "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long"))).where(
        ~F.col("source_count").eqNullSafe(F.col("found"))).select("event_id", "source_count", "found")


def cache_link_drift(cached: DataFrame, membership: DataFrame) -> DataFrame:
    """Articles whose cached event is not the one that membership gives.

    The event where an article is main wins; else the one it joined last.
    ``cached``: article_id, event_id; ``membership``: article_id, event_id, is_main, joined_at, id.
    """
    chosen = membership.groupBy("article_id").agg(
        F.max_by("event_id", F.struct(F.col("is_main").cast("int").alias("m"), "joined_at", "id")).alias("chosen"))
    return cached.join(chosen, "article_id").where(~F.col("event_id").eqNullSafe(F.col("chosen"))).select(
        "article_id", F.col("event_id").alias("cached_id"), "chosen")


def after_delete(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Events that survive the deletion of articles, with main and source count.

    The main stays where it is left; else the member published last leads.
    ``members``: event_id, article_id, is_main, source_id, published_at.
    """
    left = members.join(gone.select("article_id").distinct(), "article_id", "left_anti")
    return left.groupBy("event_id").agg(
        F.max_by("article_id", F.struct(F.col("is_main").cast("int").alias("m"), "published_at", "article_id")).alias("main_article_id"),
        F.count_distinct("source_id").alias("source_count"))


def purge(members: DataFrame, digests: DataFrame) -> DataFrame:
    """Events without digest articles: best survivor as main, members counted.

    The count is of members, not of sources: that is the rule of this repair.
    """
    left = members.join(digests.select("article_id").distinct(), "article_id", "left_anti")
    return left.groupBy("event_id").agg(
        F.max_by("article_id", F.struct("final_score", "published_at", "article_id")).alias("main_article_id"),
        F.count(F.lit(1)).alias("source_count"))


def delete_articles(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after articles go: dependent rows drop, submissions return to draft.

    ``tables``: articles, membership, clusters, and any others with article_id;
    ``submissions`` keep their rows.  Events without members drop, and so do
    redirects to them and their overrides.
    """
    gone = gone.select("article_id").distinct()
    out = {}
    for name, df in tables.items():
        if name == "submissions":
            hit = df.join(gone.withColumn("_gone", F.lit(True)), "article_id", "left")
            was = F.col("_gone").isNotNull()
            out[name] = hit.select(*[
                F.when(was, F.lit("draft")).otherwise(F.col(c)).alias(c) if c == "publication_status"
                else F.when(~was, F.col(c)).alias(c) if c in ("article_id", "published_at") else F.col(c) for c in df.columns])
        elif "article_id" in df.columns:
            out[name] = df.join(gone, "article_id", "left_anti").select(*df.columns)
        else:
            out[name] = df
    facts = after_delete(tables["membership"], gone)
    kept = facts.select("event_id")
    out["clusters"] = out["clusters"].drop("main_article_id", "source_count").join(facts, "event_id")
    if "redirects" in out:
        out["redirects"] = out["redirects"].join(kept.withColumnRenamed("event_id", "target_id"), "target_id", "left_semi")
    if "event_overrides" in out:
        out["event_overrides"] = out["event_overrides"].join(kept, "event_id", "left_semi")
    return out
