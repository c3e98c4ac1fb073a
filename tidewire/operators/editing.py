"""Editorial records: the audit of tag overrides; runs and their state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAGS = "array<string>"


def audit_tag_overrides(requested: DataFrame, processed: DataFrame, overrides: DataFrame, submissions: DataFrame) -> DataFrame:
    """(article_id, submission_id, tags, status): may an empty override of tags be lifted?

    The first reason that holds is the status; the article's latest submission
    (of equals the greatest id) tells where its tags came from.  ``processed``:
    article_id, tags; ``overrides``: article_id, tags; ``submissions``:
    submission_id, article_id, created_at, field_provenance, manual_fields (JSON).
    """
    latest = submissions.groupBy("article_id").agg(F.max_by(
        F.struct("submission_id", "field_provenance", "manual_fields"), F.struct("created_at", "submission_id")).alias("s"))
    there = F.lit(True)
    rows = requested.select("article_id").distinct().join(
        processed.select("article_id", F.coalesce("tags", F.array().cast(TAGS)).alias("tags"), there.alias("_p")), "article_id", "left").join(
        overrides.select("article_id", F.col("tags").alias("_own"), there.alias("_o")), "article_id", "left").join(
        latest.select("article_id", "s", there.alias("_s")), "article_id", "left")
    manual = F.get_json_object("s.manual_fields", "$.tags")
    status = (
        F.when(F.col("_p").isNull() | F.col("_o").isNull() | F.col("_s").isNull(), "unexpected_missing_record")
        .when(F.col("_own").isNull(), "already_repaired")
        .when(F.size("_own") > 0, "unexpected_nonempty_override")
        .when(F.size("tags") == 0, "unexpected_empty_ai_tags")
        .when(~F.get_json_object("s.field_provenance", "$.tags").eqNullSafe(F.lit("ai")), "unexpected_non_ai_provenance")
        .when(manual.isNotNull() & (manual != "[]"), "unexpected_manual_tags")
        .otherwise("eligible"))
    return rows.select("article_id", F.col("s.submission_id").alias("submission_id"), F.coalesce("tags", F.array().cast(TAGS)).alias("tags"), status.alias("status"))


def start_runs(runs: DataFrame, started: DataFrame) -> DataFrame:
    """``runs`` with new rows that are running: id, started_at, phase."""
    return runs.unionByName(started.withColumn("status", F.lit("running")), allowMissingColumns=True).select(*runs.columns)


def progress_runs(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """What running runs report on their way: id, phase, raw_count.  What an
    update leaves out stays; runs that ended are not touched."""
    new = updates.select("id", F.col("phase").alias("_phase"), F.col("raw_count").alias("_raw"))
    on = F.col("status") == "running"
    return runs.join(new, "id", "left").withColumn("phase", F.when(on, F.coalesce("_phase", "phase")).otherwise(F.col("phase"))).withColumn(
        "raw_count", F.when(on, F.coalesce("_raw", "raw_count")).otherwise(F.col("raw_count"))).select(*runs.columns)


def finish_runs(runs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Final state and counts of runs: id, status, finished_at (null: ``now``), error
    and any of the count columns."""
    fields = [c for c in results.columns if c != "id"]
    new = results.select("id", F.lit(True).alias("_ended"), *[F.col(c).alias(f"_{c}") for c in fields])
    value = lambda c: F.coalesce("_finished_at", now) if c == "finished_at" else F.col(f"_{c}")
    return runs.join(new, "id", "left").select(*[
        F.when(F.col("_ended"), value(c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in runs.columns])
