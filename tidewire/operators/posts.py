"""Posts of a mirrored timeline: eligibility, search, translation, articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import cjk_ratio, contains_all_terms, short_hash, stable_hash

ACCOUNT_BUCKET = "x_accounts"
TOPIC_BUCKET = "x_topics"


def pipeline_source(kind: Column, subscribed: Column, topics: Column) -> Column:
    """Originals of subscribed handles go to the accounts, others by topic, else null."""
    return F.when(kind == "original", F.when(subscribed, F.lit(ACCOUNT_BUCKET)).when(F.size(F.coalesce(topics, F.array())) > 0, F.lit(TOPIC_BUCKET)))


def with_eligibility(posts: DataFrame, handles: DataFrame) -> DataFrame:
    """``handles``: the configured list of subscribed handles."""
    known = handles.select(F.lower("handle").alias("_handle"), F.lit(True).alias("_known")).distinct()
    rows = posts.join(known, F.lower("author_handle") == F.col("_handle"), "left")
    bucket = pipeline_source(F.col("tweet_type"), F.coalesce("_known", F.lit(False)), F.col("topics"))
    return rows.withColumn("pipeline_source_id", bucket).drop("_handle", "_known")


def content_hash(posts: DataFrame) -> Column:
    """Hash of what a post says; engagement counters never change it."""
    fields = [c for c in ("author_handle", "created_at", "text", "tweet_type", "urls") if c in posts.columns]
    return stable_hash(F.to_json(F.struct(*sorted(fields))))


def translation_hash(text: Column, quoted: Column) -> Column:
    return short_hash(F.concat(F.coalesce(text, F.lit("")), F.lit("\u0000"), F.coalesce(quoted, F.lit(""))))


def needs_translation(posts: DataFrame, *, limit: int = 30, most_cjk: float = 0.3) -> DataFrame:
    """The newest posts whose stored translation is of another text."""
    fresh = ~F.col("source_hash").eqNullSafe(F.col("translated_hash"))
    return posts.where(fresh & (cjk_ratio(F.col("text")) <= most_cjk)).orderBy(F.desc("created_at"), F.desc("tweet_id")).limit(limit)


def search(posts: DataFrame, *, kind=None, handle=None, topic=None, q=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Filtered posts, the newest first."""
    rows = posts
    if kind:
        rows = rows.where(F.col("content_kind") == kind)
    if handle:
        rows = rows.where(F.lower("author_handle") == handle.lower().lstrip("@"))
    if topic:
        rows = rows.where(F.array_contains("topics", topic))
    if q:
        rows = rows.where(contains_all_terms(F.concat_ws(" ", "author_handle", "text", F.array_join("topics", " ")), q))
    return rows.orderBy(F.desc("created_at"), F.desc("tweet_id")).offset(offset).limit(limit)


def topic_names(posts: DataFrame) -> DataFrame:
    return posts.select(F.explode("topics").alias("topic")).where("trim(topic) <> ''").distinct().orderBy("topic")


def high_water(posts: DataFrame, by: str = "author_handle") -> DataFrame:
    return posts.groupBy(by).agg(F.max("created_at").alias("latest"))


def as_articles(posts: DataFrame) -> DataFrame:
    """Eligible posts as article rows."""
    plain = F.regexp_replace(F.regexp_replace("text", r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[*_`#>]+", "")
    return posts.where("pipeline_source_id is not null").select(
        F.concat(F.lit("https://x.com/"), "author_handle", F.lit("/status/"), "tweet_id").alias("source_url"),
        F.col("pipeline_source_id").alias("source_id"), F.substring(plain, 1, 120).alias("title"), plain.alias("content"),
        F.col("author_handle").alias("handle"), F.col("created_at").alias("published_at"))


def merge_mirror(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Payloads are replaced; eligibility is frozen when a post first arrives."""
    from tidewire.operators.upsert import frozen_once, upsert

    complete = incoming.where("tweet_id is not null and author_handle is not null and created_at is not null")
    rules = {c: frozen_once(c) for c in ("pipeline_source_id", "first_synced_at") if c in stored.columns}
    return upsert(stored, complete, "tweet_id", rules)
