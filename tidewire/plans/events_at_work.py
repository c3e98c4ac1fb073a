"""Queries of events at work: verdicts, upserts in a stream, merges in order."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import cluster, event_store
from tidewire.plans import bindings as B
from tidewire.plans.registry import query
from tidewire.session import checkpoint_folder, table
from tidewire.streaming import event_stream

THRESHOLD, WINDOW = 0.5, 72
BATCHES = 3


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("vec_id").cast("long")
    return table(spark, sf, "embeddings").select(
        i.alias("article_id"), F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, vec_id * 37)").alias("published_at"),
        F.concat(F.lit("s"), i % 7).alias("source_key"), F.when(i % 8 == 0, F.array(F.concat(F.lit("k"), F.floor(i / 8) % 25))).alias("keys"),
        F.col("embedding").cast("array<double>").alias("vec"), "label")


def articles_of(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("article_id")
    return _vectors(spark, sf).drop("label").select(
        "*", (i % 3 > 0).alias("can_be_main"), F.when(i % 3 == 0, "authority").when(i % 3 == 1, "signal").otherwise("aggregator").alias("role"),
        F.concat(F.lit("T"), i % 3 + 1).alias("tier"))


def groups_of(spark: SparkSession, sf: str) -> DataFrame:
    """Two neighbours each, every fifth with an older article; every seventeenth comes late."""
    a = _vectors(spark, sf).select("article_id", "published_at")
    g = F.floor(F.col("article_id") / 2)
    own = a.select(g.alias("g"), "article_id", "published_at")
    older = a.select((F.floor(F.col("article_id") / 2) + 10).alias("g"), "article_id", "published_at").where("g % 5 = 0 and article_id % 2 = 0")
    older = older.join(own.select("g").distinct(), "g", "left_semi")
    rows = own.unionByName(older).groupBy("g").agg(
        F.min("published_at").alias("first_seen_at"), F.max("published_at").alias("last_seen_at"), F.count(F.lit(1)).alias("source_count"),
        F.array_sort(F.collect_list(F.struct("article_id", F.lit(0.9).cast("double").alias("similarity")))).alias("articles"))
    most = own.agg(F.max("g")).first()[0] or 0  # one number
    batch = F.when(F.col("g") % 17 == 3, F.lit(BATCHES - 1)).otherwise(F.floor(F.col("g") * BATCHES / (most + 1))).cast("int")
    return rows.select(
        F.concat(F.lit("g"), F.lpad(F.col("g").cast("string"), 9, "0")).alias("group_id"), F.col("g").cast("long").alias("ord"), (F.col("g") * 2).cast("long").alias("main_article_id"),
        F.concat(F.lit("t"), "g").alias("title"), F.lit("").alias("summary"), (F.col("g") % 5).cast("double").alias("final_score"), "source_count",
        "first_seen_at", "last_seen_at", "articles", batch.alias("batch"))


@query("stored_events")
def stored_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events that a stream of groups leaves after three triggers."""
    folder = f"{checkpoint_folder(spark)}/stored-events-{uuid.uuid4().hex}"
    groups = groups_of(spark, sf)
    facts = event_store.article_facts(articles_of(spark, sf))
    for n in range(BATCHES):  # the stream goes on when a batch has come, whatever its files
        groups.where(F.col("batch") == n).drop("batch").write.mode("append").parquet(f"{folder}/groups")
        stream = spark.readStream.schema(groups.drop("batch").schema).parquet(f"{folder}/groups")
        event_stream.take_groups(stream, f"{folder}/events", f"{folder}/checkpoint", facts, threshold=THRESHOLD, window_hours=WINDOW).awaitTermination()
    return event_stream.stored_events(spark, f"{folder}/events").select(
        "event_id", "main_article_id", "title", "final_score", "source_count", F.unix_micros("first_seen_at").alias("first_seen_at"),
        F.unix_micros("last_seen_at").alias("last_seen_at"), F.array_join(F.transform("members", lambda m: m.article_id.cast("string")), ",").alias("members"))


def reports_of(spark: SparkSession, sf: str) -> DataFrame:
    """Articles that lean to the first of four neighbours; every eighth cites a source with the next but seven."""
    v = _vectors(spark, sf).drop("label", "keys")
    i = F.col("article_id")
    lead = v.select(i.alias("lead"), F.col("vec").alias("leading"))
    rows = v.withColumn("lead", i - i % 4).join(lead, "lead")
    vec = F.zip_with("vec", "leading", lambda x, y: x * 0.6 + y)
    return rows.select("article_id", F.col("published_at").alias("ts"), vec.alias("vec"), F.when(i % 8 == 0, F.array(F.concat(F.lit("k"), F.floor(i / 16)))).alias("keys"))


@query("verified_clusters")
def verified_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Articles in order, with verdicts on most pairs of a day."""
    v = reports_of(spark, sf)
    rows = v.select("article_id", "ts", F.col("article_id").alias("ord"), "vec", "keys", F.lit(True).alias("can_be_main"), F.lit("signal").alias("role"),
                    F.lit("T1").alias("tier"), F.lit(1.0).alias("final_score"), F.lit(1).alias("content_length"))
    pairs = v.select(F.col("article_id").alias("low_id"), F.explode(F.sequence(F.col("article_id") + 1, F.col("article_id") + 38)).alias("high_id"))
    return cluster.cluster_articles(rows, threshold=0.9, span_hours=24, verdicts=pairs.withColumn("same", (F.col("low_id") + F.col("high_id")) % 5 > 0))


@query("merges_in_order")
def merges_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Events that cite a source together fold into the best while their joint span allows."""
    e = F.col("event_id")
    sources = B.membership(spark, sf).groupBy("event_id").agg(F.array_sort(F.collect_set("source_id")).alias("sources"))
    rows = B.clusters(spark, sf).join(sources, "event_id").select(
        "event_id", "first_seen_at", "last_seen_at", F.col("final_score").cast("double").alias("final_score"), "sources", (e % 2 == 0).alias("can_be_main"),
        F.when(e % 3 == 0, "authority").when(e % 3 == 1, "signal").otherwise("aggregator").alias("role"), F.concat(F.lit("T"), e % 3 + 1).alias("tier"))
    cited = rows.select("event_id", F.explode(F.array(F.floor(e / 6), F.floor(e / 10) + 10**9)).alias("key"))
    return event_store.merge_order(rows, cited, since=F.lit(datetime(1994, 1, 1)), span_hours=500 * 24)
