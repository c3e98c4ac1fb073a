"""Queries of keyed records and of what needs repair."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import scoring as S
from tidewire.functions.time import local_day
from tidewire.operators import records
from tidewire.operators.upsert import upsert
from tidewire.plans import bindings as B
from tidewire.plans.registry import DAY, query
from tidewire.session import table


@query("upsert_sources", """SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.name ELSE n.name END AS name FROM
  (SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0) o FULL JOIN (SELECT s_suppkey AS id, 'new' || s_suppkey AS name FROM supplier WHERE s_suppkey % 3 = 0) n ON o.id = n.id""", bound=False)
def upsert_sources(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    stored = s.where(k % 2 == 0).select(k.alias("id"), F.col("s_name").alias("name"))
    return upsert(stored, s.where(k % 3 == 0).select(k.alias("id"), F.concat(F.lit("new"), k).alias("name")), "id")


@query("upsert_processed", """SELECT coalesce(n.id, o.id) AS article_id,
  CASE WHEN (o.origin = 'admin' AND o.status = 'processed') OR n.id IS NULL THEN o.origin ELSE n.origin END AS origin,
  CASE WHEN (o.origin = 'admin' AND o.status = 'processed') OR n.id IS NULL THEN o.status ELSE n.status END AS status,
  coalesce(n.event_id, o.event_id) AS event_id, coalesce(n.model_used, o.model_used) AS model_used
FROM (SELECT id, CASE WHEN id % 4 = 0 THEN 'admin' ELSE 'score' END AS origin, CASE WHEN id % 8 = 4 THEN 'skipped' ELSE 'processed' END AS status, id AS event_id, 'm1' AS model_used FROM articles WHERE id % 2 = 0) o
FULL JOIN (SELECT id, 'score' AS origin, 'skipped' AS status, CASE WHEN id % 5 = 0 THEN id + 1 END AS event_id, CASE WHEN id % 7 = 0 THEN 'm2' END AS model_used FROM articles WHERE id % 3 = 0) n ON o.id = n.id""")
def upsert_processed(spark: SparkSession, sf: str) -> DataFrame:
    a, i = B.articles(spark, sf), F.col("id")
    stored = a.where(i % 2 == 0).select(
        i.alias("article_id"), F.when(i % 4 == 0, "admin").otherwise("score").alias("origin"), F.when(i % 8 == 4, "skipped").otherwise("processed").alias("status"),
        i.alias("event_id"), F.lit("m1").alias("model_used"))
    incoming = a.where(i % 3 == 0).select(
        i.alias("article_id"), F.lit("score").alias("origin"), F.lit("skipped").alias("status"), F.when(i % 5 == 0, i + 1).alias("event_id"),
        F.when(i % 7 == 0, "m2").alias("model_used"))
    return records.upsert_processed(stored, incoming, ["origin", "status"])


@query("moderation", """SELECT coalesce(n.id, o.id) AS id, coalesce(n.title, o.title) AS title, len(coalesce(n.tags, o.tags)[1:5]) AS tags
FROM (SELECT id, 'old' AS title, ['a'] AS tags FROM articles WHERE id % 2 = 0) o
FULL JOIN (SELECT id, CASE WHEN id % 9 = 0 THEN 'new' END AS title, CASE WHEN id % 6 = 0 THEN ['a', 'b', 'c', 'd', 'e', 'f', 'g'] END AS tags FROM articles WHERE id % 3 = 0) n ON o.id = n.id""")
def moderation(spark: SparkSession, sf: str) -> DataFrame:
    a, i = B.articles(spark, sf), F.col("id")
    stored = a.where(i % 2 == 0).select("id", F.lit("old").alias("title"), F.array(F.lit("a")).alias("tags"))
    incoming = a.where(i % 3 == 0).select("id", F.when(i % 9 == 0, "new").alias("title"), F.when(i % 6 == 0, F.array(*map(F.lit, "abcdefg"))).alias("tags"))
    return records.moderate(stored, incoming, "id").select("id", "title", F.when(F.col("tags").isNotNull(), F.size("tags")).cast("long").alias("tags"))


@query("release_pick", """SELECT id AS article_id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'score' WHEN id % 2 = 0 THEN 'admin' ELSE 'score' END AS origin,
  CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN NULL ELSE 'why' END AS reason FROM articles""")
def release_pick(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    rows = B.articles(spark, sf).select(i.alias("article_id"), F.when(i % 2 == 0, "admin").otherwise("score").alias("origin"), F.lit("why").alias("reason"))
    return records.release_pick(rows, rows.where("article_id % 3 = 0"))


@query("deletable_sources", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0)", bound=False)
def deletable_sources(spark: SparkSession, sf: str) -> DataFrame:
    sources = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return records.deletable_sources(sources, table(spark, sf, "orders").where("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("source_id")))


@query("submissions_page", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40", bound=False)
def submissions_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("publication_status"), F.col("o_orderdate").alias("created_at"))
    return records.submissions_page(rows, "P", limit=40).select("id")


@query("changed_clusters", "SELECT event_id AS old_id, count(DISTINCT source_id) AS parts FROM membership WHERE article_id % 2 = 0 GROUP BY 1 HAVING count(DISTINCT source_id) > 1")
def changed_clusters(spark: SparkSession, sf: str) -> DataFrame:
    m = B.membership(spark, sf)
    return records.changed_clusters(m, m.where("article_id % 2 = 0").select(F.col("source_id").alias("event_id"), "article_id"))


@query("recent_pool", "SELECT m.event_id, article_id FROM membership m JOIN clusters c ON m.event_id = c.event_id AND c.last_seen_at >= TIMESTAMP '1996-01-01' AND c.source_count >= 3")
def recent_pool(spark: SparkSession, sf: str) -> DataFrame:
    return records.recent_pool(B.clusters(spark, sf), B.membership(spark, sf), since=datetime(1996, 1, 1), least_sources=3).select("event_id", "article_id")


@query("cached_results", """SELECT id AS article_id, CASE WHEN id % 3 = 0 THEN 'processed' WHEN id % 3 = 1 THEN 'skipped' END AS status, id % 4 = 0 AS has_vector, id % 5 = 0 AS has_translation
FROM articles WHERE id % 2 = 0""")
def cached_results(spark: SparkSession, sf: str) -> DataFrame:
    a, i = B.articles(spark, sf), F.col("id")
    raw = a.select(i.alias("article_id"), (i * 2).alias("url_hash"))
    done = a.where(i % 3 != 2).select(i.alias("article_id"), F.when(i % 3 == 0, "processed").otherwise("skipped").alias("status"), F.lit(None).cast("string").alias("skipped_reason"))
    own = a.select(i.alias("article_id"))
    out = records.cached_results(raw.where("article_id % 2 = 0"), raw, done, own.where("article_id % 4 = 0"), own.where("article_id % 5 = 0"))
    return out.select("article_id", "status", "has_vector", "has_translation")


@query("crawl_results", """, c AS (SELECT source_id, count(*) AS crawled, count(*) FILTER (id % 5 = 0) AS ingested, count(*) FILTER (id % 25 = 0) AS accepted FROM articles WHERE id % 3 = 0 GROUP BY 1)
SELECT s.id, coalesce(crawled, 0) AS crawled, coalesce(ingested, 0) AS ingested, coalesce(accepted, 0) AS accepted,
  CASE WHEN coalesce(ingested, 0) = 0 THEN 'duplicate' WHEN accepted > 0 THEN 'saved' ELSE 'rejected' END AS outcome FROM sources s LEFT JOIN c ON c.source_id = s.id WHERE tier <> 'T3'""")
def crawl_results(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    crawled = B.articles(spark, sf).where(i % 3 == 0).select("source_id", (i % 5 == 0).alias("is_new"), (i % 25 == 0).alias("accepted"))
    return records.crawl_results(B.sources(spark, sf).select("id", (F.col("tier") != "T3").alias("is_active")), crawled)


@query("window_names", "SELECT id, CASE WHEN d = 0 THEN 'all' WHEN d <= 1 THEN '24h' WHEN d <= 7 THEN '7d' WHEN d <= 30 THEN '30d' ELSE 'all' END AS name FROM (SELECT id, id % 40 AS d FROM articles)")
def window_names(spark: SparkSession, sf: str) -> DataFrame:
    return B.articles(spark, sf).select("id", records.window_name(F.col("id") % 40).alias("name"))


@query("focus_backfill", """SELECT focus, count(*) AS n FROM (SELECT CASE category WHEN 'model_release' THEN 'model' WHEN 'product_release' THEN 'product' WHEN 'research' THEN 'technology' WHEN 'industry' THEN 'industry'
  WHEN 'funding' THEN 'industry' WHEN 'tutorial' THEN 'tutorial' END AS focus FROM scored WHERE category NOT IN ('opinion', 'open_source')) GROUP BY 1""")
def focus_backfill(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.scored(spark, sf).where("category not in ('opinion', 'open_source')")
    return rows.groupBy(S.infer_focus(F.col("category"), F.col("title")).alias("focus")).agg(F.count(F.lit(1)).alias("n"))


@query("reprocess_scope", f"SELECT article_id FROM reports WHERE {DAY.format('ts')} IN (SELECT {DAY.format('ts')} FROM reports WHERE article_id % 1009 = 3)")
def reprocess_scope(spark: SparkSession, sf: str) -> DataFrame:
    return records.reprocess_scope(B.reports(spark, sf), F.col("article_id") % 1009 == 3, "ts").select("article_id")


@query("title_peers", """SELECT o.article_id, p.peer_id FROM (SELECT article_id, article_id % 400 AS h FROM reports WHERE article_id % 2 = 0) o
JOIN (SELECT article_id % 400 AS h, arg_min(article_id, (ts, article_id)) AS peer_id FROM reports WHERE article_id % 3 = 0 GROUP BY 1) p USING (h) WHERE o.article_id <> p.peer_id""")
def title_peers(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.reports(spark, sf).select("article_id", (F.col("article_id") % 400).alias("title_hash"), F.col("ts").alias("published_at"))
    return records.title_peers(rows.where("article_id % 2 = 0"), rows.where("article_id % 3 = 0"))


@query("outdated_extractions", "SELECT id AS article_id FROM articles WHERE id % 3 <> 0 AND coalesce(CASE WHEN id % 4 <> 0 THEN id % 7 END, 0) < CASE WHEN source_id LIKE '%1' THEN 5 ELSE 2 END AND id > 50 ORDER BY id LIMIT 100")
def outdated_extractions(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    rows = B.articles(spark, sf).select(i.alias("article_id"), (i % 3 != 0).alias("full_page"), F.when(i % 4 != 0, i % 7).alias("extractor"), "source_id")
    return records.outdated(rows, F.when(F.col("source_id").endswith("1"), 5).otherwise(2), after=50, limit=100).select("article_id")


@query("cleared_errors", "SELECT id AS article_id, CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN NULL WHEN id % 2 = 0 THEN 'embedding_failed' ELSE 'other' END AS error FROM articles")
def cleared_errors(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    rows = B.articles(spark, sf).select(i.alias("article_id"), F.when(i % 2 == 0, "embedding_failed").otherwise("other").alias("error"))
    return records.clear_resolved(rows, rows.where("article_id % 3 = 0"))


@query("stamped_events", """SELECT c.event_id, c.main_article_id, m.l_returnflag AS title, c.final_score FROM clusters c JOIN membership m ON m.article_id = c.main_article_id AND m.event_id = c.event_id""")
def stamped_events(spark: SparkSession, sf: str) -> DataFrame:
    m = B.membership(spark, sf).select("event_id", "article_id", F.col("l_returnflag").alias("title"), F.col("l_returnflag").alias("category"), "final_score")
    return records.stamped(B.clusters(spark, sf), m).select("event_id", "main_article_id", "title", "final_score")


@query("story_coverage", """SELECT event_id, array_to_string(list(article_id ORDER BY CASE WHEN article_id % 5 <> 0 THEN published_at END ASC NULLS LAST, article_id), ',') AS coverage FROM membership GROUP BY event_id""")
def story_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.membership(spark, sf).select("event_id", "article_id", F.when(F.col("article_id") % 5 != 0, F.col("published_at")).alias("published_at"))
    return records.story_coverage(rows).select("event_id", F.array_join(F.col("coverage").cast("array<string>"), ",").alias("coverage"))


@query("latest_daily", f"SELECT article_id FROM reports WHERE {DAY.format('ts')} = (SELECT max({DAY.format('ts')}) FROM reports)")
def latest_daily(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.reports(spark, sf).select(local_day(F.col("ts")).alias("report_date"), "article_id")
    return records.latest_daily(rows).select("article_id")


@query("focus_categories", """SELECT focus, array_to_string(list(category ORDER BY category), ',') AS categories FROM
  (SELECT DISTINCT category, CASE category WHEN 'model_release' THEN 'model' WHEN 'product_release' THEN 'product' WHEN 'research' THEN 'technology' WHEN 'tutorial' THEN 'tutorial' END AS focus FROM scored)
WHERE focus IN ('model', 'tutorial') GROUP BY focus""")
def focus_categories(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([("model",), ("tutorial",)], "focus string")
    known = B.scored(spark, sf).select("category").distinct()
    wide = rows.select("focus", F.explode(records.inverse(S.FOCUS_OF, F.col("focus"))).alias("category")).join(known, "category")
    return wide.groupBy("focus").agg(F.array_join(F.array_sort(F.collect_list("category")), ",").alias("categories"))
