"""Queries of event upkeep, read models, article rules and sources."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import articles as A
from tidewire.functions import topics as P
from tidewire.functions.time import local_day
from tidewire.operators import catalog, events
from tidewire.plans import bindings as B
from tidewire.plans.registry import DAY, query
from tidewire.session import table
from tidewire.sources import feeds

# --- events -----------------------------------------------------------------

EVENTS_SQL = """, ranked_events AS (
  SELECT event_id, first_seen_at, last_seen_at, source_count, final_score, event_id % 2 = 0 AS lead,
         CASE event_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END AS role, CASE event_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS tier
  FROM clusters)"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return B.clusters(spark, sf).select(
        "*", (e % 2 == 0).alias("can_be_main"), F.when(e % 3 == 0, "authority").when(e % 3 == 1, "signal").otherwise("aggregator").alias("role"),
        F.when(e % 5 == 0, "T1").when(e % 5 == 1, "T2").otherwise("T3").alias("tier"))


@query("event_redirects", f"""{EVENTS_SQL}, live AS (SELECT * FROM ranked_events WHERE last_seen_at >= TIMESTAMP '1994-01-01'),
cited AS (SELECT l.*, k FROM live l JOIN (SELECT DISTINCT event_id, unnest([event_id % 500, event_id % 700]) AS k FROM clusters) USING (event_id)),
best AS (SELECT k, arg_max(event_id, (lead, role, tier, final_score, source_count, last_seen_at, event_id)) AS target_id FROM cited GROUP BY k)
SELECT s.event_id AS source_id, arg_max(t.event_id, (t.lead, t.role, t.tier, t.final_score, t.source_count, t.last_seen_at, t.event_id)) AS target_id
FROM cited s JOIN best USING (k) JOIN live t ON t.event_id = target_id
WHERE s.event_id <> t.event_id AND greatest(s.last_seen_at, t.last_seen_at) - least(s.first_seen_at, t.first_seen_at) <= INTERVAL 400 DAY GROUP BY s.event_id""")
def event_redirects(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf)
    keys = rows.select("event_id", F.explode(F.array(F.col("event_id") % 500, F.col("event_id") % 700)).alias("key"))
    return events.reconcile(rows, keys, since=datetime(1994, 1, 1), span_hours=400 * 24)


@query("merged_events", """SELECT CASE WHEN event_id % 8 = 1 THEN event_id - 1 ELSE event_id END AS event_id, count(DISTINCT source_id) AS source_count,
  epoch_us(min(published_at)) AS first_seen_at, epoch_us(max(published_at)) AS last_seen_at, max(final_score) AS final_score, count(DISTINCT article_id) AS members
FROM membership GROUP BY 1""")
def merged_events(spark: SparkSession, sf: str) -> DataFrame:
    m = B.membership(spark, sf)
    redirects = m.where("event_id % 8 = 1").select(F.col("event_id").alias("source_id"), (F.col("event_id") - 1).alias("target_id")).distinct()
    out = events.apply_merges(m, redirects)
    return out.withColumn("first_seen_at", F.unix_micros("first_seen_at")).withColumn("last_seen_at", F.unix_micros("last_seen_at"))


@query("recluster_plan", """SELECT source_id AS new_id, array_to_string(list_sort(list(DISTINCT event_id)), ',') AS old_ids FROM membership WHERE article_id % 7 = 0 GROUP BY 1 HAVING count(DISTINCT event_id) > 1""")
def recluster_plan(spark: SparkSession, sf: str) -> DataFrame:
    m = B.membership(spark, sf)
    after = m.where("article_id % 7 = 0").select(F.col("source_id").alias("event_id"), "article_id")
    return events.recluster_plan(m, after).withColumn("old_ids", F.array_join(F.col("old_ids").cast("array<string>"), ","))


@query("recount_drift", """SELECT event_id, source_count, found FROM (SELECT event_id, source_count + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS source_count,
  source_count AS found FROM clusters) WHERE source_count <> found""")
def recount_drift(spark: SparkSession, sf: str) -> DataFrame:
    stored = B.clusters(spark, sf).select("event_id", (F.col("source_count") + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)).alias("source_count"))
    return events.recount_drift(stored, B.membership(spark, sf))


@query("cache_link_drift", """, m AS (SELECT article_id, event_id, is_main, published_at AS joined_at, article_id AS id FROM membership
  UNION ALL SELECT article_id, event_id + 1, false, published_at + INTERVAL 1 DAY, article_id + 1 FROM membership WHERE article_id % 4 = 0)
SELECT article_id, cached_id, chosen FROM (SELECT article_id, event_id + article_id % 5 // 4 AS cached_id FROM membership)
JOIN (SELECT article_id, arg_max(event_id, (is_main, joined_at, id)) AS chosen FROM m GROUP BY article_id) USING (article_id) WHERE cached_id <> chosen""")
def cache_link_drift(spark: SparkSession, sf: str) -> DataFrame:
    m = B.membership(spark, sf)
    own = m.select("article_id", "event_id", "is_main", F.col("published_at").alias("joined_at"), F.col("article_id").alias("id"))
    later = own.where("article_id % 4 = 0").select("article_id", (F.col("event_id") + 1).alias("event_id"), F.lit(False).alias("is_main"),
                                                   (F.col("joined_at") + F.expr("INTERVAL 1 DAY")).alias("joined_at"), (F.col("id") + 1).alias("id"))
    cached = m.select("article_id", (F.col("event_id") + F.floor(F.col("article_id") % 5 / 4).cast("long")).alias("event_id"))
    return events.cache_link_drift(cached, own.unionByName(later))


@query("events_after_delete", """SELECT event_id, arg_max(article_id, (is_main, published_at, article_id)) AS main_article_id, count(DISTINCT source_id) AS source_count
FROM membership WHERE article_id % 3 <> 0 GROUP BY event_id""")
def events_after_delete(spark: SparkSession, sf: str) -> DataFrame:
    m = B.membership(spark, sf)
    gone = m.where("article_id % 3 = 0")
    out = events.delete_articles({"membership": m, "clusters": B.clusters(spark, sf)}, gone)
    return out["clusters"].select("event_id", "main_article_id", "source_count")


@query("digest_purge", """SELECT event_id, arg_max(article_id, (final_score, published_at, article_id)) AS main_article_id, count(*) AS source_count
FROM membership WHERE article_id % 4 <> 1 GROUP BY event_id""")
def digest_purge(spark: SparkSession, sf: str) -> DataFrame:
    m = B.membership(spark, sf)
    return events.purge(m, m.where("article_id % 4 = 1"))


# --- read models --------------------------------------------------------------

TOPIC_SQL = """, topic_items AS (SELECT event_id, (event_id::BIGINT) % 3 = 0 AS tagged, (event_id::BIGINT) % 2 = 0 AS selected, (event_id::BIGINT) % 7 <> 0 AS is_main,
  source_count, last_seen_at AS published_at FROM items)"""


def _topic(spark: SparkSession, sf: str):
    """Items of which every third has the topic by its stored ids, and the match."""
    topic = next(iter(P.TOPICS))
    e = F.col("event_id").cast("long")
    rows = B.items(spark, sf).select(
        "event_id", F.when(e % 3 == 0, F.array(F.lit(topic))).otherwise(F.array().cast("array<string>")).alias("topic_ids"),
        (e % 2 == 0).alias("selected"), (e % 7 != 0).alias("is_main"), "source_count", F.col("last_seen_at").alias("published_at"))
    return rows, P.matches_topic(topic, F.col("topic_ids"), F.lit(""))


@query("topic_head", f"""{TOPIC_SQL} SELECT count(*) AS total_count, count(*) FILTER (selected) AS selected_count,
  strftime({DAY.format('max(published_at) FILTER (selected)')}, '%Y-%m-%d') AS latest_day FROM topic_items WHERE tagged""")
def topic_head(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.topic_head(*_topic(spark, sf)).withColumn("latest_day", F.col("latest_day").cast("string"))


@query("topic_focus", f"""{TOPIC_SQL} SELECT event_id, source_count FROM topic_items WHERE tagged AND selected AND is_main AND source_count >= 2
  AND published_at >= TIMESTAMP '1995-05-18 16:00:00' ORDER BY source_count DESC, published_at DESC, event_id LIMIT 5""")
def topic_focus(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.topic_focus(*_topic(spark, sf), today=date(1995, 6, 1)).select("event_id", "source_count")


@query("topic_timeline", f"""{TOPIC_SQL} SELECT event_id, epoch_us(published_at) AS published_at FROM topic_items WHERE tagged AND selected ORDER BY published_at DESC, event_id LIMIT 60 OFFSET 60""")
def topic_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.topic_timeline(*_topic(spark, sf), offset=60).select("event_id", F.unix_micros("published_at").alias("published_at"))


@query("dual_stats", """SELECT count(DISTINCT source_id) AS source_coverage_count, count(*) FILTER (source_count > 1) AS multi_source_count, count(*) AS coverage_count,
  count(*) FILTER (days_covered >= 2) AS selected_count FROM items""")
def dual_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.items(spark, sf)
    return catalog.dual_stats(rows, rows.where("days_covered >= 2")).drop("multi_source_ratio")


@query("empty_report", "SELECT 'weekly' AS kind, '2024-W05' AS period_key, 'empty' AS status, count(*) AS coverage_count, 0::BIGINT AS selected_count FROM items")
def empty_report(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.empty_report("weekly", "2024-W05", B.items(spark, sf)).select("kind", "period_key", "status", "coverage_count", "selected_count")


@query("trailing_items", """SELECT article_id FROM reports WHERE ts >= TIMESTAMP '2024-01-14 12:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00' ORDER BY ts DESC, article_id DESC LIMIT 50 OFFSET 5""")
def trailing_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.reports(spark, sf).select("article_id", F.col("ts").alias("published_at"), F.col("article_id").alias("event_id"))
    return catalog.trailing_items(rows, datetime(2024, 1, 15, 12), 24, limit=50, offset=5).select("article_id")


@query("date_groups", f"SELECT strftime({DAY.format('ts')}, '%Y-%m-%d') AS day, count(*) AS items FROM reports GROUP BY 1")
def date_groups(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.date_groups(B.reports(spark, sf), "ts").withColumn("day", F.col("day").cast("string"))


@query("report_dates", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS report_date FROM orders ORDER BY 1 DESC LIMIT 90", bound=False)
def report_dates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("report_date"))
    return catalog.report_dates(rows).withColumn("report_date", F.col("report_date").cast("string"))


@query("latest_finalized", """SELECT strftime(o_orderdate, '%G-W%V') AS period_key FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 ORDER BY 1 DESC LIMIT 1""", bound=False)
def latest_finalized(spark: SparkSession, sf: str) -> DataFrame:
    from tidewire.functions.time import period_key

    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(period_key("weekly", F.to_date("o_orderdate")).alias("period_key"), (k % 3 == 0).alias("is_finalized"),
                                             F.when(k % 2 == 0, "generated").otherwise("draft").alias("status"))
    return catalog.latest_finalized(rows).select("period_key")


@query("report_entries", f"""SELECT article_id, score_cents FROM reports WHERE {DAY.format('ts')} = DATE '2024-01-10' ORDER BY article_id""")
def report_entries(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.reports(spark, sf).select(local_day(F.col("ts")).alias("report_date"), F.col("article_id").alias("position"), "article_id", "score_cents")
    return catalog.report_entries(rows, F.lit(date(2024, 1, 10))).select("article_id", "score_cents")


RUNS_SQL = "SELECT o_orderkey AS id, o_orderdate AS started_at, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS status FROM orders"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    day = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), day.alias("started_at"), day.alias("finished_at"), status.alias("status"))


@query("latest_success", f"SELECT epoch_us(max(started_at)) AS finished_at FROM ({RUNS_SQL}) WHERE status = 'succeeded'", bound=False)
def latest_success(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.latest_success(_runs(spark, sf)).select(F.unix_micros("finished_at").alias("finished_at"))


@query("active_run", f"SELECT id FROM ({RUNS_SQL}) WHERE status = 'running' ORDER BY started_at DESC, id DESC LIMIT 1", bound=False)
def active_run(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.active_run(_runs(spark, sf)).select("id")


@query("source_health", """, crawls AS (SELECT event_id AS source_id, ts, source_key <> 'error' AND article_id % 4 <> 0 AS ok FROM reports),
log AS (SELECT source_id, max(ts) AS last_crawled_at, max(ts) FILTER (ok) AS last_success_at FROM crawls GROUP BY 1)
SELECT l.source_id AS id, epoch_us(last_crawled_at) AS last_crawled_at, epoch_us(last_success_at) AS last_success_at,
  (SELECT count(*) FROM crawls c WHERE c.source_id = l.source_id AND NOT c.ok AND (l.last_success_at IS NULL OR c.ts > l.last_success_at)) AS error_count FROM log l""")
def source_health(spark: SparkSession, sf: str) -> DataFrame:
    crawls = B.reports(spark, sf).select(F.col("event_id").alias("source_id"), "ts", ((F.col("source_key") != "error") & (F.col("article_id") % 4 != 0)).alias("ok"))
    out = catalog.source_health(crawls.select(F.col("source_id").alias("id")).distinct(), crawls)
    return out.select("id", F.unix_micros("last_crawled_at").alias("last_crawled_at"), F.unix_micros("last_success_at").alias("last_success_at"), "error_count")


@query("label_groups", "SELECT category AS label, min(ord) AS first, count(*) AS items FROM items GROUP BY 1")
def label_groups(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.label_groups(B.items(spark, sf).select(F.col("category").alias("label"), "ord"))


# --- article rules ------------------------------------------------------------

@query("embedding_inputs", "SELECT id, sha256(title || chr(10) || title || chr(10) || content) AS digest FROM articles")
def embedding_inputs(spark: SparkSession, sf: str) -> DataFrame:
    text = A.embedding_input(F.col("title"), F.col("content"))
    return B.articles(spark, sf).select("id", F.sha2(text.cast("binary"), 256).alias("digest"))


@query("paragraph_hashes", "SELECT id, substr(sha256(content), 1, 16) AS digest FROM articles WHERE content IS NOT NULL")
def paragraph_hashes(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.articles(spark, sf).where("content is not null")
    return rows.select("id", A.paragraph_hash(F.split("content", "\n")).alias("digest"))


@query("display_sources", "SELECT id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN '@h' || id ELSE source_id END AS name FROM articles")
def display_sources(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    handle = F.when(i % 2 == 0, F.concat(F.lit(" @h"), i)).otherwise(F.lit("@"))
    return B.articles(spark, sf).select("id", A.display_source(F.col("source_id"), F.when(i % 3 == 0, "x_tweet"), handle).alias("name"))


@query("display_scores", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN '--' ELSE CAST(CAST(floor(final_score / 100.0 + 0.5) AS BIGINT) AS VARCHAR) END AS score FROM clusters")
def display_scores(spark: SparkSession, sf: str) -> DataFrame:
    score = F.when(F.col("event_id") % 6 != 0, F.col("final_score") / 100.0)
    return B.clusters(spark, sf).select("event_id", A.display_score(score).alias("score"))


@query("unfetchable_pages", r"""SELECT page_id, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) IN ('mp.weixin.qq.com', 'm.qq.com') AS unfetchable
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://MP.weixin.qq.com/s?__biz=' || page_id ELSE url END AS u FROM pages)""", bound=False)
def unfetchable_pages(spark: SparkSession, sf: str) -> DataFrame:
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://MP.weixin.qq.com/s?__biz="), "page_id")).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", A.unfetchable(url).alias("unfetchable"))


@query("terminal_cache", """SELECT id, id % 5 <> 0 AND NOT (id % 3 = 0 AND id % 7 <> id % 8) AND NOT (id % 2 = 0 AND id % 4 < 3) AS current FROM articles""")
def terminal_cache(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    kind = F.when(i % 3 == 0, "x_tweet").otherwise("rss")
    changed = A.post_changed(kind, (i % 7).cast("string"), kind, (i % 8).cast("string"))
    current = A.cache_is_current(i % 5 != 0, changed, i % 2 == 0, i % 4, F.lit(3))
    return B.articles(spark, sf).select("id", current.alias("current"))


@query("curated_fallback", """SELECT id, CASE id % 4 WHEN 0 THEN 'model_release' WHEN 1 THEN 'research' ELSE 'industry' END AS category,
  id % 3 = 0 AS trusted FROM articles""")
def curated_fallback(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    label = F.when(i % 4 == 0, " 模型发布").when(i % 4 == 1, "论文").when(i % 4 == 2, "other")
    config = F.when(i % 3 == 0, '{"selection_policy": "trusted_curated"}').when(i % 3 == 1, "{}")
    return B.articles(spark, sf).select("id", A.curated_category(label).alias("category"), A.trusted(config).alias("trusted"))


# --- sources: captured bodies made of the tables --------------------------------

def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@query("feed_scan", """SELECT CAST(doc_id // 20 AS VARCHAR) AS source_id, 'Doc ' || doc_id || ' & <more>' AS title, 'https://example.org/d?a=' || doc_id || '&b=1' AS link,
  epoch_us(TIMESTAMP '2024-01-01 10:00:00' + to_seconds(CAST(doc_id % 60 AS INTEGER))) AS published_at, lang AS content FROM documents WHERE lang IS NOT NULL""", bound=False)
def feed_scan(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    item = F.concat(
        F.lit("<item><title>"), _escaped(F.concat(F.lit("Doc "), d, F.lit(" & <more>"))), F.lit("</title><link>"),
        _escaped(F.concat(F.lit("https://example.org/d?a="), d, F.lit("&b=1"))), F.lit("</link><description>"),
        _escaped(F.concat(F.lit("<p>"), "lang", F.lit("</p>"))), F.lit("</description><pubDate>Mon, 01 Jan 2024 10:00:"),
        F.lpad((d % 60).cast("string"), 2, "0"), F.lit(" GMT</pubDate></item>"))
    bodies = table(spark, sf, "documents").where("lang is not null").groupBy(F.floor(d / 20).cast("string").alias("source_id")).agg(
        F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("body"))
    return feeds.reader_for("rss")(bodies, {}).select("source_id", "title", "link", F.unix_micros("published_at").alias("published_at"), "content")


@query("sitemap_scan", """SELECT source_id, loc, row_number() OVER (PARTITION BY source_id ORDER BY lastmod DESC, loc) AS place FROM (
  SELECT CAST(page_id // 20 AS VARCHAR) AS source_id, 'https://example.org/news/' || page_id AS loc, DATE '2024-01-01' + CAST(page_id % 5 AS INTEGER) AS lastmod
  FROM pages WHERE page_id % 3 <> 0)""", bound=False)
def sitemap_scan(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    url = F.concat(F.lit("<url><loc>https://example.org/"), F.when(p % 3 == 0, "about/").otherwise("news/"), p, F.lit("</loc><lastmod>2024-01-0"),
                   p % 5 + 1, F.lit("</lastmod></url>"))
    maps = table(spark, sf, "pages").groupBy(F.floor(p / 20).cast("string").alias("source_id")).agg(
        F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(url), ""), F.lit("</urlset>")).alias("body"))
    return feeds.reader_for("sitemap")(maps, {"path_prefix": "/news/"}).select("source_id", "loc", F.col("place").cast("long").alias("place"))


def _dumps(rows: DataFrame, group, item, wrap: str | None = None) -> DataFrame:
    """JSON responses of about twenty items each."""
    packed = F.collect_list(item)
    body = F.to_json(F.struct(packed.alias(wrap))) if wrap else F.to_json(packed)
    return rows.groupBy(group.cast("string").alias("source_id")).agg(body.alias("body"))


@query("news_hits_scan", """SELECT CAST(o_orderkey // 20 AS VARCHAR) AS source_id, 'Agent story ' || o_orderkey AS title, 'https://example.org/' || o_orderkey AS source_url
FROM orders WHERE o_orderkey % 4 < 2 AND (o_orderkey % 9 >= 5 OR o_orderkey % 6 >= 3)""", bound=False)
def news_hits_scan(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    hit = F.struct(
        k.cast("string").alias("objectID"), F.concat(F.when(k % 4 < 2, "Agent story ").otherwise("Garden story "), k).alias("title"),
        F.concat(F.lit("https://example.org/"), k).alias("url"), (k % 9).cast("int").alias("points"), (k % 6).cast("int").alias("num_comments"),
        F.lit("2024-01-02T03:04:05Z").alias("created_at"))
    dumps = _dumps(table(spark, sf, "orders"), F.floor(k / 20), hit, "hits")
    return feeds.reader_for("hn")(dumps, {"terms": ["agent"]}).select("source_id", "title", "source_url")


@query("forum_scan", """SELECT source_id, id, place FROM (SELECT o_orderkey // 20 AS g, CAST(o_orderkey // 20 AS VARCHAR) AS source_id, o_orderkey AS id,
  row_number() OVER (PARTITION BY o_orderkey // 20 ORDER BY o_orderkey % 7 DESC, o_orderkey) AS place FROM orders WHERE o_orderkey % 7 >= 2) WHERE place <= 3""", bound=False)
def forum_scan(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    topic = F.struct(k.cast("long").alias("id"), F.concat(F.lit("t"), k).alias("title"), (k % 7).cast("int").alias("replies"))
    rows = table(spark, sf, "orders").groupBy(F.floor(k / 20).cast("string").alias("source_id")).agg(F.to_json(F.array_sort(F.collect_list(topic))).alias("body"))
    out = feeds.reader_for("v2ex")(rows, {"min_replies": 2, "limit": 3})
    return out.select("source_id", "id", F.col("place").cast("long").alias("place"))


@query("aggregator_scan", """SELECT CAST(o_orderkey // 20 AS VARCHAR) AS source_id, 'https://example.org/' || o_orderkey AS url FROM orders
WHERE o_orderkey % 5 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 10 >= 4)""", bound=False)
def aggregator_scan(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    item = F.struct(
        F.when(k % 5 != 0, F.concat(F.lit("t"), k)).otherwise(" ").alias("title"), F.concat(F.lit("https://example.org/"), k).alias("url"),
        F.when(k % 3 != 0, F.concat(F.lit("2024-01-0"), k % 10, F.lit("T01:00:00Z"))).alias("published_at"))
    item = F.struct(item.title.alias("title"), item.url.alias("url"), F.replace(item.published_at, F.lit("2024-01-00"), F.lit("2023-12-31")).alias("published_at"))
    dumps = _dumps(table(spark, sf, "orders"), F.floor(k / 20), item, "items")
    return feeds.reader_for("sourcepilot")(dumps, {"recent_days": 6, "today": "2024-01-09"}).select("source_id", "url")


@query("trending_scan", """SELECT CAST(o_orderkey // 20 AS VARCHAR) AS source_id, 'own' || o_orderkey % 4 || '/llm-' || o_orderkey % 6 AS repo FROM orders WHERE o_orderkey % 4 <> 1 GROUP BY ALL""", bound=False)
def trending_scan(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    row = F.concat(F.lit('<h2 class="h3"> <a data-x="1" href="/own'), k % 4, F.when(k % 4 == 1, "/tool-").otherwise("/llm-"), k % 6, F.lit('">x</a></h2>'))
    pages = table(spark, sf, "orders").groupBy(F.floor(k / 20).cast("string").alias("source_id")).agg(F.array_join(F.collect_list(row), "\n").alias("body"))
    return feeds.reader_for("github_trending")(pages, {"terms": ["llm"]}).select("source_id", "repo")


@query("papers_scan", """SELECT CAST(o_orderkey // 20 AS VARCHAR) AS source_id, CAST(o_orderkey AS VARCHAR) AS paper_id, 'Paper ' || o_orderkey AS title,
  array_to_string(list_transform(range(1, 1 + least(5, o_orderkey % 8)), lambda i: 'a' || i), ', ') AS author FROM orders WHERE o_orderkey % 8 > 0""", bound=False)
def papers_scan(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    authors = F.transform(F.sequence(F.lit(1), (k % 8).cast("int")), lambda i: F.struct(F.concat(F.lit("a"), i).alias("name")))
    paper = F.struct(k.cast("string").alias("id"), F.concat(F.lit("Paper  "), k).alias("title"), F.lit("s").alias("summary"), authors.alias("authors"))
    dumps = _dumps(table(spark, sf, "orders").where(k % 8 > 0), F.floor(k / 20), F.struct(paper.alias("paper"), F.lit("2024-01-02T00:00:00Z").alias("publishedAt")))
    return feeds.reader_for("huggingface_papers")(dumps, {}).select("source_id", "paper_id", "title", "author")


@query("posts_scan", """SELECT CAST(o_orderkey // 20 AS VARCHAR) AS source_id, CAST(o_orderkey AS VARCHAR) AS id FROM orders
WHERE CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE o_orderkey % 3 = 0 END""", bound=False)
def posts_scan(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    post = F.struct(
        k.cast("string").alias("id"), F.lit("t").alias("title"), F.lit("h").alias("handle"),
        F.when(k % 4 == 0, "en").when(k % 4 == 1, "de").when(k % 4 == 2, "zxx").otherwise("fr").alias("lang"),
        F.when((k % 4 == 3) & (k % 3 == 0), F.array(F.lit("fr"), F.lit("en"))).when(k % 4 == 3, F.array(F.lit("fr"))).alias("langs"))
    dumps = _dumps(table(spark, sf, "orders"), F.floor(k / 20), post)
    return feeds.reader_for("attentionvc")(dumps, {}).select("source_id", "id")
