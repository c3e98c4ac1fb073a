"""Queries of reports, posts, deliveries, contents and the query surface."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import api
from tidewire.operators import cluster, content, delivery, posts, rank, reports, upsert
from tidewire.plans import bindings as B
from tidewire.plans.registry import DAY, RANKED, query
from tidewire.session import table
from tidewire.sources import feeds, sinks


@query("page_blocks")
def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return content.extract_content(table(spark, sf, "pages")).select("page_id", "body", F.size("paragraphs").alias("n_paragraphs"), F.size("links").alias("n_links"))


@query("report_sections", f"""{RANKED}, r AS (SELECT event_id, category, row_number() OVER (ORDER BY position) AS slot FROM ranked)
SELECT category AS focus, CAST(count(*) AS INTEGER) AS n, arg_min(event_id, slot) AS first_event FROM r GROUP BY category""")
def report_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = rank.model_rank(B.items(spark, sf)).select("event_id", F.col("category").alias("focus"), F.col("position").alias("slot"))
    return reports.sections(rows).select("focus", F.size("event_ids").alias("n"), F.element_at("event_ids", 1).alias("first_event"))


@query("report_input_budget", """, k AS (SELECT category, event_id, row_number() OVER (PARTITION BY category ORDER BY ord) AS slot FROM items),
s AS (SELECT *, sum(length('{"event_id":"' || event_id || '","title":"t' || event_id || '"}') + 1) OVER (PARTITION BY category ORDER BY slot) AS used FROM k)
SELECT category, count(*) AS n FROM s WHERE slot <= 80 AND (used <= 1500 OR slot = 1) GROUP BY category""")
def report_input_budget(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = B.items(spark, sf).withColumn("slot", F.row_number().over(Window.partitionBy("category").orderBy("ord"))).withColumn("title", F.concat(F.lit("t"), "event_id"))
    return reports.budgeted_input(rows, key="category", characters=1500).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("entry_positions", """SELECT report_date, event_id, row_number() OVER (PARTITION BY report_date ORDER BY p) - 1 AS position FROM (
  SELECT strftime(ts, '%Y-%m-%d') AS report_date, CASE WHEN user_id % 5 = 1 THEN user_id - 1 ELSE user_id END AS event_id, min(event_id) AS p FROM events GROUP BY ALL)""", bound=False)
def entry_positions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    entries = e.select(F.date_format("ts", "yyyy-MM-dd").alias("report_date"), F.col("event_id").alias("position"), F.col("user_id").alias("event_id"))
    redirects = e.where("user_id % 5 = 1").select(F.col("user_id").alias("source_id"), (F.col("user_id") - 1).alias("target_id")).distinct()
    return reports.entry_positions(entries, redirects).withColumn("position", F.col("position").cast("long"))


@query("replace_entries", """SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 100 = 0) OR o_orderkey % 100 = 0""", bound=False)
def replace_entries(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return upsert.replace_partition(o, o.where("o_orderkey % 100 = 0"), "o_custkey")


@query("post_search", """SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(lower(text), 'the') ORDER BY conv_id DESC, turn DESC LIMIT 40 OFFSET 5""", bound=False)
def post_search(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    rows = c.select("conv_id", "turn", F.col("role").alias("content_kind"), F.lit("").alias("author_handle"), "text", F.array().cast("array<string>").alias("topics"),
                    F.col("conv_id").alias("created_at"), F.col("turn").alias("tweet_id"))
    return posts.search(rows, kind="user", q="THE", limit=40, offset=5).select("conv_id", "turn")


@query("post_eligibility", """SELECT CASE WHEN role = 'user' THEN CASE WHEN conv_id % 3 = 0 THEN 'x_accounts' WHEN turn % 2 = 0 THEN 'x_topics' ELSE 'none' END ELSE 'none' END AS bucket, count(*) AS n
FROM conversations GROUP BY ALL""", bound=False)
def post_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    rows = c.select(F.when(F.col("role") == "user", "original").otherwise("reply").alias("tweet_type"), F.concat(F.lit("H"), F.col("conv_id") % 3).alias("author_handle"),
                    F.when(F.col("turn") % 2 == 0, F.array(F.lit("ai"))).alias("topics"))
    handles = spark.createDataFrame([("h0",)], "handle string")
    marked = posts.with_eligibility(rows, handles)
    return marked.groupBy(F.coalesce("pipeline_source_id", F.lit("none")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("post_high_water", "SELECT event_type, epoch_us(max(ts)) AS latest FROM events GROUP BY event_type", bound=False)
def post_high_water(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("created_at"))
    return posts.high_water(rows, "event_type").withColumn("latest", F.unix_micros("latest"))


@query("claimable_deliveries", """SELECT c_custkey AS subscriber_id FROM customer WHERE c_custkey NOT IN (
  SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND (o_orderstatus = 'F' OR o_orderkey % 7 >= 5))""", bound=False)
def claimable_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    subscribers = table(spark, sf, "customer").select(F.col("c_custkey").alias("subscriber_id"))
    log = table(spark, sf, "orders").select(F.col("o_custkey").alias("subscriber_id"), F.col("o_orderpriority").alias("period_key"),
                                            F.when(F.col("o_orderstatus") == "F", "sent").otherwise("failed").alias("status"), (F.col("o_orderkey") % 7).alias("attempts"),
                                            F.lit(datetime(2024, 1, 1)).alias("claimed_at"))
    return delivery.claimable(subscribers, log, "1-URGENT", datetime(2024, 1, 2))


@query("delivery_overview", """SELECT 'subscriber' AS kind, c_mktsegment AS status, count(*) AS n FROM customer GROUP BY ALL
UNION ALL SELECT 'delivery', o_orderstatus, count(*) FROM orders GROUP BY ALL""", bound=False)
def delivery_overview(spark: SparkSession, sf: str) -> DataFrame:
    return delivery.status_overview(table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "status"), table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status"))


@query("failing_sources", "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 6 >= 3", bound=False)
def failing_sources(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(s.alias("id"), (s % 2 == 0).alias("is_active"), (s % 6).alias("error_count"))
    return delivery.failing_sources(rows).select("id")


@query("crawl_report", "SELECT s.id, count(a.id) AS article_count FROM sources s LEFT JOIN articles a ON a.source_id = s.id WHERE s.can_be_main GROUP BY s.id")
def crawl_report(spark: SparkSession, sf: str) -> DataFrame:
    sources = B.sources(spark, sf).withColumn("is_active", F.col("can_be_main"))
    return feeds.crawl_report(B.articles(spark, sf).drop("id"), sources)


@query("fold_merged_events", """SELECT DISTINCT CASE WHEN event_id % 9 = 4 THEN event_id - 4 ELSE event_id END AS event_id, article_id FROM membership""")
def fold_merged_events(spark: SparkSession, sf: str) -> DataFrame:
    m = B.membership(spark, sf)
    merges = m.where("event_id % 9 = 4").select(F.col("event_id").alias("source_id"), (F.col("event_id") - 4).alias("target_id")).distinct()
    return cluster.merge_events(m, merges).select("event_id", "article_id")


@query("events_page", f"""SELECT id AS event_id FROM scored WHERE {DAY.format('published_at')} BETWEEN DATE '2024-01-20' - 9 AND DATE '2024-01-20'
AND CASE source_category WHEN 'official' THEN 'first_party' WHEN 'community' THEN 'community' ELSE 'news' END = 'first_party' AND category IN ('research')
ORDER BY published_at DESC, id LIMIT 20""")
def events_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.scored(spark, sf).withColumnsRenamed({"id": "event_id"}).withColumns({"one_line_summary": F.lit(""), "summary": F.lit(""), "tags": F.array().cast("array<string>"), "source_name": F.lit("")})
    return api.events(rows, today=date(2024, 1, 20), days=10, limit=20, source="first_party", category="research").select("event_id")


@query("daily_markdown", """SELECT strftime(d, '%Y-%m-%d') AS report_date, '# ' || strftime(d, '%Y-%m-%d') || chr(10) || chr(10) || string_agg(slot || '. **' || event_type || '** (' || cents || ')' || chr(10) || chr(10) || '   ', chr(10) ORDER BY slot) AS markdown
FROM (SELECT ts::DATE AS d, event_type, coalesce(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), 'null') AS cents, row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id) AS slot FROM events) GROUP BY d""", bound=False)
def daily_markdown(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf, "events").withColumn("report_date", F.date_format("ts", "yyyy-MM-dd"))
    rows = e.select("report_date", F.col("event_type").alias("title"), F.round(F.col("value") * 100).cast("long").alias("final_score"), F.lit("").alias("summary"),
                    F.row_number().over(Window.partitionBy("report_date").orderBy("event_id")).alias("slot"))
    return sinks.daily_markdown(rows)
