import datetime as dt

from pyspark.sql import functions as F

from tidewire.sources import feeds, sinks
from tidewire.streaming import intake

RSS = """<rss><channel><title>c</title>
<item><title>One &amp; two</title><link>https://a.com/1</link><description>&lt;p&gt;Body&lt;/p&gt;</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title></title><link>https://a.com/2</link></item>
<item><title>Three</title><link>https://a.com/3</link><pubDate>2024-01-02 11:05:44  +0800</pubDate></item>
</channel></rss>"""
ATOM = """<feed><entry><title>E</title><link href="https://a.com/x" rel="self"/><link href="https://a.com/e"/><summary>s</summary><updated>2024-01-03T00:00:00Z</updated></entry></feed>"""
MAP = "<urlset><url><loc>https://a.com/news/</loc></url><url><loc>https://a.com/news/1</loc><lastmod>2024-01-01</lastmod></url><url><loc>https://a.com/news/2</loc><lastmod>2024-02-01</lastmod></url><url><loc>https://a.com/about</loc></url></urlset>"


def captured(spark, *bodies):
    return spark.createDataFrame([(f"s{i}", b) for i, b in enumerate(bodies)], "source_id string, body string")


def test_rss_and_atom(spark):
    rows = {r.title: r for r in feeds.parse_rss(captured(spark, RSS, ATOM)).collect()}
    assert set(rows) == {"One & two", "Three", "E"}
    assert rows["One & two"].content == "Body" and rows["One & two"].published_at == dt.datetime(2024, 1, 1, 10)
    assert rows["Three"].position == 3 and rows["Three"].published_at == dt.datetime(2024, 1, 2, 3, 5, 44)
    assert rows["E"].link == "https://a.com/e"


def test_sitemap(spark):
    rows = feeds.parse_sitemap(captured(spark, MAP), "/news/").orderBy("place").collect()
    assert [r["loc"] for r in rows] == ["https://a.com/news/2", "https://a.com/news/1"]


def test_news_hits(spark):
    body = '{"hits": [{"objectID": "1", "title": "A new LLM", "points": 9, "num_comments": 0}, {"objectID": "2", "title": "An llmish thing", "points": 9}, {"objectID": "3", "title": "llm", "points": 1, "num_comments": 1}]}'
    rows = feeds.parse_news_hits(captured(spark, body), terms=["llm"]).collect()
    assert [r.title for r in rows] == ["A new LLM"]


def test_page_title(spark):
    df = spark.createDataFrame([("<title>Big  News | Site</title>",), ('<meta property="og:title" content="Social">',), ("",)], "html string")
    assert [r.t for r in df.select(feeds.page_title(F.col("html")).alias("t")).collect()] == ["Big News", "Social", None]


def test_feed_sink(spark):
    items = spark.createDataFrame([("e1", dt.datetime(2024, 1, 1), "A<B", "s")], "event_id string, published_at timestamp, title string, summary string")
    assert "<title>A&lt;B</title>" in sinks.rss_feed(items, "https://s", "T").first().feed


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    df = spark.read.parquet(src).select(F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"),
                                        F.col("event_id").alias("ord"), (F.col("event_type") != "error").alias("ok"), F.col("event_id"))
    parts = df.orderBy("ts", "ord").withColumn("b", F.ntile(3).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("ts", "ord")))
    for b in (1, 2, 3):
        parts.where(f"b = {b}").drop("b").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = intake.read_events(spark, str(tmp_path / "in"), df.schema)
    run = stream.writeStream.foreachBatch(intake.upsert_sink(str(tmp_path / "out"), "source_id")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.source_id, r.ord) for r in intake.newest_version(spark, str(tmp_path / "out")).collect()}
    want = {(r.source_id, r.ord) for r in df.groupBy("source_id").agg(F.max_by("ord", F.struct("ts", "ord")).alias("ord")).collect()}
    assert got == want


def test_health_state_equals_the_batch_fold(spark, tmp_path):
    from tidewire.operators.ledger import health_average

    rows = [(1, dt.datetime(2024, 1, 1, h), h, h % 3 > 0) for h in range(9)]
    df = spark.createDataFrame(rows, "source_id long, ts timestamp, ord long, ok boolean")
    for a, b in ((0, 5), (5, 9)):
        df.where(f"ord >= {a} and ord < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = intake.health_stream(intake.read_events(spark, str(tmp_path / "in"), df.schema, files_per_trigger=9))
    run = stream.writeStream.format("memory").queryName("health").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.table("health").orderBy(F.desc("observations")).first()
    want = health_average(df).first()
    assert abs(got.success_rate - want.success_rate) < 1e-9 and got.error_count == want.error_count
