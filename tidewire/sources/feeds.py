"""Feeds, sitemaps and API dumps, parsed with Spark's own XML and JSON readers.

Captured responses come as one text per row (``source_id``, ``body``); the
readers explode them into entries with their position in the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.functions.time import local_day

RSS = (
    "channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: STRING, description: STRING, encoded: STRING, "
    "summary: STRING, content: STRING, pubDate: STRING, author: STRING, creator: STRING, category: STRING>>>"
)
ATOM = (
    "entry ARRAY<STRUCT<title: STRING, link: ARRAY<STRUCT<_href: STRING, _rel: STRING>>, summary: STRING, "
    "content: STRING, published: STRING, updated: STRING, author: STRUCT<name: STRING>>>"
)
SITEMAP = "url ARRAY<STRUCT<loc: STRING, lastmod: STRING>>"
# Formats of feed times, tried in order.
TIME_FORMATS = [
    "EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss z", "yyyy-MM-dd HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd",
]
READ_MORE = "阅读原文"


def repair_xml(body: Column) -> Column:
    """Control characters out, a lone ampersand at the end of an image out."""
    clean = F.regexp_replace(body, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    clean = F.regexp_replace(clean, r"&(\s*</)", "$1")
    return F.regexp_replace(clean, r"<(/?)(?:dc|content|media|atom):", "<$1")


def feed_time(value: Column, zone: str | None = None) -> Column:
    """UTC time of a feed's date text; with ``zone`` its wall clock is local there."""
    text = F.regexp_replace(F.regexp_replace(F.trim(value), r"\s+([+-]\d{2}:?\d{2})$", " $1"), "GMT$|UT$|UTC$", "+0000")
    text = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    formats = [f.replace("EEE, ", "") for f in TIME_FORMATS]
    if zone:
        text = F.regexp_replace(text, r"\s*(?:Z|[+-]\d{2}:?\d{2})$", "")
        wall = F.coalesce(*[F.try_to_timestamp(text, F.lit(f.replace(" Z", "").replace(" z", "").replace("XXX", ""))) for f in formats])
        return F.to_utc_timestamp(wall, zone)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def _filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def parse_rss(feeds: DataFrame, *, zone: str | None = None) -> DataFrame:
    """RSS items, or Atom entries where a feed has no items."""
    rows = feeds.withColumn("xml", repair_xml(F.col("body")))
    rss = rows.withColumn("doc", F.from_xml("xml", F.lit(RSS), {"mode": "PERMISSIVE"})).select(
        "source_id", F.posexplode("doc.channel.item").alias("pos", "e"))
    rss = rss.select(
        "source_id", (F.col("pos") + 1).alias("position"), _filled(F.col("e.title")).alias("title"),
        _filled(F.col("e.link")).alias("link"),
        _filled(F.col("e.description"), F.col("e.summary"), F.col("e.content"), F.col("e.encoded")).alias("html"),
        _filled(F.col("e.creator"), F.col("e.author")).alias("author"), F.col("e.pubDate").alias("published"),
        F.col("e.category").alias("category"))
    atom = rows.where(F.col("xml").contains("<entry")).withColumn("doc", F.from_xml("xml", F.lit(ATOM), {"mode": "PERMISSIVE"})).select(
        "source_id", F.posexplode("doc.entry").alias("pos", "e"))
    wanted = F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    atom = atom.select(
        "source_id", (F.col("pos") + 1).alias("position"), _filled(F.col("e.title")).alias("title"),
        F.coalesce(F.try_element_at(wanted, F.lit(1))["_href"], F.try_element_at(F.col("e.link"), F.lit(1))["_href"]).alias("link"),
        _filled(F.col("e.summary"), F.col("e.content")).alias("html"), _filled(F.col("e.author.name")).alias("author"),
        _filled(F.col("e.published"), F.col("e.updated")).alias("published"), F.lit(None).cast("string").alias("category"))
    items = rss.unionByName(atom).where("title is not null and link is not null")
    return items.withColumn("published_at", feed_time(F.col("published"), zone)).withColumn("content", T.strip_html(F.col("html")))


def original_url(html: Column) -> Column:
    """The link behind the "read the original" mark."""
    return F.nullif(F.regexp_extract(html, READ_MORE + r".*?(https?://[^\s\"'<>]+)", 1), F.lit(""))


def before_mark(html: Column) -> Column:
    """The text before that mark."""
    return F.regexp_replace(html, "(?s)" + READ_MORE + ".*$", "")


def parse_sitemap(maps: DataFrame, prefix: str) -> DataFrame:
    """Pages under ``prefix``, the newest first within a source; dateless last."""
    from pyspark.sql import Window

    urls = maps.withColumn("doc", F.from_xml(repair_xml(F.col("body")), F.lit(SITEMAP))).select("source_id", F.explode("doc.url").alias("u"))
    pages = urls.select("source_id", F.trim("u.loc").alias("loc"), F.try_to_timestamp(F.trim("u.lastmod")).alias("lastmod"))
    path = F.regexp_replace("loc", r"^[a-z]+://[^/]+", "")
    pages = pages.where(path.startswith(prefix) & (F.rtrim(path) != prefix) & (F.concat(path, F.lit("/")) != prefix))
    order = Window.partitionBy("source_id").orderBy(F.desc_nulls_last("lastmod"), "loc")
    return pages.withColumn("place", F.row_number().over(order))


def page_title(html: Column) -> Column:
    """The title without the site's suffix, else the social title."""
    title = T.clean_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    title = F.regexp_replace(title, r"\s+[|\\–—-]\s+[^|\\–—-]+$", "")
    social = F.regexp_extract(html, r"(?is)<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']*)", 1)
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(T.clean_text(social), F.lit("")))


def page_description(html: Column) -> Column:
    return F.nullif(T.clean_text(F.regexp_extract(html, r"(?is)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"']([^\"']*)", 1)), F.lit(""))


def parse_news_hits(dumps: DataFrame, *, terms: list[str], least_points: int = 5, least_comments: int = 3) -> DataFrame:
    """Hits that name a term and that readers noticed."""
    schema = ("hits ARRAY<STRUCT<objectID: STRING, title: STRING, story_title: STRING, story_text: STRING, url: STRING, "
              "author: STRING, created_at: STRING, points: INT, num_comments: INT>>")
    hits = dumps.select("source_id", F.posexplode(F.from_json("body", schema).hits).alias("pos", "h")).select("source_id", "pos", "h.*")
    title = _filled(F.col("title"), F.col("story_title"))
    words = F.concat_ws(" ", "title", "story_title", "story_text", "url")
    noticed = (F.coalesce("points", F.lit(0)) >= least_points) | (F.coalesce("num_comments", F.lit(0)) >= least_comments)
    rows = hits.withColumn("_t", title).where(F.col("_t").isNotNull() & noticed)
    if terms:
        rows = rows.where(words.rlike(T.term_pattern(terms)))
    return rows.select(
        "source_id", "pos", F.col("_t").alias("title"), F.coalesce("url", F.concat(F.lit("https://news.ycombinator.com/item?id="), "objectID")).alias("source_url"),
        _filled(F.col("story_text"), F.col("_t")).alias("content"), "author", F.try_to_timestamp("created_at").alias("published_at"))


def parse_forum_topics(dumps: DataFrame, *, terms: list[str], least_replies: int, limit: int) -> DataFrame:
    """Forum topics by replies; ties keep the dump's order."""
    from pyspark.sql import Window

    schema = "ARRAY<STRUCT<id: BIGINT, title: STRING, url: STRING, content: STRING, replies: INT, created: BIGINT>>"
    rows = dumps.select("source_id", F.posexplode(F.from_json("body", schema)).alias("pos", "t")).select("source_id", "pos", "t.*")
    rows = rows.where(F.coalesce("replies", F.lit(0)) >= least_replies)
    if terms:
        rows = rows.where(F.concat_ws(" ", "title", "content").rlike(T.term_pattern(terms)))
    order = Window.partitionBy("source_id").orderBy(F.desc("replies"), "pos")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def parse_aggregator_items(dumps: DataFrame, *, recent_days: int, today: str) -> DataFrame:
    """Aggregator items with title and URL inside the last local days."""
    schema = "items ARRAY<STRUCT<title: STRING, url: STRING, summary: STRING, published_at: STRING, time_basis: STRING>>"
    rows = dumps.select("source_id", F.posexplode(F.from_json("body", schema)["items"]).alias("pos", "i")).select("source_id", "pos", "i.*")
    rows = rows.where((F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("url", F.lit(""))) != ""))
    rows = rows.withColumn("published_at", F.try_to_timestamp("published_at"))
    if recent_days:
        rows = rows.where(F.col("published_at").isNull() | (local_day(F.col("published_at")) > F.date_sub(F.to_date(F.lit(today)), recent_days)))
    return rows


def parse_trending_repos(pages: DataFrame, *, terms: list[str]) -> DataFrame:
    """Repositories of a trending page, each at its first place."""
    names = pages.select("source_id", F.posexplode(F.regexp_extract_all("body", F.lit(r'(?is)<h2[^>]*>\s*<a[^>]*href="/([^"/]+/[^"/]+)"'), F.lit(1))).alias("pos", "repo"))
    first = names.groupBy("source_id", "repo").agg(F.min("pos").alias("pos"))
    if not terms:
        return first
    found = F.lit(False)
    for term in terms:
        found = found | F.lower("repo").contains(term.lower())
    return first.where(found)


def parse_papers(dumps: DataFrame) -> DataFrame:
    """Daily papers with at most five authors named."""
    paper = "STRUCT<id: STRING, title: STRING, summary: STRING, publishedAt: STRING, submittedOnDailyAt: STRING, authors: ARRAY<STRUCT<name: STRING>>>"
    schema = f"ARRAY<STRUCT<paper: {paper}, publishedAt: STRING>>"
    rows = dumps.select("source_id", F.posexplode(F.from_json("body", schema)).alias("pos", "p"))
    authors = F.array_join(F.slice(F.transform("p.paper.authors", lambda a: a["name"]), 1, 5), ", ")
    return rows.where("p.paper.title is not null").select(
        "source_id", "pos", F.col("p.paper.id").alias("paper_id"), T.clean_text(F.col("p.paper.title")).alias("title"),
        T.clean_text(F.col("p.paper.summary")).alias("content"), authors.alias("author"),
        F.try_to_timestamp(F.coalesce("p.paper.submittedOnDailyAt", "p.publishedAt", "p.paper.publishedAt")).alias("published_at"))


def parse_posts(dumps: DataFrame) -> DataFrame:
    """English posts with id, title and handle."""
    schema = "ARRAY<STRUCT<id: STRING, title: STRING, handle: STRING, lang: STRING, langs: ARRAY<STRING>, text: STRING>>"
    rows = dumps.select("source_id", F.posexplode(F.from_json("body", schema)).alias("pos", "p")).select("source_id", "pos", "p.*")
    english = F.when(F.size(F.coalesce("langs", F.array())) > 0, F.array_contains("langs", "en")).otherwise(F.coalesce("lang", F.lit("")).isin("en", "zxx"))
    return rows.where("id is not null and title is not null and handle is not null").where(english)


def _rss(df: DataFrame, config: dict) -> DataFrame:
    return parse_rss(df, zone=config.get("timezone"))


#: One signature for all source types: captured responses and the source's settings.
READERS = {
    "rss": _rss,
    "telegram_rss": _rss,
    "sitemap": lambda df, c: parse_sitemap(df, c.get("path_prefix", "/")),
    "hn": lambda df, c: parse_news_hits(
        df, terms=c.get("terms", []), least_points=c.get("min_points", 5), least_comments=c.get("min_comments", 3)),
    "v2ex": lambda df, c: parse_forum_topics(
        df, terms=c.get("terms", []), least_replies=c.get("min_replies", 0), limit=c.get("limit", 20)),
    "sourcepilot": lambda df, c: parse_aggregator_items(df, recent_days=c.get("recent_days", 0), today=c.get("today", "1970-01-01")),
    "github_trending": lambda df, c: parse_trending_repos(df, terms=c.get("terms", [])),
    "huggingface_papers": lambda df, c: parse_papers(df),
    "attentionvc": lambda df, c: parse_posts(df),
}


def reader_for(kind: str):
    """The reader (df, config) -> rows of a source type; feeds are the default."""
    return READERS.get(kind, _rss)


def read_articles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON dump of articles: one array in a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def crawl_report(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of every active source, those without articles included."""
    counts = articles.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return sources.where("is_active").join(counts, sources.id == counts.source_id, "left").select(
        "id", F.coalesce("n", F.lit(0)).alias("article_count"))
