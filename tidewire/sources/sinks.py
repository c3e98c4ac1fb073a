"""Sinks: JSON dumps, Markdown reports and RSS feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def daily_markdown(items: DataFrame) -> DataFrame:
    """One Markdown text for each report date, items in slot order."""
    line = F.format_string("%d. **%s** (%s)\n\n   %s", F.col("slot"), F.col("title"), F.col("final_score").cast("string"),
                           F.coalesce("summary", F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("slot", line.alias("line")))), lambda s: s.line)
    return items.groupBy("report_date").agg(
        F.concat(F.lit("# "), F.first(F.col("report_date").cast("string")), F.lit("\n\n"), F.array_join(lines, "\n")).alias("markdown"))


def _escaped(column):
    text = F.regexp_replace(F.coalesce(column, F.lit("")), "&", "&amp;")
    return F.regexp_replace(F.regexp_replace(text, "<", "&lt;"), ">", "&gt;")


def rss_items(items: DataFrame, site: str) -> DataFrame:
    """The RSS text of each item."""
    date = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return items.select(
        "event_id", "published_at",
        F.concat(F.lit("<item><title>"), _escaped(F.col("title")), F.lit(f"</title><link>{site}/events/"), F.col("event_id"),
                 F.lit("</link><guid>"), F.col("event_id"), F.lit("</guid><pubDate>"), date, F.lit("</pubDate><description>"),
                 _escaped(F.col("summary")), F.lit("</description></item>")).alias("xml"))


def rss_feed(items: DataFrame, site: str, title: str, limit: int = 50) -> DataFrame:
    """One feed of the newest items."""
    newest = rss_items(items.orderBy(F.desc("published_at"), "event_id").limit(limit), site)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("published_at", "event_id", "xml")), asc=False), lambda s: s.xml), "")
    return newest.agg(F.concat(F.lit(f'<rss version="2.0"><channel><title>{title}</title><link>{site}</link>'), body,
                               F.lit("</channel></rss>")).alias("feed"))
