"""Keyed records: write rules, cached outcomes, finders of what needs repair."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.time import local_day
from tidewire.operators.upsert import keep_if_null, upsert

# Tags of an override, windows that an upstream API offers.
MOST_TAGS = 5
WINDOWS = {1: "24h", 7: "7d", 30: "30d"}


def processed_rules(selection: list[str]) -> dict[str, Column]:
    """An editor's selection stays; event and model are never emptied."""
    picked = F.coalesce((F.col("old.origin") == "admin") & (F.col("old.status") == "processed"), F.lit(False))
    fresh = F.when(F.col("new").isNotNull(), F.lit(True)).otherwise(F.lit(False))
    rules = {c: F.when(picked | ~fresh, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")) for c in selection}
    return rules | {c: keep_if_null(c) for c in ("event_id", "model_used")}


def upsert_processed(stored: DataFrame, incoming: DataFrame, selection: list[str]) -> DataFrame:
    """Processed rows by article."""
    return upsert(stored, incoming, "article_id", processed_rules(selection))


def moderate(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Overrides by key: given fields win, others stay, at most five tags."""
    rules = {c: keep_if_null(c) for c in stored.columns}
    return upsert(stored, incoming, key, rules).withColumn("tags", F.slice("tags", 1, MOST_TAGS))


def release_pick(processed: DataFrame, ids: DataFrame) -> DataFrame:
    """Editors' picks among ``ids`` go back to what their score gives."""
    hit = processed.join(ids.select("article_id").distinct().withColumn("_hit", F.lit(True)), "article_id", "left")
    back = F.coalesce(F.col("_hit") & (F.col("origin") == "admin"), F.lit(False))
    return hit.withColumn("reason", F.when(~back, F.col("reason"))).withColumn(
        "origin", F.when(back, F.lit("score")).otherwise(F.col("origin"))).drop("_hit")


def deletable_sources(sources: DataFrame, articles: DataFrame) -> DataFrame:
    """Sources that no article refers to."""
    return sources.join(articles.select(F.col("source_id").alias("id")), "id", "left_anti")


def submissions_page(rows: DataFrame, status: str | None, *, limit: int) -> DataFrame:
    """Submissions of a publication status, newest first."""
    kept = rows.where(F.col("publication_status") == status) if status else rows
    return kept.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def changed_clusters(before: DataFrame, after: DataFrame) -> DataFrame:
    """Old events whose members are now in several new ones."""
    pairs = before.select(F.col("event_id").alias("old_id"), "article_id").join(
        after.select(F.col("event_id").alias("new_id"), "article_id"), "article_id")
    return pairs.groupBy("old_id").agg(F.count_distinct("new_id").alias("parts")).where("parts > 1")


def recent_pool(clusters: DataFrame, membership: DataFrame, *, since: datetime, least_sources: int) -> DataFrame:
    """Members of the recent events that enough sources report."""
    live = clusters.where((F.col("last_seen_at") >= F.lit(since)) & (F.col("source_count") >= least_sources)).select("event_id")
    return membership.join(live, "event_id", "left_semi")


def cached_results(wanted: DataFrame, raw: DataFrame, processed: DataFrame, vectors: DataFrame, translations: DataFrame) -> DataFrame:
    """What is known of each wanted URL; absent parts are null, each flagged."""
    own = wanted.select("url_hash").distinct().join(raw, "url_hash")
    seen = lambda df, c: df.select("article_id").distinct().withColumn(c, F.lit(True))
    out = own.join(processed.select("article_id", "status", "skipped_reason"), "article_id", "left")
    for df, flag in ((vectors, "has_vector"), (translations, "has_translation")):
        out = out.join(seen(df, flag), "article_id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return out


def crawl_results(sources: DataFrame, crawled: DataFrame) -> DataFrame:
    """Per active source how many articles came, were new, were accepted, and what that makes of it.

    ``crawled``: source_id, is_new, accepted.
    """
    counts = crawled.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("crawled"), F.count_if("is_new").alias("ingested"), F.count_if("accepted").alias("accepted"))
    rows = sources.where("is_active").join(counts, sources.id == counts.source_id, "left").select(
        "id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("crawled", "ingested", "accepted")])
    outcome = F.when(F.col("ingested") == 0, "duplicate").when(F.col("accepted") > 0, "saved").otherwise("rejected")
    return rows.withColumn("outcome", outcome)


def window_name(days: Column) -> Column:
    """The smallest window that covers some days (none: everything)."""
    name = F.lit("all")
    for most, label in sorted(WINDOWS.items(), reverse=True):
        name = F.when((days > 0) & (days <= most), F.lit(label)).otherwise(name)
    return name


def inverse(table: dict[str, str], key: Column, *, own: bool = False) -> Column:
    """The keys that ``table`` maps to ``key``; with ``own`` the key itself where there is none."""
    groups: dict[str, list[str]] = {}
    for source, target in table.items():
        groups.setdefault(target, []).append(source)
    found = F.array().cast("array<string>")
    for target, members in groups.items():
        found = F.when(key == target, F.array(*[F.lit(m) for m in members])).otherwise(found)
    return F.when(F.size(found) == 0, F.array(key)).otherwise(found) if own else found


def reprocess_scope(rows: DataFrame, failed: Column, ts: str) -> DataFrame:
    """All rows of the local days on which any row failed."""
    days = rows.where(failed).select(local_day(F.col(ts)).alias("_day")).distinct()
    return rows.withColumn("_day", local_day(F.col(ts))).join(days, "_day", "left_semi").drop("_day")


def title_peers(omitted: DataFrame, processed: DataFrame) -> DataFrame:
    """The earliest processed article with the same title hash, for each omitted one."""
    first = processed.where("title_hash is not null").groupBy("title_hash").agg(
        F.min_by("article_id", F.struct("published_at", "article_id")).alias("peer_id"))
    return omitted.join(first, "title_hash").where(F.col("article_id") != F.col("peer_id")).select("article_id", "peer_id")


def outdated(articles: DataFrame, version: Column, *, after, limit: int) -> DataFrame:
    """The next page of full-page articles whose extractor is older than required."""
    old = F.col("full_page") & (F.coalesce("extractor", F.lit(0)) < version)
    return articles.where(old & (F.col("article_id") > F.lit(after))).orderBy("article_id").limit(limit)


def clear_resolved(processed: DataFrame, vectors: DataFrame) -> DataFrame:
    """Embedding errors of articles that have a vector by now are removed."""
    done = vectors.select("article_id").distinct().withColumn("_done", F.lit(True))
    cured = F.col("_done").isNotNull() & (F.col("error") == "embedding_failed")
    return processed.join(done, "article_id", "left").withColumn("error", F.when(~F.coalesce(cured, F.lit(False)), F.col("error"))).drop("_done")


def stamped(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Events with their main article's title and category and their best score.

    ``clusters``: event_id, main_article_id; ``members``: event_id, article_id, title, category, final_score.
    """
    best = members.groupBy("event_id").agg(F.max("final_score").alias("final_score"))
    main = members.select(F.col("article_id").alias("main_article_id"), "event_id", "title", "category")
    return clusters.select("event_id", "main_article_id").join(main, ["event_id", "main_article_id"], "left").join(best, "event_id", "left")


def story_coverage(reports: DataFrame) -> DataFrame:
    """Reports of each story by time, those without one last."""
    entry = F.struct(F.col("published_at").isNull().alias("late"), "published_at", "article_id")
    return reports.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["article_id"]).alias("coverage"))


def latest_daily(dailies: DataFrame) -> DataFrame:
    """The items of the last day that has a report."""
    last = dailies.agg(F.max("report_date").alias("report_date"))  # one row
    return dailies.join(F.broadcast(last), "report_date")
