"""Rules about single articles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts whose pages can't be fetched, the policy flag of curated
# sources, and what a curated article scores when no model answers.
UNFETCHABLE_HOSTS = ["mp.weixin.qq.com", "m.qq.com"]
CURATED_POLICY = "trusted_curated"
CURATED_CATEGORIES = {
    "AI 产品": "product_release", "模型发布": "model_release", "开源项目": "open_source", "论文": "research", "研究": "research",
    "技巧观点": "opinion", "行业动态": "industry",
}
CURATED_DIMENSIONS = {"impact": 5.0, "novelty": 5.0, "substance": 4.5}


def paragraph_hash(paragraphs: Column) -> Column:
    """16 hex digits that change when any paragraph does."""
    return F.substring(F.sha2(F.array_join(paragraphs, "\n").cast("binary"), 256), 1, 16)


def embedding_input(title: Column, content: Column) -> Column:
    """The text that is embedded: the title twice, so that it weighs more, then the body."""
    return F.concat(title, F.lit("\n"), title, F.lit("\n"), content)


def display_source(name: Column, source_type: Column, handle: Column) -> Column:
    """A post shows its author's handle, anything else its source's name."""
    plain = F.regexp_replace(F.trim(handle), "^@+", "")
    return F.when((source_type == "x_tweet") & (F.coalesce(plain, F.lit("")) != ""), F.concat(F.lit("@"), plain)).otherwise(name)


def display_score(score: Column) -> Column:
    """Whole points, two dashes for none."""
    return F.coalesce(F.floor(score + 0.5).cast("long").cast("string"), F.lit("--"))


def unfetchable(url: Column) -> Column:
    """Whether an article's host shows a wall instead of the article."""
    return F.coalesce(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).isin(UNFETCHABLE_HOSTS), F.lit(False))


def trusted(config: Column) -> Column:
    """Whether a source's JSON settings mark it as curated."""
    return F.coalesce(F.get_json_object(config, "$.selection_policy") == CURATED_POLICY, F.lit(False))


def post_changed(new_type: Column, new_hash: Column, old_type: Column, old_hash: Column) -> Column:
    """Whether a cached post has another content hash than the one that came in."""
    empty = F.lit("")
    posts = F.coalesce((new_type == "x_tweet") & (old_type == "x_tweet"), F.lit(False))
    incoming = F.coalesce(new_hash, empty)
    return posts & (incoming != "") & (incoming != F.coalesce(old_hash, empty))


def cache_is_current(terminal: Column, changed: Column, deferred: Column, old_version: Column, version: Column) -> Column:
    """Whether a cached outcome still holds: final, same content, same extractor."""
    stale = deferred & (F.coalesce(old_version, F.lit(0)) < version)
    return F.coalesce(terminal, F.lit(False)) & ~changed & ~F.coalesce(stale, F.lit(False))


def curated_category(feed_category: Column) -> Column:
    """The category of a curated article by its feed's own label."""
    table = F.create_map(*[F.lit(x) for pair in CURATED_CATEGORIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.trim(feed_category)), F.lit("industry"))


def body_present(notes: Column, roster_size: Column) -> Column:
    """A report has a body where its notes say something, or where there is nothing to say."""
    spoken = F.exists(F.coalesce(notes, F.array().cast("array<string>")), lambda n: F.trim(F.coalesce(n, F.lit(""))) != "")
    return spoken | (roster_size == 0)
