"""Keyed merges that give the new table; running one twice changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_missing(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``incoming`` whose key is new, the first of each key."""
    fresh = incoming.join(stored.select(key), key, "left_anti")
    first = fresh.groupBy(F.col(key).alias("_k")).agg(F.min(order).alias("_first"))
    return fresh.join(first, (F.col(key) == F.col("_k")) & (F.col(order) == F.col("_first"))).drop("_k", "_first")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, rules: dict[str, Column] | None = None) -> DataFrame:
    """Full outer merge on ``key``; new values win unless a rule says otherwise.

    A rule is an expression over ``old.<column>`` and ``new.<column>``.
    """
    rules = rules or {}
    old = stored.select(F.struct("*").alias("old"), F.col(key).alias("_k"))
    new = incoming.select(F.struct("*").alias("new"), F.col(key).alias("_k"))
    both = old.join(new, "_k", "full")
    values = []
    for name in stored.columns:
        rule = rules.get(name, F.when(F.col("new").isNotNull(), F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")))
        values.append(rule.alias(name))
    return both.select(*values)


def article_rules() -> dict[str, Column]:
    """Longer bodies win unless the extractor is newer; ids and first times stay."""
    longer = F.length("new.content") > F.length("old.content")
    newer = F.coalesce(F.col("new.extractor") > F.col("old.extractor"), F.lit(False))
    inserted = F.col("old").isNull()
    gone = F.col("new").isNull()
    return {
        "id": F.coalesce("old.id", "new.id"),
        "content": F.when(inserted | (~gone & (longer | newer)), F.col("new.content")).otherwise(F.col("old.content")),
        "extractor": F.greatest("old.extractor", "new.extractor"),
        "published_at": F.coalesce("new.published_at", "old.published_at"),
    }


def keep_if_null(name: str) -> Column:
    """A new value unless it is null."""
    return F.coalesce(f"new.{name}", f"old.{name}")


def frozen_once(name: str) -> Column:
    """The first value that was ever set."""
    return F.coalesce(f"old.{name}", f"new.{name}")


def delete_keys(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key).distinct(), key, "left_anti")


def promote_after_delete(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Membership without ``gone``; an event that lost its main article gets
    its latest published member, events without members vanish."""
    left = members.join(gone.select("article_id"), "article_id", "left_anti")
    state = left.groupBy("event_id").agg(
        F.max_by("article_id", F.struct("published_at", "article_id")).alias("_next"), F.max("is_main").alias("_has")
    )
    return left.join(state, "event_id").withColumn(
        "is_main", F.when(F.col("_has"), F.col("is_main")).otherwise(F.col("article_id") == F.col("_next"))
    ).drop("_next", "_has")


def replace_partition(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that ``incoming`` has are replaced."""
    return delete_keys(stored, incoming, key).unionByName(incoming.select(stored.columns))


def manual_entries(entries: DataFrame, extra: DataFrame) -> DataFrame:
    """``extra`` events not in their date's report, placed after its last position."""
    from pyspark.sql import Window

    fresh = extra.join(entries.select("report_date", "event_id"), ["report_date", "event_id"], "left_anti")
    last = entries.groupBy("report_date").agg(F.max("position").alias("_last"))
    order = Window.partitionBy("report_date").orderBy("published_at", "event_id")
    return fresh.join(last, "report_date", "left").select(
        "report_date", (F.coalesce("_last", F.lit(-1)) + F.row_number().over(order)).alias("position"), "event_id"
    )
