"""Identity, date windows and duplicates of incoming articles."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.functions.time import local_day
from tidewire.operators.graph import connected_labels


def normalize_articles(rows: DataFrame, *, now: str | None = None) -> DataFrame:
    """Canonical URL, collapsed texts, hashes and the article id.

    A missing ``published_at`` becomes ``now``.
    """
    url = T.canonical_url(F.col("source_url"))
    title = T.clean_text(F.col("title"))
    when = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    return (
        rows.withColumn("source_url", url)
        .withColumn("title", title)
        .withColumn("content", T.clean_text(F.col("content")))
        .withColumn("published_at", F.coalesce("published_at", when))
        .withColumn("url_hash", T.stable_hash(F.col("source_url")))
        .withColumn("title_hash", T.stable_hash(F.lower("title")))
        .withColumn("id", F.substring(T.stable_hash(F.concat_ws(":", "source_id", "url_hash")), 1, 24))
    )


def recent_days(config: Column) -> Column:
    """Days to keep from a source's JSON config: 1 where absent, bad or negative."""
    n = F.expr("try_cast(get_json_object(config, '$.recent_days') AS INT)") if config is None else config.try_cast("int")
    return F.when(n.isNull() | (n < 0), F.lit(1)).otherwise(n)


def within_recent_days(articles: DataFrame, sources: DataFrame, report_date: date, *, exempt: list[str] = ()) -> DataFrame:
    """Articles of exempt sources, of sources without a window (0), without a
    time, or whose local day is among the last N of the report date."""
    days = sources.select(F.col("id").alias("_source"), recent_days(F.col("recent_days")).alias("_days"))
    day, last = local_day(F.col("published_at")), F.lit(report_date).cast("date")
    n = F.coalesce("_days", F.lit(1))
    fits = day.between(F.date_sub(last, n - 1), last)
    keep = F.col("source_id").isin(list(exempt)) | (n == 0) | F.col("published_at").isNull() | fits
    return articles.join(days, F.col("source_id") == F.col("_source"), "left").where(keep).drop("_source", "_days")


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; the key's rows are reduced where they are read."""
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    return rows.join(first, F.col(key).eqNullSafe(F.col("_key")) & (F.col(order) == F.col("_first"))).drop("_key", "_first")


def dedupe_two_keys(rows: DataFrame, *, url: str, title: str, order: str, exempt: Column | None = None) -> DataFrame:
    """First occurrence wins by URL and by title, keys counting only once kept.

    Whether a row is kept depends on the kept rows before it, so each group of
    rows that are linked by keys is folded in order; unlinked rows never meet
    in a task.  Rows where ``exempt`` holds have no title key.
    """
    free = F.coalesce(exempt, F.lit(False)) if exempt is not None else F.lit(False)
    keyed = rows.select(
        F.col(order).alias("ord"),
        F.concat(F.lit("u:"), F.col(url)).alias("u"),
        F.when(~free, F.concat(F.lit("t:"), F.col(title))).alias("t"),
    )
    edges = keyed.select("ord", F.explode(F.array("u", "t")).alias("key")).where("key is not null")
    shared = edges.groupBy("key").agg(F.min("ord").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    links = edges.join(shared, "key").where("ord <> hub").select(F.col("hub").alias("src"), F.col("ord").alias("dst"))
    labels = connected_labels(links.distinct())
    linked = keyed.join(labels, keyed.ord == labels.node).select("label", "ord", "u", "t")

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        drop = []
        for row in pdf.sort_values("ord").itertuples():
            if row.u in seen or (row.t is not None and row.t in seen):
                drop.append(row.ord)
            else:
                seen.update(k for k in (row.u, row.t) if k is not None)
        return pd.DataFrame({"dropped": drop}, dtype="int64")

    dropped = linked.groupBy("label").applyInPandas(fold, "dropped long")
    return rows.join(dropped, F.col(order) == F.col("dropped"), "left_anti")


def chunk_paragraphs(rows: DataFrame, *, key: str, order: str, body: str, budget: int) -> DataFrame:
    """Paragraphs in order while the running length is within ``budget``; the
    one that crosses it is cut."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(body)).over(upto), F.lit(0))
    left = F.greatest(F.lit(0), F.lit(budget) - used)
    return (
        rows.withColumn("_left", left.cast("int"))
        .where("_left > 0")
        .withColumn(body, F.substring(F.col(body), F.lit(1), F.col("_left")))
        .drop("_left")
    )


def split_long_paragraph(rows: DataFrame, *, body: str, limit: int) -> DataFrame:
    """Pieces of at most ``limit`` characters, cut after the last sentence end
    in the second half of the limit where there is one."""
    ends = "。！？.!?；;"

    def pieces(text: str) -> list[str]:
        out = []
        while len(text) > limit:
            at = max(text.rfind(e, limit // 2, limit) for e in ends) + 1
            at = at or limit
            out.append(text[:at])
            text = text[at:]
        return [*out, text] if text else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = pdf[body].fillna("").map(pieces)
            wide = pdf.assign(piece=parts).explode("piece").dropna(subset=["piece"])
            wide["piece_no"] = wide.groupby(level=0).cumcount().astype("int32")
            yield wide

    from pyspark.sql import types as K

    schema = K.StructType([*rows.schema.fields, K.StructField("piece", K.StringType()), K.StructField("piece_no", K.IntegerType())])
    return rows.mapInPandas(run, schema)
