"""A query over a paged feed: captures made of the documents, read with a pushed bound."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.positions import with_positions
from tidewire.plans.registry import query
from tidewire.session import checkpoint_folder, table
from tidewire.sources import paged

PAGE, ACCOUNTS, NOW = 20, 16, "2024-03-01T00:00:00Z"
#: Pages that one task writes at a time.
BLOCK_PAGES = 100


def _captured(folder: str):
    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        """Some pages of one account and window, cursors by number; a page or an attempt replaces its file as a whole."""
        account, n = pdf.account.iat[0], -(-int(pdf.total.iat[0]) // PAGE)
        os.makedirs(at := f"{folder}/{account}/{pdf.window.iat[0]}", exist_ok=True)
        for page, rows in pdf.sort_values("place").groupby("page"):
            items = [{"title": f"Doc {r.doc_id}", "url": f"https://example.org/{r.doc_id}", "published_at": r.published_at} for r in rows.itertuples()]
            body = {"ok": True, "data": {"items": items}, "meta": {"has_more": page + 1 < n, "next_cursor": str(page + 1)}}
            part = f"{at}/{uuid.uuid4().hex}.part"
            with open(part, "w", encoding="utf-8") as f:
                json.dump(body, f)
            os.replace(part, f"{at}/{page}.json")
        return pd.DataFrame({"account": [account]})

    return write


@query("paged_scan", f"""WITH d AS (SELECT 'a' || doc_id % {ACCOUNTS} AS account, doc_id, doc_id // 16 % 50 * 6 AS hours FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY doc_id) - 1 AS n FROM d WHERE hours <= 168)
SELECT account, CAST(n // {PAGE} AS INTEGER) AS page, CAST(n % {PAGE} AS INTEGER) AS position, 'Doc ' || doc_id AS title, '7d' AS "window" FROM p WHERE hours <= 120""", bound=False)
def paged_scan(spark: SparkSession, sf: str) -> DataFrame:
    root = f"{checkpoint_folder(spark)}/paged-{uuid.uuid4().hex}"
    d = F.col("doc_id")
    hours = F.floor(d / 16) % 50 * 6
    moment = F.date_format(F.to_timestamp(F.lit(NOW)) - F.make_dt_interval(hours=hours.cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = table(spark, sf, "documents").select(F.concat(F.lit("a"), d % ACCOUNTS).alias("account"), "doc_id", hours.alias("hours"), moment.alias("published_at"))
    rows = rows.withColumn("window", F.explode(F.when(F.col("hours") <= 168, F.array(F.lit("all"), F.lit("7d"))).otherwise(F.array(F.lit("all")))))
    placed = with_positions(rows.drop("hours"), [F.col("account"), F.col("window"), F.col("doc_id")], "place")
    sizes = placed.groupBy("account", "window").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("total"))
    paged_rows = placed.join(F.broadcast(sizes), ["account", "window"]).withColumn("page", F.floor((F.col("place") - F.col("first")) / PAGE))  # two rows for each account
    written = paged_rows.withColumn("block", F.floor(F.col("page") / BLOCK_PAGES)).groupBy("account", "window", "block").applyInPandas(
        _captured(urlsplit(root).path), "account string")
    names = [r.account for r in written.distinct().collect()]  # one row for each account
    paged.register(spark)
    feed = spark.read.format("paged_feed").option("path", root).option("accounts", json.dumps(names)).option("now", NOW).load()
    return feed.where("published_at >= timestamp'2024-02-25 00:00:00'").select("account", "page", "position", "title", "window")
