"""Ledgers: usage, cost, source health, scoring models, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.time import local_day

COUNTERS = ["calls", "prompt_tokens", "cache_hit_tokens", "cache_miss_tokens", "completion_tokens", "reasoning_tokens"]


def usage_by_day(usage: DataFrame) -> DataFrame:
    """Sums of all counters by local day, model and operation."""
    return usage.groupBy(local_day(F.col("recorded_at")).alias("day"), "model", "operation").agg(
        *[F.sum(c).alias(c) for c in COUNTERS]
    )


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Micro-cost by model and operation with subtotals, from prices per million.

    ``prices`` holds one row for each model (a configuration table).
    """
    cost = (F.col("cache_hit_tokens") * F.col("hit_price") + F.col("cache_miss_tokens") * F.col("miss_price")
            + F.col("completion_tokens") * F.col("out_price"))
    priced = usage.join(prices, "model", "left").withColumn("cost_micro", cost)
    return priced.rollup("model", "operation").agg(
        F.sum("calls").alias("calls"), F.sum("cost_micro").alias("cost_micro"),
        F.sum("cache_hit_tokens").alias("hit_tokens"), F.sum("prompt_tokens").alias("prompt_tokens"),
    )


def normalize_usage(rows: DataFrame) -> DataFrame:
    """Two vendors' spellings of cache counters; misses are what is left."""
    hit = F.coalesce("prompt_cache_hit_tokens", "cached_tokens", F.lit(0))
    miss = F.coalesce("prompt_cache_miss_tokens", F.greatest(F.lit(0), F.col("prompt_tokens") - hit))
    return rows.withColumn("cache_hit_tokens", hit).withColumn("cache_miss_tokens", miss)


def health_average(observations: DataFrame) -> DataFrame:
    """Per source in time order: the first observation, then 0.8 old + 0.2 new
    rounded to four places, and the current streak of failures.

    The rounding makes each step depend on the one before, so each source is
    one ordered fold; its observations are the log of one source.
    """
    log = F.array_sort(F.collect_list(F.struct("ts", "ord", F.col("ok").cast("int").alias("ok"))))
    folded = F.aggregate(
        F.col("log"),
        F.struct(F.lit(None).cast("decimal(20,10)").alias("rate"), F.lit(0).alias("errors")),
        lambda s, x: F.struct(
            F.when(s.rate.isNull(), x.ok.cast("decimal(20,10)"))
            .otherwise(F.bround(s.rate * F.lit("0.8").cast("decimal(2,1)") + x.ok * F.lit("0.2").cast("decimal(2,1)"), 4).cast("decimal(20,10)")).alias("rate"),
            F.when(x.ok == 1, 0).otherwise(s.errors + 1).alias("errors"),
        ),
    )
    return (
        observations.groupBy("source_id").agg(log.alias("log")).withColumn("state", folded)
        .select("source_id", F.col("state.rate").cast("double").alias("success_rate"),
                F.col("state.errors").alias("error_count"), F.size("log").cast("long").alias("observations"))
    )


def model_segments(runs: DataFrame, *, keys: list[str] = ()) -> DataFrame:
    """Runs of the same model in time order, collapsed to their starts."""
    order = Window.partitionBy(*keys).orderBy("ts", "ord")
    return runs.withColumn("_before", F.lag("model").over(order)).where(
        F.col("_before").isNull() | (F.col("_before") != F.col("model"))
    ).select(*keys, "ts", "ord", "model")


def asof_model(moments: DataFrame, segments: DataFrame, *, key: str, legacy: str) -> DataFrame:
    """For each moment the model of the latest segment that began by then.

    Both sides are one ordered stream for each key; no range join.
    """
    a = moments.select(key, "ts", F.lit(1).alias("_side"), "id", F.lit(None).cast("string").alias("model"))
    b = segments.select(key, "ts", F.lit(0).alias("_side"), F.lit(None).cast("long").alias("id"), "model")
    upto = Window.partitionBy(key).orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("model", ignorenulls=True).over(upto)
    return a.unionByName(b).withColumn("_model", last).where("_side = 1").select(
        key, "id", "ts", F.coalesce("_model", F.lit(legacy)).alias("model")
    )


def score_range(items: DataFrame) -> DataFrame:
    return items.groupBy(F.coalesce("model_used", F.lit("")).alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.min("final_score").alias("lowest"), F.max("final_score").alias("highest")
    )


def run_metrics(runs: DataFrame, limit: int = 20) -> DataFrame:
    """Latest runs with the duplicates they met; unknown stays unknown."""
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(limit).withColumn(
        "duplicate_count", F.col("raw_count") - F.col("new_raw_count") - F.col("non_ai_dropped_count")
    )


def sweep_stale(runs: DataFrame, now, minutes: int = 45) -> DataFrame:
    """Runs that are running for too long become failed."""
    old = (F.col("status") == "running") & (F.col("started_at") < F.lit(now) - F.expr(f"INTERVAL {minutes} MINUTES"))
    return runs.withColumn("finished_at", F.when(old, F.lit(now)).otherwise(F.col("finished_at"))).withColumn(
        "status", F.when(old, "failed").otherwise(F.col("status")))


def transitions(before: Column, after: Column, rows: DataFrame) -> DataFrame:
    return rows.groupBy(before.alias("before"), after.alias("after")).agg(F.count(F.lit(1)).alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of named tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
