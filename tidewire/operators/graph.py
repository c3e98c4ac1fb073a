"""Redirects, components and lexicographic choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import checkpointed

MAX_HOPS = 8


def follow_redirects(ids: DataFrame, redirects: DataFrame, *, hops: int = MAX_HOPS) -> DataFrame:
    """``id`` with ``target``: the end of its chain of redirects, or of ``hops``.

    A chain that comes back to an id stops there, so cycles end.  Each hop is
    one join on the current end; an id without a redirect stays.
    """
    table = redirects.select(F.col("source_id").alias("_from"), F.col("target_id").alias("_to"))
    state = ids.select("id").distinct().select("id", F.col("id").alias("target"), F.array("id").alias("seen"))
    for _ in range(hops):
        state = state.join(table, F.col("target") == F.col("_from"), "left").select(
            "id",
            F.when(F.col("_to").isNotNull() & ~F.array_contains("seen", F.col("_to")), F.col("_to"))
            .otherwise(F.col("target")).alias("target"),
            F.when(F.col("_to").isNotNull(), F.array_append("seen", F.col("_to"))).otherwise(F.col("seen")).alias("seen"),
        )
    return state.select("id", "target")


def connected_labels(edges: DataFrame, *, store=checkpointed) -> DataFrame:
    """(src, dst) -> (node, label): the least node of each component.

    In a round every node goes into the first of its neighbours and itself, and
    edges then lead between those that are left.  First is the least node at
    the start, which ends stars at once, and then what a hash, another in each
    round, puts first: so about half of the nodes go, however they are called
    and however long their chains are.  ``store`` cuts the lineage of a table.
    """
    links = store(edges.union(edges.select("dst", "src")).where("src is not null and dst is not null").distinct())
    rounds = []
    while not rounds or not links.isEmpty():
        at = len(rounds)
        order = lambda c: F.struct((F.xxhash64(F.lit(at), c) if at else F.lit(0).cast("long")).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        first = links.groupBy(F.col("src").alias("node")).agg(F.min(order("dst")).alias("near"))
        rounds.append(into := store(first.select("node", F.least(order("node"), "near")["n"].alias("label"))))
        ends = [into.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("src", "dst")]
        moved = links.join(ends[0], "src").join(ends[1], "dst").where("src_label <> dst_label")
        links = store(moved.select(F.col("src_label").alias("src"), F.col("dst_label").alias("dst")).distinct())
    labels = rounds.pop()
    for n, into in enumerate(reversed(rounds), 1):
        ends = labels.select(F.col("node").alias("label"), F.col("label").alias("end"))
        labels = into.join(ends, "label", "left").select("node", F.coalesce("end", "label").alias("label"))
        labels = store(labels) if n % 4 == 0 or n == len(rounds) else labels
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return store(labels.join(least, "label").select("node", F.col("least").alias("label")))


def bucketed(rows: DataFrame, *keys: str, size: int) -> DataFrame:
    """``rows`` with ``bucket``, of about ``size`` rows and with whole keys: many
    small groups are one call of Python.  ``rows`` are counted, so a table is best."""
    buckets = max(1, -(-rows.count() // size))
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))


def best_by(rows: DataFrame, key: str, rank: list) -> DataFrame:
    """The row of each key with the greatest rank (an ordered list of columns)."""
    names = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*names), F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)]))
    return rows.groupBy(key).agg(best.alias("_best")).select(key, *[F.col(f"_best.{n}").alias(n) for n in names])
