"""Reports of one event: candidates, greedy grouping, merges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators.greedy import grouped
from tidewire.operators.positions import with_positions
from tidewire.operators.views import ROLE_RANK, TIER_RANK, cluster_id, ranked

SPAN_HOURS = 24
BLOCK_ROWS = 1000


def similar_pairs(vectors: DataFrame, *, threshold: float, span_hours: float | None = None) -> DataFrame:
    """(a, b, similarity) with a < b and cosine of at least ``threshold``.

    With a span, rows meet only in the same or the next time band, so the work
    follows the density of the feed; without one all rows are one band.  A band
    is cut into blocks of about ``BLOCK_ROWS`` rows, and each pair of blocks is
    one product of two matrices; only pairs over the threshold are rows.  So a
    band of any density is many tasks of bounded size.
    """
    seconds = int(span_hours * 3600) if span_hours else None
    band = F.floor(F.unix_timestamp("ts") / seconds) if seconds else F.lit(0).cast("long")
    rows = vectors.select("id", "vec", (F.unix_micros("ts") if seconds else F.lit(0).cast("long")).alias("at"), band.alias("band"))
    blocks = rows.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("n"))
    near = lambda by, name: blocks.select((F.col("band") + by).alias("band"), F.col("n").alias(name))
    rows = rows.join(near(0, "own"), "band").join(near(-1, "after"), "band", "left").join(near(1, "before"), "band", "left")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("own")).cast("int"))
    zero = F.lit(0)
    every = lambda n: F.when(F.coalesce(n, zero) > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<int>"))

    def met(others, role: int, left, right):
        return F.transform(others, lambda t: F.struct(*left(t), *right(t), F.lit(role).alias("role")))

    lead = lambda b, t: (F.col("band").alias("b1") if b is None else b.alias("b1"), t.alias("s1"))
    last = lambda b, t: (b.alias("b2"), t.alias("s2"))
    here, mine = F.col("band"), F.col("block")
    parts = [
        met(F.filter(every(F.col("own")), lambda t: t >= mine), 0, lambda t: lead(None, mine), lambda t: last(here, t)),
        met(F.filter(every(F.col("own")), lambda t: t <= mine), 1, lambda t: lead(None, t), lambda t: last(here, mine)),
    ]
    if seconds:
        parts += [
            met(every(F.col("after")), 0, lambda t: lead(None, mine), lambda t: last(here + 1, t)),
            met(every(F.col("before")), 1, lambda t: lead(here - 1, t), lambda t: last(here, mine)),
        ]
    dealt = rows.select("id", "vec", "at", F.explode(F.concat(*parts)).alias("p")).select("id", "vec", "at", "p.*")
    kind = vectors.schema["id"].dataType.simpleString()
    return dealt.groupBy("b1", "s1", "b2", "s2").applyInPandas(
        _block_pairs(threshold, seconds), f"a {kind}, b {kind}, similarity double")


def _block_pairs(threshold: float, seconds: int | None):
    def pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs of one block pair; a block with itself gives each pair once."""
        same = key[0] == key[2] and key[1] == key[3]
        pdf = pdf[pdf.vec.notna()]
        widths, out = pdf.vec.map(len), []
        for width in widths.unique():
            left, right = (pdf[(pdf.role == r) & (widths == width)] for r in (0, 1))
            if not len(left) or not len(right):
                continue
            u, v = (np.stack([np.asarray(x, float) for x in side.vec]) for side in (left, right))
            u, v = (m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1) for m in (u, v))
            score = u @ v.T
            keep = score >= threshold
            if seconds is not None:
                keep &= np.abs(left["at"].to_numpy()[:, None] - right["at"].to_numpy()[None, :]) <= seconds * 10**6
            i, j = np.nonzero(keep)
            x, y = left.id.to_numpy()[i], right.id.to_numpy()[j]
            once = x < y if same else x != y
            x, y, near = x[once], y[once], score[i, j][once]
            out.append(pd.DataFrame({"a": np.where(x < y, x, y), "b": np.where(x < y, y, x), "similarity": near}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "similarity": []}, dtype=object)

    return pairs


def centroids(members: DataFrame) -> DataFrame:
    """Component means of each event's vectors of the usual width."""
    width = members.groupBy("event_id").agg(F.max(F.size("vec")).alias("_w"))
    usable = members.join(width, "event_id").where("size(vec) = _w")
    parts = usable.select("event_id", F.posexplode("vec").alias("pos", "x")).groupBy("event_id", "pos").agg(
        F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy("event_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("centroid"))


def reference_matches(articles: DataFrame, events: DataFrame) -> DataFrame:
    """Per article the best recent event that cites one of its sources.

    ``articles``: article_id, keys; ``events``: event_id, keys and the rank
    columns can_be_main, role, tier, final_score, source_count, last_seen_at.
    The best event of a source comes first, so an article meets one event for
    each of its keys, however many cite them.
    """
    left = articles.select("article_id", F.explode(F.array_distinct("keys")).alias("key"))
    right = events.withColumn("key", F.explode(F.array_distinct("keys"))).drop("keys")
    rank = F.struct(F.col("can_be_main").cast("int"), ranked(F.col("role"), ROLE_RANK), ranked(F.col("tier"), TIER_RANK),
                    F.col("final_score"), F.col("source_count"), F.col("last_seen_at"), F.col("event_id"))
    best = right.groupBy("key").agg(F.max(rank).alias("best"))
    return left.join(best, "key").groupBy("article_id").agg(F.max("best").alias("best")).select("article_id", "best.event_id")


def merge_rank(events: DataFrame) -> DataFrame:
    """Events from the best to keep to the first to fold away."""
    order = [F.desc("can_be_main"), ranked(F.col("role"), ROLE_RANK).desc(), ranked(F.col("tier"), TIER_RANK).desc(),
             F.desc("final_score"), F.desc("source_count"), F.desc("last_seen_at"), F.desc("event_id")]
    return with_positions(events, order, "merge_rank")


def cluster_articles(
    articles: DataFrame, *, threshold: float = 0.90, span_hours: float | None = SPAN_HOURS, verdicts: DataFrame | None = None
) -> DataFrame:
    """(article_id, main_article_id, event_id) by the rule of ``greedy``.

    ``articles``: article_id, ts, ord, vec (null allowed), keys, and the rank
    columns can_be_main, role, tier, final_score, content_length.  ``verdicts``
    (low_id, high_id, same) are outside answers to whether two articles report
    the same event; a pair without one is not the same.  With a table of them
    similarity alone joins nothing, and the gray band opens; without one the
    band stays closed.
    """
    both = [F.lit(0)]
    by_key = articles.select("article_id", F.explode(F.array_distinct("keys")).alias("key"), F.lit(0).cast("long").alias("band"))
    if span_hours is not None:
        both = [F.lit(0), F.lit(1)]
        by_key = articles.select("article_id", F.explode(F.array_distinct("keys")).alias("key"), F.floor(
            F.unix_micros("ts") / F.lit(int(span_hours * 3600 * 10**6))).alias("band"))
    by_key = by_key.withColumn("band", F.explode(F.array(*[F.col("band") + n for n in both])))
    hubs = by_key.groupBy("key", "band").agg(F.min("article_id").alias("hub"))
    links = by_key.join(hubs, ["key", "band"]).where("hub <> article_id").select(F.col("hub").alias("src"), F.col("article_id").alias("dst"))
    if verdicts is None:
        vectors = articles.where("vec is not null").select(F.col("article_id").alias("id"), "vec", "ts")
        near = similar_pairs(vectors, threshold=threshold, span_hours=span_hours)
        links = links.union(near.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    found = grouped(articles, links, threshold=threshold, span_hours=span_hours, verdicts=verdicts)
    rank = F.struct(
        F.col("can_be_main").cast("int").alias("lead"), ranked(F.col("role"), ROLE_RANK).alias("role"), ranked(F.col("tier"), TIER_RANK).alias("tier"),
        "final_score", "ts", "content_length", (-F.col("ord")).alias("first"))
    mains = found.join(articles, "article_id").groupBy("founder_id").agg(F.max_by("article_id", rank).alias("main_article_id"))
    return found.join(mains, "founder_id").select("article_id", "main_article_id", cluster_id(F.col("main_article_id")).alias("event_id"))


def text_affinity(pairs: DataFrame, *, tasks: int | None = None) -> DataFrame:
    """Bigram affinity and sequence ratio of two titles, and the larger.

    Titles are few bytes and much work, so by their bytes they would be joined
    into few tasks; ``tasks`` deals the pairs to that many.
    """
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right, strict=True)])

    left, right = T.event_title(F.col("left_title")), T.event_title(F.col("right_title"))
    rows = (pairs if tasks is None else pairs.repartition(tasks)).withColumn("bigram", T.bigram_affinity(T.bigrams(F.col("left_title")), T.bigrams(F.col("right_title"))))
    rows = rows.withColumn("sequence", ratio(left, right))
    return rows.withColumn("affinity", F.greatest("bigram", "sequence"))


def merge_events(membership: DataFrame, merges: DataFrame) -> DataFrame:
    """Memberships after folding events into their targets; one row for each
    article, and only the target's main stays main."""
    table = merges.select(F.col("source_id").alias("event_id"), "target_id")
    moved = membership.join(table, "event_id", "left")
    return moved.select(
        F.coalesce("target_id", "event_id").alias("event_id"), "article_id",
        (F.col("is_main") & F.col("target_id").isNull()).alias("is_main"),
    ).dropDuplicates(["event_id", "article_id"])
