"""Mixing sources to target weights, in DataFrame functions alone.

Tokens are aggregated per source; targets are the water level of the weights
under a cap for each source; a document is emitted ``floor(rate)`` times plus
one hash-seeded Bernoulli copy with probability ``rate - floor(rate)``.

Scale: the documents are never shuffled while the table of sources is small.
Its size is counted; up to ``BROADCAST_SOURCES`` rows it is broadcast, beyond
that both sides are dealt by (source, salt), so a hot source has many tasks.
Places of sources come from ranges and prefix sums, the water level from a few
aggregates over the sources, so no task holds all sources either.

Defined results: a null or empty text has size 0; texts are read whole at any
length; a null source is a source of its own and comes last; a source without
words has target 0 and is not taken; the draw depends on the seed, the
document id (null draws as an empty string) and the text; rows that repeat
both are counted by all their columns and numbered from 1, and the number draws
as well, so equal rows have draws of their own whatever the layout of the input
(rows that differ in other columns alone are numbered apart, and share draws); of
sources with equal ratios of cap and weight all or none reach the cap; an
empty table gives an empty result; other columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.positions import with_positions

from .storage import work_folder, written

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
BROADCAST_SOURCES = 100_000
SALTS = 64


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, cycle=CYCLE, share=SHARE, cap=CAP) -> DataFrame:
    """(source, source_size) -> the same with weight and target.

    A source's target is its weight times the water level, or its cap if that
    is less.  The level rises as capped sources leave their excess to the
    others, and settles when no further source reaches its cap.
    """
    placed = with_positions(sizes, [F.col("source").asc_nulls_last()], "_place")
    at = F.pmod(F.col("_place") - 1, F.lit(len(cycle)))
    weight = F.lit(cycle[-1])
    for i, w in enumerate(cycle[:-1]):
        weight = F.when(at == i, F.lit(w)).otherwise(weight)
    rows = placed.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    ratio = F.col("most") / F.col("weight")
    whole = rows.agg(F.sum("source_size") * F.lit(share), F.sum("weight")).first()
    total, weights = (whole[0] or 0.0), (whole[1] or 0.0)
    level, full, spent = -1.0, 0.0, 0.0
    while weights > spent and (next_level := (total - full) / (weights - spent)) != level:
        level = next_level
        capped = rows.where(ratio <= F.lit(level)).agg(F.sum("most"), F.sum("weight")).first()
        full, spent = capped[0] or 0.0, capped[1] or 0.0
    own = F.col("most") if weights <= spent else F.least("most", F.col("weight") * F.lit(level))
    return rows.select("source", "source_size", "weight", own.alias("target"))


def draw(doc_id: Column, text: Column, tie: Column, seed: str) -> Column:
    """A number in [0, 1) from id, text and seed, the same in every run."""
    own = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.md5(text), F.lit("")), tie)
    return F.conv(F.substring(F.md5(own), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def _with_ties(docs: DataFrame, folder: str) -> DataFrame:
    """``docs`` with ``_tie``: empty, or the number of a row that repeats id and text.

    Equal rows are interchangeable, so those that repeat are summed up, which
    happens before they are shuffled, and laid out again with numbers.
    """
    key = [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash")]
    again = written(docs.select(*key).groupBy("_id", "_hash").count().where("count > 1").drop("count"), f"{folder}/again")
    n = again.count()
    if not n:
        return docs.withColumn("_tie", F.lit(""))
    again = F.broadcast(again) if n <= BROADCAST_SOURCES else again
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    rows = [F.col(f"`{c}`") for c in docs.columns]
    counted = docs.join(again, same, "left_semi").groupBy(*rows).agg(F.count(F.lit(1)).alias("_n"))
    numbered = counted.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    numbered = numbered.select(*rows, F.col("_k").cast("string").alias("_tie"))
    return docs.join(again, same, "left_anti").withColumn("_tie", F.lit("")).unionByName(numbered)


def _with_targets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    named = targets.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if targets.count() <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(named), same).drop("_source")
    salted = docs.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
    spread = named.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(spread, same & (F.col("_salt") == F.col("_slot")))
    return joined.drop("_source", "_salt", "_slot")


def mix_copies(
    docs: DataFrame, *, seed: str = "mix-1", cycle=CYCLE, share=SHARE, cap=CAP
) -> DataFrame:
    """``docs`` with size, source_size, target and the number of copies."""
    folder = work_folder(docs.sparkSession, "mix")
    sums = docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sums, cycle=cycle, share=share, cap=cap).drop("weight"), f"{folder}/targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(F.col("_rate"))
    extra = (draw(F.col("doc_id"), F.col("text"), F.col("_tie"), seed) < F.col("_rate") - whole).cast("long")
    sized = _with_ties(docs, folder).withColumn("size", word_count(F.col("text")))
    return (
        _with_targets(sized, targets)
        .withColumn("_rate", rate)
        .withColumn("copies", (whole + extra).cast("long"))
        .drop("_rate", "_tie")
    )


def mixing_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: size, source_size, target of its source, words taken."""
    rows = mix_copies(docs.select("doc_id", "source", "text"), **options)
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken."""
    renamed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source", "text"
    )
    rows = mix_copies(renamed, **options).where(F.col("copies") > 0)
    return rows.select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")
