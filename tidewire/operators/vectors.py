"""Article vectors: one for each article, from text by hashing, replaced and dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 512
DIGEST_BYTES = 32


def hash_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A vector in [-1, 1] that depends on the lower-cased text alone.

    Its values are the bytes of the text's SHA-256 digest, of that digest's
    digest, and so on.  A null text is an empty one.
    """
    rounds = -(-dimensions // DIGEST_BYTES)
    first = F.sha2(F.lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)
    chain = first if rounds == 1 else F.aggregate(
        F.sequence(F.lit(2), F.lit(rounds)), first,
        lambda digits, _: F.concat(digits, F.sha2(F.unhex(F.right(digits, F.lit(2 * DIGEST_BYTES))), 256)))
    value = lambda digits, i: F.conv(F.substr(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / F.lit(255.0) * 2 - 1
    # through an array of one, so that the digits are made once for all places
    return F.flatten(F.transform(F.array(chain), lambda digits: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: value(digits, i))))


def upsert_vectors(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``stored`` with the vectors of a batch: one for each article, the batch's
    where there is one; a run id that the batch doesn't give stays.

    Both: article_id, model, vector, source_hash, run_id.
    """
    old = stored.select("article_id", F.col("run_id").alias("_run"))
    fresh = incoming.join(old, "article_id", "left").withColumn("run_id", F.coalesce("run_id", "_run")).drop("_run")
    return stored.join(incoming.select("article_id"), "article_id", "left_anti").unionByName(fresh)


def drop_vectors(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """``stored`` without the vectors of some articles."""
    return stored.join(gone.select("article_id").distinct(), "article_id", "left_anti")


def current_vectors(stored: DataFrame, inputs: DataFrame) -> DataFrame:
    """The vectors that were made from what their articles say now.

    ``inputs``: article_id, source_hash.
    """
    return stored.join(inputs.select("article_id", F.col("source_hash").alias("_now")), "article_id").where(F.col("source_hash").eqNullSafe(F.col("_now"))).drop("_now")
