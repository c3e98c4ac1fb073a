"""Tables, fold rules and bounded samples that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.session import table

__all__ = ["bounded_sample", "fold", "table", "tokenizer_path"]

#: Keys that a model is fitted for: 512 of op9's languages are 67 MB of centroids.
MOST_KEYS = 512


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (0 for a null id)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def bounded_sample(rows: DataFrame, key: str, tag: str, per_key: int, *, most_keys: int = MOST_KEYS) -> DataFrame:
    """At most ``per_key`` rows of each key, those with the smallest ``tag``.

    ``tag`` is a 64-bit hash.  Rows are counted by key first, and only those
    whose tag is among the smallest ``2 * per_key`` or so of their key go on, so
    the window holds that many whatever the size of the table.  Rows with equal
    key and tag are one row.  What is fitted on the sample grows with the keys
    and is broadcast, so the sample has the ``most_keys`` keys with the most
    rows, of equals the first; rows of other keys are not sampled.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), key).limit(most_keys).collect()
    shares = rows.sparkSession.createDataFrame(
        [(r[0], min(1.0, (2 * per_key + 64) / r._n)) for r in counts],
        f"`{key}` {rows.schema[key].dataType.simpleString()}, _share double",
    )
    early = rows.join(F.broadcast(shares), key).where(F.col(tag) / F.lit(2.0**64) + F.lit(0.5) < F.col("_share"))
    return (
        early.drop("_share").dropDuplicates([key, tag])
        .withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(tag)))
        .where(F.col("_rank") <= per_key).drop("_rank")
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's vocabulary is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
