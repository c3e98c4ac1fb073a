"""Token counts: rollups by source, language and tokenizer version, kept by deltas.

A batch of changes holds one row for each document that changed, with its
image before and after: an insert has no *before*, a delete no *after*, a
revised count or a new tokenizer version both.  Each image becomes a signed row
(-1 and minus the tokens, +1 and the tokens), signed rows are summed by key,
with partial sums where they are read, and added to the totals.

Totals are versions in a folder that all machines share::

    log/00000007.json     {"batch": ..., "state": "state-<uuid>"}
    state-<uuid>/         Parquet: key columns, n_docs, n_tokens

A commit first writes its state, then creates the log entry of the next number
with "create, fail if it exists".  A batch whose name is in the log is skipped,
so a repeated or half-finished run leaves the totals as one run does, and of
two writers one has to read again.  Reads see whole versions only.

Defined results: null key columns are keys of their own; a null token count is
0; keys whose documents are all gone drop out; an empty batch commits and
changes nothing; rows that repeat in a batch count as often as they occur.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import WORD
from .storage import work_folder, written

KEYS = ("source", "lang", "tokenizer")
#: Letters and digits of a word, or one other visible character.
PIECE = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"


class DeltaLog:
    """Numbered log entries, created atomically through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark.sparkContext._jvm, folder
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(f"{folder}/log")
        self.system = self.root.getFileSystem(conf)

    def entries(self) -> list[dict]:
        """All commits in order."""
        if not self.system.exists(self.root):
            return []
        found = []
        for status in self.system.listStatus(self.root):
            path = status.getPath()
            if path.getName().endswith(".json"):
                stream = self.system.open(path)
                try:
                    text = bytes(stream.readAllBytes()).decode()
                finally:
                    stream.close()
                if text:
                    found.append((path.getName(), json.loads(text)))
        return [entry for _, entry in sorted(found, key=lambda x: x[0])]

    def append(self, number: int, entry: dict) -> bool:
        """Create entry ``number``; False if another writer was first."""
        part = self.jvm.org.apache.hadoop.fs.Path(self.root, f".{uuid.uuid4().hex}")
        path = self.jvm.org.apache.hadoop.fs.Path(self.root, f"{number:08d}.json")
        self.system.mkdirs(self.root)
        stream = self.system.create(part, False)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        if self.system.exists(path):
            self.system.delete(part, False)
            return False
        try:
            return bool(self.system.rename(part, path))
        except Exception:  # rename onto a file that appeared meanwhile
            return False


class TokenRollup:
    """Additive totals under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.log = DeltaLog(spark, folder)

    def totals(self) -> DataFrame:
        """The newest committed totals."""
        entries = self.log.entries()
        schema = ", ".join(f"{k} string" for k in KEYS) + ", n_docs long, n_tokens long"
        if not entries:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{entries[-1]['state']}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply one batch once; False if it was there already."""
        delta = signed(changes).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        while True:
            entries = self.log.entries()
            if any(e["batch"] == batch for e in entries):
                return False
            state = f"state-{uuid.uuid4().hex}"
            (
                self.totals().unionByName(delta).groupBy(*KEYS)
                .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .where("n_docs <> 0 or n_tokens <> 0")
                .write.parquet(f"{self.folder}/{state}")
            )
            if self.log.append(len(entries), {"batch": batch, "state": state}):
                return True


def image(docs: DataFrame, tokenizer: str, tokens) -> DataFrame:
    """Documents with what a change row says of them."""
    return docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(tokenizer).alias("tokenizer"),
        tokens.cast("long").alias("n_tokens"),
    )


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(None).cast(rows.select(F.struct("*").alias("x")).schema[0].dataType).alias("before"),
                       F.struct("*").alias("after"))


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(F.struct("*").alias("before"),
                       F.lit(None).cast(rows.select(F.struct("*").alias("x")).schema[0].dataType).alias("after"))


def revisions(docs: DataFrame, old: tuple, new: tuple) -> DataFrame:
    """Documents that move from one (tokenizer, count) to another."""
    def own(tokenizer, tokens):
        return F.struct(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                        F.lit(tokenizer).alias("tokenizer"), tokens.cast("long").alias("n_tokens"))

    return docs.select(own(*old).alias("before"), own(*new).alias("after"))


def signed(changes: DataFrame) -> DataFrame:
    """before/after images -> signed rows of key, n_docs, n_tokens."""
    both = changes.select(F.explode(F.array(
        F.struct(F.lit(-1).cast("long").alias("sign"), F.col("before").alias("x")),
        F.struct(F.lit(1).cast("long").alias("sign"), F.col("after").alias("x")),
    )).alias("s")).where("s.x is not null")
    return both.select(
        *[F.col(f"s.x.{k}").alias(k) for k in KEYS],
        F.col("s.sign").alias("n_docs"),
        (F.col("s.sign") * F.coalesce("s.x.n_tokens", F.lit(0))).alias("n_tokens"),
    )


def words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def pieces(text):
    return F.coalesce(F.regexp_count(text, F.lit(PIECE)), F.lit(0))


def rollup_history(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The life of a corpus as four batches, and the totals they leave.

    All documents are loaded under tokenizer ``words-1``; documents whose text
    an earlier document has are deleted; those not in English are counted anew
    by ``pieces-2``; then a count of English documents is revised.  Batches
    are sent again after the others, as a restarted job does; they change
    nothing.
    """
    spark = docs.sparkSession
    store = TokenRollup(spark, folder or work_folder(spark, "rollup"))
    rows = docs.select("doc_id", "source", "lang", "text").withColumn("_md5", F.md5("text"))
    counted = rows.select("doc_id", "source", "lang", "_md5", words(F.col("text")).alias("w"), pieces(F.col("text")).alias("p"))
    counted = written(counted, f"{store.folder}/counted")
    first = counted.where("_md5 is not null").groupBy("_md5").agg(F.min("doc_id").alias("_first"))
    first = written(first, f"{store.folder}/first")
    marked = counted.join(first.withColumnRenamed("_md5", "_key"), F.col("_md5") == F.col("_key"), "left")
    repeated = marked.where("doc_id > _first")
    kept = marked.where("not coalesce(doc_id > _first, false)")
    foreign = kept.where("lang is null or lang <> 'en'")
    native = kept.where("lang = 'en' and p > 2 * w")
    batches = {
        "load": inserts(image(counted, "words-1", F.col("w"))),
        "exact-copies": deletes(image(repeated, "words-1", F.col("w"))),
        "retokenize": revisions(foreign, ("words-1", F.col("w")), ("pieces-2", F.col("p"))),
        "recount": revisions(native, ("words-1", F.col("w")), ("words-1", F.col("p"))),
    }
    for name, changes in batches.items():
        store.commit(name, changes)
    for name in ("load", "retokenize"):
        store.commit(name, batches[name])
    return store.totals()
