"""The stored events as the state of a stream of groups.

Groups look for events by article, by source and by similarity at once, so no
key sends a group to its event before the search; the state is a table, and each
micro-batch is one run of ``event_store.upsert_groups`` over it.  A micro-batch
writes the events it changes under a name of its own, so one that is sent again
finds its folder and does nothing.  The window plays the part of a time limit of
state: an event not seen within it is only reached by its own articles or id.
Late groups meet the events as they are by then, under their own times.

After ``PARTS`` folders of changes a micro-batch writes all events in place of
its changes, and what came before is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.event_store import EVENT, changed_store, empty_store, upsert_groups
from tidewire.session import checkpointed

PARTS = 16


def _folders(spark: SparkSession, path: str) -> list[tuple[int, bool, str]]:
    """(number, whether it holds all events, name) of the finished folders in order."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in system.listStatus(root) if system.exists(root) else []:
        kind, _, rest = (name := status.getPath().getName()).partition("=")
        if kind in ("all", "part") and system.exists(fs.Path(status.getPath(), "_SUCCESS")):
            found.append((int(rest.split("-", 1)[0]), kind == "all", name))
    return sorted(found)


def stored_events(spark: SparkSession, path: str) -> DataFrame:
    """The events as the last finished micro-batch left them."""
    folders = _folders(spark, path)
    last = max((i for i, (_, everything, _) in enumerate(folders) if everything), default=0)
    rows = None
    for number, _, name in folders[last:]:
        own = spark.read.schema(EVENT).parquet(f"{path}/{name}").withColumn("_n", F.lit(number))
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        return empty_store(spark)
    return rows.groupBy("event_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "_n"]), "_n").alias("e")).select("e.*")


def event_sink(path: str, facts: DataFrame, *, threshold: float = 0.85, window_hours: float = 72, parts: int = PARTS):
    """A foreachBatch function; ``facts`` are those of ``event_store.article_facts``."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        folders = _folders(spark, path)
        if any(name.endswith(f"-{query}-{number}") for _, _, name in folders):
            return
        store = checkpointed(stored_events(spark, path))
        changes = upsert_groups(store, batch, facts, threshold=threshold, window_hours=window_hours)
        at = folders[-1][0] + 1 if folders else 0
        since = len(folders) - max((i for i, (_, everything, _) in enumerate(folders) if everything), default=0)
        if since < parts:
            changes.select(*store.columns).write.mode("overwrite").parquet(f"{path}/part={at:08d}-{query}-{number}")
            return
        changed_store(store, checkpointed(changes)).write.mode("overwrite").parquet(f"{path}/all={at:08d}-{query}-{number}")
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        system = fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for _, _, name in folders:
            system.delete(fs.Path(path, name), True)

    return write


def take_groups(groups: DataFrame, path: str, checkpoint: str, facts: DataFrame, **options):
    """Start the stream of ``groups`` (columns of ``event_store.with_articles``) over all that is there."""
    run = groups.writeStream.option("checkpointLocation", checkpoint).foreachBatch(event_sink(path, facts, **options))
    return run.trigger(availableNow=True).start()
