"""Streams: late-data rules, idempotent upserts and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "3 days"


def read_events(spark: SparkSession, folder: str, schema, *, files_per_trigger: int = 1) -> DataFrame:
    """A file stream; each trigger takes the next files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(stream: DataFrame, key: str, ts: str) -> DataFrame:
    """First row of each key within the re-read margin."""
    return stream.withWatermark(ts, LATE).dropDuplicatesWithinWatermark([key])


def daily_coverage(stream: DataFrame) -> DataFrame:
    """Reports and sources of each event by local day.

    A local day begins at 16:00 UTC.  The state holds the sources of an event's
    day, so their number is exact.
    """
    day = F.window("ts", "1 day", startTime="16 hours")
    return stream.withWatermark("ts", LATE).groupBy(day.alias("w"), "event_id").agg(
        F.count(F.lit(1)).alias("reports"), F.size(F.collect_set("source_key")).cast("long").alias("sources")
    ).select(F.col("w.start").alias("day_start"), "event_id", "reports", "sources")


def _fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    rate, errors, n = state.get if state.exists else (None, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "ord"])
    for ok in rows.ok:
        rate = float(ok) if rate is None else round(0.8 * rate + 0.2 * float(ok), 4)
        errors = 0 if ok else errors + 1
        n += 1
    state.update((rate, errors, n))
    yield pd.DataFrame({"source_id": [key[0]], "success_rate": [rate], "error_count": [errors], "observations": [n]})


def health_stream(stream: DataFrame) -> DataFrame:
    """Running success rate of each source, kept in state."""
    return stream.groupBy("source_id").applyInPandasWithState(
        _fold, "source_id long, success_rate double, error_count int, observations long",
        "rate double, errors int, n long", "update", "NoTimeout")


def upsert_sink(path: str, key: str, *, order: tuple[str, ...] = ("ts", "event_id")):
    """A foreachBatch function: a keyed merge into a versioned Parquet table.

    The row with the greatest ``order`` stays, whichever batch brings it.  Each
    batch writes a version of its own, named by the query and the batch number,
    after the newest finished one; a batch that is sent again finds its version
    and does nothing.  A query with a new checkpoint has another name, so its
    numbers, which start anew, are not taken for done.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        root = fs.Path(path)
        system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        done = []
        for status in system.listStatus(root) if system.exists(root) else []:
            name = status.getPath().getName()
            if name.startswith("v=") and system.exists(fs.Path(status.getPath(), "_SUCCESS")):
                done.append((int(name[2:].split("-", 1)[0]), name))
        if any(name.endswith(f"-{query}-{number}") for _, name in done):
            return
        rows = batch
        if done:
            rows = spark.read.parquet(f"{path}/{max(done)[1]}").unionByName(batch)
        latest = rows.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("x")).select("x.*")
        version = max(done)[0] + 1 if done else 0
        latest.write.mode("overwrite").parquet(f"{path}/v={version:08d}-{query}-{number}")

    return write


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    """What the sink's newest finished version holds."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath() for s in system.listStatus(root)]
    done = [p.getName() for p in names if p.getName().startswith("v=") and system.exists(fs.Path(p, "_SUCCESS"))]
    return spark.read.parquet(f"{path}/{max(done)}")


def replayed(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stateful stream over all that is there, and read its last result."""
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out-{number:08d}")

    run = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(store)
    handle = run.trigger(availableNow=True).start()
    handle.awaitTermination()
    last = handle.lastProgress["batchId"] if handle.lastProgress else 0
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out-{last:08d}")
