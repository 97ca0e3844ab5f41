"""Queues, leases and windows: batch transforms and Structured Streaming forms of the same rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes
from ..operators import relational as rel

# Legal steps of the demonstration outbox.
LEGAL = ("view>click", "click>purchase", "view>view", "signup>view", "click>view", "purchase>view")


def expire(jobs: DataFrame, now: Column, max_attempts: int) -> DataFrame:
    """State after a sweep: running leases past their end are queued again, or dead after too many attempts."""
    over = F.col("lease_until") <= now
    state = F.when(over & (F.col("attempts") >= max_attempts), "dead_letter").when(over, "queued").otherwise("running")
    return jobs.withColumn("state", state)


def claim(jobs: DataFrame, now: Column, lease: str, limit: int) -> DataFrame:
    """The oldest queued jobs become running, with one more attempt and a lease from ``now``."""
    picked = jobs.where("state = 'queued'").orderBy("updated_at", "job_id").limit(limit).select("job_id", F.lit(True).alias("_mine"))
    j = jobs.join(picked, "job_id", "left")
    mine = F.coalesce("_mine", F.lit(False))
    return j.select(
        *[c for c in jobs.columns if c not in ("state", "attempts", "lease_until")],
        F.when(mine, "running").otherwise(F.col("state")).alias("state"),
        (F.col("attempts") + mine.cast("int")).alias("attempts"),
        F.when(mine, now + F.expr(f"interval {lease}")).otherwise(F.col("lease_until")).alias("lease_until"),
    )


def plan(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Idempotent insert: wanted jobs whose id is unknown are queued; known ones stay as they are."""
    fresh = wanted.join(jobs.select("job_id"), "job_id", "left_anti").dropDuplicates(["job_id"])
    return jobs.unionByName(fresh, allowMissingColumns=True)


def windows(stream: DataFrame, time: str, size: str, late: str, keys: list[str]) -> DataFrame:
    """Tumbling counts with a watermark; late rows beyond it are dropped by the engine."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"))


def dedupe(stream: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def lease_states(stream: DataFrame, max_attempts: int = 5) -> DataFrame:
    """State machine per job over (job_id, event, at): claim, done, fail; a fifth failure is dead.

    State is one row per job; a step out of order leaves it as it was.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, attempts = state.get if state.exists else ("queued", 0)
        for f in frames:
            for event in f.sort_values("at")["event"]:
                if event == "claim" and status == "queued":
                    status, attempts = "running", attempts + 1
                elif event == "done" and status == "running":
                    status = "done"
                elif event == "fail" and status == "running":
                    status = "dead" if attempts >= max_attempts else "queued"
        state.update((status, attempts))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts]})

    return stream.groupBy("job_id").applyInPandasWithState(step, "job_id long, status string, attempts int", "status string, attempts int", "update", "NoTimeout")


#: Parts of a keyed table that are rewritten by themselves.
BUCKETS = 64


def _parts(spark, path: str, before: int | None = None) -> dict[int, str]:
    """The newest folder of each bucket among epochs that were written whole (their _SUCCESS file is there)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, str] = {}
    if not fs.exists(root):
        return out
    epochs = sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(root) if f.getPath().getName().startswith("epoch="))
    for e in epochs:
        folder = hadoop.Path(f"{path}/epoch={e}")
        if (before is None or e < before) and fs.exists(hadoop.Path(folder, "_SUCCESS")):
            out |= {int(f.getPath().getName().split("=")[1]): f"{folder}/{f.getPath().getName()}" for f in fs.listStatus(folder) if f.getPath().getName().startswith("_bucket=")}
    return out


def read_upserts(spark, path: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The table that ``upsert_sink`` keeps, as of its last whole epoch (or the last below ``before``); None before the first."""
    parts = {b: p for b, p in _parts(spark, path, before).items() if buckets is None or b in buckets}
    return spark.read.parquet(*parts.values()) if parts else None


def upsert_sink(path: str, keys: list[str], newest: str):
    """A foreachBatch function that keeps the newest row of each key in Parquet.

    Keys are dealt to BUCKETS parts. An epoch rewrites only the parts that its batch touches, into
    a folder of its own, which counts once it is whole; readers take each part's newest. So a batch
    that is run again after a failure reads what stood before it and gives the same result.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = rel.latest(batch, keys, [F.desc(newest)]).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # BUCKETS at most
        if not touched:
            return
        known = read_upserts(spark, path, epoch, touched)
        if known is not None:
            both = known.unionByName(rows.drop("_bucket"), allowMissingColumns=True)
            rows = rel.latest(both, keys, [F.desc(newest)]).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/epoch={epoch}")

    return write


def hashed_files(files: DataFrame) -> DataFrame:
    """(path, hash, size, modified) of binary files."""
    return files.select("path", F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def follow_folder(spark: SparkSession, root: str, pattern: str, sink: str, checkpoint: str) -> None:
    """Takes in the files that are new since the last call, each once, whatever fails in between.

    The source remembers paths in the checkpoint, and the sink is keyed by path, so a batch that
    is run again changes nothing. A file that changes in place is new to no file source: ``rescan_folder``
    finds those.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    hashed_files(files).writeStream.foreachBatch(upsert_sink(sink, ["path"], "modified")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def rescan_folder(spark: SparkSession, root: str, pattern: str, sink: str, epoch: int) -> DataFrame:
    """(path, hash, state) of all files against the sink, which then holds what is new or changed."""
    files = hashed_files(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root))
    known = read_upserts(spark, sink)
    states = rel.cut(changes.rescan(files, known if known is not None else files.limit(0)))
    upsert_sink(sink, ["path"], "modified")(files.join(states.where("state in ('new', 'changed')").select("path"), "path", "left_semi"), epoch)
    return states
