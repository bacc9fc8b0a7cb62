"""Continuous forms of the batch operators, by Structured Streaming. Each has a batch form that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, root: str, most_files: int = 1000) -> DataFrame:
    """New files below a folder as they appear; most_files limits what one batch takes, which is how a backlog is met. Deletions never show in a stream: the listing's difference finds them."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(most_files)).load(root)


def settled(files: DataFrame, now, seconds: int = 5) -> DataFrame:
    """Files not written to in the last seconds; younger ones are left for the next listing."""
    return files.filter(F.col("modificationTime") <= now - F.expr(f"INTERVAL {seconds} SECONDS"))


def debounced(changes: DataFrame, key: str, at: str, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """One row for each burst of changes, once the watermark has passed its end."""
    w = F.session_window(at, gap)
    return changes.withWatermark(at, late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("changes")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes")


def deduplicated(jobs: DataFrame, at: str = "created_at", late: str = "1 hour") -> DataFrame:
    """Jobs (type, payload), each once within the time that the watermark keeps."""
    return jobs.withWatermark(at, late).dropDuplicatesWithinWatermark(["type", "payload"])


def poll_plan(polls: DataFrame, base: float = 60.0, most: float = 3600.0) -> DataFrame:
    """polls (source, at, changed) to (source, at, next_poll, wait): the wait starts at `base` seconds, doubles with each poll that found nothing, up to `most`, and falls back when something changed."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (wait,) = state.get if state.exists else (base / 2,)
        for b in batches:
            out = []
            for at, changed in b.sort_values("at")[["at", "changed"]].itertuples(index=False):
                wait = base if changed else min(most, wait * 2)
                out.append((key[0], at, at + pd.Timedelta(seconds=wait), wait))
            state.update((wait,))
            yield pd.DataFrame(out, columns=["source", "at", "next_poll", "wait"])

    return polls.groupBy("source").applyInPandasWithState(step, "source string, at timestamp, next_poll timestamp, wait double", "wait double", "append", GroupStateTimeout.NoTimeout)


def poll_plan_batch(polls: DataFrame, base: float = 60.0, most: float = 3600.0) -> DataFrame:
    """poll_plan on a table: the wait is base * 2^(polls without change since the last change), the first poll counting as one with change."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("at")
    first = F.row_number().over(w) == 1
    runs = polls.withColumn("_first", first).withColumn("_run", F.sum((F.col("changed") | F.col("_first")).cast("int")).over(w))
    still = F.row_number().over(Window.partitionBy("source", "_run").orderBy("at")) - 1
    wait = F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), still))
    return runs.withColumn("wait", wait).select("source", "at", (F.col("at") + F.make_dt_interval(secs=F.col("wait"))).alias("next_poll"), "wait")


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs work on each micro-batch until nothing is left. work must be able to see a batch again: it commits through a table version that names the batch."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
