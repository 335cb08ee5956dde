"""Live engagement: counters, accepted events and sliding counts as Structured Streaming jobs.

Each job also runs to completion over files (``availableNow``) and then gives what the nightly batch gives.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from placeloom.session import shared_dir


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files of ``path`` (one file, or a folder of them) as a stream; timestamps without zone are read as UTC."""
    schema = spark.read.parquet(path).schema
    # written as a pattern, a single file may be a source too
    df = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def drained(df: DataFrame, mode: str, combine: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Run a streaming plan over what is there and return what it wrote: batches in the shared folder, then ``combine``.

    The batch number is a column of every row, so that an update of a later batch can replace an earlier one; a
    batch that is repeated after a failure overwrites its own files.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/n={n}")

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    schema = spark.createDataFrame([], df.schema).withColumn("batch", F.lit(0)).schema
    return combine(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out"))


def live_counters(events: DataFrame, entity: str, action: str) -> DataFrame:
    """(entity, action, n): running counts, each batch writing the new totals of the keys it touched."""
    counts = events.where(F.col(entity).isNotNull()).groupBy(entity, action).agg(F.count("*").alias("n"))
    latest = lambda w: w.groupBy(entity, action).agg(F.max_by("n", "batch").alias("n"))
    return drained(counts, "update", latest)


def accepted_of(us: np.ndarray, last: int | None, span: int) -> list[int]:
    """Places in sorted ``us`` of the values that lie more than ``span`` after the last accepted one; jumps from one to the next."""
    out: list[int] = []
    i = 0 if last is None else int(np.searchsorted(us, last + span, side="right"))
    while i < len(us):
        out.append(i)
        i = int(np.searchsorted(us, us[i] + span, side="right"))
    return out


def accept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, seconds: float) -> Iterator[pd.DataFrame]:
    """Events more than ``seconds`` after the last accepted one of their key. Only an id and a time are held of each."""
    if state.hasTimedOut:
        state.remove()
        return
    parts = [(b["event_id"].to_numpy(np.int64), b["ts"].to_numpy("datetime64[us]").astype(np.int64)) for b in batches]
    ids, us = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((ids, us))
    ids, us = ids[order], us[order]
    kept = accepted_of(us, state.get[0] if state.exists else None, int(seconds * 1e6))
    if kept:
        state.update((int(us[kept[-1]]),))
    if state.exists:
        # once the watermark is past this, whatever still comes is accepted with or without a state
        state.setTimeoutTimestamp(int((state.get[0] + seconds * 1e6) // 1000) + 1000)
    yield pd.DataFrame({"event_id": ids[kept], "user_id": key[0], "event_type": key[1], "ts": pd.to_datetime(us[kept], unit="us")})


def accepted_events(events: DataFrame, seconds: float = 60.0, late: str = "30 days") -> DataFrame:
    """Events (event_id, user_id, event_type, ts) that count: per user and type, none within ``seconds`` of the last one that
    counted. Events without a user or time, and those more than ``late`` behind the newest, count for nothing. The state is
    one number per key, dropped once the watermark is past its span."""
    keyed = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select("event_id", "user_id", "event_type", "ts").withWatermark("ts", late)

    def run(key, batches, state):
        yield from accept(key, batches, state, seconds)

    kept = keyed.groupBy("user_id", "event_type").applyInPandasWithState(run, "event_id long, user_id long, event_type string, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return drained(kept, "append").drop("batch")


def sliding_counts(events: DataFrame, days: int = 14, step: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n): trailing counts over sliding windows, closed windows only once the watermark has passed them."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", f"{days} days", step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return drained(w.select(F.col("w.start").alias("start"), "event_type", "n"), "update", lambda x: x.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n")))


def hourly_load(events: DataFrame, entity: str) -> DataFrame:
    """(hour, entity, n): tumbling hourly counts, for a limiter to compare with its threshold."""
    h = events.groupBy(F.window("ts", "1 hour").alias("w"), entity).agg(F.count("*").alias("n"))
    return drained(h.select(F.col("w.start").alias("hour"), entity, "n"), "update", lambda x: x.groupBy("hour", entity).agg(F.max_by("n", "batch").alias("n")))
