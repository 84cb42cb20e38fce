"""Structured Streaming operators: incremental index, windows over late data, stateful sessions."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_parquet_stream(spark: SparkSession, folder: str, name: str, per_trigger: int = 8) -> DataFrame:
    """A table's files as a stream; one file or folder named ``name``.parquet in ``folder``."""
    static = spark.read.parquet(f"{folder}/{name}.parquet")
    return spark.readStream.schema(static.schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*.parquet")


def run_once(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all that is available and stop; a failed run goes on from its checkpoint (ST02)."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and type with a watermark for late rows."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def deliveries_once(runs: DataFrame) -> DataFrame:
    """Each run_id once, whatever its deliveries and however late; the state holds all run_ids (ST08)."""
    return runs.withColumn("landed_at", F.col("landed_at").cast("timestamp")).dropDuplicates(["run_id"])


def changed_only(batch: DataFrame, index: DataFrame | None, key: str, fingerprint: str) -> DataFrame:
    """Rows whose fingerprint isn't the stored one (ST01): an anti join on key and fingerprint."""
    return batch if index is None else batch.join(index.select(key, fingerprint), [key, fingerprint], "left_anti")


def sessions(events: DataFrame, gap_ms: int = 1_800_000) -> DataFrame:
    """(user_id, start, end, n) of each closed session by a state per user with event-time timeout (ST09)."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        if state.hasTimedOut:
            s, e, n = state.get
            done.append((key[0], pd.Timestamp(s, unit="ms"), pd.Timestamp(e, unit="ms"), n))
            state.remove()
        else:
            cur = state.get if state.exists else None
            times = sorted(int(t.value // 1_000_000) for b in batches for t in b["ts"])
            for t in times:
                if cur is not None and t - cur[1] <= gap_ms:
                    cur = (cur[0], max(cur[1], t), cur[2] + 1)
                else:
                    if cur is not None:
                        done.append((key[0], pd.Timestamp(cur[0], unit="ms"), pd.Timestamp(cur[1], unit="ms"), cur[2]))
                    cur = (t, t, 1)
            if cur is not None:
                state.update(cur)
                state.setTimeoutTimestamp(max(cur[1] + gap_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["user_id", "start", "end", "n"])

    e = events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour")
    return e.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, start timestamp, end timestamp, n bigint", "s bigint, e bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)
