"""The status of each URL as a stream: a state machine, windows, and runs that stop when all is read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "url long, status string, event_seq long, retries long"


def latest(events: DataFrame) -> DataFrame:
    """Stateful: (url, status, event_seq, retries), updated as events (url, status, event_seq) arrive in any order."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, seq, retries = state.get if state.exists else (None, -1, 0)
        for f in frames:
            retries += int((f["status"] == "retrying").sum())
            top = f.loc[f["event_seq"].idxmax()]
            if top["event_seq"] > seq:
                status, seq = top["status"], int(top["event_seq"])
        state.update((status, seq, retries))
        yield pd.DataFrame({"url": [key[0]], "status": [status], "event_seq": [seq], "retries": [retries]})

    return events.groupBy("url").applyInPandasWithState(step, SCHEMA, "status string, seq long, retries long", "update", GroupStateTimeout.NoTimeout)


def counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and status; later ones than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "status").count()


def unique(events: DataFrame, late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["url", "status"])


def run_once(rows: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there, once, into Parquet; the checkpoint lets the next run go on from here."""
    rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_updates(rows: DataFrame, sink: str, checkpoint: str) -> None:
    """Updates of a stateful query as Parquet, a folder a batch."""

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def settled(spark: SparkSession, sink: str) -> DataFrame:
    """The last update of each URL."""
    rows = spark.read.parquet(sink)
    return rows.groupBy("url").agg(F.max_by(F.struct("status", "event_seq", "retries"), F.struct("batch", "event_seq")).alias("v")).select("url", "v.*")
