"""Daily counts of a stream whose rows may come after their day was closed.

A day of a type has a state: its count and whether it is closed. A timer closes it when the watermark passes its end.
Rows that come later are not dropped, as a windowed aggregate would: they are written to a table of their own and correct
the count. Spark drops a row whose event time is behind the watermark before any state sees it; so each row travels
twice, once without an event time, to be counted, and once as a tick that carries the time and drives the watermark."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakeloom.streaming.events import checkpoint_dir

RESULT = "event_type string, day date, n long, event_id long, kind string"


def counted(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of kind count (a day's count so far), closed and late (with the event's id)."""
    event_type, day = key
    n, closed = state.get if state.exists else (0, False)
    ends = int(pd.Timestamp(day).value // 1_000_000) + 86_400_000
    late: list[int] = []
    if state.hasTimedOut:
        closed = True
    else:
        closed = closed or state.getCurrentWatermarkMs() >= ends
        for part in parts:
            part = part[part["mark"].isna()]  # the others are ticks
            n += len(part)
            late += part["event_id"].tolist() if closed else []
        if not closed:
            state.setTimeoutTimestamp(ends)
    state.update((n, closed))
    kinds = ["closed" if state.hasTimedOut else "count", *["late"] * len(late)]
    yield pd.DataFrame({"event_type": event_type, "day": day, "n": n, "event_id": pd.array([None, *late], dtype="Int64"), "kind": kinds})


def daily_with_late(stream: DataFrame, delay: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """Runs a stream (event_id, event_type, ts) over what is there now: the exact counts (day, event_type, n) and the rows
    that came too late (event_id, event_type, day)."""
    spark, base = stream.sparkSession, checkpoint_dir(stream.sparkSession)
    twice = F.explode(F.array(F.lit(None).cast("timestamp"), F.col("ts"))).alias("mark")
    rows = stream.select("event_id", "event_type", F.to_date("ts").alias("day"), twice).withWatermark("mark", delay)
    found = rows.groupBy("event_type", "day").applyInPandasWithState(counted, RESULT, "n long, closed boolean", "append", GroupStateTimeout.EventTimeTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{base}/out/batch={number}")  # a repeated batch replaces itself

    query = found.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.schema(f"{RESULT}, batch long").option("basePath", f"{base}/out").parquet(f"{base}/out")
    counts = out.where("kind <> 'late'").groupBy("day", "event_type").agg(F.max("n").alias("n"))
    return counts, out.where("kind = 'late'").select("event_id", "event_type", "day")
