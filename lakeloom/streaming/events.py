"""Structured Streaming twins of the incremental load: the table's files as a stream, run until they are consumed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.session import shared_dir


def stream_of(rows: DataFrame) -> DataFrame:
    """The files behind a table as file streams, one for each folder that holds some (a stream reads folders: a single
    file becomes a name filter)."""
    folders: dict[str, list[str]] = {}
    for path in rows.inputFiles():
        folder, name = path.rsplit("/", 1)
        folders.setdefault(folder, []).append(name)
    out = None
    for folder, names in sorted(folders.items()):
        only = names[0] if len(names) == 1 and not names[0].startswith("part-") else "*.parquet"
        part = rows.sparkSession.readStream.schema(rows.schema).option("pathGlobFilter", only).parquet(folder)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def checkpoint_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there now and give the table it wrote. In the complete mode every batch holds the whole
    result, so the last one stays."""
    spark, base = stream.sparkSession, checkpoint_dir(stream.sparkSession)
    out, state = f"{base}/out", f"{base}/state"

    def write(batch: DataFrame, number: int) -> None:
        kept = 0 if mode == "complete" else number
        batch.write.mode("overwrite").parquet(f"{out}/batch={kept}")  # a repeated batch replaces itself

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def deduplicated(events: DataFrame) -> DataFrame:
    """Each (event_id, ts) once, although every event arrives twice; state is dropped an hour after the watermark."""
    stream = stream_of(events)
    twice = stream.unionAll(stream)
    return run_to_end(twice.withWatermark("ts", "60 minutes").dropDuplicatesWithinWatermark(["event_id", "ts"]).select("event_id"), "append")


def daily_counts(events: DataFrame) -> DataFrame:
    """Events per day and type in tumbling windows."""
    counts = stream_of(events).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return run_to_end(counts.select(F.to_date("window.start").alias("day"), "event_type", "n"), "complete")
