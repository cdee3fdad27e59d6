"""Streams: event-time windows, duplicates, packing, and batch-equal counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.session import scratch

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A folder of event files as a stream; ``ts`` becomes a timestamp, which watermarks need."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, size: str, step: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def packed_stream(texts: DataFrame, lane: str, text: str, length: int) -> DataFrame:
    """(lane, block, tokens): words of each lane in order of arrival, cut into blocks; a lane's tail waits as state."""

    def pack(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block, tail = state.get if state.exists else (0, [])
        tail = list(tail)
        out = []
        for frame in frames:
            tail += frame[text].dropna().str.split().explode().dropna().tolist()
            while len(tail) >= length:
                out.append((key[0], block, tail[:length]))
                tail, block = tail[length:], block + 1
        state.update((block, tail))
        yield pd.DataFrame(out, columns=["lane", "block", "tokens"])

    own = texts.select(F.col(lane).cast("long").alias("lane"), text)
    return own.groupBy("lane").applyInPandasWithState(pack, "lane long, block long, tokens array<string>", "block long, tail array<string>", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a bounded stream to its end and return what it made, from a table in the shared folder.

    Each batch is written to a folder of its own, over what a failed attempt left, with the stream's checkpoint beside it;
    of a complete output the last batch counts.
    """
    spark, path = stream.sparkSession, scratch(stream.sparkSession, name)
    last = [-1]

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={k}")
        last[0] = k

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], stream.schema)
    made = spark.read.schema(stream.schema)
    return made.parquet(f"{path}/table/batch={last[0]}") if mode == "complete" else made.parquet(*(f"{path}/table/batch={k}" for k in range(last[0] + 1)))


def progress(reports: list[dict], total: int) -> list[tuple[int, int, float]]:
    """(batch, rows seen so far, their share of ``total``) from a query's progress reports."""
    seen, out = 0, []
    for r in sorted(reports, key=lambda r: r["batchId"]):
        seen += r["numInputRows"]
        out.append((r["batchId"], seen, seen / total if total else 1.0))
    return out


def epochs(df: DataFrame, n: int) -> DataFrame:
    """A source read n times over; the column epoch tells the pass."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
