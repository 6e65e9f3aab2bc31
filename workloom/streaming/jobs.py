"""Streaming forms of deduplication, rates, histograms and dead-letter routing."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from workloom.functions.timing import micros_of
from workloom.operators.lifecycle import retry_schedule
from workloom.operators.metrics import histogram
from workloom.schemas import DEAD_LETTERED, MAX_ATTEMPTS
from workloom.sources.deadletters import to_dlq


def stream_dedup(stream: DataFrame, keys=("task_id", "attempt"), ts: str | None = None,
                 horizon: str | None = None) -> DataFrame:
    """The first row of each key.

    Exact without a horizon, with state that keeps every key. With `ts` and `horizon`, keys are
    forgotten after that time, so a repeat that comes later passes; seven days matches the
    retention of the message stream.
    """
    if horizon is None:
        return stream.dropDuplicates(list(keys))
    return (stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, horizon)
            .dropDuplicatesWithinWatermark(list(keys)))


def stream_rate(stream: DataFrame, ts: str, window: str, slide: str, delay: str,
                by: list[str] = ()) -> DataFrame:
    """Events per second in sliding windows; rows later than `delay` are dropped.

    In append mode a window appears once the watermark has passed its end.
    """
    seconds = micros_of(window) / 1_000_000
    span = F.window(ts, window, slide) if slide != window else F.window(ts, window)
    return (
        stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
        .groupBy(span.alias("_window"), *by).agg(F.count(F.lit(1)).alias("n_events"))
        .select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"),
                *by, "n_events", (F.col("n_events") / seconds).alias("rate_per_sec"))
    )


def stream_histogram(stream: DataFrame, ts: str, value: str, window: str, delay: str,
                     by: list[str] = ()) -> DataFrame:
    """Cumulative buckets per tumbling window."""
    stamped = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return histogram(stamped, value, [F.window(ts, window).alias("window"), *by])


def route_dispositions(df: DataFrame) -> DataFrame:
    """Adds `lane`: dead for dead letters, retry for requeues, else good."""
    return df.withColumn(
        "lane", F.when(F.col("disposition").isin(*DEAD_LETTERED), "dead")
        .when(F.col("disposition") == "requeued", "retry").otherwise("good"))


def stream_route(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                 max_attempts: int = MAX_ATTEMPTS, clock: str = "delivered_at") -> StreamingQuery:
    """Writes each micro-batch of `stream_replay` to lanes, replacing what a failed try left.

    `stream` must carry subject, data, error and `clock`. path/lane=dead has dead letters as
    `read_dlq` reads them, path/lane=retry the retries with `delay_ms` and `next_at`, and
    path/lane=good all other rows; each in a folder per batch.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        def put(rows: DataFrame, lane: str) -> None:
            rows.write.mode("overwrite").parquet(f"{path}/lane={lane}/batch={batch_id}")

        # The batch is written once; its lanes are read from there, so its state advances once.
        held = f"{path}/held/batch={batch_id}"
        batch.write.mode("overwrite").parquet(held)
        routed = route_dispositions(batch.sparkSession.read.schema(batch.schema).parquet(held))
        put(to_dlq(routed.where("lane = 'dead'"), max_attempts, clock), "dead")
        retries = retry_schedule(routed.where("lane = 'retry'"), clock)
        put(retries.select("task_id", "task_type", "attempt", "subject", "data", clock, "delay_ms", "next_at"), "retry")
        put(routed.where("lane = 'good'").select("task_id", "disposition", "attempt", "n_deliveries", "status", "version"), "good")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
