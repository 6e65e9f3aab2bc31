import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.models import fold_deliveries
from tests.test_lifecycle import ORDER, frames, random_case
from workloom.operators import lifecycle
from workloom.operators.handlers import HandlerRegistry, PermanentError, run_handlers, run_with_retries
from workloom.sources.deadletters import read_dlq
from workloom.streaming import jobs
from workloom.streaming.redelivery import stream_redelivery
from workloom.streaming.replay import stream_replay

T0 = dt.datetime(2024, 1, 1)


def drain(stream, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
     .outputMode(mode).trigger(availableNow=True).start().awaitTermination())
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def staged(spark, df, path, batches, key):
    """Writes a log as `batches` files in order and streams them one per micro-batch."""
    total = df.count()
    for b in range(batches):
        low, high = total * b // batches, total * (b + 1) // batches
        (df.where((F.col(key) >= low) & (F.col(key) < high)).coalesce(1)
         .write.mode("append").parquet(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("batches, with_recorded, initial_state", [(1, False, False), (4, False, True), (3, True, False), (2, True, True)])
def test_stream_replay_equals_the_batch(spark, tmp_path, batches, with_recorded, initial_state):
    tasks, log, recorded = random_case(11, n=600)
    recorded = recorded if with_recorded else set()
    executions = spark.createDataFrame(sorted(recorded), "task_id string, attempt int") if recorded else None
    expected, final, _ = fold_deliveries(tasks, [r[:3] for r in log], recorded)
    task_df, delivery_df = frames(spark, tasks, log)
    stream = staged(spark, delivery_df, str(tmp_path / "log"), batches, "seq")
    rows = drain(stream_replay(stream, task_df, ORDER, executions=executions, initial_state=initial_state), tmp_path).collect()
    counts = {}
    for (key, *_), disposition in zip(log, expected):
        counts[key, disposition] = counts.get((key, disposition), 0) + 1
    got = {}
    for r in rows:
        got[r.task_id, r.disposition] = got.get((r.task_id, r.disposition), 0) + r.n_deliveries
    assert got == counts
    last = {}
    for r in rows:
        if r.version is not None:
            last[r.task_id] = max(last.get(r.task_id, (0, "")), (r.version, r.status))
    assert all(last[k] == (final[k][2], final[k][1]) for k in last)


def test_a_hot_task_is_reduced_where_it_is_read(spark):
    from workloom.streaming.replay import _first_of_batches

    log = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 1_000 > 0, F.concat(F.lit("t"), F.col("id").cast("string"))).alias("task_id"),
                                     (-F.col("id")).alias("order_0"), F.lit(None).cast("bigint").alias("more")).repartition(4)
    reduced = log.mapInArrow(_first_of_batches(5, ["order_0"]), "task_id string, order_0 bigint, more bigint").cache()
    batches = reduced.where("task_id = 'hot' AND more IS NOT NULL").count()
    assert reduced.where("task_id = 'hot' AND more IS NULL").count() == 5 * batches < 100
    assert reduced.agg(F.sum(F.coalesce("more", F.lit(1)))).first()[0] == 60_000
    assert reduced.where("task_id = 'hot'").agg(F.min("order_0")).first()[0] == -59_999
    assert reduced.where("task_id IS NULL AND more IS NULL").count() <= 20


def test_stream_dedup(spark, tmp_path):
    df = spark.createDataFrame([(i, "t", i % 3, T0 + dt.timedelta(seconds=i)) for i in range(30)],
                               "seq int, task_id string, attempt int, ts timestamp")
    stream = staged(spark, df, str(tmp_path / "in"), 3, "seq")
    assert drain(jobs.stream_dedup(stream), tmp_path).count() == 3
    bounded = jobs.stream_dedup(stream, ts="ts", horizon="7 days")
    (tmp_path / "b").mkdir()
    assert drain(bounded, tmp_path / "b").count() == 3


def test_stream_rate_equals_the_batch_for_closed_windows(spark, tmp_path):
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i * 7)) for i in range(400)], "seq int, ts timestamp")
    stream = staged(spark, df, str(tmp_path / "in"), 4, "seq")
    rows = drain(jobs.stream_rate(stream, "ts", "1 minute", "10 seconds", "30 seconds"), tmp_path).collect()
    from workloom.operators.metrics import event_rate
    batch = {r.window_start_us: r.n_events for r in event_rate(df, "ts", "1 minute", "10 seconds").collect()}
    epoch = dt.datetime(1970, 1, 1)
    got = {int((r.window_start - epoch).total_seconds()) * 1_000_000: r.n_events for r in rows}
    watermark = int((T0 + dt.timedelta(seconds=399 * 7 - 30) - epoch).total_seconds()) * 1_000_000
    assert got == {k: v for k, v in batch.items() if k + 60_000_000 <= watermark}


def test_stream_histogram(spark, tmp_path):
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i), i / 10) for i in range(100)], "seq int, ts timestamp, v double")
    stream = staged(spark, df, str(tmp_path / "in"), 2, "seq")
    rows = drain(jobs.stream_histogram(stream, "ts", "v", "30 seconds", "1 second"), tmp_path).collect()
    first = {r.le: r.bucket_count for r in rows if r.window.start == T0}
    assert first["+Inf"] == 30 and first["1"] == 11


def test_stream_route_is_idempotent_per_batch(spark, tmp_path):
    rows = [(i, "t", "demo", d, 2, 1, "queued", 3, "tasks.low", f"data {i}" * 20, "boom", T0)
            for i, d in enumerate(["completed", "requeued", "permanent_dlq", "terminal_noop"])]
    df = spark.createDataFrame(rows, "seq int, task_id string, task_type string, disposition string, attempt int, n_deliveries bigint, "
                                     "status string, version int, subject string, data string, error string, delivered_at timestamp")
    stream = staged(spark, df, str(tmp_path / "in"), 2, "seq")
    out = str(tmp_path / "lanes")
    for checkpoint in ("cp", "cp2"):
        jobs.stream_route(stream, out, str(tmp_path / checkpoint)).awaitTermination()
        lane = {name: spark.read.parquet(f"{out}/lane={name}").drop("batch").collect() for name in ("dead", "retry", "good")}
        assert sorted(r.disposition for r in lane["good"]) == ["completed", "terminal_noop"]
        assert [(r.task_id, r.attempt, r.delay_ms, r.next_at) for r in lane["retry"]] == [("t", 2, 1000, T0 + dt.timedelta(seconds=1))]
        good, bad = read_dlq(spark.createDataFrame([(r.data,) for r in lane["dead"]], "data string"))
        assert bad.count() == 0
        assert [(r.task_id, r.error, bytes(r.original_data).decode()) for r in good.collect()] == [("t", "boom", "data 2" * 20)]


ORDERS = {"text": ("string", lambda i: "x" * 25 + f"{i:03d}"), "uuid": ("string", lambda i: f"{i:08x}-0000-4000-8000-000000000000"),
          "negative": ("int", lambda i: i - 500), "null first": ("int", lambda i: i or None)}


@pytest.mark.parametrize("order", ORDERS)
def test_stream_order_is_that_of_the_batch(spark, tmp_path, order):
    kind, at = ORDERS[order]
    log = [("t", 1, "retryable"), ("t", None if order == "text" else 2, "ok"), ("u", 2, "retryable"), ("u", 1, "permanent"), ("u", 1, "ok")]
    rows = [(i, k, a, o, at(i)) for i, (k, a, o) in enumerate(log)]
    random.Random(2).shuffle(rows)
    deliveries = spark.createDataFrame(rows, f"seq int, task_id string, attempt int, outcome string, place {kind}")
    tasks = spark.createDataFrame([(k, "demo", "{}", "low", "queued", T0, T0, 1) for k in "tu"], "id string, type string, payload string, "
                                  "priority string, status string, created_at timestamp, updated_at timestamp, version int")
    batch = sorted((r.task_id, r.disposition) for r in lifecycle.replay(tasks, deliveries, ["place"]).collect())
    stream = staged(spark, deliveries, str(tmp_path / "in"), 1, "seq")
    got = drain(stream_replay(stream, tasks, ["place"], carry=["seq"]), tmp_path).collect()
    assert sorted((r.task_id, r.disposition) for r in got for _ in range(r.n_deliveries)) == batch
    assert all(r.seq is not None for r in got if r.attempt is not None)


def _sometimes(task):
    if task["payload"] == "never":
        raise RuntimeError("busy")


def _wrapped(task):
    try:
        raise PermanentError("inner")
    except PermanentError as error:
        raise RuntimeError("outer") from error


def queued(spark, rows):
    return spark.createDataFrame([(i, t, p, s, 1) for i, t, p, s in rows],
                                 "id string, type string, payload string, status string, version int")


def test_handlers(spark):
    registry = HandlerRegistry.with_defaults()
    registry.register("wrapped", _wrapped)
    registry.register("some", _sometimes)
    df = queued(spark, [("a", "demo", "", "queued"), ("b", "fail", "", "queued"), ("c", "wrapped", "", "queued"),
                        ("d", "some", "never", "queued"), ("e", "x", "", "queued")])
    rows = {r.id: (r.outcome, r.error) for r in run_handlers(df, registry).collect()}
    assert rows == {"a": ("ok", None), "b": ("permanent", "requested failure for demo"), "c": ("permanent", "outer"),
                    "d": ("retryable", "busy"), "e": ("no_handler", 'no handler registered for type "x"')}


def test_redelivery_reaches_the_states_of_the_rounds(spark, tmp_path):
    registry = HandlerRegistry.with_defaults()
    registry.register("some", _sometimes)
    rows = [("a", "demo", "", "queued"), ("b", "fail", "", "queued"), ("d", "some", "never", "queued"), ("e", "x", "", "queued"), ("f", "demo", "", "cancelled")]
    tasks = queued(spark, rows).withColumn("priority", F.lit("low"))
    log = [(i, r[0], None, T0 + dt.timedelta(seconds=i)) for i, r in enumerate(rows)]
    log += [(5, "gone", 1, T0 + dt.timedelta(seconds=9)), (6, None, 1, T0 + dt.timedelta(seconds=9)), (7, "a", 2, T0 + dt.timedelta(seconds=9)),
            (8, None, 1, T0 + dt.timedelta(days=1))]  # the last only moves the clock
    deliveries = spark.createDataFrame(log, "seq int, task_id string, attempt int, delivered_at timestamp")
    stream = staged(spark, deliveries, str(tmp_path / "in"), 3, "seq")
    got = drain(stream_redelivery(stream, tasks, registry, max_attempts=3), tmp_path).collect()
    final, executions, _ = run_with_retries(tasks, registry, 3)
    ran = {(r.task_id, r.attempt): (r.error, r.delay_ms) for r in got if not r.disposition.endswith("noop") and r.disposition != "not_found"}
    assert ran == {(r.task_id, r.attempt): (r.error, r.retry_after_ms) for r in executions.collect()}
    last = {r.task_id: (r.status, r.version) for r in sorted(got, key=lambda r: r.version or 0) if r.version}
    assert last == {r.id: (r.status, r.version) for r in final.collect()}
    assert [(r.attempt, r.delivered_at, r.next_at) for r in sorted(got, key=lambda r: r.attempt) if r.task_id == "d"] == [
        (1, T0 + dt.timedelta(seconds=2), T0 + dt.timedelta(seconds=2.5)), (2, T0 + dt.timedelta(seconds=2.5), T0 + dt.timedelta(seconds=3.5)),
        (3, T0 + dt.timedelta(seconds=3.5), None)]
    assert sorted(str(r.task_id) for r in got if r.disposition == "not_found") == ["None", "None", "gone"]
    assert sorted((r.attempt, r.disposition) for r in got if r.task_id == "a") == [(1, "completed"), (2, "terminal_noop")]


def test_retry_rounds(spark):
    registry = HandlerRegistry.with_defaults()
    registry.register("some", _sometimes)
    df = queued(spark, [("a", "demo", "", "queued"), ("b", "fail", "", "queued"), ("d", "some", "never", "queued"),
                        ("e", "x", "", "queued"), ("f", "demo", "", "cancelled")])
    final, executions, dead = run_with_retries(df, registry, 3)
    assert {r.id: (r.status, r.version) for r in final.collect()} == {
        "a": ("completed", 3), "b": ("failed", 3), "d": ("failed", 7), "e": ("failed", 3), "f": ("cancelled", 1)}
    assert {(r.task_id, r.attempt): r.retry_after_ms for r in executions.collect()} == {
        ("a", 1): None, ("b", 1): None, ("d", 1): 500, ("d", 2): 1000, ("d", 3): None, ("e", 1): None}
    assert {(r.task_id, r.attempt) for r in dead.collect()} == {("b", 1), ("d", 3), ("e", 1)}


@pytest.mark.parametrize("initial_state", [False, True])
def test_a_bucket_of_state_holds_many_tasks(spark, tmp_path, initial_state):
    tasks, log, _ = random_case(12, n=300)
    task_df, delivery_df = frames(spark, tasks, log)
    expected, _, _ = fold_deliveries(tasks, [r[:3] for r in log], set())
    stream = staged(spark, delivery_df, str(tmp_path / "log"), 2, "seq")
    got = drain(stream_replay(stream, task_df, ORDER, initial_state=initial_state, buckets=3), tmp_path)
    counts = {}
    for (key, *_), disposition in zip(log, expected):
        counts[key, disposition] = counts.get((key, disposition), 0) + 1
    assert {(r.task_id, r.disposition): r.n for r in got.groupBy("task_id", "disposition").agg(F.sum("n_deliveries").alias("n")).collect()} == counts
    state = spark.read.format("statestore").option("stateVarName", "tasks").load(str(tmp_path / "cp"))
    assert 0 < state.count() <= 3


def test_redelivery_in_one_bucket(spark, tmp_path):
    registry = HandlerRegistry.with_defaults()
    registry.register("some", _sometimes)
    tasks = queued(spark, [(str(i), "some", "never" if i % 2 else "", "queued") for i in range(40)]).withColumn("priority", F.lit("low"))
    log = [(0, str(i), 1, T0 + dt.timedelta(seconds=i)) for i in range(40)] + [(1, None, 1, T0 + dt.timedelta(days=1))]
    stream = staged(spark, spark.createDataFrame(log, "seq int, task_id string, attempt int, delivered_at timestamp"), str(tmp_path / "in"), 2, "seq")
    got = drain(stream_redelivery(stream, tasks, registry, max_attempts=3, buckets=1), tmp_path).where("task_id IS NOT NULL").collect()
    assert sorted((int(r.task_id), r.attempt, r.disposition) for r in got) == sorted(
        [(i, 1, "completed") for i in range(0, 40, 2)]
        + [(i, n, "exhausted_dlq" if n == 3 else "requeued") for i in range(1, 40, 2) for n in (1, 2, 3)])
