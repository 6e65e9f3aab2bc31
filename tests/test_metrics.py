import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.models import counter_rates
from workloom.operators import metrics
from workloom.schemas import EXECUTIONS

T0 = dt.datetime(2024, 1, 1)
EPOCH = dt.datetime(1970, 1, 1)


def test_histogram_and_quantile(spark):
    rng = random.Random(2)
    values = [("a", rng.uniform(0, 12)) for _ in range(500)] + [("b", 0.001), ("c", 99.0)]
    df = spark.createDataFrame(values, "s string, v double")
    buckets = metrics.histogram(df, "v", ["s"])
    counts = {(r.s, r.le): r.bucket_count for r in buckets.collect()}
    for le in ("0.005", "0.01", "0.25", "1", "10"):
        assert counts["a", le] == sum(v <= float(le) for s, v in values if s == "a")
    assert counts["a", "+Inf"] == 500 and len([k for k in counts if k[0] == "a"]) == 12
    q = {r.s: r.quantile for r in metrics.histogram_quantile(buckets, 0.95, ["s"]).collect()}
    assert q["c"] == 10.0
    assert q["b"] == pytest.approx(0.005 * 0.95)
    rank, below, upto = 475, counts["a", "5"], counts["a", "10"]
    expected = 10.0 if rank > upto else 5 + 5 * (rank - below) / (upto - below)
    assert q["a"] == pytest.approx(expected)


def test_quantile_edges(spark):
    empty = spark.createDataFrame([("x", "1", 0), ("x", "+Inf", 0), ("y", "1", 5)], "s string, le string, bucket_count bigint")
    assert all(math.isnan(r.quantile) for r in metrics.histogram_quantile(empty, 0.5, ["s"]).collect())
    assert metrics.histogram_quantile(empty, 2, ["s"]).first().quantile == math.inf
    assert metrics.histogram_quantile(empty, -1, ["s"]).first().quantile == -math.inf


def test_event_rate_equals_brute_force(spark):
    rng = random.Random(6)
    times = [rng.randint(0, 900) for _ in range(300)]
    df = spark.createDataFrame([(T0 + dt.timedelta(seconds=t),) for t in times], "ts timestamp")
    got = {r.window_start_us // 1_000_000: (r.n_events, r.rate_per_sec) for r in metrics.event_rate(df, "ts", "1 minute", "10 seconds").collect()}
    base = int((T0 - EPOCH).total_seconds())
    want = {}
    for start in range(base - 60, base + 910, 10):
        n = sum(start <= base + t < start + 60 for t in times)
        if n:
            want[start] = (n, n / 60)
    assert got == want
    with pytest.raises(ValueError):
        metrics.event_rate(df, "ts", "1 minute", "7 seconds")


@pytest.mark.parametrize("partitions", [None, 3, 40])
def test_counter_rate_equals_the_model(spark, partitions):
    rng = random.Random(8)
    base = int((T0 - EPOCH).total_seconds())
    samples, want = [], {}
    for series in "abc":
        t, v, points = 0, rng.randint(0, 5), []
        while t < 4000:
            points.append((base + t, float(v)))
            t += rng.choice([10, 10, 10, 50, 400])
            v = rng.choice([v, v + 1, v + 7, 0 if rng.random() < 0.2 else v])
        samples += [(series, T0 + dt.timedelta(seconds=p[0] - base), p[1]) for p in points]
        want.update({(series, k): x for k, x in counter_rates(points, 600).items()})
    df = spark.createDataFrame(samples, "series string, ts timestamp, value double").repartition(4)
    rates = metrics.counter_rate(df, "10 minutes", ["series"], partitions=partitions)
    got = {(r.series, r.window_start_us // 1_000_000): r.rate_per_sec for r in rates.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    total = metrics.sum_rates(rates, ["window_start_us"]).agg(F.sum("rate_per_sec")).first()[0]
    assert total == pytest.approx(sum(want.values()))


def test_stream_stats(spark):
    df = spark.createDataFrame([("tasks.low", "ab"), ("tasks.low", "é"), ("tasks.high", "x")], "subject string, data string")
    rows = {r.subject: (r.n_messages, r.n_bytes, r.n_subjects) for r in metrics.stream_stats(df, "S").collect()}
    assert rows == {"tasks.low": (2, 4, 1), "tasks.high": (1, 1, 1), "*": (3, 5, 2)}


def test_audit(spark):
    tasks = spark.createDataFrame(
        [("once", "demo", "completed"), ("twice", "demo", "completed"), ("never", "demo", "completed"),
         ("unk", "unknown", "failed"), ("odd", "unknown", "failed"), ("new", "demo", "queued")], "id string, type string, status string")
    rows = [("once", 1, None), ("twice", 1, "x"), ("twice", 2, None), ("unk", 1, 'no handler registered for type "unknown"'), ("odd", 1, "x")]
    execs = spark.createDataFrame([(f"e{i}", t, a, "failed", e, T0, T0) for i, (t, a, e) in enumerate(rows)], EXECUTIONS)
    got = {r.id: r.finding for r in metrics.audit(tasks, execs).collect()}
    assert got == {"once": "ok", "twice": "repeated_execution", "never": "missing_execution", "unk": "ok",
                   "odd": "wrong_error", "new": "ok"}


def test_counters(spark):
    rows = [("demo", "low", "completed", "ok"), ("demo", "low", "requeued", "retryable"), ("demo", "high", "exhausted_dlq", "retryable"),
            ("fail", "low", "permanent_dlq", "permanent"), ("unk", "low", "no_handler_dlq", "ok"), ("demo", "low", "max_attempts_dlq", "ok")]
    df = spark.createDataFrame(rows, "task_type string, message_priority string, disposition string, outcome string")
    assert {(r.type, r.priority): r.value for r in metrics.tasks_started(df).collect()} == {
        ("demo", "low"): 2, ("demo", "high"): 1, ("fail", "low"): 1}
    assert {r.type: r.value for r in metrics.tasks_completed(df).collect()} == {"demo": 1}
    assert {(r.type, r.reason): r.value for r in metrics.tasks_failed(df).collect()} == {("demo", "retryable"): 2, ("fail", "permanent"): 1}


def test_histogram_keeps_its_columns_and_skips_nulls(spark):
    df = spark.createDataFrame([("a", "b", 0.1), ("a", "b", None), ("a", "b", 3.0)], "total_x string, _by string, v double")
    rows = metrics.histogram(df, "v", ["total_x", "_by"]).collect()
    assert {(r.total_x, r["_by"], r.total_count) for r in rows} == {("a", "b", 2)}
    assert {r.le: r.bucket_count for r in rows}["+Inf"] == 2


@pytest.mark.parametrize("partitions", [None, 3, 9])
def test_sliding_rates_equal_single_windows(spark, partitions):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rows = [("s", start + dt.timedelta(seconds=7 * i), float(i * i % 50)) for i in range(80)]
    df = spark.createDataFrame(rows, "series string, ts timestamp, value double")
    got = {r.window_start_us: r.rate_per_sec for r in metrics.counter_rate(df, "1 minute", ["series"], partitions=partitions, step="10 seconds").collect()}
    assert len(got) > 50
    origin = int((start - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    for k in range(6):  # tumbling windows, shifted by whole steps
        moved = df.withColumn("ts", F.col("ts") - F.expr(f"INTERVAL {10 * k} SECONDS"))
        for r in metrics.counter_rate(moved, "1 minute", ["series"]).collect():
            assert got[r.window_start_us + 10_000_000 * k] == pytest.approx(r.rate_per_sec)
    assert min(got) < origin
