import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.models import fold_deliveries
from workloom.functions.timing import backoff_ms
from workloom.operators import lifecycle
from workloom.operators.handlers import PermanentError, is_permanent

T0 = dt.datetime(2024, 1, 1)
ORDER = ["delivered_at", "seq"]


def random_case(seed, n_tasks=40, n=1500, hot=True):
    rng = random.Random(seed)
    tasks = {f"t{i}": [rng.choice(["demo", "demo", "fail", "other"]),
                       rng.choice(["queued"] * 6 + ["processing", "completed", "failed", "cancelled"]),
                       rng.randint(1, 3)] for i in range(n_tasks)}
    tasks["t0"] = ["demo", "queued", 1]
    log = []
    for seq in range(n):
        key = "t0" if hot and seq % 3 == 0 else f"t{rng.randint(0, n_tasks + 3)}"
        outcome = rng.choice(["retryable"] * 5 + ["ok", "permanent"])
        log.append((key, rng.choice([1, 1, 2, 2, 3, 4, 5, 6, 9]), outcome, seq))
    recorded = {(f"t{rng.randint(0, n_tasks)}", rng.randint(1, 7)) for _ in range(25)}
    return tasks, log, recorded


def frames(spark, tasks, log):
    task_rows = [(k, t, "{}", "normal", s, T0, T0, v) for k, (t, s, v) in tasks.items()]
    delivered = [(k, a, o, T0 + dt.timedelta(seconds=s // 5), s, "boom", "tasks.low", f'{{"task_id":"{k}"}}', "low")
                 for k, a, o, s in log]
    random.Random(1).shuffle(delivered)
    return (
        spark.createDataFrame(task_rows, "id string, type string, payload string, priority string, status string, "
                                         "created_at timestamp, updated_at timestamp, version int"),
        spark.createDataFrame(delivered, "task_id string, attempt int, outcome string, delivered_at timestamp, seq int, "
                                         "error string, subject string, data string, message_priority string").repartition(5),
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("with_recorded", [False, True])
def test_replay_equals_the_fold(spark, seed, with_recorded):
    tasks, log, recorded = random_case(seed)
    recorded = recorded if with_recorded else set()
    expected, final, ran = fold_deliveries(tasks, [row[:3] for row in log], recorded)
    task_df, delivery_df = frames(spark, tasks, log)
    executions = spark.createDataFrame(sorted(recorded), "task_id string, attempt int") if recorded else None

    replayed = lifecycle.replay(task_df, delivery_df, ORDER, executions=executions)
    got = {r.seq: r.disposition for r in replayed.select("seq", "disposition").collect()}
    assert [got[i] for i in range(len(log))] == expected

    affected = lifecycle.effects(task_df, delivery_df, ORDER, executions=executions).cache()
    quiet = {"not_found", "terminal_noop", "in_flight_noop"}
    assert {r.seq: r.disposition for r in affected.collect()} == {
        i: d for i, d in enumerate(expected) if d not in quiet}
    after = {r.id: [r.type, r.status, r.version]
             for r in lifecycle.final_tasks(task_df, affected, ORDER).collect()}
    assert after == final
    written = {(r.task_id, r.attempt) for r in lifecycle.executions_of(affected).collect()}
    assert written == ran - recorded


def test_final_tasks_accepts_the_full_replay(spark):
    tasks, log, _ = random_case(7, n=300)
    task_df, delivery_df = frames(spark, tasks, log)
    _, final, _ = fold_deliveries(tasks, [row[:3] for row in log])
    replayed = lifecycle.replay(task_df, delivery_df, ORDER)
    assert {r.id: [r.type, r.status, r.version]
            for r in lifecycle.final_tasks(task_df, replayed, ORDER).collect()} == final


def test_smoke_scenarios(spark):
    """A demo task runs once however often it is published; an unknown type fails with its text."""
    tasks = {"dup": ["demo", "queued", 1], "unk": ["unknown", "queued", 1]}
    log = [("dup", 1, "ok", i) for i in range(20)] + [("unk", 1, "ok", 20)]
    task_df, delivery_df = frames(spark, tasks, log)
    affected = lifecycle.effects(task_df, delivery_df, ORDER)
    rows = {r.task_id: r for r in lifecycle.executions_of(affected).collect()}
    assert len(rows) == 2
    assert rows["dup"].status == "succeeded" and rows["dup"].error is None
    assert rows["unk"].status == "failed" and rows["unk"].error == 'no handler registered for type "unknown"'
    after = {r.id: (r.status, r.version) for r in lifecycle.final_tasks(task_df, affected, ORDER).collect()}
    assert after == {"dup": ("completed", 3), "unk": ("failed", 3)}


def test_effects_keeps_few_rows_per_task_before_the_shuffle(spark):
    tasks, log, _ = random_case(1)
    task_df, delivery_df = frames(spark, tasks, log)
    plan = lifecycle.effects(task_df, delivery_df, ORDER)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_backoff(spark):
    row = spark.range(1).select(*[backoff_ms(F.lit(a)).alias(f"a{a}") for a in (0, 1, 2, 5, 6, 100)]).first()
    assert list(row) == [500, 500, 1000, 8000, 10000, 10000]
    capped = spark.range(1).select(backoff_ms(F.lit(1), 20_000, 10_000)).first()[0]
    assert capped == 10_000


def test_retry_schedule(spark):
    tasks, log = {"a": ["demo", "queued", 1]}, [("a", 1, "retryable", 0), ("a", 2, "ok", 5)]
    task_df, delivery_df = frames(spark, tasks, log)
    rows = {r.attempt: r for r in lifecycle.retry_schedule(
        lifecycle.effects(task_df, delivery_df, ORDER)).collect()}
    assert (rows[1].action, rows[1].delay_ms) == ("retry", 500)
    assert rows[1].next_at == T0 + dt.timedelta(milliseconds=500)
    assert (rows[2].action, rows[2].delay_ms, rows[2].next_at) == ("ack", None, None)


@pytest.mark.parametrize("partitions", [None, 1, 3, 40])
def test_attempt_numbers(spark, partitions):
    rng = random.Random(4)
    rows = [(f"m{rng.randint(0, 5) if i % 3 else 0}", T0 + dt.timedelta(seconds=rng.randint(0, 40)), i)
            for i in range(400)]
    rows += [(None, T0 + dt.timedelta(seconds=i), 400 + i) for i in range(20)] + [(f"m{i % 2}", None, 420 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "msg string, at timestamp, seq int").repartition(4)
    got = {r.seq: r.attempt for r in lifecycle.number_attempts(df, "msg", "at", ["seq"], partitions).collect()}
    seen, expected = {}, {}
    for msg, at, seq in sorted(rows, key=lambda r: (r[1] is not None, r[1] or T0, r[2])):
        seen[msg] = seen.get(msg, 0) + 1
        expected[seq] = seen[msg]
    assert got == expected


def test_attempts_of_one_hot_message_are_spread(spark):
    df = spark.range(20_000).select(F.lit("m").alias("msg"), F.timestamp_seconds("id").alias("at"), "id")
    from workloom.functions.chain import _RANGE, _pass  # the ranges themselves
    ranged = df.repartitionByRange(8, "msg", "at").sortWithinPartitions("msg", "at")
    sizes = ranged.mapInArrow(_pass(["msg"], [], []), f"msg string, at timestamp, id bigint, {_RANGE} int, _head boolean, _edge string")
    assert max(r["count"] for r in sizes.groupBy(_RANGE).count().collect()) < 5_000
    numbered = lifecycle.number_attempts(df, "msg", "at", ["id"], 8)
    assert numbered.where("attempt <> id + 1").count() == 0 and numbered.count() == 20_000


def test_permanent_errors_are_seen_through_wrapping():
    try:
        try:
            raise PermanentError("no")
        except PermanentError as error:
            raise RuntimeError("outer") from error
    except RuntimeError as outer:
        assert is_permanent(outer)
    assert not is_permanent(RuntimeError("x")) and not is_permanent(None)


@pytest.mark.parametrize("outcomes, expected", [
    (["retryable"] * 2 + ["ok"], ["requeued", "dup_execution_stuck", "in_flight_noop"]),
    (["ok"] * 3, ["completed", "terminal_noop", "terminal_noop"]),
])
def test_a_missing_attempt_is_the_first(spark, outcomes, expected):
    tasks = {"t": ["demo", "queued", 1]}
    log = [("t", None if i % 2 else 0, o, i) for i, o in enumerate(outcomes)]
    task_df, delivery_df = frames(spark, tasks, log)
    got = {r.seq: r.disposition for r in lifecycle.replay(task_df, delivery_df, ORDER).collect()}
    assert [got[i] for i in range(len(log))] == expected
    assert {r.attempt for r in lifecycle.effects(task_df, delivery_df, ORDER).collect()} == {1}
