import datetime as dt
import random

import pytest

from tests.models import apply_in_order
from workloom.operators import changes
from workloom.operators.changes import _OpenRun

T0 = dt.datetime(2024, 1, 1)


def test_an_open_run_agrees_with_every_entry_version():
    rng = random.Random(3)
    for _ in range(300):
        expected = [rng.randint(1, 6) for _ in range(rng.randint(0, 25))]
        run = _OpenRun()
        ranges = [run.accept(e) for e in expected]
        for entry in range(0, 9):
            version, taken = entry, []
            for e in expected:
                taken.append(e == version)
                version += e == version
            assert [low <= entry <= high for low, high in ranges] == taken
            leaves = [x for low, high, x in run.exits() if low <= entry <= high]
            assert (leaves or [entry])[0] == version


def update_case(seed, hot, style):
    rng = random.Random(seed)
    tasks = {f"t{i:02d}": ["queued", rng.randint(1, 3)] for i in range(12)}
    updates, at = [], dict.fromkeys(tasks, 1)
    for seq in range(800):
        key = "t05" if hot and rng.random() < 0.6 else f"t{rng.randint(0, 14):02d}"
        if style == "advancing":
            expected = tasks.get(key, ["", 1])[1] + at.get(key, 0) // 2
            at[key] = at.get(key, 0) + 1
        else:
            expected = rng.randint(1, 12)
        updates.append((key, expected, rng.choice(["processing", "failed", "completed"]), seq))
    return tasks, updates


@pytest.mark.parametrize("partitions", [1, 3, 17, 60])
@pytest.mark.parametrize("style", ["random", "advancing"])
def test_versioned_updates_equal_the_loop(spark, partitions, style):
    tasks, updates = update_case(partitions, True, style)
    expected, final = apply_in_order(tasks, [u[:3] for u in updates])
    task_df = spark.createDataFrame(
        [(k, "demo", "{}", "low", s, T0, T0, v) for k, (s, v) in tasks.items()],
        "id string, type string, payload string, priority string, status string, created_at timestamp, "
        "updated_at timestamp, version int")
    shuffled = [(k, e, s, T0 + dt.timedelta(seconds=q // 7), q) for k, e, s, q in updates]
    random.Random(9).shuffle(shuffled)
    update_df = spark.createDataFrame(
        shuffled, "id string, expected_version int, new_status string, requested_at timestamp, seq int")
    table, outcomes = changes.apply_updates(task_df, update_df, ["requested_at", "seq"], partitions=partitions)
    got = {r.seq: r.outcome for r in outcomes.collect()}
    assert [got[i] for i in range(len(updates))] == expected
    rows = {r.id: r for r in table.collect()}
    assert {k: [r.status, r.version] for k, r in rows.items()} == final
    untouched = [k for k in tasks if final[k] == tasks[k]]
    assert all(rows[k].updated_at == T0 for k in untouched)


def executions(spark, rows):
    return spark.createDataFrame(rows, "id string, task_id string, attempt int, status string, error string, "
                                       "started_at timestamp, finished_at timestamp")


def test_insert_ignores_repeats(spark):
    old = executions(spark, [("e0", "a", 1, "failed", "x", T0, T0)])
    rows = [(f"n{i}", "hot" if i % 2 else "a", 1 + i % 3, "started", None, T0 + dt.timedelta(seconds=i), None)
            for i in range(60)]
    table, outcomes = changes.insert_executions(old, executions(spark, rows), ["started_at"])
    seen, expected = {("a", 1)}, {}
    for r in rows:
        expected[r[0]] = "already_exists" if (r[1], r[2]) in seen else "inserted"
        seen.add((r[1], r[2]))
    assert {r.id: r.outcome for r in outcomes.collect()} == expected
    assert {r.id for r in table.collect()} == {"e0"} | {k for k, v in expected.items() if v == "inserted"}


def test_finish_executions(spark):
    old = executions(spark, [("e1", "a", 1, "started", None, T0, None), ("e2", "a", 2, "started", None, T0, None)])
    results = spark.createDataFrame(
        [("e1", "failed", "boom", T0, 1), ("e1", "succeeded", None, T0, 2), ("zz", "failed", "x", T0, 1)],
        "id string, status string, error string, finished_at timestamp, seq int")
    table, outcomes = changes.finish_executions(old, results, ["seq"])
    rows = {r.id: r for r in table.collect()}
    assert (rows["e1"].status, rows["e1"].error, rows["e1"].finished_at) == ("succeeded", None, T0)
    assert (rows["e2"].status, rows["e2"].finished_at) == ("started", None)
    assert {r.id: r.outcome for r in outcomes.collect()} == {"e1": "finished", "zz": "not_found"}


def test_delete_cascades(spark):
    tasks = spark.createDataFrame([("a",), ("b",)], "id string")
    old = executions(spark, [("e1", "a", 1, "started", None, T0, None), ("e2", "b", 1, "started", None, T0, None)])
    left, kept = changes.delete_tasks(tasks, old, spark.createDataFrame([("a",), ("a",)], "id string"))
    assert [r.id for r in left.collect()] == ["b"] and [r.id for r in kept.collect()] == ["e2"]


def test_insert_of_unknown_tasks_and_equal_order(spark):
    old = executions(spark, [])
    rows = [("n2", "a", 1, "started", None, T0, None), ("n1", "a", 1, "started", None, T0, None), ("n3", "zz", 1, "started", None, T0, None)]
    tasks = spark.createDataFrame([("a",), ("b",)], "id string")
    table, outcomes = changes.insert_executions(old, executions(spark, rows), ["started_at"], tasks=tasks)
    assert {r.id: r.outcome for r in outcomes.collect()} == {"n1": "inserted", "n2": "already_exists", "n3": "unknown_task"}
    assert [r.id for r in table.collect()] == ["n1"]


@pytest.mark.parametrize("partitions", [1, 8])
def test_updates_without_an_expected_version(spark, partitions):
    tasks = spark.createDataFrame([("a", "t", "{}", "low", "queued", T0, T0, 1)], "id string, type string, payload string, "
                                  "priority string, status string, created_at timestamp, updated_at timestamp, version int")
    rows = [("a" if i % 5 else "zz", None if i % 3 == 0 else 1, "processing", T0 + dt.timedelta(seconds=i)) for i in range(200)]
    updates = spark.createDataFrame(rows, "id string, expected_version int, new_status string, requested_at timestamp")
    _, outcomes = changes.apply_updates(tasks, updates, ["requested_at"], partitions=partitions)
    got = {r.requested_at: r.outcome for r in outcomes.collect()}
    first = next(r[3] for r in rows if r[0] == "a" and r[1] == 1)
    assert got == {r[3]: "not_found" if r[0] == "zz" else "updated" if r[3] == first else "version_conflict" for r in rows}


def test_delete_sorts_no_table(spark):
    tasks = spark.range(2000).selectExpr("cast(id AS string) AS id")
    executions = spark.range(6000).selectExpr("cast(id AS string) AS id", "cast(id % 2000 AS string) AS task_id")
    ids = spark.range(0, 4000, 2).selectExpr("cast(id % 2000 AS string) AS id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, kept = changes.delete_tasks(tasks, executions, ids)
        assert left.count() == 1000 and kept.count() == 3000
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort " not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_unknown_tasks_need_no_second_join(spark):
    schema = "id string, task_id string, attempt int, started_at timestamp"
    at = dt.datetime(2024, 1, 1)
    new = spark.createDataFrame([("a", "t", 1, at), ("b", "t", 1, at), ("c", "gone", 1, at), ("d", None, 1, at), ("e", "t", 2, at), ("f", "t", None, at)], schema)
    old = spark.createDataFrame([("z", "t", 2, at)], schema)
    table, outcomes = changes.insert_executions(old, new, ["started_at"], tasks=spark.createDataFrame([("t",)], "id string"))
    assert {r.id: r.outcome for r in outcomes.collect()} == {
        "a": "inserted", "b": "already_exists", "c": "unknown_task", "d": "unknown_task", "e": "already_exists", "f": "already_exists"}
    assert sorted(r.id for r in table.collect()) == ["a", "f", "z"]
    assert set(outcomes.columns) == {*new.columns, "outcome"}
    assert "Union" not in outcomes._jdf.queryExecution().optimizedPlan().toString()
