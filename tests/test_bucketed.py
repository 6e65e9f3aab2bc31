"""Bucketed tables: versions, plans, and change sets that touch few buckets."""

import pytest
from pyspark.sql import functions as F

from workloom.operators import changes, lookup, metrics, stored
from workloom.session import fresh_path
from workloom.sources.bucketed import ConcurrentChange, _Folder, create_table, open_table

N = 40


def _id(i):
    return F.concat(F.lpad(i.cast("string"), 8, "0"), F.lit("-0000-4000-8000-000000000000"))


def _tasks(spark, n=400):
    at = F.lit("2024-01-01").cast("timestamp")
    return spark.range(n).select(_id(F.col("id")).alias("id"), F.lit("demo").alias("type"), F.lit("{}").alias("payload"), F.lit("low").alias("priority"),
                                 F.when(F.col("id") % 2 == 0, "completed").otherwise("queued").alias("status"), at.alias("created_at"),
                                 at.alias("updated_at"), F.lit(1).alias("version"))


def _executions(spark, n=400):
    at = F.lit("2024-01-01").cast("timestamp")
    return spark.range(2 * n).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"), _id((F.col("id") / 2).cast("long")).alias("task_id"),
                                     (F.col("id") % 2 + 1).cast("int").alias("attempt"), F.lit("started").alias("status"),
                                     F.lit(None).cast("string").alias("error"), at.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"))


@pytest.fixture(scope="module")
def tables(spark):
    return (create_table(_tasks(spark), fresh_path(spark, "t"), "id", N),
            create_table(_executions(spark), fresh_path(spark, "e"), "task_id", N, ["task_id", "attempt"]))


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_reads_what_was_written(spark, tables):
    tasks, executions = tables
    assert _rows(tasks.df()) == _rows(_tasks(spark)) and _rows(open_table(spark, executions.path).df()) == _rows(_executions(spark))


def test_one_task_reads_one_bucket(spark, tables):
    wanted = "00000007-0000-4000-8000-000000000000"
    found = stored.list_executions(tables[1], wanted.upper())
    assert [r.attempt for r in found.collect()] == [2, 1]
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    metric = {k: scan.metrics().get(k).get().value() for k in ("numPartitions", "numFiles")}
    assert metric == {"numPartitions": 1, "numFiles": 1}
    with pytest.raises(ValueError):
        stored.list_executions(tables[1], "x")


def test_joins_and_groups_by_the_key_need_no_exchange(spark, tables):
    tasks, executions = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # joins by more columns than the key
    try:
        for df in (metrics.audit(tasks.df(), executions.df()),
                   executions.df().join(tasks.df().select(F.col("id").alias("task_id"), F.col("type")), "task_id", "left_anti"),
                   executions.df().join(executions.df().select("task_id", "attempt", F.col("id").alias("other")), ["task_id", "attempt"]),
                   lookup.latest_executions(executions.df(), 1)):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert _rows(metrics.audit(tasks.df(), executions.df())) == _rows(metrics.audit(_tasks(spark), _executions(spark)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")


def test_a_change_rewrites_the_buckets_it_hits(spark):
    table = create_table(_tasks(spark, 4_000), fresh_path(spark, "t"), "id", N)
    whole = sum(table.generation_bytes().values())
    wanted = table.part([3]).select("id").limit(5)
    updates = wanted.select("id", F.lit(1).alias("expected_version"), F.lit("failed").alias("new_status"),
                            F.lit("2024-02-01").cast("timestamp").alias("requested_at"))
    updates = updates.unionByName(spark.range(50, 60).select(  # refused, so their buckets stay
        _id(F.col("id")).alias("id"), F.lit(9).alias("expected_version"), F.lit("failed").alias("new_status"),
        F.lit("2024-02-01").cast("timestamp").alias("requested_at")))
    new, outcomes = stored.apply_updates(table, updates, ["requested_at"])
    plain, plain_outcomes = changes.apply_updates(table.df(), updates, ["requested_at"])
    assert _rows(new.df()) == _rows(plain) and _rows(outcomes) == _rows(plain_outcomes)
    assert {b for b in new.parts if new.parts[b] != table.parts[b]} == {3}
    assert sum(new.generation_bytes().values()) - whole < 2.5 * whole / N  # parquet's own overhead included
    assert _rows(open_table(spark, table.path, 1).df()) == _rows(table.df())


def test_inserts_append(spark, tables):
    old = tables[1]
    new = _executions(spark, 3).unionByName(_executions(spark, 410).where("id IN ('e801', 'e802', 'e803', 'e810')"))
    new = new.unionByName(new.where("id = 'e801'").withColumn("id", F.lit("later")))
    table, outcomes = stored.insert_executions(old, new, ["id"])
    plain, plain_outcomes = changes.insert_executions(old.df(), new, ["id"])
    assert _rows(table.df()) == _rows(plain) and _rows(outcomes.select("id", "outcome")) == _rows(plain_outcomes.select("id", "outcome"))
    assert all(table.parts[b][:len(g)] == g for b, g in old.parts.items())
    again, _ = stored.insert_executions(table, new, ["id"])
    assert again.version == table.version  # nothing new, no new version
    whole = table.compact(most=1)
    assert _rows(whole.df()) == _rows(plain) and max(map(len, whole.parts.values())) == 1


def test_finish_and_delete(spark):
    tasks = create_table(_tasks(spark, 40), fresh_path(spark, "t"), "id", N)
    executions = create_table(_executions(spark, 40), fresh_path(spark, "e"), "task_id", N)
    results = spark.createDataFrame([("e3", "failed", "x", 1), ("e3", "succeeded", None, 2), ("nobody", "failed", "y", 1)],
                                    "id string, status string, error string, n int").withColumn("finished_at", F.lit("2024-03-01").cast("timestamp"))
    new, outcomes = stored.finish_executions(executions, results, ["n"])
    plain, plain_outcomes = changes.finish_executions(executions.df(), results, ["n"])
    assert _rows(new.df()) == _rows(plain) and _rows(outcomes) == _rows(plain_outcomes)
    ids = spark.createDataFrame([("00000001-0000-4000-8000-000000000000",), ("absent",)], "id string")
    left, kept = stored.delete_tasks(tasks, new, ids)
    want_left, want_kept = changes.delete_tasks(tasks.df(), new.df(), ids)
    assert _rows(left.df()) == _rows(want_left) and _rows(kept.df()) == _rows(want_kept.select(kept.schema.names)) and left.df().count() == 39


def test_two_changes_at_once_and_a_cut_short_one(spark):
    table = create_table(_tasks(spark, 20), fresh_path(spark, "t"), "id", 4)
    first = table.replace(table.part([0]).where("false"), [0])
    with pytest.raises(ConcurrentChange):
        table.replace(table.part([1]), [1])
    _Folder(spark, f"{table.path}/manifest").create("00000003.json", '{"key": "id", "buck')
    assert open_table(spark, table.path).version == first.version == 2
    assert _rows(open_table(spark, table.path).df()) == _rows(first.df())
    with pytest.raises(ValueError):
        first.replace(_tasks(spark, 20), [1])
    with pytest.raises(FileNotFoundError):
        open_table(spark, table.path, 9)


def test_empty_tables_and_rows_without_a_key(spark):
    empty = create_table(_tasks(spark, 0), fresh_path(spark, "t"), "id", 4)
    assert empty.df().count() == 0 and empty.append(_tasks(spark, 3)).df().count() == 3
    odd = create_table(_tasks(spark, 3).withColumn("id", F.when(F.col("status") == "queued", F.col("id"))), fresh_path(spark, "t"), "id", 4)
    assert odd.df().where("id IS NULL").count() == 2
