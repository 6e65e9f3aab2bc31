"""Table constraints as queries that return what breaks them."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from workloom.schemas import EXECUTION_STATUSES, PRIORITIES, TASK_STATUSES
from workloom.session import ship_package

#: About so many keys are told apart in one task.
ROWS_PER_TASK = 1_500_000

_TASK_REQUIRED = ("id", "type", "payload", "priority", "status", "created_at", "updated_at", "version")
_EXECUTION_REQUIRED = ("id", "task_id", "attempt", "status", "started_at")
_DANGLING = "foreign key task_id"


def _broken_rules(df: DataFrame, table: str, required, value_sets: dict) -> DataFrame:
    rules = [F.when(F.col(c).isNull(), F.lit(f"{c} not null")) for c in required]
    rules += [F.when(~F.col(c).isin(*allowed), F.lit(f"{c} check")) for c, allowed in value_sets.items()]
    broken = F.filter(F.array(*rules), lambda rule: rule.isNotNull())
    return df.select(F.lit(table).alias("table_name"), F.col("id").alias("row_id"),
                     F.explode(broken).alias("rule"))


def constraint_violations(tasks: DataFrame, executions: DataFrame) -> DataFrame:
    """One row per (row, broken rule), in one pass over each table and without a shuffle."""
    return _broken_rules(tasks, "tasks", _TASK_REQUIRED,
                         {"status": TASK_STATUSES, "priority": PRIORITIES}).unionAll(
        _broken_rules(executions, "task_executions", _EXECUTION_REQUIRED,
                      {"status": EXECUTION_STATUSES}))


def _count_batches(*key: str):
    """Counts the keys of each Arrow batch."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = pa.Table.from_batches([batch]).group_by(list(key), use_threads=False).aggregate([([], "count_all")])
            yield from counted.select([*key, "count_all"]).rename_columns([*key, "n_rows"]).to_batches()
    return work


def _repeated(df: DataFrame, n: int, table: str, rule: str, *key: str) -> DataFrame:
    ship_package(df.sparkSession)
    given = df.dropna(subset=list(key)).select(*key)
    kinds = ", ".join(f"`{k}` {given.schema[k].dataType.simpleString()}" for k in key)
    counted = given.mapInArrow(_count_batches(*key), f"{kinds}, n_rows bigint").repartition(max(1, -(-n // ROWS_PER_TASK)), *key)
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    return (counted.groupBy(*key).agg(F.sum("n_rows").alias("n_rows")).where("n_rows > 1")
            .select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), text.alias("key_value"), "n_rows"))


def unique_violations(tasks: DataFrame, executions: DataFrame) -> DataFrame:
    """Keys that occur more than once, told apart by their columns. A key with a null in it breaks no unique rule.

    Keys are counted a batch at a time before they are shuffled, so a hot key sends a row a batch, and a task that reads
    keeps none of its keys. The tables' rows are counted when called: the more rows, the more tasks tell the keys apart.
    """
    n_tasks, n_executions = tasks.count(), executions.count()
    return (
        _repeated(tasks, n_tasks, "tasks", "primary key", "id")
        .unionAll(_repeated(executions, n_executions, "task_executions", "primary key", "id"))
        .unionAll(_repeated(executions, n_executions, "task_executions", "unique task_id attempt", "task_id", "attempt"))
    )


def fk_violations(tasks: DataFrame, executions: DataFrame) -> DataFrame:
    """Task ids that executions point at in vain, with the number of such executions. A null points at nothing.

    Executions are counted per id before the join, so a hot id crosses it once.
    """
    pointed_at = executions.where("task_id IS NOT NULL").groupBy("task_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return pointed_at.join(tasks.select(F.col("id").alias("task_id")), "task_id", "left_anti")


def violations(tasks: DataFrame, executions: DataFrame) -> DataFrame:
    """All broken constraints as (table_name, rule, key_value, n_rows); rules of single rows name the row's id.

    Only rows that break a rule, and counts of keys, are shuffled.
    """
    rows = constraint_violations(tasks, executions).groupBy("table_name", "rule", F.col("row_id").alias("key_value")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    dangling = fk_violations(tasks, executions).select(
        F.lit("task_executions").alias("table_name"), F.lit(_DANGLING).alias("rule"), F.col("task_id").alias("key_value"), "n_rows")
    return rows.unionByName(unique_violations(tasks, executions)).unionByName(dangling)
