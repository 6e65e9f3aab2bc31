"""Lookups by id and ordered listings."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from workloom.functions.ids import parse_uuid, valid_uuid
from workloom.schemas import (
    INVALID_STATUS, INVALID_TASK_ID, LIMIT_RANGE, LIST_LIMIT_DEFAULT, LIST_LIMIT_MAX, OFFSET_RANGE,
    TASK_STATUSES,
)

TASK_COLUMNS = ("id", "type", "payload", "priority", "status", "created_at", "updated_at", "version")


def get_tasks(tasks: DataFrame, ids: DataFrame, id_column: str = "requested_id") -> DataFrame:
    """One row per requested id: `lookup` is found, not_found or invalid, plus the task's columns.

    A repeated request gives one row: requests are made distinct before the join, which also
    keeps a hot id from reaching it more than once.
    """
    asked = (ids.select(F.col(id_column).alias("requested_id")).distinct()
             .withColumn("id", valid_uuid("requested_id")))
    # An id that is none joins under a key of its own, so such ids don't meet in one partition.
    keyed = asked.withColumn("_key", F.coalesce("id", F.concat(F.lit("invalid "), F.coalesce("requested_id", F.lit("")))))
    found = keyed.join(tasks.select(F.col("id").alias("_key"), *[c for c in TASK_COLUMNS if c != "id"],
                                    F.lit(True).alias("_hit")), "_key", "left")
    return found.select(
        "requested_id",
        F.when(F.col("id").isNull(), "invalid").when(F.col("_hit"), "found")
        .otherwise("not_found").alias("lookup"),
        *[F.col(c).alias(f"task_{c}") for c in TASK_COLUMNS if c != "id"],
    )


def enrich(deliveries: DataFrame, tasks: DataFrame) -> DataFrame:
    """Deliveries with their task's type, priority, status and version; nulls when there is none.

    Tasks are unique per id, so adaptive execution can split a busy task's deliveries.
    """
    side = tasks.select(F.col("id").alias("task_id"), F.col("type").alias("task_type"),
                        F.col("priority").alias("task_priority"),
                        F.col("status").alias("task_status"), F.col("version").alias("task_version"))
    return deliveries.join(side, "task_id", "left")


def checked_limit(limit: int | None, strict: bool = True) -> int:
    if limit is None:
        return LIST_LIMIT_DEFAULT
    if 1 <= limit <= LIST_LIMIT_MAX:
        return limit
    if strict:
        raise ValueError(LIMIT_RANGE)
    return LIST_LIMIT_DEFAULT


def checked_offset(offset: int | None, strict: bool = True) -> int:
    if offset is None or offset >= 0:
        return offset or 0
    if strict:
        raise ValueError(OFFSET_RANGE)
    return 0


def checked_task_id(task_id: str) -> str:
    """The dashed lower-case form of an id given in any accepted form."""
    found = parse_uuid(task_id)
    if found is None:
        raise ValueError(f"{INVALID_TASK_ID}: {task_id!r}")
    return found


def check_status(status: str | None, strict: bool = True) -> None:
    if status and status not in TASK_STATUSES and strict:
        raise ValueError(INVALID_STATUS)


def list_order() -> list[Column]:
    """The order of the task list."""
    return [F.desc("created_at"), F.col("id")]


def filter_tasks(tasks: DataFrame, status: str | None = None, type: str | None = None) -> DataFrame:
    """Equality filters that apply only when given; both reach the file scan."""
    if status:
        tasks = tasks.where(F.col("status") == status)
    if type:
        tasks = tasks.where(F.col("type") == type)
    return tasks


def list_tasks(tasks: DataFrame, status: str | None = None, type: str | None = None,
               limit: int | None = None, offset: int | None = None, strict: bool = True) -> DataFrame:
    """One page of tasks, newest first, ties by id.

    `strict` rejects arguments outside their ranges; otherwise they fall back to the defaults.
    """
    check_status(status, strict)
    page = filter_tasks(tasks, status, type).orderBy(*list_order())
    offset = checked_offset(offset, strict)
    if offset:
        page = page.offset(offset)
    return page.limit(checked_limit(limit, strict)).select(*TASK_COLUMNS)


def list_executions(executions: DataFrame, task_id: str, limit: int | None = None,
                    strict: bool = True) -> DataFrame:
    """One task's executions, latest attempt first. An unknown task gives no rows.

    `strict` takes the id in any accepted form and rejects other text; otherwise it is compared
    as it is.
    """
    if strict:
        task_id = checked_task_id(task_id)
    return (executions.where(F.col("task_id") == task_id)
            .orderBy(F.desc("attempt"), "id").limit(checked_limit(limit, strict)))


def latest_executions(executions: DataFrame, k: int) -> DataFrame:
    """The latest k attempts of every task.

    The filter on the row number lets Spark keep k rows per task in each map task, so a hot
    task shuffles k rows per map task and not all of its own.
    """
    newest_first = Window.partitionBy("task_id").orderBy(F.desc("attempt"), "id")
    return (executions.withColumn("recency", F.row_number().over(newest_first))
            .where(F.col("recency") <= k))
