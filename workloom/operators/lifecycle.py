"""What each delivery of a task did, and what that leaves behind.

A queued task stays queued through deliveries that fail and may be tried again. Each of those
leaves an execution for its attempt, and attempts at the limit end the task, so at most
`max_attempts - 1` deliveries can requeue it and the next one ends it. Whatever follows has no
effect. A task's outcome therefore needs only its first `max_attempts` deliveries, and those
are kept by a row-number filter that already runs before the shuffle. The length of a task's
delivery log never matters.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from workloom.functions.chain import chained
from workloom.functions.ids import stable_uuid
from workloom.functions.timing import backoff_ms, shifted
from workloom.schemas import (
    BACKOFF_BASE_MS, BACKOFF_CAP_MS, BUILTIN_TASK_TYPES, DEAD_LETTERED, EFFECTIVE, MAX_ATTEMPTS,
    MAX_ATTEMPTS_TEXT, NO_HANDLER_TEXT, RAN, TERMINAL_STATUSES,
)


def with_attempts(deliveries: DataFrame) -> DataFrame:
    """Deliveries with a usable attempt: one without a count, or with one below 1, is the first."""
    return deliveries.withColumn("attempt", F.greatest(F.coalesce("attempt", F.lit(1)), F.lit(1)).cast("int"))


def effects(tasks: DataFrame, deliveries: DataFrame, order: list[str],
            handlers=BUILTIN_TASK_TYPES, max_attempts: int = MAX_ATTEMPTS,
            executions: DataFrame | None = None) -> DataFrame:
    """The deliveries that changed something, each with its `disposition`.

    `deliveries` has task_id, attempt (see `with_attempts`), outcome (ok, permanent or retryable: what the
    handler would say) and columns to carry along; `order` names columns that order a task's
    deliveries totally. Adds task_type, task_priority, task_version and pair_exists. At most
    `max_attempts` rows per task come out.
    """
    in_order = Window.partitionBy("task_id").orderBy(*order)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    early = (with_attempts(deliveries).withColumn("_nth", F.row_number().over(in_order))
             .where(F.col("_nth") <= max_attempts).drop("_nth"))
    if executions is None:
        early = early.withColumn("pair_exists", F.lit(False))
    else:
        recorded = executions.select("task_id", "attempt", F.lit(True).alias("pair_exists"))
        early = (early.join(recorded, ["task_id", "attempt"], "left")
                 .withColumn("pair_exists", F.coalesce("pair_exists", F.lit(False))))
    queued = tasks.where(F.col("status") == "queued").select(
        F.col("id").alias("task_id"), F.col("type").alias("task_type"),
        F.col("priority").alias("task_priority"), F.col("version").alias("task_version"))
    own = (
        F.when(F.col("attempt") > max_attempts, "max_attempts_dlq")
        .when(~F.col("task_type").isin(*handlers), "no_handler_dlq")
        .when(F.col("pair_exists") | F.array_contains("_tried", F.col("attempt")), "dup_execution_stuck")
        .when(F.col("outcome") == "ok", "completed")
        .when(F.col("outcome") == "permanent", "permanent_dlq")
        .when(F.col("attempt") >= max_attempts, "exhausted_dlq")
        .otherwise("requeued")
    )
    return (
        early.join(queued, "task_id")
        .withColumn("_tried", F.collect_list("attempt").over(before))
        .withColumn("disposition", own)
        .withColumn("_ended", F.count_if(F.col("disposition") != "requeued").over(before))
        .where(F.col("_ended") == 0)
        .drop("_tried", "_ended")
    )


def replay(tasks: DataFrame, deliveries: DataFrame, order: list[str],
           handlers=BUILTIN_TASK_TYPES, max_attempts: int = MAX_ATTEMPTS,
           executions: DataFrame | None = None) -> DataFrame:
    """Every delivery with its `disposition`, including those without effect.

    The outcome of each task is found first (see `effects`); a delivery then only compares its
    position with the one that ended its task. That join has one row per task on its right side,
    so adaptive execution can split a task with very many deliveries.
    """
    deliveries = with_attempts(deliveries)
    position = F.struct(*order)
    ended = (
        effects(tasks, deliveries.select("task_id", "attempt", "outcome",
                                         *[c for c in order if c not in ("attempt", "outcome")]),
                order, handlers, max_attempts, executions)
        .where(F.col("disposition") != "requeued")
        .select("task_id", position.alias("_end"), F.col("disposition").alias("_ended_as"))
    )
    known = tasks.select(F.col("id").alias("task_id"), F.col("status").alias("_status"),
                         F.col("type").alias("task_type"), F.col("priority").alias("task_priority"))
    joined = deliveries.join(known.join(ended, "task_id", "left"), "task_id", "left")
    disposition = (
        F.when(F.col("_status").isNull(), "not_found")
        .when(F.col("_status").isin(*TERMINAL_STATUSES), "terminal_noop")
        .when(F.col("_status") != "queued", "in_flight_noop")
        .when(F.col("_end").isNull() | (position < F.col("_end")), "requeued")
        .when(position == F.col("_end"), F.col("_ended_as"))
        .when(F.col("_ended_as") == "dup_execution_stuck", "in_flight_noop")
        .otherwise("terminal_noop")
    )
    return joined.withColumn("disposition", disposition).drop("_status", "_end", "_ended_as")


def version_step(disposition: Column | str = "disposition") -> Column:
    disposition = F.col(disposition) if isinstance(disposition, str) else disposition
    return (F.when(disposition.isin("max_attempts_dlq", "dup_execution_stuck"), 1)
            .when(disposition.isin(*EFFECTIVE), 2).otherwise(0))


def status_after(disposition: Column | str = "disposition") -> Column:
    disposition = F.col(disposition) if isinstance(disposition, str) else disposition
    return (F.when(disposition == "completed", "completed")
            .when(disposition == "requeued", "queued")
            .when(disposition == "dup_execution_stuck", "processing")
            .when(disposition.isin(*DEAD_LETTERED), "failed"))


def final_tasks(tasks: DataFrame, replayed: DataFrame, order: list[str],
                clock: str = "delivered_at") -> DataFrame:
    """The task table after the log; takes the rows of `effects` or of `replay`."""
    changed = (
        replayed.where(F.col("disposition").isin(*EFFECTIVE))
        .groupBy(F.col("task_id").alias("id"))
        .agg(F.max_by(status_after(), F.struct(*order)).alias("_status"),
             F.max_by(F.col(clock), F.struct(*order)).alias("_at"),
             F.sum(version_step()).cast("int").alias("_steps"))
    )
    return tasks.join(changed, "id", "left").select(
        "id", "type", "payload", "priority",
        F.coalesce("_status", "status").alias("status"), "created_at",
        F.coalesce("_at", "updated_at").alias("updated_at"),
        (F.col("version") + F.coalesce("_steps", F.lit(0))).cast("int").alias("version"),
    )


def error_text(max_attempts: int = MAX_ATTEMPTS, handler_error: str = "error") -> Column:
    return (
        F.when(F.col("disposition") == "max_attempts_dlq", F.lit(f"{MAX_ATTEMPTS_TEXT}({max_attempts})"))
        .when(F.col("disposition") == "no_handler_dlq",
              F.concat(F.lit(NO_HANDLER_TEXT + '"'), F.col("task_type"), F.lit('"')))
        .when(F.col("disposition").isin("permanent_dlq", "exhausted_dlq", "requeued"), F.col(handler_error))
    )


def executions_of(affected: DataFrame, max_attempts: int = MAX_ATTEMPTS,
                  clock: str = "delivered_at", duration_ms: str | None = None) -> DataFrame:
    """Execution rows that the rows of `effects` leave behind.

    A dead letter that never ran writes its row only when its attempt has none yet.
    """
    writes = F.col("disposition").isin(*RAN) | (
        F.col("disposition").isin("max_attempts_dlq", "no_handler_dlq") & ~F.col("pair_exists"))
    finished = F.col(clock) if duration_ms is None else shifted(clock, F.col(duration_ms) * 1_000)
    return affected.where(writes).select(
        stable_uuid("task_id", "attempt").alias("id"), "task_id", "attempt",
        F.when(F.col("disposition") == "completed", "succeeded").otherwise("failed").alias("status"),
        error_text(max_attempts).alias("error"),
        F.col(clock).alias("started_at"),
        F.when(F.col("disposition").isin(*RAN), finished).otherwise(F.col(clock)).alias("finished_at"),
    )


def number_attempts(deliveries: DataFrame, message: str, clock: str, order: list[str],
                    partitions: int | None = None) -> DataFrame:
    """Adds `attempt`: the running number of each delivery of a message, in order of `clock` and `order`.

    Rows are numbered in ranges of (message, time) that are chained (see `chained`), so a message delivered any number of
    times is spread over as many tasks as it needs. Deliveries without a message are numbered as those of one
    message, and deliveries without a time come first.
    """
    counted = chained(deliveries.withColumn("_one", F.lit(1).cast("bigint")), [message], [clock, *order],
                      sums={"_nth": "_one"}, partitions=partitions)
    return counted.withColumn("attempt", F.col("_nth").cast("int")).drop("_one", "_nth")


def retry_schedule(replayed: DataFrame, clock: str = "delivered_at",
                   base_ms: int = BACKOFF_BASE_MS, cap_ms: int = BACKOFF_CAP_MS) -> DataFrame:
    """Adds `action` (retry after a requeue, else ack), `delay_ms` and `next_at` for retries."""
    again = F.col("disposition") == "requeued"
    return (
        replayed.withColumn("action", F.when(again, "retry").otherwise("ack"))
        .withColumn("delay_ms", F.when(again, backoff_ms("attempt", base_ms, cap_ms)))
        .withColumn("next_at", F.when(again, shifted(clock, F.col("delay_ms") * 1_000)))
    )


def failure_class(outcome: Column | str = "outcome") -> Column:
    """permanent or retryable for a failed run, null for a successful one."""
    outcome = F.col(outcome) if isinstance(outcome, str) else outcome
    return F.when(outcome == "ok", None).when(outcome == "permanent", "permanent").otherwise("retryable")
