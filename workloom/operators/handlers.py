"""User functions per task type, run where the rows are."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from workloom.functions.ids import stable_uuid
from workloom.functions.timing import backoff_ms
from workloom.schemas import DEAD_LETTER_SUBJECT, DEMO_FAILURE_TEXT, MAX_ATTEMPTS, NO_HANDLER_TEXT
from workloom.session import ship_package, stash

Handler = Callable[[dict], None]


class PermanentError(Exception):
    """A failure that another try would not mend."""


def is_permanent(error: BaseException | None) -> bool:
    """Whether the error, or one it was raised from, is permanent."""
    # By name: a class that travels with a query is a copy of the one that a function's own module imports.
    wanted = (PermanentError.__module__, PermanentError.__qualname__)
    while error is not None:
        if any((kind.__module__, kind.__qualname__) == wanted for kind in type(error).__mro__):
            return True
        error = error.__cause__
    return False


def _demo(task: dict) -> None:
    return None


def _fail(task: dict) -> None:
    raise PermanentError(DEMO_FAILURE_TEXT)


class HandlerRegistry:
    """Functions by task type. A function gets the task as a dict and raises to report failure."""

    def __init__(self, handlers: dict[str, Handler] | None = None):
        self._handlers = dict(handlers or {})

    @classmethod
    def with_defaults(cls) -> "HandlerRegistry":
        return cls({"demo": _demo, "fail": _fail})

    def register(self, task_type: str, handler: Handler) -> None:
        self._handlers[task_type] = handler

    def get(self, task_type: str) -> Handler | None:
        return self._handlers.get(task_type)

    @property
    def types(self) -> list[str]:
        return sorted(self._handlers)


def run_handlers(tasks: DataFrame, registry: HandlerRegistry) -> DataFrame:
    """Runs each task's function once. Adds `outcome` (ok, permanent, retryable, no_handler), `error`.

    Tasks without a function are settled by Spark; only the rest go through Python, in Arrow
    batches and without a shuffle.
    """
    ship_package(tasks.sparkSession)
    known = F.col("type").isin(*registry.types) if registry.types else F.lit(False)
    handled = F.coalesce(known, F.lit(False))
    columns = list(tasks.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            outcomes, errors = [], []
            for task in batch.to_dict("records"):
                try:
                    registry.get(task["type"])(task)
                    outcomes.append("ok"), errors.append(None)
                except Exception as error:
                    outcomes.append("permanent" if is_permanent(error) else "retryable")
                    errors.append(str(error))
            yield batch.assign(outcome=pd.Series(outcomes, index=batch.index, dtype="object"),
                               error=pd.Series(errors, index=batch.index, dtype="object"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema)
    ran = tasks.where(handled).mapInPandas(run, f"{schema}, outcome string, error string")
    unhandled = tasks.where(~handled).select(
        *columns, F.lit("no_handler").alias("outcome"),
        F.concat(F.lit(NO_HANDLER_TEXT + '"'), F.col("type"), F.lit('"')).alias("error"))
    return ran.unionByName(unhandled)


def run_with_retries(tasks: DataFrame, registry: HandlerRegistry,
                     max_attempts: int = MAX_ATTEMPTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs queued tasks, then those to retry, until none is left or attempts are spent.

    Returns (final tasks, executions, dead letters). Runs one job per round, at most
    `max_attempts`, each over what the round before left; every round is written once.
    """
    columns = list(tasks.columns)
    pending = tasks.where(F.col("status") == "queued")
    rounds = []
    for attempt in range(1, max_attempts + 1):
        ran = stash(run_handlers(pending, registry).withColumn("attempt", F.lit(attempt)), "handler-round")
        rounds.append(ran)
        pending = ran.where(F.col("outcome") == "retryable").select(*columns)
        if pending.isEmpty():
            break
    every = rounds[0]
    for ran in rounds[1:]:
        every = every.unionByName(ran)
    last = (F.col("outcome") != "retryable") | (F.col("attempt") == max_attempts)
    executions = every.select(
        stable_uuid("id", "attempt").alias("id"), F.col("id").alias("task_id"), "attempt",
        F.when(F.col("outcome") == "ok", "succeeded").otherwise("failed").alias("status"), "error",
        F.when(~last, backoff_ms("attempt")).alias("retry_after_ms"))
    ended = every.where(last)
    dead = ended.where(F.col("outcome") != "ok").select(
        F.lit(DEAD_LETTER_SUBJECT).alias("subject"), F.col("id").alias("task_id"),
        F.col("type").alias("task_type"), "attempt", "error")
    settled = ended.select(
        "id", F.when(F.col("outcome") == "ok", "completed").otherwise("failed").alias("_status"),
        (F.col("attempt") * 2).alias("_steps"))
    final = tasks.join(settled, "id", "left").withColumns({
        "status": F.coalesce("_status", "status"),
        "version": (F.col("version") + F.coalesce("_steps", F.lit(0))).cast("int"),
    }).select(*columns)
    return final, executions, dead
