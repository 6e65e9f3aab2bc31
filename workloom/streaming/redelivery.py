"""Redelivery of failed messages when their delay has passed, by timers of the stream's state."""

import datetime as dt
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from workloom.operators import handlers as _handlers_module
from workloom.operators.handlers import HandlerRegistry, is_permanent
from workloom.schemas import BACKOFF_BASE_MS, BACKOFF_CAP_MS, MAX_ATTEMPTS, NO_HANDLER_TEXT, TERMINAL_STATUSES
from workloom.session import ship_package
from workloom.streaming import buckets as _buckets_module
from workloom.streaming.buckets import BUCKETS, bucket_of, in_buckets, pack, unpack

# See streaming.replay: the process that sets up a stream's state does not see files added to the session.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(_handlers_module)
cloudpickle.register_pickle_by_value(_buckets_module)

_EPOCH = dt.datetime(1970, 1, 1)
_OUTPUT = ("task_id string, task_type string, attempt int, delivered_at timestamp, disposition string, error string, "
           "status string, version int, delay_ms bigint, next_at timestamp")


def _micros(at: dt.datetime) -> int:
    return (at.replace(tzinfo=None) - _EPOCH) // dt.timedelta(microseconds=1)


class _Redelivery(StatefulProcessor):
    """Runs the deliveries of one bucket's tasks, and holds back the next one of each until its time."""

    def __init__(self, registry: HandlerRegistry, max_attempts: int, base_ms: int, cap_ms: int):
        self._registry, self._max_attempts, self._base_ms, self._cap_ms = registry, max_attempts, base_ms, cap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._tasks = handle.getValueState("tasks", "tasks string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._tasks.update((initialState.tasks,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        given = {}
        for row in rows:
            given.setdefault(row.task_id, []).append((_micros(row.delivered_at), row.attempt))
        tasks = self._known()
        for task_id, deliveries in given.items():
            task = tasks.get(task_id)
            for at, attempt in sorted(deliveries):
                if task is None:
                    yield self._row(task_id, None, attempt, at, "not_found", None, None, None)
                else:
                    yield from self._due(task_id, task, at)
                    yield from self._deliver(task_id, task, attempt, at)
        yield from self._settle(tasks, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settle(self._known(), timerValues)

    def close(self) -> None:
        pass

    def _known(self) -> dict[str, "_Task"]:
        return {task_id: _Task(**kept) for task_id, kept in unpack(self._tasks.get()).items()}

    def _settle(self, tasks: dict[str, "_Task"], timerValues) -> Iterator[Row]:
        """Delivers what is due, keeps the tasks and sets a timer for the next one due."""
        until = timerValues.getCurrentWatermarkInMs() * 1_000
        for task_id, task in tasks.items():
            yield from self._due(task_id, task, until)
        if tasks:
            self._tasks.update((pack({task_id: task.kept() for task_id, task in tasks.items()}),))
        waiting = [task.due for task in tasks.values() if task.due is not None]
        if waiting:
            self._handle.registerTimer(-(-min(waiting) // 1_000))

    def _due(self, task_id: str, task: "_Task", until: int) -> Iterator[Row]:
        """The redeliveries whose time is not after `until`, each of which may call for another."""
        while task.due is not None and task.due <= until:
            at, attempt = task.due, task.attempt
            task.due = task.attempt = None
            yield from self._deliver(task_id, task, attempt, at)

    def _deliver(self, task_id: str, task: "_Task", attempt: int, at: int) -> Iterator[Row]:
        if task.status != "queued":
            quiet = "terminal_noop" if task.status in TERMINAL_STATUSES else "in_flight_noop"
            yield self._row(task_id, task, attempt, at, quiet, None, None, None)
            return
        error = delay = next_at = None
        if attempt > self._max_attempts:
            disposition = "max_attempts_dlq"
        elif self._registry.get(task.type) is None:
            disposition, error = "no_handler_dlq", f'{NO_HANDLER_TEXT}"{task.type}"'
        elif attempt in task.tried:
            disposition = "dup_execution_stuck"
        else:
            disposition, error = self._run(task_id, task)
            if disposition == "retryable":
                disposition = "exhausted_dlq" if attempt >= self._max_attempts else "requeued"
        task.tried.append(attempt)
        task.version += 1 if disposition in ("max_attempts_dlq", "dup_execution_stuck") else 2
        if disposition == "requeued":
            delay = min(self._base_ms * 2 ** min(attempt - 1, 40), self._cap_ms)
            next_at = at + delay * 1_000
            if task.due is None or next_at < task.due:
                task.attempt, task.due = attempt + 1, next_at
        else:
            task.status = {"completed": "completed", "dup_execution_stuck": "processing"}.get(disposition, "failed")
            task.attempt, task.due, task.tried = None, None, []
        yield self._row(task_id, task, attempt, at, disposition, error, delay, next_at)

    def _run(self, task_id: str, task: "_Task") -> tuple[str, str | None]:
        try:
            self._registry.get(task.type)({"id": task_id, "type": task.type, "payload": task.payload, "priority": task.priority})
            return "completed", None
        except Exception as error:
            return "permanent_dlq" if is_permanent(error) else "retryable", str(error)

    @staticmethod
    def _row(task_id, task, attempt, at, disposition, error, delay, next_at) -> Row:
        def moment(us):
            return None if us is None else (_EPOCH + dt.timedelta(microseconds=us)).replace(tzinfo=dt.timezone.utc)

        return Row(task_id=task_id, task_type=task and task.type, attempt=attempt, delivered_at=moment(at), disposition=disposition, error=error,
                   status=task and task.status, version=task and task.version, delay_ms=delay, next_at=moment(next_at))


class _Task:
    """A task's state while its rows are handled; `attempt` and `due` belong to the message that is held back."""

    def __init__(self, task_id, status=None, version=None, type=None, payload=None, priority=None, tried=None, attempt=None, due=None):
        self.task_id, self.status, self.version, self.type, self.payload, self.priority = task_id, status, version, type, payload, priority
        self.tried, self.attempt, self.due = list(tried or ()), attempt, due

    def kept(self) -> dict:
        return {name: value for name, value in vars(self).items() if value is not None and value != []}


def stream_redelivery(deliveries: DataFrame, tasks: DataFrame, registry: HandlerRegistry, delay: str = "0 seconds",
                      max_attempts: int = MAX_ATTEMPTS, base_ms: int = BACKOFF_BASE_MS, cap_ms: int = BACKOFF_CAP_MS,
                      buckets: int = BUCKETS) -> DataFrame:
    """Runs a stream of deliveries and brings failed ones back when their delay has passed.

    `deliveries` has task_id, delivered_at and attempt (null or below 1: the first); rows later than `delay` are dropped.
    `tasks`, as the stream begins, is its initial state. Every delivery gives a row with its disposition, and a
    requeued one is delivered again at `next_at` as the next attempt: its timer fires once the stream's time
    has passed that moment, in whatever micro-batch, and the row bears the moment itself. A message that waits is kept
    in the state, so it outlives a restart. Tasks are kept in `buckets` as in `stream_replay`. Null task ids are not found. Needs the RocksDB state store.
    """
    ship_package(tasks.sparkSession)
    known = tasks.where("id IS NOT NULL").select(F.col("id").alias("task_id"), "status", F.col("version").cast("int").alias("version"), "type",
                                                 "payload", "priority")
    attempt = F.greatest(F.coalesce("attempt", F.lit(1)), F.lit(1)).cast("int")
    rows = deliveries.select("task_id", F.col("delivered_at").cast("timestamp").alias("delivered_at"), attempt.alias("attempt")).withWatermark("delivered_at", delay)
    return rows.withColumn("bucket", bucket_of("task_id", buckets)).groupBy("bucket").transformWithState(
        _Redelivery(registry, max_attempts, base_ms, cap_ms), _OUTPUT, "append", "eventTime", initialState=in_buckets(known, buckets).groupBy("bucket"))
