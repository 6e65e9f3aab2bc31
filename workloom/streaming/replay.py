"""The delivery replay on a stream, its tasks kept in buckets of state."""

import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from workloom.operators.lifecycle import with_attempts
from workloom.schemas import BUILTIN_TASK_TYPES, MAX_ATTEMPTS, TERMINAL_STATUSES
from workloom.session import ship_package
from workloom.streaming import buckets as _buckets_module
from workloom.streaming.buckets import BUCKETS, bucket_of, in_buckets, pack, unpack

# The process that sets up a stream's state does not see files added to the session, so this
# module's code travels with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(_buckets_module)

_OUTPUT = ("task_id string, task_type string, disposition string, attempt int, n_deliveries bigint, "
           "status string, version int, {carried}")


def _in_order(row: Row, n: int) -> tuple:
    """Sorts as the batch does: by the n order columns' values, with nulls first."""
    return tuple((row[f"order_{i}"] is not None, row[f"order_{i}"]) for i in range(n))

_FINAL = {"completed": "completed", "dup_execution_stuck": "processing"}


def _first_of_batches(most: int, order: list[str]):
    """Of each Arrow batch, each task's first `most` rows in order, and how many more there were as one row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [(name, "ascending") for name in ("task_id", *order)]
            batch = batch.take(pc.sort_indices(pa.Table.from_batches([batch]), keys, null_placement="at_start"))
            task = batch.column("task_id").fill_null("")
            head = np.ones(n, bool)
            head[1:] = pc.not_equal(task.slice(1), task.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(head)
            rank = np.arange(n) - starts[np.cumsum(head) - 1]
            yield batch.filter(pa.array(rank < most))
            sizes = np.diff(starts, append=n)
            long = sizes > most
            if long.any():
                firsts = batch.column("task_id").take(pa.array(starts[long]))
                more = pa.array(sizes[long] - most)
                yield pa.RecordBatch.from_arrays(
                    [firsts if f.name == "task_id" else more if f.name == "more" else batch.column("bucket").take(pa.array(starts[long]))
                     if f.name == "bucket" else pa.nulls(len(more), f.type) for f in batch.schema],
                    schema=batch.schema)
    return work


class _TaskReplay(StatefulProcessor):
    """Advances the tasks of one bucket by the deliveries of a micro-batch."""

    def __init__(self, handlers: frozenset[str], max_attempts: int, n_order: int, carry: list[str], joined: bool):
        self._handlers = handlers
        self._max_attempts = max_attempts
        self._n_order = n_order
        self._carry = carry
        self._joined = joined

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._tasks = handle.getValueState("tasks", "tasks string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._tasks.update((initialState.tasks,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        totals, given = {}, {}
        for row in rows:
            totals[row.task_id] = totals.get(row.task_id, 0) + (row.more or 1)
            held = given.setdefault(row.task_id, [])
            if row.more is None:
                held.append(row)
                if len(held) >= 8 * self._max_attempts + 64:
                    held[:] = self._first(held)
        tasks = unpack(self._tasks.get())
        changed = False
        for task_id, held in given.items():
            known = tasks.get(task_id)
            if known is None and self._joined:
                row = held[0]
                known = {"task_id": task_id, "status": row.status, "version": row.version, "task_type": row.task_type, "tried": row.tried}
            if known is None:
                yield self._row(task_id, None, "not_found", None, totals[task_id], None, None)
                continue
            if known.get("status") == "queued":
                tasks[task_id] = known
                changed = True
            yield from self._advance(known, self._first(held), totals[task_id])
        if changed:
            self._tasks.update((pack(tasks),))

    def _first(self, rows: list[Row]) -> list[Row]:
        return heapq.nsmallest(self._max_attempts, rows, key=lambda row: _in_order(row, self._n_order))

    def _advance(self, known: dict, early: list[Row], total: int) -> Iterator[Row]:
        task_id, task_type, status, version = (known.get(name) for name in ("task_id", "task_type", "status", "version"))
        n_effective = 0
        if status == "queued":
            tried = set(known.get("tried") or ())
            for row in early:
                attempt = row.attempt
                disposition = self._own_disposition(attempt, row.outcome, task_type, attempt in tried)
                tried.add(attempt)
                n_effective += 1
                version += 1 if disposition in ("max_attempts_dlq", "dup_execution_stuck") else 2
                status = "queued" if disposition == "requeued" else _FINAL.get(disposition, "failed")
                yield self._row(task_id, task_type, disposition, attempt, 1, status, version, row)
                if status != "queued":
                    break
            known.update(status=status, version=version, tried=sorted(tried) if status == "queued" else [])
        if total > n_effective:
            quiet = "terminal_noop" if status in TERMINAL_STATUSES else "in_flight_noop"
            yield self._row(task_id, task_type, quiet, None, total - n_effective, status, version)

    def _row(self, task_id, task_type, disposition, attempt, n_deliveries, status, version, row=None) -> Row:
        return Row(task_id=task_id, task_type=task_type, disposition=disposition, attempt=attempt,
                   n_deliveries=n_deliveries, status=status, version=version,
                   **{name: None if row is None else row[f"carried_{name}"] for name in self._carry})

    def _own_disposition(self, attempt, outcome, task_type, has_run) -> str:
        if attempt > self._max_attempts:
            return "max_attempts_dlq"
        if task_type not in self._handlers:
            return "no_handler_dlq"
        if has_run:
            return "dup_execution_stuck"
        if outcome in ("ok", "permanent"):
            return "completed" if outcome == "ok" else "permanent_dlq"
        return "exhausted_dlq" if attempt >= self._max_attempts else "requeued"

    def close(self) -> None:
        pass


def stream_replay(deliveries: DataFrame, tasks: DataFrame, order: list[str],
                  handlers=BUILTIN_TASK_TYPES, max_attempts: int = MAX_ATTEMPTS,
                  executions: DataFrame | None = None, carry: list[str] = (), initial_state: bool = False,
                  buckets: int = BUCKETS) -> DataFrame:
    """Dispositions of a delivery stream, as in the batch `replay`.

    A delivery that changes its task gives a row with the status and version after it, and with its
    `carry` columns, such as those a dead letter needs (subject, data, error and the time).
    Deliveries without effect are counted in `n_deliveries`. Micro-batches must arrive in log
    order; inside one, `order` decides. `tasks` and `executions` are the tables as the stream
    begins. With `initial_state` they are loaded into the state once, every task of them, and no
    micro-batch reads them again: for streams that run long. Without, each micro-batch joins what it holds with the
    tasks, and only those that were queued at the start carry state: for short runs, and tables that are mostly done.

    The state holds a task's status, type, version and the attempts already run, never more than
    `max_attempts`. Tasks are kept in `buckets` of their id, and a bucket is read and written once in a micro-batch
    that hits it, whatever the number of its tasks. More buckets suit small micro-batches over many tasks; the number
    must stay the same as long as the stream's checkpoint is used. A task's first `max_attempts` rows of a micro-batch decide, so each task of the
    stream's input sends that many rows of a task and a count of the rest for each of its Arrow batches; a
    task with very many deliveries is reduced wherever they are read. Needs the RocksDB state store
    (`session.use_rocksdb_state`).
    """
    ship_package(tasks.sparkSession)
    known = tasks.where("id IS NOT NULL").select(F.col("id").alias("task_id"), "status", F.col("version").cast("int").alias("version"),
                                                 F.col("type").alias("task_type"))
    if executions is None:
        known = known.withColumn("tried", F.array().cast("array<int>"))
    else:
        ran = (executions.where(F.col("attempt") <= max_attempts).groupBy("task_id")
               .agg(F.collect_set(F.col("attempt").cast("int")).alias("tried")))
        known = known.join(ran, "task_id", "left")
    carry, places = list(carry), [f"order_{i}" for i in range(len(order))]
    deliveries = with_attempts(deliveries)
    kinds = {name: deliveries.schema[name].dataType.simpleString() for name in carry}
    rows = deliveries.select(
        "task_id", "attempt", "outcome", *[F.col(name).alias(place) for place, name in zip(places, order)],
        *[F.col(name).alias(f"carried_{name}") for name in carry], F.lit(None).cast("bigint").alias("more"))
    rows = rows.withColumn("bucket", bucket_of("task_id", buckets))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
    reduced = rows.mapInArrow(_first_of_batches(max_attempts, places), schema)
    output = _OUTPUT.format(carried=", ".join(f"{name} {kind}" for name, kind in kinds.items())).rstrip(", ")
    processor = _TaskReplay(frozenset(handlers), max_attempts, len(order), carry, joined=not initial_state)
    if initial_state:
        return reduced.groupBy("bucket").transformWithState(
            processor, output, "append", "none", initialState=in_buckets(known, buckets).groupBy("bucket"))
    joined = reduced.join(known, "task_id", "left")
    settled = joined.where(F.col("status").isNull() | (F.col("status") != "queued")).select(
        "task_id", "task_type",
        F.when(F.col("status").isNull(), "not_found").when(F.col("status").isin(*TERMINAL_STATUSES), "terminal_noop")
        .otherwise("in_flight_noop").alias("disposition"),
        "attempt", F.coalesce("more", F.lit(1)).cast("bigint").alias("n_deliveries"), "status", "version",
        *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()])
    advanced = joined.where(F.col("status") == "queued").groupBy("bucket").transformWithState(processor, output, "append", "none")
    return settled.unionByName(advanced)
