"""Change sets applied to tables: (old table, changes) -> (new table, outcome per change)."""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from workloom.session import ship_package, stash

_UPDATED, _CONFLICT, _MISSING, _OPEN = "updated", "version_conflict", "not_found", "open"


class _OpenRun:
    """Version checks of one id whose version on entry is not known yet.

    Entry versions that have reached the same version stay together, and they keep their order,
    so each group is a range. A request is accepted for exactly the range that stands at its
    expected version.
    """

    def __init__(self):
        self.standing = {}

    def accept(self, expected: int | None) -> tuple[int, int]:
        if expected is None:  # no version fits, so no entry version does
            return (0, -1)
        moved = self.standing.get(expected, (expected, expected))
        if moved is None:
            return (0, -1)
        self.standing[expected] = None
        ahead = self.standing.get(expected + 1, (expected + 1, expected + 1))
        self.standing[expected + 1] = moved if ahead is None else (moved[0], ahead[1])
        return moved

    def exits(self) -> list[tuple[int, int, int]]:
        return [(low_high[0], low_high[1], version)
                for version, low_high in self.standing.items() if low_high is not None]


_EDGE_FIELDS = [
    pa.field("outcome", pa.string()), pa.field("low", pa.int64()), pa.field("high", pa.int64()),
    pa.field("segment", pa.int32()), pa.field("lows", pa.list_(pa.int64())),
    pa.field("highs", pa.list_(pa.int64())), pa.field("exits", pa.list_(pa.int64())),
    pa.field("exit_version", pa.int64()),
]


def _check_versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decides the requests of one range partition, sorted by id and order.

    An id's own row comes before its requests. Only the first id of a partition can lack it
    without being unknown: it may continue from the partition before. Its requests stay open,
    with the range of entry versions that would accept them.
    """
    segment = TaskContext.get().partitionId()
    current = version = run = schema = None
    seen_first = False

    def edge() -> dict | None:
        if run is not None:
            lows, highs, exits = (list(part) for part in zip(*run.exits()))
            return {"id": current, "segment": segment, "lows": lows, "highs": highs, "exits": exits}
        if version is not None:
            return {"id": current, "segment": segment, "exit_version": version}
        return None

    for batch in batches:
        schema = schema or pa.schema([*batch.schema, *_EDGE_FIELDS])
        outcomes, lows, highs, edges = [], [], [], []
        for key, own, expected in zip(*(batch.column(name).to_pylist()
                                        for name in ("id", "_own_version", "expected_version"))):
            if key != current:
                if run is not None:
                    edges.append(edge())
                current, version = key, own
                run = _OpenRun() if own is None and not seen_first else None
                seen_first = True
                if own is not None:
                    outcomes.append(None), lows.append(None), highs.append(None)
                    continue
            low = high = None
            if run is not None:
                low, high = run.accept(expected)
                outcome = _OPEN
            elif version is None:
                outcome = _MISSING
            elif version == expected:
                version += 1
                outcome = _UPDATED
            else:
                outcome = _CONFLICT
            outcomes.append(outcome), lows.append(low), highs.append(high)
        n = batch.num_rows
        decided = pa.RecordBatch.from_arrays([
            *batch.columns, pa.array(outcomes, pa.string()), pa.array(lows, pa.int64()),
            pa.array(highs, pa.int64()), pa.array([segment] * n, pa.int32()),
            *[pa.nulls(n, field.type) for field in _EDGE_FIELDS[4:]]], schema=schema)
        yield decided.filter(decided.column("outcome").is_valid())
        if edges:
            yield pa.RecordBatch.from_pylist(edges, schema=schema)
    last = edge() if current is not None else None
    if last is not None:
        yield pa.RecordBatch.from_pylist([last], schema=schema)


def _entry_versions(edges: pd.DataFrame) -> pd.DataFrame:
    """Follows one id through its segments; the edges are what its partitions left behind."""
    version, entries = None, []
    for edge in edges.sort_values("segment").itertuples():
        if edge.exits is None:
            version = int(edge.exit_version)
            continue
        entries.append((edge.id, edge.segment, version))
        if version is not None:
            for low, high, leaves_as in zip(edge.lows, edge.highs, edge.exits):
                if low <= version <= high:
                    version = int(leaves_as)
                    break
    return pd.DataFrame(entries, columns=["id", "segment", "entry_version"]).astype(
        {"entry_version": "Int64"})


def apply_updates(tasks: DataFrame, updates: DataFrame, order: list[str],
                  clock: str = "requested_at", partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Versioned updates in request order: accepted when the expected version is the current one.

    `updates` has id, expected_version, new_status, `clock` and the `order` columns. Returns the
    new task table and every update with its outcome: updated, version_conflict or not_found. A
    null expected version fits no task. The check itself runs when this is called, not with the
    returned plans.

    The rows are cut into equal ranges of (id, order), so an id with any number of updates is
    spread over as many partitions as it needs. Each partition checks its own rows in one pass
    and leaves at most two edge rows, for the ids it shares with its neighbours; those are
    followed per id and joined back by broadcast, at most one row per partition. The checked
    rows are written once, as both steps must see the same ranges.
    """
    ship_package(updates.sparkSession)
    kept = list(dict.fromkeys(["id", *order, "expected_version", "new_status", clock]))
    requests = updates.select(*kept, F.lit(1).alias("_after"), F.lit(None).cast("int").alias("_own_version"))
    own = tasks.select("id", F.lit(0).alias("_after"), F.col("version").alias("_own_version"))
    ranged = requests.unionByName(own, allowMissingColumns=True)
    keys = ["id", "_after", *order]
    ranged = (ranged.repartitionByRange(partitions, *keys) if partitions
              else ranged.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in ranged.schema])
    for name, kind in (("outcome", T.StringType()), ("low", T.LongType()), ("high", T.LongType()),
                       ("segment", T.IntegerType()), ("lows", longs), ("highs", longs),
                       ("exits", longs), ("exit_version", T.LongType())):
        schema = schema.add(name, kind, True)
    checked = stash(ranged.mapInArrow(_check_versions, schema), "version-checks")

    edges = checked.where(F.col("outcome").isNull())
    entries = edges.groupBy("id").applyInPandas(
        _entry_versions, "id string, segment int, entry_version bigint")
    rows = checked.where(F.col("outcome").isNotNull())
    settled = (
        F.when(F.col("outcome") != _OPEN, F.col("outcome"))
        .when(F.col("entry_version").isNull(), _MISSING)
        .when(F.col("entry_version").between(F.col("low"), F.col("high")), _UPDATED)
        .otherwise(_CONFLICT)
    )
    outcomes = (rows.join(F.broadcast(entries), ["id", "segment"], "left")
                .select(*kept, settled.alias("outcome")))

    position = F.struct(*order)
    changed = (
        outcomes.where(F.col("outcome") == _UPDATED).groupBy("id")
        .agg(F.count(F.lit(1)).cast("int").alias("_steps"),
             F.max_by("new_status", position).alias("_status"),
             F.max_by(F.col(clock), position).alias("_at"))
    )
    new_tasks = tasks.join(changed, "id", "left").select(
        "id", "type", "payload", "priority",
        F.coalesce("_status", "status").alias("status"), "created_at",
        F.coalesce("_at", "updated_at").alias("updated_at"),
        (F.col("version") + F.coalesce("_steps", F.lit(0))).cast("int").alias("version"),
    )
    return new_tasks, outcomes


def insert_executions(executions: DataFrame, new: DataFrame, order: list[str],
                      tasks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert, ignoring repeats of (task_id, attempt): the first new row wins unless one exists.

    Returns the new table and every new row with outcome inserted or already_exists. With
    `tasks`, a row whose task does not exist is not inserted and its outcome is unknown_task. The
    table is built from winners alone, found by a row-number filter that runs before the shuffle.
    Rows that `order` leaves equal are told apart by their id.
    """
    pair = ["task_id", "attempt"]
    order = [*order, "id"] if "id" not in order else list(order)
    offered = new
    if tasks is not None:
        known = tasks.select(F.col("id").alias("task_id")).distinct().withColumn("_known", F.lit(True))
        offered = offered.join(known, "task_id", "left")
        new = offered.where("_known").drop("_known")
    first = Window.partitionBy(*pair).orderBy(*order)
    winners = (
        new.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") == 1).drop("_nth")
        .join(executions.select(*pair), pair, "left_anti")
    )
    table = executions.unionByName(winners.select(*executions.columns))
    winning = winners.select(*pair, F.struct(*order).alias("_winner"))
    outcome = F.when(F.struct(*order) == F.col("_winner"), "inserted").otherwise("already_exists")
    if tasks is not None:
        # The winners' tasks are known, so the rows of other tasks find none.
        outcome = F.when(F.col("_known").isNull(), "unknown_task").otherwise(outcome)
    outcomes = offered.join(winning, pair, "left").withColumn("outcome", outcome).drop("_winner", "_known")
    return table, outcomes


def finish_executions(executions: DataFrame, results: DataFrame,
                      order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Set status, error and finished_at by execution id; the last result of an id counts.

    Returns the new table and one row per result id with outcome finished or not_found. Results
    are reduced to one per id before the join.
    """
    last = results.groupBy("id").agg(
        F.max_by(F.struct("status", "error", "finished_at"), F.struct(*order)).alias("_result"))
    hit = F.col("_result").isNotNull()
    table = executions.join(last, "id", "left").select(
        "id", "task_id", "attempt",
        F.when(hit, F.col("_result.status")).otherwise(F.col("status")).alias("status"),
        F.when(hit, F.col("_result.error")).otherwise(F.col("error")).alias("error"),
        "started_at",
        F.when(hit, F.col("_result.finished_at")).otherwise(F.col("finished_at")).alias("finished_at"),
    )
    outcomes = last.join(executions.select("id", F.lit(True).alias("_hit")), "id", "left").select(
        "id", F.when(F.col("_hit"), "finished").otherwise("not_found").alias("outcome"))
    return table, outcomes


def delete_tasks(tasks: DataFrame, executions: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given tasks and their executions.

    Only the ids are held, each partition's own in one hash table; the tables' rows pass by it unsorted.
    """
    gone = ids.select("id").distinct().hint("shuffle_hash")
    left = tasks.join(gone, "id", "left_anti")
    kept = executions.join(gone.select(F.col("id").alias("task_id")), "task_id", "left_anti")
    return left, kept
