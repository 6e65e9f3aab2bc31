"""The change sets of `changes` applied to bucketed tables: only the buckets that change are read and written.

Each function returns the new version(s) of its table(s) and the outcomes that the function of the same kind in `changes`
gives. The old version stays readable until its files are removed.
"""

from pyspark.sql import DataFrame, functions as F

from workloom.operators import changes, lookup
from workloom.session import stash
from workloom.sources.bucketed import BucketedTable, bucket_of


def list_executions(table: BucketedTable, task_id: str, limit: int | None = None, strict: bool = True) -> DataFrame:
    """One task's executions from the one bucket that can hold them; `table` is kept by task_id."""
    wanted = lookup.checked_task_id(task_id) if strict else task_id
    return lookup.list_executions(table.rows_of(wanted), wanted, limit, strict)


def apply_updates(tasks: BucketedTable, updates: DataFrame, order: list[str], **options) -> tuple[BucketedTable, DataFrame]:
    """Versioned updates (see `changes.apply_updates`) on a task table kept by id.

    Tasks are read from the buckets that updates name; buckets in which no update was accepted stay as they are.
    """
    new, outcomes = changes.apply_updates(tasks.part(tasks.touched(updates, "id")), updates, order, **options)
    changed = tasks.touched(outcomes.where(F.col("outcome") == "updated"), "id")
    return tasks.replace(new.where(bucket_of("id", tasks.buckets).isin(changed)), changed), outcomes


def insert_executions(executions: BucketedTable, new: DataFrame, order: list[str],
                      tasks: DataFrame | None = None) -> tuple[BucketedTable, DataFrame]:
    """Insert, ignoring repeats of (task_id, attempt), into an execution table kept by task_id.

    Existing pairs are looked up in the buckets of the new rows; the winners are appended and nothing is rewritten.
    """
    new = stash(new, "offered-executions")
    known = executions.part(executions.touched(new, "task_id"))
    _, outcomes = changes.insert_executions(known, new, order, tasks)
    outcomes = stash(outcomes, "insert-outcomes")
    winners = outcomes.where(F.col("outcome") == "inserted").select(executions.schema.names)
    return executions.append(winners), outcomes


def finish_executions(executions: BucketedTable, results: DataFrame, order: list[str]) -> tuple[BucketedTable, DataFrame]:
    """Status, error and finished_at by execution id, in a table kept by task_id.

    Results name executions only, so their tasks are looked up first, in two columns of the table.
    """
    results = stash(results, "results")
    hit = executions.df().select("id", "task_id").join(results.select("id").distinct(), "id", "left_semi")
    buckets = executions.touched(hit)
    new, outcomes = changes.finish_executions(executions.part(buckets), results, order)
    outcomes = stash(outcomes, "finish-outcomes")
    return executions.replace(new, buckets), outcomes


def delete_tasks(tasks: BucketedTable, executions: BucketedTable, ids: DataFrame) -> tuple[BucketedTable, BucketedTable]:
    """Both tables without the given tasks and their executions.

    Executions go first, so that a run that is cut short leaves no execution without a task; another run ends the work.
    """
    ids = stash(ids.select("id"), "deleted-ids")
    of_tasks, of_executions = tasks.touched(ids, "id"), executions.touched(ids, "id")
    left, kept = changes.delete_tasks(tasks.part(of_tasks), executions.part(of_executions), ids)
    executions = executions.replace(kept, of_executions)
    return tasks.replace(left, of_tasks), executions
