"""Stream state of many tasks under one key, so that a task costs no call to the state store of its own."""

import json

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 4096


def bucket_of(task_id: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(task_id), F.lit(buckets)).cast("int")


def in_buckets(tasks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, tasks): the rows of `tasks`, which have a task_id, as each bucket's text."""
    return tasks.groupBy(bucket_of("task_id", buckets).alias("bucket")).agg(
        F.to_json(F.collect_list(F.struct(*tasks.columns))).alias("tasks"))


def unpack(state: tuple | None) -> dict[str, dict]:
    """A bucket's tasks by id, from the value of its state."""
    return {task["task_id"]: task for task in json.loads(state[0])} if state else {}


def pack(tasks: dict[str, dict]) -> str:
    return json.dumps(list(tasks.values()), separators=(",", ":"))
