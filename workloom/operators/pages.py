"""Pages of the task list by position.

A listing is a copy of the task table in list order (newest first, ties by id), cut into ranges of about equal size,
with the number of rows of each status and type that a range holds. A page is found by adding up these numbers: only
the ranges that hold its rows are read, so the page at offset ten million costs as much as the first one. Tasks that share
one creation time are spread over ranges by their ids. A listing does not follow its table: make a new one.

Null creation times come last, as in `lookup.list_tasks`. Tasks without status or type appear in pages that do not filter
by it. Pages behind the last row, and those of empty tables, are empty.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from workloom.operators.lookup import TASK_COLUMNS, check_status, checked_limit, checked_offset, filter_tasks, list_order
from workloom.schemas import TASKS

ROWS_PER_RANGE = 1_000_000
_RANGE = "_range"
_COUNTS = f"{_RANGE} int, status string, type string, n bigint"


@dataclass
class Listing:
    spark: SparkSession
    path: str
    schema: T.StructType

    def counts(self, status: str | None = None, type: str | None = None) -> list[tuple[int, int]]:
        """(range, rows) of the ranges that hold such tasks, in list order."""
        held = filter_tasks(self.spark.read.schema(_COUNTS).parquet(f"{self.path}/counts"), status, type)
        return [tuple(r) for r in held.groupBy(_RANGE).agg(F.sum("n")).orderBy(_RANGE).collect()]  # a row per range

    def page(self, status: str | None = None, type: str | None = None, limit: int | None = None,
             offset: int | None = None, strict: bool = True) -> DataFrame:
        """The page that `lookup.list_tasks` gives for the same arguments, from the ranges that hold its rows."""
        check_status(status, strict)
        offset, limit = checked_offset(offset, strict), checked_limit(limit, strict)
        before, first, chosen = 0, 0, []
        for number, rows in self.counts(status, type):
            if before < offset + limit and before + rows > offset:
                first = first if chosen else before
                chosen.append(number)
            before += rows
        if not chosen:
            return self.spark.createDataFrame([], self.schema).select(*TASK_COLUMNS)
        ranges = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/tasks/{_RANGE}={n}" for n in chosen])
        return (filter_tasks(ranges, status, type).orderBy(*list_order()).offset(offset - first).limit(limit)
                .select(*TASK_COLUMNS))


def build_listing(tasks: DataFrame, path: str, rows_per_range: int = ROWS_PER_RANGE) -> Listing:
    """Writes a listing of `tasks` into the new folder `path`, and the counts from what was written."""
    spark = tasks.sparkSession
    tasks = tasks.select(*TASK_COLUMNS)
    ranges = max(1, -(-tasks.count() // rows_per_range))
    cut = tasks.repartitionByRange(ranges, *list_order()).withColumn(_RANGE, F.spark_partition_id())
    cut.sortWithinPartitions(_RANGE, *list_order()).write.partitionBy(_RANGE).parquet(f"{path}/tasks")
    # Read with the schema given, as an empty table leaves no file behind.
    written = spark.read.schema(T.StructType([*tasks.schema.fields, T.StructField(_RANGE, T.IntegerType())])).parquet(f"{path}/tasks")
    written.groupBy(_RANGE, "status", "type").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/counts")
    return Listing(spark, path, tasks.schema)


def open_listing(spark: SparkSession, path: str, schema: T.StructType = TASKS) -> Listing:
    """A listing that `build_listing` has written in full, of tasks with these columns."""
    return Listing(spark, path, schema)
