"""The task and execution tables in parquet, ORC, JSON lines or a JDBC database."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from workloom.schemas import EXECUTIONS, TASKS

_DAY = "created_day"


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_tasks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The task table with its fixed schema. A table written by day is pruned by `created_day`."""
    return _read(spark, path, TASKS, fmt)


def read_executions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, EXECUTIONS, fmt)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order and types; a missing column is an error."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def write_tasks(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                by_day: bool = False) -> None:
    """Writes the task table. `by_day` lays files out by creation day, sorted by status and type,
    so listings and retention skip days and row groups. Days are cut into equal ranges, so a day
    of any size is written by as many tasks as it needs."""
    out = conform(df, TASKS)
    if by_day:
        layout = [_DAY, "status", "type", "id"]
        (out.withColumn(_DAY, F.to_date("created_at"))
         .repartitionByRange(*layout).sortWithinPartitions(*layout)
         .write.mode(mode).format(fmt).partitionBy(_DAY).save(path))
        return
    out.write.mode(mode).format(fmt).save(path)


def write_executions(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    conform(df, EXECUTIONS).write.mode(mode).format(fmt).save(path)


def read_jdbc(spark: SparkSession, url: str, table: str, bounds: tuple[str, str] | None = None,
              partition_column: str = "created_at", partitions: int = 16, **options) -> DataFrame:
    """A database table, read in parallel ranges of `partition_column` when bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0],
                                upperBound=bounds[1], numPartitions=partitions)
    return reader.load()
