"""Small helpers shared by the operators of this subpackage."""

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from workloom.session import ship_package

#: About the bytes of a batch that goes to a worker; a longer row goes alone.
BATCH_BYTES = 4 << 20


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """`mapInArrow`, with this package sent to the workers, which give their memory back after each task.

    Batches are cut by their bytes as well, since rows are whole texts: executor and worker each hold one or two.
    """
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


_kept: dict = {}


def kept(key, make: Callable):
    """What `make` has made for `key` in this process, so that a worker keeps what it has learned from task to task.

    Only the last key's stays: a worker that goes on to another operator doesn't hold both.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Returns freed memory to the system: a worker waits for later tasks, and what it keeps adds to theirs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, column: str, alias: str = "text"):
    """The column as text, null as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit("")).alias(alias)
