"""Filters and flags on parsed log and request records."""

from pyspark.sql import Column, DataFrame, functions as F

from workloom.functions.text import level_rank
from workloom.schemas import LOG_LEVELS


def min_level(logs: DataFrame, level: str) -> DataFrame:
    """Records at or above a level; records without a known level are dropped."""
    if level.lower() not in LOG_LEVELS:
        raise ValueError(f"unrecognized level: {level!r}")
    return logs.where(level_rank("level") >= LOG_LEVELS.index(level.lower()))


def fill_request_id(df: DataFrame, column: str = "request_id", generated: Column | None = None) -> DataFrame:
    """Keeps a request id that is not empty, else draws a new one."""
    generated = F.uuid() if generated is None else generated
    return df.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), generated))


def flag_errors(requests: DataFrame) -> DataFrame:
    return requests.withColumn("server_error", F.col("status") >= 500)
