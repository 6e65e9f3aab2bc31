"""Log lines of the services and of the proxy in front of them."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from workloom.functions.once import computed_once
from workloom.operators.logs import fill_request_id
from workloom.schemas import ACCESS_LOG, APP_LOG_FIELDS

INDEX_LABELS = ("service", "level", "request_id", "trace_id", "task_id")


def parse_app_logs(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds level, ts_text, msg, request_id, trace_id, span_id and task_id.

    A line that is not JSON stays, with nulls. INDEX_LABELS names the fields to filter on.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in APP_LOG_FIELDS])
    parsed = computed_once(lines, _record=F.from_json(line, schema))
    return parsed.select(*lines.columns, *[
        F.col(f"_record.{name}").alias("ts_text" if name == "timestamp" else name)
        for name in APP_LOG_FIELDS])


def labels(logs: DataFrame) -> DataFrame:
    """The index labels of parsed log records."""
    return logs.select(*INDEX_LABELS)


def parse_access_logs(lines: DataFrame, line: str = "line", generated_id: Column | None = None) -> DataFrame:
    """Adds the eleven fields of a proxy log line; an empty request id is replaced.

    The replacement is 32 random hex digits unless `generated_id` is given.
    """
    generated_id = F.replace(F.uuid(), F.lit("-"), F.lit("")) if generated_id is None else generated_id
    parsed = computed_once(lines, _record=F.from_json(line, ACCESS_LOG))
    fields = parsed.select(*lines.columns, *[F.col(f"_record.{n}").alias(n) for n in ACCESS_LOG.names])
    return fill_request_id(fields, "request_id", generated_id)
