"""Rows as JSON lines."""

from pyspark.sql import DataFrame, functions as F

from workloom.functions.timing import rfc3339


def export_json(df: DataFrame, raw_json: tuple[str, ...] = ("payload",)) -> DataFrame:
    """One `json` text per row. Nulls are left out, times are RFC 3339, and a column that holds
    JSON is nested as it is."""
    fields = []
    for field in df.schema:
        if field.dataType.typeName() in ("timestamp", "timestamp_ntz"):
            fields.append(rfc3339(field.name).alias(field.name))
        elif field.name in raw_json:
            fields.append(F.try_parse_json(field.name).alias(field.name))
        else:
            fields.append(F.col(field.name))
    return df.select(F.to_json(F.struct(*fields)).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    export_json(df).write.mode(mode).text(path)
