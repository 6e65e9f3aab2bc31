"""Keeping costly columns from being computed twice."""

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a one-row generator.

    A filter on a plain computed column is moved below it, which repeats the computation in the
    filter. Filters stay above a generator, so parsing runs once per row.
    """
    record = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(record)))
