"""Running sums and previous values inside keys of any size.

Rows are cut into equal ranges of (keys, order), so a key with any number of rows spans as many ranges as it needs.
One pass over each sorted range gives sums and previous values inside it, and leaves two edge rows: the range's
first key, and its last one with what the range holds of it. What a key had in earlier ranges comes from these
edge rows, at most two per range, and is joined back by broadcast.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from workloom.session import ship_package, stash

_RANGE, _HEAD, _EDGE = "_range", "_head", "_edge"


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are equal."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    if column.null_count:
        differ = differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return differ


def _pass(keys: list[str], sums: list[str], lags: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = schema = None
        carried, before = [0] * len(sums), [None] * len(lags)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = {name: batch.column(name) for name in {*keys, *sums, *lags}}
            head = np.ones(n, bool)
            if n > 1:
                head[1:] = np.logical_or.reduce([_changes(column[k]) for k in keys])
            opening = [column[k][0].as_py() for k in keys]
            head[0] = last is None or opening != last
            run = np.cumsum(head)
            out = [*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(head), pa.nulls(n, pa.string())]
            fields = [*batch.schema, pa.field(_RANGE, pa.int32()), pa.field(_HEAD, pa.bool_()), pa.field(_EDGE, pa.string())]
            starts = np.flatnonzero(head)
            for i, name in enumerate(sums):
                value = pc.fill_null(column[name].cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                total = np.cumsum(value)
                total = total - np.concatenate([[-carried[i]], (total - value)[starts]])[run]
                carried[i] = int(total[-1])
                out.append(pa.array(total, pa.int64()))
                fields.append(pa.field(f"_sum_{i}", pa.int64()))
            for i, name in enumerate(lags):
                kind = column[name].type
                ahead = pa.concat_arrays([pa.array([before[i]], kind), column[name].slice(0, n - 1)])
                out.append(pc.if_else(pa.array(head), pa.scalar(None, kind), ahead))
                fields.append(pa.field(f"_lag_{i}", kind))
                before[i] = column[name][n - 1].as_py()
            schema = pa.schema(fields)
            yield pa.RecordBatch.from_arrays(out, schema=schema)
            first = opening if first is None else first
            last = [column[k][n - 1].as_py() for k in keys]
        if last is not None:
            edges = [dict(zip(keys, first)) | {_RANGE: part, _EDGE: "first"} | {f"_sum_{i}": 0 for i in range(len(sums))},
                     dict(zip(keys, last)) | {_RANGE: part, _EDGE: "last"} | {f"_sum_{i}": x for i, x in enumerate(carried)}
                     | {f"_lag_{i}": x for i, x in enumerate(before)}]
            yield pa.RecordBatch.from_pylist(edges, schema=schema)
    return work


def chained(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str] | None = None,
            lags: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """`df` with columns added: `sums` names running sums (the row included) of whole-number columns, `lags` the value
    of a column in the key's row before, null in its first.

    Null keys are one key, and nulls come first in the order. Nulls add nothing to a sum. Rows that `order` leaves equal
    are numbered in any order. The pass over the ranges runs when this is called; its rows are written once.
    """
    ship_package(df.sparkSession)
    sums, lags = dict(sums or {}), dict(lags or {})
    by = [*keys, *order]
    ranged = (df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)).sortWithinPartitions(*by)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    for name, kind in ((_RANGE, T.IntegerType()), (_HEAD, T.BooleanType()), (_EDGE, T.StringType())):
        schema = schema.add(name, kind)
    for i in range(len(sums)):
        schema = schema.add(f"_sum_{i}", T.LongType())
    for i, name in enumerate(lags.values()):
        schema = schema.add(f"_lag_{i}", df.schema[name].dataType)
    passed = stash(ranged.mapInArrow(_pass(keys, list(sums.values()), list(lags.values())), schema), "chain")

    own_sums, own_lags = [f"_sum_{i}" for i in range(len(sums))], [f"_lag_{i}" for i in range(len(lags))]
    pieces = passed.where(F.col(_EDGE).isNotNull()).groupBy(_RANGE, *keys).agg(
        F.bool_or(F.col(_EDGE) == "first").alias("_opens"), *[F.sum(c).alias(c) for c in own_sums],
        *[F.any_value(F.when(F.col(_EDGE) == "last", F.struct(c)), True).alias(c) for c in own_lags])
    along = Window.partitionBy(*keys).orderBy(_RANGE)
    earlier = pieces.select(
        F.col(_RANGE).alias("_at"), *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], "_opens",
        *[F.sum(c).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_before{c}") for c in own_sums],
        *[F.lag(c).over(along)[c].alias(f"_before{c}") for c in own_lags]).where("_opens")
    same = F.col(_RANGE) == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    joined = passed.where(F.col(_EDGE).isNull()).join(F.broadcast(earlier), same, "left")
    return joined.select(
        *[c for c in df.columns if c not in sums and c not in lags],
        *[(F.col(c) + F.coalesce(F.col(f"_before{c}"), F.lit(0))).alias(name) for name, c in zip(sums, own_sums)],
        *[F.when(F.col(_HEAD), F.col(f"_before{c}")).otherwise(F.col(c)).alias(name) for name, c in zip(lags, own_lags)])
