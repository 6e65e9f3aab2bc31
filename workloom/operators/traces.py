"""Spans: sampling whole traces and finding the logs around a span."""

from pyspark.sql import Column, DataFrame, functions as F

from workloom.functions.sampling import trace_sampled
from workloom.functions.timing import epoch_micros, micros_of, pane_start
from workloom.schemas import TRACE_SAMPLE_RATIO

#: Panes of one level are so many times as long as those of the level before; the last of an hour's levels is 29 years.
_LONGER, _LEVELS = 4, 10


def trace_sample(spans: DataFrame, ratio: float = TRACE_SAMPLE_RATIO,
                 parent_sampled: Column | None = None) -> DataFrame:
    """The spans of a fixed share of traces, whole traces at a time."""
    return spans.where(trace_sampled("trace_id", ratio, parent_sampled))


def _in_panes(spans: DataFrame, step: int) -> DataFrame:
    """Spans (_opens, _closes) with the length of their level's panes, and the panes that they touch."""
    lengths = [F.lit(step * _LONGER ** level).cast("bigint") for level in range(_LEVELS)]
    needed = F.col("_closes") - F.col("_opens")
    fitting = F.coalesce(*[F.when(needed <= length, length) for length in lengths], lengths[-1])
    first, last = (pane_start(F.col(c), F.col("_length")) for c in ("_opens", "_closes"))
    return (spans.where("_opens IS NOT NULL").withColumn("_length", fitting)
            .withColumn("_panes", F.sequence(first, last, F.col("_length"))))


def logs_for_spans(spans: DataFrame, logs: DataFrame, keys: list[str], before: str = "1 hour",
                   after: str = "1 hour", log_ts: str = "ts", start: str = "start_ts",
                   end: str = "end_ts", pane: str = "1 hour", if_set: list[str] = ()) -> DataFrame:
    """Every (span, log) pair with equal `keys` and the log inside the span's widened time.

    Both sides are cut into panes of time and joined on keys and pane. Panes come in levels, each four times as long as
    the one before, the shortest being `pane`. A span takes the first level whose panes are as long as its widened
    time, so it touches two of them at most, however long it is; a log lies in one pane of each level that spans take.
    So no pair appears twice, and logs that meet a span without lying in it are of its own length around it. A span
    without an end, or one that ends before it starts, counts as ended at its start. Spans without a start and logs
    without a time make no pair. `if_set` names further keys that must be equal where the span has them. Logs and spans
    may share further columns only under different names. Runs a job over the spans when called, for their levels.
    """
    step = micros_of(pane)
    opens = epoch_micros(start) - micros_of(before)
    closes = F.greatest(epoch_micros(start), F.coalesce(epoch_micros(end), epoch_micros(start))) + micros_of(after)
    wide = _in_panes(spans.withColumns({"_opens": opens, "_closes": closes}), step)
    used = sorted(r[0] for r in wide.select("_length").distinct().collect()) or [step]  # at most _LEVELS rows
    wide = wide.withColumn("_pane", F.explode("_panes")).drop("_panes")
    stamped = logs.withColumn("_us", epoch_micros(log_ts)).withColumn("_length", F.explode(F.array(*[F.lit(n).cast("bigint") for n in used])))
    stamped = stamped.withColumn("_pane", pane_start(F.col("_us"), F.col("_length")))
    stamped = stamped.withColumnsRenamed({name: f"_log_{name}" for name in if_set})
    near = F.col("_us").between(F.col("_opens"), F.col("_closes"))
    for name in if_set:
        near &= F.col(name).isNull() | (F.col(name) == F.col(f"_log_{name}"))
    return wide.join(stamped, [*keys, "_length", "_pane"]).where(near).drop(
        "_length", "_pane", "_opens", "_closes", "_us", *[f"_log_{name}" for name in if_set])
