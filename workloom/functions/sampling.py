"""Keep-or-drop decisions that depend on the trace id alone."""

from pyspark.sql import Column, functions as F

from workloom.schemas import TRACE_SAMPLE_RATIO


def trace_sampled(trace_id: Column | str, ratio: float = TRACE_SAMPLE_RATIO,
                  parent_sampled: Column | None = None) -> Column:
    """Whether a trace is kept: the top 63 bits of the id's second half fall below the ratio.

    Every row of a trace gets the same answer without a shuffle. A known decision of the
    parent wins over the ratio.
    """
    trace_id = F.col(trace_id) if isinstance(trace_id, str) else trace_id
    if ratio >= 1:
        own = F.lit(True)
    elif ratio <= 0:
        own = F.lit(False)
    else:
        high = F.conv(F.substring(trace_id, 17, 8), 16, 10).cast("long")
        low = F.conv(F.substring(trace_id, 25, 8), 16, 10).cast("long")
        own = F.shiftleft(high, 31) + F.shiftright(low, 1) < F.lit(int(ratio * 2**63))
    return own if parent_sampled is None else F.coalesce(parent_sampled, own)
