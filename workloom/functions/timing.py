"""Durations, retry delays and time arithmetic."""

from pyspark.sql import Column, functions as F

from workloom.schemas import BACKOFF_BASE_MS, BACKOFF_CAP_MS

_UNITS = {"millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000,
          "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def micros_of(duration: str) -> int:
    """Microseconds in a text such as '5 minutes' or '1 day 2 hours'."""
    words = duration.split()
    if not words or len(words) % 2:
        raise ValueError(f"not a duration: {duration!r}")
    total = 0
    for amount, unit in zip(words[::2], words[1::2]):
        unit = unit.lower().rstrip("s")
        if unit not in _UNITS:
            raise ValueError(f"not a duration: {duration!r}")
        total += int(float(amount) * _UNITS[unit])
    return total


def epoch_micros(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def pane_start(micros: Column, length: int) -> Column:
    """The start of the pane of time that a moment lies in; panes are counted from 1970."""
    return micros - F.pmod(micros, F.lit(length))


def shifted(ts: Column | str, micros: Column | int) -> Column:
    """A timestamp moved by a number of microseconds, keeping its type."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    micros = F.lit(micros) if isinstance(micros, int) else micros
    return ts + F.make_dt_interval(secs=(micros.cast("decimal(24,6)") / 1_000_000).cast("decimal(18,6)"))


def backoff_ms(attempt: Column | str, base_ms: int = BACKOFF_BASE_MS,
               cap_ms: int = BACKOFF_CAP_MS) -> Column:
    """The wait before the next try: the base doubled once per earlier attempt, up to the cap."""
    attempt = F.col(attempt) if isinstance(attempt, str) else attempt
    doublings = F.least(F.greatest(attempt, F.lit(1)) - 1, F.lit(40)).cast("double")
    return F.least(F.lit(float(base_ms)) * F.pow(F.lit(2.0), doublings),
                   F.lit(float(cap_ms))).cast("long")


def rfc3339(ts: Column | str) -> Column:
    """Text such as 2024-01-01T00:00:07.18Z, without trailing zeros in the fraction."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), r"\.?0+Z$", "Z")
