"""Time arithmetic on whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_US = 60 * 1_000_000
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US


def micros(column: str | Column) -> Column:
    """Microseconds since 1970 as a long; zone-less clocks are read in the session zone."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def micros_between(start: str | Column, end: str | Column) -> Column:
    return micros(end) - micros(start)


def rounded_span(span_us: Column, unit_us: int, digits: int = 2) -> Column:
    """A span in the given unit, rounded; NULL stays NULL."""
    return F.round(span_us / F.lit(float(unit_us)), digits)


def time_block(time_us: Column, width_us: int) -> Column:
    """Number of the ``width_us`` wide slice of the time axis that holds ``time_us``.
    """
    return F.call_function("div", time_us - F.pmod(time_us, F.lit(width_us)), F.lit(width_us))
