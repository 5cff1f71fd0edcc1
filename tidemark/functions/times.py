"""Event-time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(ts) -> Column:
    """Microseconds since the epoch; takes a timestamp or an ISO dateTime text.

    A zone-less time counts as UTC in any session zone: it is taken from the epoch as it stands,
    since a cast would read it in the session's zone."""
    ts = _col(ts)
    since = ts.cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    hours = F.extract(F.lit("DAY"), since).cast("bigint") * 24 + F.extract(F.lit("HOUR"), since)
    seconds = (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("bigint")
    plain = (hours * 60 + F.extract(F.lit("MINUTE"), since)) * 60_000_000 + seconds
    return F.when(F.typeof(ts) == "timestamp_ntz", plain).otherwise(F.unix_micros(ts.cast("timestamp")))


def epoch_ms(ts) -> Column:
    """Milliseconds since the epoch, cut off; takes a timestamp or an ISO dateTime text."""
    us = epoch_us(ts)
    return F.call_function("div", us - F.pmod(us, F.lit(1000)), F.lit(1000).cast("bigint"))


def iso_ms(ts) -> Column:
    """`YYYY-MM-DDTHH:MM:SS.mmmZ`; takes a timestamp or epoch milliseconds in a timestamp."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def time_cell(ts, cell_ms: int) -> Column:
    """Ordinal of the fixed-length time cell that holds `ts`.

    Cells split the rows of one stream or bucket over tasks; they never show in results.
    """
    us, cell = epoch_us(ts), F.lit(cell_ms * 1000).cast("bigint")
    return F.call_function("div", us - F.pmod(us, cell), cell)
