"""Time buckets as column expressions.

Buckets are closed on the left and labelled by their start.  Fixed units are
aligned to 1970-01-01, weeks to Mondays, and months, quarters and years to the
calendar, multiples counting from January 1970.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unit suffix -> Spark interval unit or number of months.
_INTERVAL_UNITS = {
    "us": "microseconds",
    "ms": "milliseconds",
    "s": "seconds",
    "m": "minutes",
    "h": "hours",
    "d": "days",
    "w": "weeks",
}
_MONTHS = {"mo": 1, "q": 3, "y": 12}
_FREQUENCY = re.compile(r"(\d+)(us|ms|mo|s|m|h|d|w|q|y)")


@dataclass(frozen=True)
class Frequency:
    count: int
    unit: str

    @property
    def months(self) -> int | None:
        return self.count * _MONTHS[self.unit] if self.unit in _MONTHS else None

    @property
    def interval(self) -> str:
        return f"{self.count} {_INTERVAL_UNITS[self.unit]}"


def parse_frequency(text: str) -> Frequency:
    match = _FREQUENCY.fullmatch(text)
    if match is None or int(match.group(1)) == 0:
        raise ValueError(
            f"Unsupported frequency '{text}'. Use a positive whole number and one of: "
            f"{', '.join([*_INTERVAL_UNITS, *_MONTHS])}"
        )
    return Frequency(int(match.group(1)), match.group(2))


def bucket_start(moment: Column, dtype: T.DataType, frequency: Frequency) -> Column:
    """The start of the bucket a date or timestamp falls in, in its own type."""
    if frequency.months is not None:
        return _month_start(moment, frequency.months).cast(dtype)
    at = moment.cast(T.TimestampNTZType()) if isinstance(dtype, T.DateType) else moment
    if frequency.unit == "w":
        # 1970-01-01 was a Thursday; the following Monday is four days later.
        window = F.window(at, frequency.interval, startTime="4 days")
    else:
        window = F.window(at, frequency.interval)
    return window.getField("start").cast(dtype)


def _month_start(moment: Column, months: int) -> Column:
    since_1970 = (F.year(moment) - 1970) * 12 + F.month(moment) - 1
    first = since_1970 - F.pmod(since_1970, F.lit(months))
    month = F.pmod(first, F.lit(12))
    return F.make_date(
        ((first - month) / 12 + 1970).cast("int"), (month + 1).cast("int"), F.lit(1)
    )


def required(moment: Column, name: str) -> Column:
    """The moment itself; a null stops the job instead of leaving the result."""
    message = F.lit(f"Null values in datetime column '{name}'; pass on_null='drop' to leave them out.")
    return F.coalesce(moment, F.raise_error(message))
