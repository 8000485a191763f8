"""Null-safe scalar helpers. NULL is the only missing value; NaN and inf are never produced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, NULL when the denominator is zero or NULL."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def flag(cond: Column) -> Column:
    """1.0 / 0.0; an undefined comparison counts as 0.0."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def finite(c: Column | str) -> Column:
    """The value, or NULL for NaN and infinities."""
    c = as_col(c).try_cast("double") if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def clamp(c: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    """Limit to [lo, hi]; NULL stays NULL (greatest/least alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def finite_columns(df: DataFrame) -> DataFrame:
    """Replace NaN/inf by NULL in every floating column."""
    return df.select(
        *[
            finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def double_columns(df: DataFrame, exclude: set[str] = frozenset()) -> list[str]:
    """Names of numeric columns not in ``exclude`` (feature selection by type)."""
    numeric = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, numeric) and f.name not in exclude]


def parse_date(c: Column | str, *formats: str) -> Column:
    """First format that parses; NULL when none does."""
    return F.coalesce(*[F.try_to_timestamp(as_col(c), F.lit(f)).cast("date") for f in formats])


def minute_of_day(ts: Column | str) -> Column:
    ts = as_col(ts)
    return F.hour(ts) * 60 + F.minute(ts)


def in_session(ts: Column | str, start: str = "09:15", end: str = "15:30") -> Column:
    """Time of day inside [start, end], both ends included."""

    def seconds(hhmm: str) -> int:
        h, m = hhmm.split(":")
        return int(h) * 3600 + int(m) * 60

    ts = as_col(ts).cast("timestamp")
    micros = F.unix_micros(ts) - F.unix_micros(F.date_trunc("day", ts))
    return micros.between(seconds(start) * 1_000_000, seconds(end) * 1_000_000)


def is_weekday(d: Column | str) -> Column:
    return F.weekday(as_col(d)) < 5


def in_market_hours(ts: Column | str, zone: str = "UTC", start: str = "09:15", end: str = "15:30") -> Column:
    """Monday to Friday inside the session, in the exchange's local time."""
    local = F.from_utc_timestamp(as_col(ts).cast("timestamp"), zone)
    return is_weekday(local) & in_session(local, start, end)
