"""As-of, neighbouring-event and interval lookups.

Both sides are put into one series (union) and the wanted rows are carried along the
order by window functions. There is no inequality join, the work is linear, and the
series of one key holds daily rows of that key only. Without a key the lookup runs on
the distinct dates (bounded by the calendar) and is joined back by date. Series that are
not daily are carried along range parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import running
from .calendar import join_daily
from .ranking import PART, dealt


def _sides(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, columns: list[str], right_first: bool) -> DataFrame:
    rows = F.struct(*[F.col(c) for c in left.columns])
    values = F.struct(*[F.col(c) for c in columns])
    lhs = left.select(*by, F.col(on).alias("_on"), F.lit(1 if right_first else 0).alias("_side"), rows.alias("_left"))
    rhs = right.select(*by, F.col(right_on).alias("_on"), F.lit(0 if right_first else 1).alias("_side"), values.alias("_right"))
    return lhs.unionByName(rhs, allowMissingColumns=True)


def asof(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    columns: list[str],
    on: str = "date",
    right_on: str | None = None,
    inclusive: bool = True,
    each_column: bool = False,
) -> DataFrame:
    """Add the values of the latest right row at or before (``inclusive``) the left row.

    ``each_column`` carries every column's own latest non-NULL value instead of the
    values of one row. Lookups by ``date`` use the calendar's bound; any other key goes
    through ``asof_ranges``. Without ``by`` the left table is read twice: give a stored one.
    """
    right_on = right_on or on
    if on != "date":
        return asof_ranges(left, right, by, columns, on, right_on, inclusive, each_column)
    if not by:
        dates = left.select(on).distinct()
        return join_daily(left, _carry(dates, right, [], columns, on, right_on, inclusive, each_column))
    return _carry(left, right, by, columns, on, right_on, inclusive, each_column)


def asof_ranges(left: DataFrame, right: DataFrame, by: list[str], columns: list[str], on: str, right_on: str | None = None, inclusive: bool = True, each_column: bool = False) -> DataFrame:
    """``asof`` for a key with any number of values, such as a time stamp.

    Both sides are first reduced to one row per (by, on): whether the left has it, and the
    right row there (of several the one with the greatest values). These rows are dealt out by
    range, so a series spans as many tasks as it needs; a task carries the values along its
    part, and what enters a part from the left is found from one row per series and part. The
    values found join back by equality, which Spark splits where a key is hot. Right rows
    without a key are left out; a left row without one gets NULLs.
    """
    right_on = right_on or on
    values = F.struct(*[F.col(c).alias(c) for c in columns])
    marks = right.where(F.col(right_on).isNotNull()).groupBy(*by, F.col(right_on).alias("_on")).agg(F.max(values).alias("_right"))
    asked = left.where(F.col(on).isNotNull()).select(*by, F.col(on).alias("_on")).distinct().withColumn("_asked", F.lit(True))
    points = asked.unionByName(marks, allowMissingColumns=True).groupBy(*by, "_on").agg(F.max("_asked").alias("_asked"), F.max("_right").alias("_right"))
    points = dealt(points, *by, "_on")
    here = Window.partitionBy(*by, PART).orderBy("_on").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    parts = Window.partitionBy(*(by or [F.lit(0)])).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    names = {c: F.col(f"_right.{c}") for c in columns} if each_column else {"": F.col("_right")}
    ends = points.groupBy(*by, PART).agg(*[F.max_by(v, F.when(v.isNotNull(), F.col("_on"))).alias(f"_end_{c}") for c, v in names.items()])
    enters = ends.select(*by, PART, *[F.last(f"_end_{c}", ignorenulls=True).over(parts).alias(f"_in_{c}") for c in names])
    inside = points.withColumns({f"_at_{c}": F.last(v, ignorenulls=True).over(here) for c, v in names.items()}).where("_asked")
    same_series = F.lit(True)
    for c in by:
        same_series = same_series & inside[c].eqNullSafe(enters[c])
    both = inside.join(enters, same_series & (inside[PART] == enters[PART]), "left")
    value = {c: F.coalesce(f"_at_{c}", f"_in_{c}") for c in names}
    picked = [value[c].alias(f"_v_{c}") for c in columns] if each_column else [value[""][c].alias(f"_v_{c}") for c in columns]
    found = both.select(*[inside[c].alias(f"_by_{c}") for c in by], F.col("_on"), *picked)
    match = left[on] == found["_on"]
    for c in by:
        match = match & left[c].eqNullSafe(found[f"_by_{c}"])
    return left.join(found, match, "left").select(*[left[c] for c in left.columns], *[F.col(f"_v_{c}").alias(c) for c in columns])


def asof_daily(daily: DataFrame, right: DataFrame, columns: list[str], inclusive: bool = True) -> DataFrame:
    """The same for a left table that has one row per date itself."""
    return _carry(daily, right, [], columns, "date", "date", inclusive, False)


def _carry(left, right, by, columns, on, right_on, inclusive, each_column) -> DataFrame:
    both = _sides(left, right, by, on, right_on, columns, inclusive)
    w = running(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_on", "_side"))
    if each_column:
        carried = {f"_v_{c}": F.last(F.col(f"_right.{c}"), ignorenulls=True).over(w) for c in columns}
        both = both.withColumns(carried)
        picked = [F.col(f"_v_{c}").alias(c) for c in columns]
    else:
        both = both.withColumn("_v", F.last("_right", ignorenulls=True).over(w))
        picked = [F.col(f"_v.{c}").alias(c) for c in columns]
    return both.where(F.col("_left").isNotNull()).select("_left.*", *picked)


def neighbours(
    left: DataFrame,
    events: DataFrame,
    by: list[str],
    previous: dict[str, str],
    following: dict[str, str],
    on: str = "date",
    event_on: str = "date",
) -> DataFrame:
    """Values of the last event at or before the row and of the first event after it.

    ``previous`` / ``following`` map new column names to event columns.
    """
    columns = list(dict.fromkeys([*previous.values(), *following.values()]))
    both = _sides(left, events, by, on, event_on, columns, True)
    order = Window.partitionBy(*by).orderBy("_on", "_side")
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    both = both.withColumns(
        {
            "_before": F.last("_right", ignorenulls=True).over(running(order)),
            "_after": F.first("_right", ignorenulls=True).over(ahead),
        }
    ).where(F.col("_left").isNotNull())
    return both.select(
        "_left.*",
        *[F.col(f"_before.{c}").alias(n) for n, c in previous.items()],
        *[F.col(f"_after.{c}").alias(n) for n, c in following.items()],
    )


def within_days(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    value: str,
    spans: dict[str, int],
    on: str = "date",
) -> DataFrame:
    """First, last and number of right values dated in [date - days, date], per span name.

    Adds ``<name>_first``, ``<name>_last`` and ``<name>_n``; right rows must be unique
    per (by, date).
    """
    both = _sides(left, right, by, on, on, [value], True).withColumn("_day", F.unix_date("_on"))
    v = F.col(f"_right.{value}")
    added = {}
    for name, days in spans.items():
        w = Window.partitionBy(*by).orderBy("_day").rangeBetween(-days, 0)
        added |= {
            f"{name}_first": F.first(v, ignorenulls=True).over(w),
            f"{name}_last": F.last(v, ignorenulls=True).over(w),
            f"{name}_n": F.count(v).over(w),
        }
    out = both.withColumns(added).where(F.col("_left").isNotNull())
    return out.select("_left.*", *added)
