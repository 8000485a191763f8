"""Rolling measures over rows of one series.

Every window here is partitioned by symbol on a table that holds one row per
(symbol, date). Such a partition can not grow beyond the trading calendar (about
25,000 rows in a century), whatever share of the raw ticks the symbol has, because
ticks are aggregated to days before any window runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .scalar import as_col, flag, ratio


def series(*partition: str, order: str = "date") -> WindowSpec:
    """Ordered window of one series; the same spec lets Spark share one sort."""
    return Window.partitionBy(*(partition or ("symbol",))).orderBy(order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), Window.currentRow)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def rolling(agg: Callable[[Column], Column], x: Column | str, w: WindowSpec, n: int, at_least: int | None = None) -> Column:
    """agg over the last n rows, NULL until ``at_least`` (default n) values are present."""
    x, frame = as_col(x), trailing(w, n)
    return F.when(F.count(x).over(frame) >= (n if at_least is None else at_least), agg(x).over(frame))


def mean(x, w, n, at_least=None) -> Column:
    return rolling(F.avg, x, w, n, at_least)


def std(x, w, n, at_least=None, ddof: int = 0) -> Column:
    return rolling(F.stddev_pop if ddof == 0 else F.stddev_samp, x, w, n, at_least)


def low(x, w, n, at_least=None) -> Column:
    return rolling(F.min, x, w, n, at_least)


def high(x, w, n, at_least=None) -> Column:
    return rolling(F.max, x, w, n, at_least)


def window_values(x, w, n) -> Column:
    """Sorted values of the last n rows: the base of rolling quantiles and ranks."""
    return F.sort_array(F.collect_list(as_col(x)).over(trailing(w, n)))


def quantile_of(values: Column, q: float, at_least: int) -> Column:
    """Exact quantile of a sorted array with linear interpolation."""
    at = (F.size(values) - 1) * F.lit(float(q))
    low_at = F.floor(at).cast("int")
    lower = F.try_element_at(values, low_at + 1)
    upper = F.coalesce(F.try_element_at(values, low_at + 2), lower)
    value = F.when(lower == upper, lower).otherwise(lower + (upper - lower) * (at - low_at))
    return F.when(F.size(values) >= at_least, value)


def rank_pct_of(values: Column, x: Column, at_least: int) -> Column:
    """Average rank of x in a sorted array, divided by its length."""
    n = F.size(values)
    below = F.array_position(values, x) - 1
    above = F.array_position(F.reverse(values), x) - 1
    return F.when(x.isNotNull() & (n >= at_least), (below + (n - below - above + 1) / F.lit(2.0)) / n)


def quantile(x, q: float, w, n, at_least=None) -> Column:
    return quantile_of(window_values(x, w, n), q, n if at_least is None else at_least)


def chain(piece: str, w, n: int, step: int, combine: Callable[[list[Column]], Column]) -> Column:
    """A window of n rows put together from n / step windows of ``step`` rows.

    ``piece`` is a column with the aggregate of the last ``step`` rows, NULL until
    complete. A long frame costs n visits per row; its pieces cost step + n / step.
    """
    if n % step:
        raise ValueError(f"{n} is no multiple of {step}")
    parts = [F.lag(piece, k).over(w) if k else F.col(piece) for k in range(0, n, step)]
    known = parts[0].isNotNull()
    for part in parts[1:]:
        known = known & part.isNotNull()
    return F.when(known, combine(parts))


def total(parts: list[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def zscore(x, w, n, at_least=None, ddof: int = 0) -> Column:
    return ratio(as_col(x) - mean(x, w, n, at_least), std(x, w, n, at_least, ddof))


def correlation(x, y, w, n, at_least) -> Column:
    """Pearson correlation; NULL when either side does not vary.

    Built from covariance and deviations: corr() itself fails on a constant window,
    because a window expression is evaluated before any guard around it.
    """
    x, y, frame = as_col(x), as_col(y), trailing(w, n)
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(px).over(frame) * F.stddev_pop(py).over(frame)
    return F.when(F.count(px).over(frame) >= at_least, ratio(F.covar_pop(px, py).over(frame), spread))


def slope(x, index: Column | str, w, n) -> Column:
    """Least-squares slope of the last n values against their row number."""
    x, frame = as_col(x), trailing(w, n)
    return F.when(F.count(x).over(frame) >= n, F.regr_slope(x, as_col(index).cast("double")).over(frame))


def rank_pct(x, w, n, at_least) -> Column:
    """Position of the current value inside its window: average rank / count."""
    return rank_pct_of(window_values(x, w, n), as_col(x), at_least)


def change(x, w, n: int = 1) -> Column:
    x = as_col(x)
    return x - F.lag(x, n).over(w)


def growth(x, w, n: int = 1) -> Column:
    x = as_col(x)
    return ratio(x, F.lag(x, n).over(w)) - 1.0


def streak_island(reset: Column, w: WindowSpec) -> Column:
    """Id of the run a row belongs to: it steps up on every row that breaks the run."""
    return F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(running(w))


def streak_length(hit: Column, island: str, *partition: str, order: str = "date") -> Column:
    """Hits so far inside the run; needs the island as a column."""
    w = Window.partitionBy(*(partition or ("symbol",)), island).orderBy(order)
    return F.sum(F.coalesce(hit, F.lit(False)).cast("int")).over(running(w))


def above(x, y) -> Column:
    return flag(as_col(x) > as_col(y))
