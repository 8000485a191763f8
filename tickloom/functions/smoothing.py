"""Exponential smoothing as a blocked prefix scan in plain window functions.

y[0] = x[0];  y[t] = (1 - a) * y[t-1] + a * x[t].

With r = 1 - a this is a weighted prefix sum. Rows of a series are cut into blocks
of B rows. Inside a block the prefix is sum(u * r^-j) * r^j, and the total of the
block before enters through a RANGE frame on the block number. B is chosen so that
r^B < e^-40 (older blocks are below double precision) and r^-B stays finite, so the
work is linear in the rows and no state is folded row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rolling import running, series

NEGLIGIBLE = 40.0  # e^-40 is below the resolution of a double
LARGEST = 650.0  # e^650 is still a finite double


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


def wilder(n: int) -> float:
    return 1.0 / n


def _blocks(alphas: list[float]) -> list[tuple[int, list[int]]]:
    """Group smoothing factors that can share one block length."""
    rates = sorted(((-math.log1p(-a), i) for i, a in enumerate(alphas)), reverse=True)
    groups: list[tuple[int, list[int]]] = []
    while rates:
        limit = int(LARGEST / rates[0][0])
        fits = [i for rate, i in rates if math.ceil(NEGLIGIBLE / rate) <= limit] or [rates[0][1]]
        need = max(math.ceil(NEGLIGIBLE / rate) for rate, i in rates if i in fits)
        groups.append((max(1, min(need, limit)), fits))
        rates = [(rate, i) for rate, i in rates if i not in fits]
    return groups


def smooth(
    df: DataFrame,
    columns: dict[str, tuple[str, float, int]],
    partition: tuple[str, ...] = ("symbol",),
    order: str = "date",
    seeds: dict[str, str] | None = None,
) -> DataFrame:
    """Add ``name -> (input column, alpha, min rows)`` smoothed columns.

    A series starts at its first non-NULL input; the result is NULL before that and
    until ``min rows`` inputs were seen. Inputs must have no gaps after their start.
    ``seeds`` (name -> column) carries a series on: where the first row of a partition has a
    seed, that is the smoothed value there, whatever came before.
    """
    names = list(columns)
    w = series(*partition, order=order)
    out = df.withColumn("_row", F.row_number().over(w) - 1)
    inputs = {x for x, _, _ in columns.values()}
    out = out.withColumns({f"_seen_{x}": F.count(x).over(running(w)) for x in inputs})
    seeds = {n: c for n, c in (seeds or {}).items() if n in columns}
    out = out.withColumns({f"_from_{n}": F.first(c).over(running(w)) for n, c in seeds.items()})
    for size, members in _blocks([columns[n][1] for n in names]):
        out = out.withColumns(
            {"_block": F.floor(F.col("_row") / size).cast("int"), "_at": (F.col("_row") % size).cast("double")}
        )
        inside = running(Window.partitionBy(*partition, "_block").orderBy(order))
        before = Window.partitionBy(*partition).orderBy("_block").rangeBetween(-1, -1)
        local, total = {}, {}
        for i in members:
            x, alpha, _ = columns[names[i]]
            r = F.lit(1.0 - alpha)
            weight = F.when(F.col(f"_seen_{x}") == 1, F.lit(1.0)).otherwise(F.lit(alpha))
            term = F.col(x) * weight
            if names[i] in seeds:
                start = F.col(f"_from_{names[i]}")
                term = F.when(start.isNull(), term).when(F.col("_row") == 0, start).otherwise(F.col(x) * alpha)
            local[f"_local_{i}"] = F.sum(term * F.pow(r, -F.col("_at"))).over(inside) * F.pow(r, F.col("_at"))
            total[f"_total_{i}"] = F.sum(term * F.pow(r, F.lit(size - 1.0) - F.col("_at"))).over(before)
        out = out.withColumns(local).withColumns(total)
        out = out.withColumns(
            {
                names[i]: F.when(
                    (F.col(f"_seen_{columns[names[i]][0]}") >= max(columns[names[i]][2], 1)) | (F.col(f"_from_{names[i]}").isNotNull() if names[i] in seeds else F.lit(False)),
                    F.coalesce(f"_local_{i}", F.lit(0.0))
                    + F.pow(F.lit(1.0 - columns[names[i]][1]), F.col("_at") + 1.0) * F.coalesce(f"_total_{i}", F.lit(0.0)),
                )
                for i in members
            }
        ).drop("_block", "_at", *local, *total)
    return out.drop("_row", *[f"_seen_{x}" for x in inputs], *[f"_from_{n}" for n in seeds])
