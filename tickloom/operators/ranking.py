"""Exact ranks without putting a whole group into one task.

Values are first reduced to one row per (group, distinct value). These rows are dealt out
by range (Spark samples the values themselves for the borders, so neither their magnitude
nor a common prefix matters), every part is summed inside, and the totals of the parts
before it are added. Only part totals, one row per part and group, meet in one place. A
group with a third of all rows spans many parts, ties are one row, nothing is approximate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

PART = "_part"


def dealt(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows in range partitions of the order, with the number of their part.

    The rows are written once: a part number must not change when a task is run again.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()), "dealt")


def before(window, column: Column | str) -> Column:
    """Sum over the rows ahead in the window's order."""
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def distinct_counts(df: DataFrame, group: list[str], value: str, **measures: Column) -> DataFrame:
    """Per (group, value): rows ``n``, summed measures, and running totals over the values.

    Adds ``below`` (rows of the group with a smaller value), ``total`` (rows of the
    group) and, for each measure m, ``m`` and ``m_below``.
    """
    names = ["n", *measures]
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count("*").alias("n"), *[F.sum(m).alias(k) for k, m in measures.items()])
    )
    counts = dealt(counts, *group, value)
    totals = counts.groupBy(*group, PART).agg(*[F.sum(k).alias(f"_{k}") for k in names])
    over = Window.partitionBy(*(group or [F.lit(0)]))
    totals = totals.select(
        *group,
        PART,
        *[before(over.orderBy(PART), f"_{k}").alias(f"_{k}_before") for k in names],
        F.sum("_n").over(over).alias("total"),
    )
    inside = Window.partitionBy(*group, PART).orderBy(value)
    local = counts.withColumns({f"_{k}_inside": before(inside, k) for k in names})
    joined = local.join(totals, [*group, PART])
    below = {"n": "below"} | {k: f"{k}_below" for k in measures}
    return joined.select(
        *group,
        value,
        *names,
        "total",
        *[(F.col(f"_{k}_before") + F.col(f"_{k}_inside")).alias(below[k]) for k in names],
    )


def percent_ranks(df: DataFrame, group: list[str], values: dict[str, str], strict: bool = False) -> DataFrame:
    """Add ``new column -> rank of old column`` within the group; NULL in, NULL out.

    Default: average rank of ties / number of non-NULL values. ``strict``: share of
    values that are smaller. All values are ranked in one long table of distinct values, so
    the input is read once for the ranks and once for the result.
    """
    columns = list(values.values())
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    pairs = F.array(*[F.struct(F.lit(i).alias("_which"), F.col(c).cast("double").alias("_value")) for i, c in enumerate(columns)])
    long = df.select(*keys, F.explode(pairs).alias("_p")).select(*[f"_g{i}" for i in range(len(group))], "_p.*")
    ranks = distinct_counts(long, ["_which", *[f"_g{i}" for i in range(len(group))]], "_value")
    position = F.col("below").cast("double") if strict else F.col("below") + (F.col("n") + 1) / F.lit(2.0)
    ranks = ranks.select("_which", *[f"_g{i}" for i in range(len(group))], "_value", (position / F.col("total")).alias("_rank"))
    if len(columns) > 1:
        ranks = stored(ranks, "ranks")
    out = df
    for i, (new, value) in enumerate(values.items()):
        mine = ranks.where(F.col("_which") == i).select(*[F.col(f"_g{k}").alias(g) for k, g in enumerate(group)], F.col("_value").alias("_match"), F.col("_rank").alias(new))
        on = [out[g] == mine[g] for g in group] + [out[value].cast("double") == mine["_match"]]
        out = out.join(mine, on, "left").select(*[out[c] for c in out.columns], new)
    return out.select(*df.columns, *values)


def row_numbers(df: DataFrame, value: str, tie: str, name: str = "rank") -> DataFrame:
    """1, 2, 3, ... over the whole table by (value descending, NULL last, tie ascending)."""
    order = [F.col(value).desc_nulls_last(), F.col(tie).asc()]
    rows = dealt(df, *order)
    totals = rows.groupBy(PART).agg(F.count("*").alias("_n"))
    totals = totals.select(PART, before(Window.partitionBy(F.lit(0)).orderBy(PART), "_n").alias("_before"))
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(PART).orderBy(*order)))
    return local.join(totals, PART).select(*df.columns, (F.col("_before") + F.col("_local")).alias(name))
