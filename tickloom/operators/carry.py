"""Features of new bars from a small state per symbol, without the history.

The state of a symbol is one row: its last ``TAIL`` bars, each with the smoothed values and
running totals it ended with. That is all that any feature of the next bar looks at: windows
reach back 252 rows at most, and a smoothed series goes on from the value of the tail's first
row. A batch touches the state of its own symbols only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .technical import CARRIED, indicators

TAIL = 252  # rows of the longest window
BAR = ("date", "open", "high", "low", "close", "volume")
SEEDS = {c: f"_seed_{c.strip('_')}" for c in CARRIED}


@dataclass(frozen=True)
class Refreshed:
    """Feature rows of the new bars, and the states of the symbols that had any."""

    features: DataFrame
    state: DataFrame


def _tails(built: DataFrame) -> DataFrame:
    """The state of every symbol in ``built``: at most ``TAIL`` rows each meet in one row."""
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    rows = built.select("symbol", *BAR, *CARRIED, newest.alias("_age")).where(F.col("_age") <= TAIL)
    tail = F.sort_array(F.collect_list(F.struct(*BAR, *CARRIED)))
    return rows.groupBy("symbol").agg(tail.alias("tail"), F.max("date").alias("last_date"))


def first_state(bars: DataFrame) -> Refreshed:
    """Features of a whole history, and the states it leaves."""
    built = stored(indicators(bars.select("symbol", *BAR), keep=CARRIED), "carry")
    return Refreshed(_shown(built), _tails(built))


def _shown(built: DataFrame) -> DataFrame:
    return built.drop(*[c for c in built.columns if c.startswith("_")])


def late_bars(state: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars at or before the last date of their symbol: they change rows that are out already."""
    return bars.join(state.select("symbol", "last_date"), "symbol").where(F.col("date") <= F.col("last_date")).drop("last_date")


def carry_on(state: DataFrame, bars: DataFrame) -> Refreshed:
    """Features of bars that come after the state of their symbol (or of new symbols).

    Equal to the rows of a rebuild from the whole history. ``bars`` has one row per (symbol,
    date), all later than ``last_date``; see ``late_bars``. States of other symbols are not read
    further than their key.
    """
    fresh = bars.select("symbol", *BAR)
    touched = state.join(fresh.select("symbol").distinct(), "symbol", "left_semi")
    tail = touched.select("symbol", F.posexplode("tail").alias("_at", "t"))
    seeds = [F.when(F.col("_at") == 0, F.col(f"t.{c}")).alias(SEEDS[c]) for c in CARRIED]
    old = tail.select("symbol", *[F.col(f"t.{c}").alias(c) for c in BAR], *seeds, F.lit(False).alias("_new"))
    new = fresh.select("*", *[F.lit(None).cast("double").alias(s) for s in SEEDS.values()], F.lit(True).alias("_new"))
    built = stored(indicators(old.unionByName(new), seeds=SEEDS, keep=(*CARRIED, "_new")), "carry")
    return Refreshed(_shown(built.where("_new")), _tails(built))


def with_states(state: DataFrame, changed: DataFrame) -> DataFrame:
    """All states, those of ``changed`` in place of their former ones."""
    return state.join(changed.select("symbol"), "symbol", "left_anti").unionByName(changed)
