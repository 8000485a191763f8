"""A maintained feature panel: daily bars in, feature rows and small states out.

Three snapshot tables below one folder: ``bars``, ``features`` and ``state``. A batch reads the
states of its own symbols and writes its own dates; the history is not read. Only where a bar
comes late, at or before the last date of its symbol, are that symbol's bars read again and its
rows from there on replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.carry import BAR, Refreshed, carry_on, first_state, late_bars, with_states
from ..operators.dedup import keep_best
from ..session import stored
from ..sources.snapshots import SnapshotTable
from .log import BATCH

KEY = ["symbol", "date"]


def _newest(rows: DataFrame) -> DataFrame:
    return keep_best(rows, KEY, F.struct(BATCH))


class FeaturePanel:
    def __init__(self, spark: SparkSession, folder: str):
        self.bars, self.features = (SnapshotTable(spark, f"{folder}/{name}", "date") for name in ("bars", "features"))
        self.state = SnapshotTable(spark, f"{folder}/state")

    def _rebuilt(self, late: DataFrame, rows: DataFrame) -> Refreshed:
        """The symbols with late bars from all their bars; their feature rows from the first late date on."""
        since = late.groupBy("symbol").agg(F.min("date").alias("_since"))
        batch = rows.join(since.select("symbol"), "symbol", "left_semi").select("symbol", *BAR, F.lit(1 << 30).alias(BATCH))
        history = _newest(self.bars.read().join(since.select("symbol"), "symbol", "left_semi").select("symbol", *BAR, BATCH).unionByName(batch)).drop(BATCH)
        built = first_state(history)
        return Refreshed(built.features.join(since, "symbol").where(F.col("date") >= F.col("_since")).drop("_since"), built.state)

    def refresh(self, rows: DataFrame, batch: int) -> None:
        """Add one batch of bars (symbol, date, open, high, low, close, volume; one row per symbol
        and date, a later batch wins). A batch that failed half-way can be run again: each table
        takes a batch once, and the states, from which the batch is computed, go last."""
        if batch <= self.state.version().last_batch:
            return
        rows = stored(rows.select("symbol", *BAR), "batch")
        state = self.state.read()
        if state is None:
            done = first_state(rows)
        else:
            late = stored(late_bars(state, rows), "late")
            done = carry_on(state, rows.join(late.select("symbol").distinct(), "symbol", "left_anti"))
            if late.limit(1).count():
                again = self._rebuilt(late, rows)
                done = Refreshed(done.features.unionByName(again.features), done.state.unionByName(again.state))
        changed = done.state if state is None else with_states(state, stored(done.state, "state"))
        self.bars.append(rows.withColumn(BATCH, F.lit(batch)), batch, _newest)
        self.features.append(done.features.withColumn(BATCH, F.lit(batch)), batch, _newest)
        self.state.replace(changed, batch)

    def read(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """Feature rows of a range of dates, from the parts that hold them."""
        rows = self.features.read(since=since, until=until)
        if rows is None:
            raise ValueError("the panel is empty")
        return _newest(rows).drop(BATCH)

    def today(self) -> DataFrame:
        """Feature rows of the newest date, which the manifest knows."""
        newest = self.features.newest_date()
        return self.read(newest, newest)

    def last_bars(self) -> DataFrame:
        """The newest bar of every symbol, from the states."""
        state = self.state.read()
        if state is None:
            raise ValueError("the panel is empty")
        last = F.element_at("tail", -1)
        return state.select("symbol", *[last[c].alias(c) for c in BAR])


def refresh_panel(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start a stream of daily bars into the panel below ``folder``."""

    def apply(rows: DataFrame, batch_id: int) -> None:
        FeaturePanel(rows.sparkSession, folder).refresh(rows, batch_id)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
