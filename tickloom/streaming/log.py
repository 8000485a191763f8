"""A batch log: the sink of streaming upserts.

Every micro-batch becomes one part of a snapshot table; a retried batch that is in already adds
nothing. The sink itself merges parts tier by tier, so after n batches a reader opens a few
times log n parts; with ``key`` a merge keeps the newest row per key, and the log holds no
more than the state and its latest batches. A log belongs to one checkpoint: its batch numbers count up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import keep_best
from ..sources.snapshots import SnapshotTable

BATCH = "batch"


def _best(rows: DataFrame, key: list[str], tie: list[str] | None) -> DataFrame:
    return keep_best(rows, key, F.struct(*(tie or []), BATCH))


def write_log(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", transform=None, trigger: dict | None = None, key: list[str] | None = None, tie: list[str] | None = None) -> StreamingQuery:
    """Start the stream into the log. ``transform`` maps each micro-batch before writing; ``key``
    and ``tie`` (see ``newest``) let merges drop rows that a newer one replaces."""
    merge = (lambda rows: _best(rows, key, tie)) if key else None

    def write(rows: DataFrame, batch_id: int) -> None:
        out = transform(rows) if transform else rows
        SnapshotTable(rows.sparkSession, path).append(out.withColumn(BATCH, F.lit(batch_id)), batch_id, merge)

    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of the log, with their batch."""
    rows = SnapshotTable(spark, path).read()
    return spark.createDataFrame([], schema) if rows is None else rows


def newest(spark: SparkSession, path: str, schema, key: list[str], tie: list[str] | None = None) -> DataFrame:
    """The newest row per key of the log.

    With ``tie`` the row with the greatest tie wins whatever batch brought it, so the
    result does not depend on the order of arrival; the batch decides between equal ties.
    Without it the row written last wins.
    """
    return _best(read_log(spark, path, schema), key, tie).drop(BATCH)


def log_schema(df: DataFrame):
    return df.withColumn(BATCH, F.lit(0)).schema


def compact(spark: SparkSession, path: str, target: str, schema, key: list[str], tie: list[str] | None = None) -> None:
    """Write the current state as the only part of another log."""
    SnapshotTable(spark, target).replace(newest(spark, path, schema, key, tie).withColumn(BATCH, F.lit(0)))
