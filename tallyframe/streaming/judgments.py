"""Judgments that arrive as a stream: appended once per key, counted with late data in mind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyframe.sources.writers import append_new


def append_stream(stream: DataFrame, path: str, key: list[str], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each key's first judgment to a Parquet table.

    A batch that is run again after a failure finds its keys there and adds nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        append_new(batch.dropDuplicates(key), path, key)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def rates(stream: DataFrame, time: str, window: str, late: str, by: list[str], judgment: str = "judgment") -> DataFrame:
    """Items and positives per window and group; a window closes once the watermark passes it."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), *by)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col(judgment)).alias("positive"))
