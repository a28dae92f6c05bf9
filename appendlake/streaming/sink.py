"""A foreachBatch sink that commits each micro-batch once, and watermarked uniqueness."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from ..table import Table


class TableSink:
    """For writeStream.foreachBatch. Each batch is committed once, however often it comes again after restarts.

    The last batch id lies beside the table and is part of the commit's journal: a stop
    before the journal leaves neither rows nor id, one after it leaves both to the next
    writer, which replays the journal before the id is looked at. break_lock: take over
    the lock of a writer that was stopped (a stream has one sink at a time).
    """

    def __init__(self, table: Table, name: str = "stream", break_lock: bool = False):
        self.table, self.mark, self.break_lock = table, f"{table.path}/.staging/.{name}.batch", break_lock

    def last(self) -> int:
        files = self.table.files_api
        return int(files.read(self.mark)) if files.exists(self.mark) else -1

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        with self.table.writer(break_lock=self.break_lock) as w:
            if batch_id > self.last():
                w.stage_frame(df, mark=(self.mark, str(batch_id)))


def first_within_watermark(df: DataFrame, column: str, time_column: str, delay: str) -> DataFrame:
    """The first row of each value while the watermark remembers it."""
    return df.withColumn(time_column, df[time_column].cast("timestamp")).withWatermark(time_column, delay).dropDuplicatesWithinWatermark([column])
