"""One refresh per burst of changes.

A reader that reloads on every change reloads all the time while changes come in a
burst.  Here each table's changes are counted until none has come for a quiet time, by
a processing-time timer that every further change puts off; then one row says that the
table should be read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quorumbook.functions.rules import REFRESH_QUIET_MILLIS
from quorumbook.streaming.throttle import require_state_store

REFRESH = "source string, changes bigint, quiet_since bigint"


class BurstProcessor(StatefulProcessor):
    """Counts the changes of one table until it is quiet."""

    def __init__(self, quiet_millis: int):
        self._quiet = quiet_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("burst", "changes bigint, last bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        changes = (self._state.get() or (0, 0))[0] + sum(row.changes for row in rows)
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(now + self._quiet)
        self._state.update((changes, now))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        changes, last = self._state.get()
        self._state.clear()
        yield Row(source=key[0], changes=changes, quiet_since=last)

    def close(self) -> None:
        pass


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes per table in each batch of rows, so that few rows go to the task that holds a table's state."""
    for batch in batches:
        found = batch.column("source").value_counts()
        yield pa.RecordBatch.from_arrays(
            [found.field("values"), found.field("counts")], names=["source", "changes"])


def refreshes(changes: DataFrame, quiet_millis: int = REFRESH_QUIET_MILLIS) -> DataFrame:
    """A row per table and burst: ``source``, number of changes, time of the micro-batch with the last one (ms).

    ``changes`` has a column ``source`` that names the table; rows without a name are left out.
    """
    require_state_store(changes.sparkSession)
    counted = changes.where("source is not null").select("source").mapInArrow(_counted, "source string, changes bigint")
    return counted.groupBy("source").transformWithState(
        statefulProcessor=BurstProcessor(quiet_millis), outputStructType=REFRESH, outputMode="Append",
        timeMode="ProcessingTime")
