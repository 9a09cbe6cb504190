"""Append-only logs as streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType


def first_crashes(crashes: DataFrame, delay: str = "30 days") -> DataFrame:
    """A stream's crash records without those whose key was seen within ``delay`` before; state older than that goes."""
    return crashes.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["crash_key"])


def dropped_ledger(records: DataFrame) -> DataFrame:
    """A ledger of dropped candidates with its defaults filled in."""
    text = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other)).alias(c)
    return records.select(text("source", "unknown"), text("stage", "finalize"), "id", text("verdict", "dropped"), text("reason", "unspecified"))


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Write what is there now to ``path`` and read it back; called again, only what is new is added."""
    spark: SparkSession = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


class _FirstOfKey(StatefulProcessor):
    """Flags all rows of a key but its first.  The state is one value a key; of a batch one row a key is held at a time."""

    def __init__(self, schema: StructType, first: list[str], keep_ms: int | None):
        self._row = Row(*[f.name for f in schema.fields], "duplicate")
        self._order = [schema.names.index(c) for c in first]
        self._keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "seen boolean", self._keep) if self._keep else handle.getValueState("seen", "seen boolean")

    def _before(self, row) -> tuple:
        return tuple((row[i] is not None, row[i]) if row[i] is not None else (False,) for i in self._order)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        known, held = self._seen.exists(), None
        for row in rows:
            if known:
                yield self._row(*row, True)
            elif held is None:
                held = row
            else:
                early, late = (row, held) if self._before(row) < self._before(held) else (held, row)
                yield self._row(*late, True)
                held = early
        if held is not None:
            self._seen.update((True,))
            yield self._row(*held, False)

    def close(self) -> None:
        pass


def flagged(stream: DataFrame, path: str, checkpoint: str, keep_ms: int | None = None) -> DataFrame:
    """Append every record with a flag ``duplicate``: its key is in an earlier batch, or earlier in its own.

    ``stream(crash_key, seen_at, ...)``; order in a batch is by time, then by all
    columns, nulls first.  What was seen is the query's keyed state, in RocksDB and
    its checkpoint, so a batch costs its own records, however many came before, and one
    that is repeated after a failure is written once.  With ``keep_ms`` a key is
    forgotten so many milliseconds after it was first seen.
    """
    spark: SparkSession = stream.sparkSession
    schema = StructType([*stream.schema.fields, StructField("duplicate", BooleanType())])
    order = ["seen_at", *[c for c in stream.columns if c not in ("crash_key", "seen_at")]]
    fold = stream.groupBy("crash_key").transformWithState(_FirstOfKey(stream.schema, order, keep_ms), schema, "Append", "ProcessingTime" if keep_ms else "None")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = fold.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(schema).parquet(path)
