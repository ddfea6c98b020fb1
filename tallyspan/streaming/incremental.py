"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from tallyspan.operators import recording, validation
from tallyspan.operators.recording import RecordStore
from tallyspan.sources import documents
from tallyspan.sources.versions import Versions


def stream_ingest(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, keep: str = "true", files_per_batch: int = 100) -> StreamingQuery:
    """Appends the valid rows of newly landed files to sink, a folder per micro-batch.

    Writing a batch again replaces its folder, so a replay after a failure adds nothing twice.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source).where(keep)
    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_documents(spark: SparkSession, root: str, list_field: str, fields: dict[str, tuple[str, int | None, bool]], sink: str, checkpoint: str, files_per_batch: int = 100, packed: bool = False) -> StreamingQuery:
    """Validates newly landed JSON documents (a file each, or packed: see documents.pack_documents): rows of documents without an error are appended below
    sink/accepted, all rows of the others below sink/quarantine, with their path and errors.

    A micro-batch has a folder of its own, replaced when it is replayed, so nothing is written twice. Documents that
    are no JSON or have no such list give no rows. The rows of a micro-batch are kept until both folders are written, so
    that each is parsed and checked once. A packed document has to have a path of its own.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        objects = validation.explode_objects(batch.select("path", F.try_parse_json("value").alias("doc")), list_field)
        checked = validation.validate(objects, fields).persist()
        try:
            good, bad = validation.batch_gate(checked, ["path"])
            good.write.mode("overwrite").parquet(f"{sink}/accepted/batch_id={batch_id}")
            bad.write.mode("overwrite").parquet(f"{sink}/quarantine/batch_id={batch_id}")
        finally:
            checked.unpersist()

    arrivals = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    if packed:
        rows = arrivals.schema(documents.PACKED).parquet(root).select("path", "value")
    else:
        rows = arrivals.format("text").option("wholetext", True).load(root).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_records(spark: SparkSession, source: str, schema: StructType, store: RecordStore, keys: list[str], checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Records the sightings of newly landed snapshot pages (files of rows with batch_id) in a store of records.

    Each micro-batch is judged against the records before it: pages without a new entity are dropped, the others make the
    store's version of the micro-batch's number. A micro-batch that is replayed starts from the version before it, so
    nothing is recorded twice. A page has to be in one file.
    """

    def record(batch: DataFrame, batch_id: int) -> None:
        recording.record_sightings(batch, store, batch_id, keys)

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.foreachBatch(record).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb_state(spark: SparkSession) -> None:
    """Has queries that start from now on keep their state in RocksDB: it is not bound by memory, and processors need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Cursor(StatefulProcessor):
    """The page cursor of a key; a micro-batch is put in order and folded as arrays."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cursor", "page long, loop_count long, last_count long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        page, loop, last = self.state.get() if self.state.exists() else (1, 0, 0)
        counts = pd.concat(rows).sort_values(["seq", "player_count"])["player_count"].to_numpy("int64")
        turns = np.flatnonzero(np.diff(counts, prepend=last) < 0)
        page = len(counts) - int(turns[-1]) if len(turns) else page + len(counts)
        after = (page, loop + len(turns), int(counts[-1]))
        self.state.update(after)
        yield pd.DataFrame([[*key, *after]], columns=self.columns)

    def close(self) -> None:
        pass


def stream_cursor(observations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page, loop_count, last_count) of each key after each micro-batch; observations: keys, seq, player_count.

    Inside a micro-batch rows are taken in the order of seq; micro-batches have to come in that order. The state is a
    row per key, kept through restarts from the checkpoint. Use output mode update.
    """
    rocksdb_state(observations.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in observations.schema}
    names = [*keys, "page", "loop_count", "last_count"]
    out = ", ".join(f"{k} {kinds.get(k, 'bigint')}" for k in names)
    return observations.select(*keys, "seq", "player_count").groupBy(*keys).transformWithStateInPandas(_Cursor(names), out, "update", "none")


class _StaleRuns(StatefulProcessor):
    """Watches a run's last heartbeat with an event-time timer; a finish ends the watch."""

    def __init__(self, horizon_ms: int):
        self.horizon_ms = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "us long")

    def _stop(self) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.last.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(rows)
        before = self.last.get()[0] if self.last.exists() else None
        last = max(events["ts"].max().value // 1000, before if before is not None else -(2**62))
        self._stop()
        if not (events["kind"] == "finish").any():
            self.last.update((last,))
            # strictly later than the horizon, and never before what the watermark has already passed
            self.handle.registerTimer(max(last // 1000 + self.horizon_ms, timerValues.getCurrentWatermarkInMs()) + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            yield pd.DataFrame({"run_id": [key[0]], "last_heartbeat": [pd.Timestamp(self.last.get()[0], unit="us")]})
            self.last.clear()

    def close(self) -> None:
        pass


def stream_stale_runs(run_events: DataFrame, horizon_seconds: int, watermark: str = "0 seconds") -> DataFrame:
    """(run_id, last_heartbeat) of runs whose heartbeat the watermark has passed by more than the horizon.

    run_events: run_id, ts, kind (a finish ends the watch). Output mode append.
    """
    rocksdb_state(run_events.sparkSession)
    marked = run_events.select("run_id", F.col("ts").cast("timestamp").alias("ts"), "kind").withWatermark("ts", watermark)
    return marked.groupBy("run_id").transformWithStateInPandas(_StaleRuns(horizon_seconds * 1000), "run_id long, last_heartbeat timestamp", "append", "eventTime")


def stream_sweep(run_events: DataFrame, horizon_seconds: int, runs: Versions, records: RecordStore, snapshot_tasks: Versions, detail_tasks: Versions, as_of: Column, checkpoint: str, base: int, watermark: str = "0 seconds") -> StreamingQuery:
    """Fails the runs that fall silent and cleans up after them in the four tables (see recording.sweep_batch).

    A micro-batch makes the version base + its number of each table it changes; replayed, it starts from the state before.
    """

    def sweep(batch: DataFrame, batch_id: int) -> None:
        recording.sweep_batch(batch, runs, records, snapshot_tasks, detail_tasks, base + batch_id, as_of)

    found = stream_stale_runs(run_events, horizon_seconds, watermark)
    return found.writeStream.outputMode("append").foreachBatch(sweep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
