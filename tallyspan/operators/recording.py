"""Recording batches through to files and ledger, step by numbered step; every step can be repeated.

A batch's rows are written below its own number, and records are kept in buckets of which a batch rewrites those it
touches; both replace what an earlier attempt of the same batch wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.operators import histories, ledger
from tallyspan.sources import sinks
from tallyspan.sources.versions import Versions

BUCKETS = 64
RECORD = [
    "entity_id", "region", "queue", "tier", "division", "history", "latest_logged_at", "detail_task_id", "detail_status", "detail_path", "detail_logged_at", "detail_patch",
]


class RecordStore:
    """Records in hash buckets of the entity, a version per batch.

    A batch reads the buckets its entities fall in as they were before it, joins them with its sightings and writes
    those buckets anew; no other bucket is read or written. The number of buckets is fixed with the first batch.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.versions = Versions(spark, root, buckets)

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        rows = self.versions.read(before, only)
        return None if rows is None else rows.drop("bucket")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows (entity_id): as many numbers as there are buckets at most."""
        return sorted(r.bucket for r in rows.select(self.versions.bucket_of("entity_id").alias("bucket")).distinct().collect())

    def beside(self, name: str) -> Versions:
        """A table of what a batch's steps share, by its number: written once, so that no step works it out anew."""
        return Versions(self.versions.spark, f"{self.versions.root}/{name}")

    def upsert(self, sightings: DataFrame, version: int) -> list[int]:
        """Adds a batch of sightings; gives the touched buckets. A version that is repeated starts from the state before it."""
        touched = self.touched(sightings)
        if touched:
            self.replace(ledger.upsert_records(sightings, self.read(version, touched)), version, touched)
        return touched

    def replace(self, records: DataFrame, version: int, touched: list[int]) -> None:
        """Writes records as the whole content of some buckets, with all columns of the details."""
        when = records.schema["latest_logged_at"].dataType.simpleString()
        absent = {c: F.lit(None).cast(k) for c, k in (("detail_task_id", "long"), ("detail_path", "string"), ("detail_logged_at", when), ("detail_patch", "string")) if c not in records.columns}
        self.versions.write(records.withColumns(absent).select(*RECORD).withColumn("bucket", self.versions.bucket_of("entity_id")), version, touched)

    def mirror(self, task_events: DataFrame, version: int) -> list[int]:
        """Takes the last transition of a batch's detail tasks over into the records of their entities alone."""
        touched, ids = self.touched(task_events), task_events.select("entity_id").distinct()
        prior = self.read(version, touched)
        if prior is not None:
            concerned, others = prior.join(ids, "entity_id", "left_semi"), prior.join(ids, "entity_id", "left_anti")
            self.replace(ledger.mirror_detail_status(concerned, task_events).unionByName(others), version, touched)
        return touched


class HistoryStore:
    """Histories in chunks, kept by span of time: a batch reads and writes the spans it has sightings in, and no other.

    An entity with most of the sightings is spread over spans, and its earlier ones are not touched again.
    """

    def __init__(self, spark: SparkSession, root: str, span: int = histories.SPAN):
        self.versions, self.span = Versions(spark, root, 1), span

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        rows = self.versions.read(before, only)
        return None if rows is None else rows.drop("bucket")

    def upsert(self, sightings: DataFrame, version: int) -> list[int]:
        """Adds a batch of sightings; gives the touched spans. A version that is repeated starts from the state before it."""
        chunk = histories.chunk_of(F.col("logged_at"), self.span)
        touched = sorted(r.chunk for r in sightings.select(chunk.alias("chunk")).distinct().collect())  # the spans of a batch
        if touched:
            new, prior = histories.history_chunks(sightings, self.span), self.read(version, touched)
            merged = new if prior is None else histories.merge_chunks(prior, new)
            self.versions.write(merged.withColumn("bucket", F.col("chunk")), version, touched)
        return touched


def replace_buckets(table: Versions, rows: DataFrame, key: str, version: int, touched: list[int]) -> None:
    table.write(rows.drop("bucket").withColumn("bucket", table.bucket_of(key)), version, touched)


def record_sightings(snapshots: DataFrame, store: RecordStore, version: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, discarded batches) of snapshot pages against the records before a version, which the accepted ones then make.

    Only the buckets of the pages' entities are read. Repeating the version gives the same records. The batches' counts
    and the accepted rows are kept beside the store, so the pages are read three times, whatever is done with the result.
    """
    prior = store.read(version, store.touched(snapshots))
    known = prior if prior is not None else snapshots.limit(0)
    counts, pages = store.beside("novelty"), store.beside("accepted")
    counts.write(ledger.novelty_counts(snapshots, known, keys), version)
    accepted, _ = ledger.accept_batches(snapshots, counts.read_version(version))
    pages.write(accepted, version)
    accepted = pages.read_version(version)
    store.upsert(ledger.one_sighting(accepted), version)
    return accepted, counts.read_version(version).where("unique_new = 0")


def sweep_batch(swept: DataFrame, runs: Versions, records: RecordStore, snapshot_tasks: Versions, detail_tasks: Versions, version: int, as_of: Column) -> None:
    """Fails a batch of runs (run_id) and cleans up after them in all four tables, as a version of each.

    runs and tasks are bucketed by run_id, so only the swept runs' buckets are read, and of the records only those are
    written that hold an entity of their tasks. Runs that are not running any more are passed over; repeating the version
    starts from the state before it.
    """
    touched = sorted(r.bucket for r in swept.select(runs.bucket_of("run_id").alias("bucket")).distinct().collect())  # buckets at most
    own_runs = runs.read(version, touched) if touched else None
    if own_runs is None:
        return
    hit = own_runs.where("status = 'running'").join(swept.select("run_id"), "run_id", "left_semi").select("run_id")
    snaps, details = (t.read(version, touched) for t in (snapshot_tasks, detail_tasks))
    open_ids = lambda tasks: tasks.where("status != 'success'").join(hit, "run_id", "left_semi").select(F.col("task_id").alias("id"))
    everything = records.read(version)
    if everything is not None and snaps is not None and details is not None:
        first = everything.where("size(history) = 1").withColumn("id", F.get("history", F.lit(0))["task_id"]).join(open_ids(snaps), "id", "left_semi").select("entity_id")
        concerned = first.unionByName(everything.withColumn("id", F.col("detail_task_id")).join(open_ids(details), "id", "left_semi").select("entity_id"))
        places = records.touched(concerned)
        own = records.read(version, places) if places else everything.limit(0)
        left, new_snaps, new_details = ledger.cleanup_runs(hit, own, snaps, details, as_of)
        if places:
            records.replace(left, version, places)
        replace_buckets(snapshot_tasks, new_snaps, "run_id", version, touched)
        replace_buckets(detail_tasks, new_details, "run_id", version, touched)
    # the runs come last: until they are written the batch counts as not done
    failed = own_runs.join(hit.withColumn("_hit", F.lit(True)), "run_id", "left")
    was = lambda new, old: F.when(F.col("_hit"), new).otherwise(F.col(old))
    changed = {"status": was(F.lit("failed"), "status"), "error_message": was(F.lit(ledger.STALLED), "error_message"), "finished_at": was(as_of, "finished_at")}
    replace_buckets(runs, failed.withColumns(changed).drop("_hit"), "run_id", version, touched)


def record_snapshots(snapshots: DataFrame, store: RecordStore, root: str, batch: int, keys: list[str], fetched_at: Column, fmt: str = "parquet") -> DataFrame:
    """Lands a batch of snapshot pages and records their sightings; the ends (task_id, status, file_path) of its tasks.

    snapshots: sightings with batch_id, one page each. Pages all of whose entities are known under the same keys are
    not landed: their task succeeds without a path. Others are written below root (see sinks.write_snapshots), their
    entities recorded in the store. Repeating the batch leaves the same rows.
    """
    accepted, discarded = record_sightings(snapshots, store, batch, keys)
    sinks.write_snapshots(accepted, root, fetched_at, fmt, batch=batch)
    landed = accepted.select("task_id", F.lit("success").alias("status"), F.concat(F.lit(f"{root}/batch={batch}/"), "batch_id").alias("file_path")).distinct()
    dropped = snapshots.join(discarded.select("batch_id"), "batch_id", "left_semi").select("task_id", F.lit("success").alias("status"), F.lit(None).cast("string").alias("file_path")).distinct()
    return landed.unionByName(dropped)


def record_details(details: DataFrame, claims: DataFrame, store: RecordStore, root: str, batch: int, as_of: Column, patch: Column, keys: list[str], fmt: str = "parquet", log: Versions | None = None) -> DataFrame:
    """Lands the details of a batch of claims and mirrors the ends of their tasks into the records; gives those ends, which also go to the log.

    Without a log they are kept beside the store: details are read twice, once for the verdicts and once to be landed.

    claims: entity_id, task_id. details: entity_id, errors and fields; an entity with an invalid row, without rows, or whose
    record lacks a bracket value fails, and none of its rows is written.
    """
    touched = store.touched(claims)
    prior = store.read(batch, touched)
    if prior is None:
        raise ValueError("no record is known for these claims")
    log = store.beside("ends") if log is None else log
    ends = ledger.detail_ends(details, claims.select("entity_id"), prior, keys)
    path = F.when(F.col("status") == "success", F.concat(F.lit(f"{root}/batch={batch}/"), "entity_id"))
    log.write(ends.join(claims.select("entity_id", "task_id"), "entity_id").select("entity_id", "task_id", as_of.alias("ts"), F.lit(batch).cast("long").alias("seq"), "status", path.alias("file_path"), "error", patch.alias("patch")), batch)
    events = log.read_version(batch)
    info = prior.join(claims.select("entity_id"), "entity_id", "left_semi")
    sinks.write_details(ledger.ended_well(details, events).withColumn("patch", patch), info, root, fmt, batch=batch)
    store.mirror(events, batch)
    return events
