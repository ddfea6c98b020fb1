"""Writing snapshots, details, bundles and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.functions.expressions import partition_keys, percent

PARTITIONS = ["region", "queue", "tier", "patch", "date"]


def _append(rows: DataFrame, root: str, fmt: str, mode: str, batch: int | None, folders: list[str] = PARTITIONS) -> None:
    """Rows of one partition are brought together first; a large partition is split among tasks by adaptive execution.

    A batch has a partition level of its own, of which only what it writes itself is replaced when it is repeated.
    PARTITIONS that are no folders are columns of the files, whose rows are in their order.
    """
    by, dealt = folders, rows.hint("rebalance", *folders)
    if batch is not None:
        dealt, by, mode = dealt.withColumn("batch", F.lit(batch)), [*folders, "batch"], "overwrite"
    if folders != PARTITIONS:
        dealt = dealt.sortWithinPartitions(*by, *(c for c in PARTITIONS if c not in folders))
    writer = dealt.write.mode(mode).partitionBy(*by).format(fmt)
    (writer if batch is None else writer.option("partitionOverwriteMode", "dynamic")).save(root)


def write_snapshots(df: DataFrame, root: str, fetched_at: Column, fmt: str = "parquet", mode: str = "append", batch: int | None = None) -> None:
    """Snapshot rows (with the bracket columns and patch) below region=/queue=/tier=/patch=/date=[/batch=].

    Adds loose_date, time and fetched_at. With a batch number the same batch can be written again and leaves the same rows.
    """
    date, time = partition_keys(fetched_at)
    _append(df.withColumns({"fetched_at": fetched_at, "date": date, "loose_date": date, "time": time}), root, fmt, mode, batch)


def write_details(details: DataFrame, info: DataFrame, root: str, fmt: str = "parquet", mode: str = "append", batch: int | None = None) -> None:
    """Details with their entity's bracket; date and time come from the entity's latest sighting, not from the fetch.

    A batch's details have nearly as many days as entities: a folder and file for each bracket and day would hold a few
    rows. With a batch number the date is a column of the files of its bracket and patch, in whose order they are.
    """
    date, time = partition_keys(F.col("latest_logged_at"))
    rows = details.join(info.select("entity_id", "region", "queue", "tier", "division", "latest_logged_at"), "entity_id")
    _append(rows.withColumns({"date": date, "time": time}), root, fmt, mode, batch, PARTITIONS if batch is None else PARTITIONS[:-1])


def write_bundle(tables: dict[str, DataFrame], root: str, source: str, fetched_at: Column) -> None:
    for name, df in tables.items():
        df.withColumns({"source": F.lit(source), "fetched_at": fetched_at}).write.mode("overwrite").parquet(f"{root}/{name}")


def write_report(summary: DataFrame, details: dict[str, DataFrame], root: str, percents: tuple[str, ...] = ()) -> None:
    """A JSON table each below root; the named shares of the summary become text such as 12.50%."""
    shown = summary.withColumns({c: percent(F.col(c)) for c in percents})
    for name, df in {"summary": shown, **details}.items():
        df.write.mode("overwrite").json(f"{root}/{name}")
