"""What the corpus operators share: word and character classes, the shared scratch folder, written tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts here: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table for A-Z only: other letters stay as they are.
ASCII_LOWER = bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
#: Spark's setting for removing the shuffle files of an execution when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folder of new scratch tables, where it isn't the shared one itself.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where it is unset, a temporary one, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-tallyspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_scratch.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _saved(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors.

    Nothing reads the shuffles behind it again: their files go with the end of the write, not when the driver happens
    to collect its garbage.
    """
    return _saved(df, new_path(df.sparkSession, label), *partition_by)


def written_alone(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, as written() has it; all other tables that make wrote are removed."""
    path, folder = new_path(spark, label), new_path(spark, f"{label}-scratch")
    outer = _scratch.set(folder)
    try:
        return _saved(make(), path)
    finally:
        _scratch.reset(outer)
        delete_path(spark, folder)


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a scratch table or folder through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def all_columns(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*("`" + c.replace("`", "``") + "`" for c in df.columns))


def rows_of(docs: DataFrame, kept: DataFrame, text_key: Callable[[Column], Column], label: str) -> DataFrame:
    """The rows of docs whose doc_id and key of the text are in kept (id, key; each once), all columns; of rows that repeat both, one."""
    rows = docs.select(all_columns(docs).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("_id"), text_key(F.col("row.text")).alias("_key"))
    same = lambda other: rows["_id"].eqNullSafe(other["id"]) & (rows["_key"] == other["key"])
    # keys of rows that repeat id and text: seldom any; written, so that their number is known when they are joined
    often = written(rows.groupBy(F.col("_id").alias("id"), F.col("_key").alias("key")).count().where("count > 1").select("id", "key"), label)
    single = rows.join(often, same(often), "left_anti").join(kept, same(kept), "left_semi").select("row")
    repeated = rows.join(often, same(often), "left_semi").join(kept, same(kept), "left_semi").groupBy("_id", "_key").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(repeated).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(doc_id.cast("string")) % F.lit(folds)
