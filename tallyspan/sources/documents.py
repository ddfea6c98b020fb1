"""Reading nested documents and ledger tables.

Documents are whole JSON files, often pretty-printed, in hive-style folders. Many small ones are packed: rows (path,
value) of Parquet files, so that listing, opening and committing files does not grow with their number. Partition
columns are always read as text: with inference a period 15.10 would become the number 15.1.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.sources.schemas import LEDGER

#: Packed documents: their own path and whole text; a file holds so many at most.
PACKED = "path string, value string"
PACK_DOCUMENTS = 1000

INFERENCE = "spark.sql.sources.partitionColumnTypeInference.enabled"


@contextmanager
def text_partitions(spark: SparkSession):
    before = spark.conf.get(INFERENCE)
    spark.conf.set(INFERENCE, "false")
    try:
        yield
    finally:
        spark.conf.set(INFERENCE, before)


def scan_documents(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """One row per file below root: partition columns, path, modified, doc (variant; null if it isn't JSON).

    since (yyyy-MM-ddTHH:mm:ss in session time): only files modified later are read, chosen where files are listed.
    """
    with text_partitions(spark):
        after = {} if since is None else {"modifiedAfter": since}
        raw = spark.read.options(**after).text(root, wholetext=True)
        return raw.select(
            *[c for c in raw.columns if c != "value"], F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.try_parse_json("value").alias("doc")
        )


def pack_documents(docs: DataFrame, root: str) -> None:
    """Adds documents (path, value) below root, packed."""
    docs.select("path", "value").write.mode("append").option("maxRecordsPerFile", PACK_DOCUMENTS).parquet(root)


def scan_packed(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """The same as scan_documents for packed documents: path is the document's own, modified that of the file that holds it."""
    with text_partitions(spark):
        after = {} if since is None else {"modifiedAfter": since}
        raw = spark.read.schema(PACKED).options(**after).parquet(root)
        return raw.select(*[c for c in raw.columns if c not in ("path", "value")], "path", F.col("_metadata.file_modification_time").alias("modified"), F.try_parse_json("value").alias("doc"))


def scan_bracket(spark: SparkSession, root: str, **equals: str | None) -> DataFrame:
    """Documents of the given partitions only (region=, queue=, tier=, patch=, date=): pruned before any file is read."""
    docs = scan_documents(spark, root)
    for column, value in equals.items():
        if value not in (None, ""):
            docs = docs.where(F.col(column) == value)
    return docs


def scan_latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest document below root; an error if there is none."""
    docs = scan_documents(spark, root)
    newest = docs.agg(F.max("modified").alias("newest")).first().newest  # file metadata of one row
    if newest is None:
        raise FileNotFoundError(f"no document below {root}")
    return docs.where(F.col("modified") == F.lit(newest))


def item_dimension(docs: DataFrame) -> DataFrame:
    """(item_id, item_name) from dictionary documents {"data": {name: {"id": name, "key": number as text}}}."""
    entries = F.from_json(F.to_json(F.try_variant_get("doc", "$.data", "variant")), "map<string, struct<id: string, key: string>>")
    return docs.select(F.explode(F.map_values(entries)).alias("e")).select(F.col("e.key").alias("item_id"), F.col("e.id").alias("item_name"))


def read_ledger(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(LEDGER[name]).parquet(f"{root}/{name}")
