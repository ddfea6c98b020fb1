"""A corpus pipeline of five stages; each works on all that its predecessor kept, written as Parquet and read again.

quality rules     documents that fail go, lines that fail go from those that stay
exact dedup       of equal texts one stays
n-gram join       of each group of near duplicates the one with the smallest doc_id stays
mixing            the order of the rows becomes the mix of the sources by their target weights
BPE               one row per document: doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, position: its
                  place in the mix, from 0; the rows are written in that order
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspan.llm import bpe, exact_dedup, mixing, ngram_join, quality_rules
from tallyspan.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null or empty text fails; rows that repeat an id are judged each on its own account. Columns of any name stay. An empty table gives no rows."""
    return quality_rules.quality_filter(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are one group, of which one row stays; of rows that repeat a text the longest as written, then the smallest id. Columns of any name stay. An empty table gives no rows."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without words all stay, a null id is the last of its group; rows that repeat id and text are one row. Columns of any name stay. An empty table gives no rows."""
    return ngram_join.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, a null source is a source of its own; rows that repeat an id are rows of their own. Columns of any name stay. An empty table gives no rows."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text has no tokens; every row is encoded, repeated ids and rows too. Other columns than doc_id, lang and source are left. An empty table gives no rows."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    # where a row stands in the files of the mix goes along with it; the files' first positions come in at the end
    placed = docs.withColumns({"file": F.col("_metadata.file_name"), "row_index": F.col("_metadata.row_index")})
    out = bpe.encode_documents(placed, path, bpe.digests, bpe.DIGESTS, keep=("doc_id", "lang", "source", "file", "row_index"))
    out = out.join(first_positions(docs), "file").withColumn("position", F.col("first") + F.col("row_index")).drop("file", "row_index", "first")
    return out.repartitionByRange("position").sortWithinPartitions("position")


def first_positions(docs: DataFrame) -> DataFrame:
    """Rows (file, first) for a table just read: the rows in the files before it, in the order of the writing tasks.

    One row per file: the window is over the table's files, not its rows.
    """
    files = docs.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))
    task = F.regexp_extract("file", r"^part-(\d+)", 1).cast("int")
    before = Window.orderBy(task, "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))


STAGES = [("quality rules", quality_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage), ("mixing", mixing_stage), ("BPE", bpe_stage)]

#: The near-duplicate and mixing stages are beyond SQL; tests/llm/test_pipeline.py holds the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
