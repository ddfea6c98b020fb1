"""Tables written version by version: each a folder of plain Parquet that counts once a commit names it.

Writing a version again replaces it, so a step that is repeated after a failure adds nothing twice; what a failed step
left behind is not read. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("rows", T.LongType())])


class Versions:
    """root/data/version=n[/bucket=b] and root/commits/version=n, a row (bucket, rows) for each bucket that the version replaces.

    Without buckets (0) versions are added up: an append-only log. With them a bucket's rows are those of its last
    version, so a version rewrites only the buckets it touches.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 0):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def bucket_of(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(max(1, self.buckets)).cast("long"))

    def _files(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        files, where = self._files(path)
        return files.exists(where)

    def has(self, version: int) -> bool:
        return self._exists(f"{self.root}/commits/version={version}/_SUCCESS")

    def commits(self, before: int | None = None) -> DataFrame | None:
        """(bucket, rows, version) of the committed versions below one; None if there is none."""
        if not self._exists(f"{self.root}/commits"):
            return None
        rows = self.spark.read.schema(T.StructType([*COMMIT, T.StructField("version", T.LongType())])).parquet(f"{self.root}/commits")
        return rows if before is None else rows.where(F.col("version") < before)

    def write(self, rows: DataFrame, version: int, touched: list[int] | None = None) -> None:
        """rows (with the column bucket, if there are buckets) as a version. touched: the buckets it replaces, even by nothing."""
        path = f"{self.root}/data/version={version}"
        writer = rows.hint("rebalance", "bucket").write.partitionBy("bucket") if self.buckets else rows.write
        writer.mode("overwrite").parquet(path)
        if self.buckets:
            counted = self.spark.read.schema(T.StructType([*rows.drop("bucket").schema, COMMIT["bucket"]])).parquet(path).groupBy("bucket").agg(F.count("*").alias("rows"))
            named = self.spark.createDataFrame([(b,) for b in touched or []], "bucket long")
            commit = named.join(counted, "bucket", "full_outer").select("bucket", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"))
        else:
            commit = self.spark.createDataFrame([(0, None)], COMMIT)
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/version={version}")  # a row per bucket at most

    def read_version(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/data/version={version}")

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The rows as they were before a version (or now), of some buckets or all; None if there is none.

        Only the folders of the wanted buckets are listed and read.
        """
        known = self.commits(before)
        if known is None:
            return None
        if only is not None:
            known = known.where(F.col("bucket").isin(only))
        if self.buckets:  # a row per bucket
            places = [f"{self.root}/data/version={r.last.version}/bucket={r.bucket}" for r in known.groupBy("bucket").agg(F.max(F.struct("version", "rows")).alias("last")).collect() if r.last.rows]
        else:  # a row per version
            places = [f"{self.root}/data/version={r.version}" for r in known.select("version").distinct().collect()]
        return self.spark.read.parquet(*places) if places else None

    def trim(self, keep_from: int) -> int:
        """Removes bucket folders that a later version below keep_from replaces; gives their number.

        Every state from keep_from on, and the one before it, can still be read and its version repeated.
        """
        known = self.commits(keep_from) if self.buckets else None
        if known is None:
            return 0
        last = known.groupBy("bucket").agg(F.max("version").alias("last"))
        old = known.join(last, "bucket").where((F.col("version") < F.col("last")) & (F.col("rows") > 0)).select("version", "bucket")
        gone = 0
        for r in old.toLocalIterator():  # a row per folder
            files, where = self._files(f"{self.root}/data/version={r.version}/bucket={r.bucket}")
            gone += bool(files.delete(where, True))
        return gone
