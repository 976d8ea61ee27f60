"""A table of largest values by key that micro-batches are merged into: one row for each key, safe to replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("sim_name", "res_type", "r", "c")


class MergedPeaks:
    """Largest value of each key, in buckets of a hash of the keys.

    Batch n reads the buckets that it has rows for, as batch n - 1 left them, and writes them anew as version n; a small list
    of buckets and versions, written last, makes the batch count.  So a batch costs what its buckets hold, not all history;
    a batch that is run again reads the same versions and writes the same rows; and readers see whole batches only.  The
    versions before the last two lists are deleted.  Batches are numbered from 0, as foreachBatch does.
    """

    def __init__(self, path: str, keys: tuple[str, ...] = KEYS, value: str = "value", buckets: int = 64) -> None:
        self.path, self.keys, self.value, self.buckets = path, keys, value, buckets

    def _list(self, n: int) -> str:
        return f"{self.path}/batches/{n}"

    def _bucket(self, bucket: int, version: int) -> str:
        return f"{self.path}/versions/{version}/bucket={bucket}"

    def _files(self, spark: SparkSession):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        where = hadoop(self.path)
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def versions(self, spark: SparkSession, n: int) -> dict[int, int]:
        """The version of each bucket after batch n; as many rows as there are buckets at most."""
        return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(self._list(n)).collect()} if n >= 0 else {}

    def latest(self, spark: SparkSession) -> int:
        """The last batch that counts, -1 before the first."""
        files, path = self._files(spark)
        if not files.exists(path(f"{self.path}/batches")):
            return -1
        done = [int(x.getPath().getName()) for x in files.listStatus(path(f"{self.path}/batches")) if files.exists(path(f"{x.getPath()}/_SUCCESS"))]
        return max(done, default=-1)

    def _read(self, spark: SparkSession, found: dict[int, int], schema: str) -> DataFrame:
        paths = [self._bucket(b, v) for b, v in found.items()]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, n: int) -> None:
        """Take in batch number n; null values are no peaks."""
        spark = batch.sparkSession
        rows = batch.select(*self.keys, self.value).where(F.col(self.value).isNotNull())
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")
        new = rows.groupBy(*self.keys).agg(F.max(self.value).alias(self.value)).persist()
        try:
            before = self.versions(spark, n - 1)
            touched = [r.bucket for r in new.select(bucket).distinct().collect()]
            old = self._read(spark, {b: before[b] for b in touched if b in before}, schema)
            merged = new.unionByName(old).select(bucket, *self.keys, self.value).repartition("bucket").groupBy("bucket", *self.keys).agg(F.max(self.value).alias(self.value))
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/versions/{n}")
        finally:
            new.unpersist()
        after = before | dict.fromkeys(touched, n)
        spark.createDataFrame(list(after.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(self._list(n))
        if n > 1:
            files, path = self._files(spark)
            for b, v in self.versions(spark, n - 2).items() if files.exists(path(self._list(n - 2))) else ():
                if before.get(b) != v:
                    files.delete(path(self._bucket(b, v)), True)
            files.delete(path(self._list(n - 3)), True)

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        """keys and value, one row for each key, as of the last batch that counts."""
        return self._read(spark, self.versions(spark, self.latest(spark)), schema)
