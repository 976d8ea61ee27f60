"""Small shared pieces: Arrow mapping, tables in the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that go to Python at once, and that a per-batch function gets at most (or one row): texts differ in length, and this
#: bounds the memory of both sides.
SENT_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
DEFAULT_BYTES = "67108864b"  # Spark's own


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def by_bytes(batches: Iterable[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of at most `limit` bytes, or of one row."""
    for batch in batches:
        rows = batch.num_rows
        if batch.nbytes <= limit:
            if rows:
                yield batch
            continue
        at = 0
        while at < rows:
            n = max(1, min(rows - at, rows * limit // batch.nbytes))
            while n > 1 and batch.slice(at, n).nbytes > limit:
                n //= 2
            yield batch.slice(at, n)
            at += n


def sent_by_bytes(df: DataFrame) -> DataFrame:
    """df, once its session sends batches of SENT_BYTES to Python.  A bound that the user has set stays as it is."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == DEFAULT_BYTES:
        conf.set(key, str(SENT_BYTES))
    return df


def map_arrow(df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with one output batch for each slice of input rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            yield per_batch(batch)

    return sent_by_bytes(df).mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where Spark runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of written() that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges between longs: (node, root) of every node that isn't the smallest of its component.

    Alternates large-star and small-star steps until only stars are left; the number of rounds grows with the
    logarithm of the longest path.  A minimum is taken with partial aggregation and joined back, so a hub's
    neighbours never have to meet in one task (AQE splits a skewed join).  Null ends and self edges are left out.
    """
    spark = edges.sparkSession
    cur, path = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v").distinct(), "edges")
    while True:
        n, own = cur.agg(F.count("*"), F.count_distinct("u")).first()
        if n == own and cur.select(F.col("v").alias("u")).join(cur.select("u"), "u", "left_semi").isEmpty():
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = cur.union(cur.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_path = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        small, small_path = written(small.distinct(), "small")
        removed(spark, large_path)
        removed(spark, path)
        cur, path = small, small_path
