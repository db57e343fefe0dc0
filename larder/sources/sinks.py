"""Writing results.

Operators return new DataFrames and never write over their own input;
callers append accepted ledger and audit rows to a table path, or emit JSON
lines (orders nested with their items).  Writes are distributed (one file
per task); nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """S3: append rows to a parquet table."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """S3: append one batch, once.  The batch is a partition of the table and replaces
    what an earlier run of the same batch wrote, so a repeated or retried batch
    leaves the table as it is; other batches are not touched (dynamic partition
    overwrite).  A batch without rows writes nothing."""
    (df.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def read_batches(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The rows of a table written by ``append_batch``, of all batches or those up to
    ``upto`` (older folders are pruned); the batch id is the last column."""
    df = spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("bigint"))
    return df if upto is None else df.where(F.col("batch_id") <= upto)


def overwrite_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Idempotent write of one micro-batch (a retry replaces its own output)."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def emit_json(df: DataFrame, path: str, compression: str | None = None) -> None:
    """JSON lines, nested structs and arrays kept (e.g. ``orders_nested``),
    null fields written as null.  JSON repeats its field names in every row;
    ``compression`` ("gzip") makes the files a small part of that, one per task."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path, compression=compression)
