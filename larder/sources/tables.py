"""S1 for stored inventory tables: read and write the six tables as parquet
with their fixed schemas (no inference; Catalyst prunes columns and pushes
filters into each scan)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from larder.sources.schemas import TABLES


def load_tables(spark: SparkSession, directory: str, names=None) -> dict[str, DataFrame]:
    """{table: DataFrame} for the tables stored under ``directory/<table>``."""
    out = {}
    for name in names or TABLES:
        path = os.path.join(directory, name)
        out[name] = spark.read.schema(TABLES[name]).parquet(path)
    return out


def save_tables(tables: dict[str, DataFrame], directory: str, mode: str = "errorifexists") -> None:
    """Write tables under ``directory/<table>`` in their declared column order.
    Callers write new versions to a new directory, never over their input."""
    for name, df in tables.items():
        cols = [f.name for f in TABLES[name].fields if f.name in df.columns]
        df.select(*cols).write.mode(mode).parquet(os.path.join(directory, name))


# The key that joins, folds and running sums of a table use.
BUCKET_KEYS = {"products": "id", "stock_transactions": "product_id", "purchase_orders": "id", "purchase_order_items": "order_id"}


def save_bucketed(tables: dict[str, DataFrame], directory: str, buckets: int, prefix: str = "") -> None:
    """Store tables in ``buckets`` buckets of their key, one sorted file each, and register
    them as ``<prefix><table>``.  A product and its ledger rows share a bucket number, so
    the listing join, the ledger fold and a running sum per product need no shuffle."""
    for name, df in tables.items():
        cols = [f.name for f in TABLES[name].fields if f.name in df.columns]
        key = BUCKET_KEYS[name]
        order = [key] if key == "id" else [key, "id"]
        (df.select(*cols).repartition(buckets, key).write.mode("overwrite").format("parquet")
         .option("path", os.path.join(directory, name)).bucketBy(buckets, key).sortBy(*order).saveAsTable(f"{prefix}{name}"))


def load_bucketed(spark: SparkSession, names, prefix: str = "") -> dict[str, DataFrame]:
    return {name: spark.table(f"{prefix}{name}") for name in names}
