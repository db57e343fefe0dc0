"""Scan the raw tables of a data directory and lay the inventory model over them.

The driver's test data holds TPC-H-style tables, not inventory tables.  Each
inventory table is a column projection of one raw table (plus the 25-row
``nation`` dimension for suppliers), so every query's work grows with the raw
tables.  The same definitions are written as DuckDB CTEs in
``larder.plans.model_sql``; keep the two in step.

Projections are lazy: Catalyst prunes the unused raw columns and pushes
filters into the parquet scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.columns import signed_quantity

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

# Fixed creation time of the projected catalogue rows.
CATALOG_EPOCH = "2024-01-01 00:00:00"


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The raw table as a parquet scan, listed anew on each call: files that
    arrive during a long session are seen by the next query."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ts(c):
    """Raw parquet timestamps are zone-less; the model works in session-zone TIMESTAMP."""
    return F.col(c).cast("timestamp")


def _supplier_count(supplier: DataFrame):
    # Scalar subquery (one value), not a join: the count never travels as rows.
    return supplier.select(F.count(F.lit(1))).scalar()


def suppliers(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    n = nation.select("n_nationkey", "n_name")
    s = supplier.join(n, supplier.s_nationkey == n.n_nationkey, "left")
    return s.select(
        F.col("s_suppkey").cast("bigint").alias("id"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("contact_name"),
        F.concat(F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("-"))), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("+1-555-"), F.col("s_suppkey").cast("string")).alias("phone"),
        F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("address"),
        F.when(F.col("s_acctbal") < 0, "Inactive").otherwise("Active").alias("status"),
        F.lit(CATALOG_EPOCH).cast("timestamp").alias("created_at"),
    )


def products(part: DataFrame, supplier: DataFrame) -> DataFrame:
    n = F.nullif(_supplier_count(supplier), F.lit(0))
    key = F.col("p_partkey")
    return part.select(
        key.cast("bigint").alias("id"),
        F.concat(F.col("p_type"), F.lit("-"), key.cast("string")).alias("sku"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("description"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
        ((key * 37) % 200).cast("int").alias("quantity_in_stock"),
        F.col("p_size").cast("int").alias("reorder_level"),
        F.when(key % 11 == 0, F.lit(None)).otherwise(key % n).cast("bigint").alias("supplier_id"),
        F.when(F.col("p_brand") == "Brand#25", "Inactive").otherwise("Active").alias("status"),
        F.lit(CATALOG_EPOCH).cast("timestamp").alias("created_at"),
    )


def purchase_orders(orders: DataFrame, supplier: DataFrame) -> DataFrame:
    n = F.nullif(_supplier_count(supplier), F.lit(0))
    orders = orders.withColumn("_k", F.col("o_custkey") % n)
    k = F.col("_k")
    key = F.col("o_orderkey")
    odate = _ts("o_orderdate")
    status = (
        F.when(F.col("o_orderstatus") == "F", "DELIVERED")
        .when(F.col("o_orderstatus") == "O", "SHIPPED")
        .when((F.col("o_orderstatus") == "P") & (key % 3 == 0), "CANCELLED")
        .when(F.col("o_orderstatus") == "P", "PENDING")
    )
    delivered_on = F.when(
        (F.col("o_orderstatus") == "F") & (key % 17 != 0),
        F.timestamp_add("DAY", (key % 30).cast("int"), odate),
    )
    return orders.select(
        key.cast("bigint").alias("id"),
        (k + F.when(k % 10 == 0, 1).otherwise(0)).cast("bigint").alias("supplier_id"),
        odate.alias("order_date"),
        F.timestamp_add("DAY", F.lit(14), odate).alias("expected_date"),
        delivered_on.alias("delivery_date"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("total_amount"),
        status.alias("status"),
        odate.alias("created_at"),
        odate.alias("updated_at"),
    )


def order_items(lineitem: DataFrame) -> DataFrame:
    """Items of the orders.  (orderkey, linenumber) repeats in the test data, so
    ``id`` is a surrogate that is not unique there; no operator keys on it."""
    # Unit price rounded half-up to the cent in integer arithmetic: exact on
    # every engine (rounding the double quotient differs on half-cent ties).
    unit_cents = F.expr(
        "(2 * cast(round(l_extendedprice * 100) as bigint) + cast(l_quantity as bigint))"
        " div (2 * cast(l_quantity as bigint))"
    )
    quantity = F.col("l_quantity").cast("int")
    return lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("id"),
        F.col("l_orderkey").cast("bigint").alias("order_id"),
        F.col("l_partkey").cast("bigint").alias("product_id"),
        quantity.alias("quantity"),
        (unit_cents / 100).cast("decimal(12,2)").alias("unit_price"),
        F.when(F.col("l_linestatus") == "F", quantity).otherwise(F.lit(0)).alias("received_quantity"),
    )


def ledger_events(events: DataFrame) -> DataFrame:
    """Ordered ledger (unique ids) from the event stream."""
    et = F.col("event_type")
    return events.select(
        F.col("event_id").cast("bigint").alias("id"),
        F.col("user_id").cast("bigint").alias("product_id"),
        F.when(et.isin("purchase", "click"), "OUT").when(et == "error", "ADJUSTMENT").otherwise("IN")
        .alias("transaction_type"),
        F.greatest(F.lit(1), F.ceil(F.col("value"))).cast("int").alias("quantity"),
        F.concat(F.lit("EV-"), F.col("event_id").cast("string")).alias("reference_id"),
        et.alias("notes"),
        _ts("ts").alias("transaction_date"),
    )


def ledger_bulk(lineitem: DataFrame) -> DataFrame:
    """Bulk ledger from line items: sums only (no unique key, so no ordering)."""
    rf = F.col("l_returnflag")
    return lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("id"),
        F.col("l_partkey").cast("bigint").alias("product_id"),
        F.when(rf == "R", "IN").when(rf == "N", "OUT").when(rf == "A", "ADJUSTMENT").alias("transaction_type"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.concat(F.lit("LI-"), F.col("l_orderkey").cast("string")).alias("reference_id"),
        F.lit(None).cast("string").alias("notes"),
        _ts("l_shipdate").alias("transaction_date"),
    )


def products_synced(products_df: DataFrame, bulk: DataFrame) -> DataFrame:
    """Products whose stock equals the bulk ledger sum, off by 7 on every 50th key."""
    sums = bulk.groupBy("product_id").agg(F.sum(signed_quantity()).alias("_ledger"))
    p = products_df.join(sums, products_df.id == sums.product_id, "left")
    qty = F.coalesce(F.col("_ledger"), F.lit(0)) + F.when(F.col("id") % 50 == 0, 7).otherwise(0)
    return p.select(
        *[qty.cast("int").alias(c) if c == "quantity_in_stock" else F.col(c) for c in products_df.columns]
    )


def products_faulty(products_df: DataFrame) -> DataFrame:
    """Products with injected faults: negative price on every 97th key, and the
    sku of key k-1 copied onto key k for every 101st key."""
    prev = products_df.select((F.col("id") + 1).alias("_next_id"), F.col("sku").alias("_prev_sku"))
    p = products_df.join(prev, (products_df.id == prev._next_id) & (products_df.id % 101 == 0), "left")
    out = []
    for c in products_df.columns:
        if c == "price":
            out.append(F.when(F.col("id") % 97 == 0, -F.col("price")).otherwise(F.col("price")).alias("price"))
        elif c == "sku":
            out.append(F.coalesce(F.col("_prev_sku"), F.col("sku")).alias("sku"))
        else:
            out.append(F.col(c))
    return p.select(*out)


def ledger_faulty(ledger_df: DataFrame) -> DataFrame:
    """Events ledger with a dangling product on every 103rd row."""
    return ledger_df.withColumn(
        "product_id",
        F.when(F.col("id") % 103 == 0, -F.col("product_id") - 1).otherwise(F.col("product_id")),
    )


def audit_log(events: DataFrame) -> DataFrame:
    """A change log from the event stream: every event a change of a product."""
    et = F.col("event_type")
    return events.select(
        F.col("event_id").cast("bigint").alias("id"),
        F.lit("products").alias("table_name"),
        F.when(et == "signup", "INSERT").when(et == "error", "DELETE").otherwise("UPDATE").alias("action_type"),
        F.col("user_id").cast("bigint").alias("record_id"),
        F.lit(None).cast("string").alias("old_values"),
        F.col("props").alias("new_values"),
        F.lit("SYSTEM").alias("changed_by"),
        _ts("ts").alias("changed_at"),
    )


def status_log(events: DataFrame) -> DataFrame:
    """A log of order statuses with one outside the four names (order_id, seq, status)."""
    et = F.col("event_type")
    return events.select(
        F.col("user_id").cast("bigint").alias("order_id"), F.col("event_id").cast("bigint").alias("seq"),
        F.when(et == "signup", "PENDING").when(et == "view", "SHIPPED").when(et == "click", "DELIVERED")
        .when(et == "purchase", "CANCELLED").when(et == "error", "ON_HOLD").alias("status"))


# Faults by table and column, as SQL over the sound rows; the oracle states the same.  Every
# CHECK, some NOT NULL columns, the unique e-mail and all five foreign keys are broken.
FAULTS = {
    "suppliers": {
        "status": "CASE WHEN id % 7 = 3 THEN 'Closed' ELSE status END",
        "phone": "CASE WHEN id % 11 = 5 THEN NULL ELSE phone END",
        "email": "CASE WHEN id % 9 = 1 THEN 'shared@example.com' WHEN id % 9 = 2 THEN NULL ELSE email END",
    },
    "products": {
        "price": "CASE WHEN id % 97 = 0 THEN -price ELSE price END",
        "reorder_level": "CASE WHEN id % 89 = 1 THEN -1 ELSE reorder_level END",
        "status": "CASE WHEN id % 83 = 2 THEN 'Gone' WHEN id % 83 = 3 THEN NULL ELSE status END",
        "name": "CASE WHEN id % 79 = 3 THEN NULL ELSE name END",
        "supplier_id": "CASE WHEN id % 71 = 4 THEN -id - 1 ELSE supplier_id END",
    },
    "purchase_orders": {
        "total_amount": "CASE WHEN id % 61 = 5 THEN -total_amount - 1 ELSE total_amount END",
        "status": "CASE WHEN id % 59 = 6 THEN 'LOST' ELSE status END",
        "supplier_id": "CASE WHEN id % 53 = 7 THEN -id - 1 WHEN id % 67 = 8 THEN NULL ELSE supplier_id END",
    },
    "purchase_order_items": {
        "quantity": "CASE WHEN id % 47 = 1 THEN 0 ELSE quantity END",
        "unit_price": "CASE WHEN id % 43 = 2 THEN -unit_price - 1 ELSE unit_price END",
        "received_quantity": "CASE WHEN id % 41 = 3 THEN -1 ELSE received_quantity END",
        "order_id": "CASE WHEN id % 37 = 4 THEN -order_id - 1 ELSE order_id END",
        "product_id": "CASE WHEN id % 31 = 5 THEN -product_id - 1 ELSE product_id END",
    },
    "stock_transactions": {
        "transaction_type": "CASE WHEN id % 29 = 1 THEN 'TRANSFER' ELSE transaction_type END",
        "quantity": "CASE WHEN id % 23 = 2 THEN 0 WHEN id % 101 = 6 THEN NULL ELSE quantity END",
        "product_id": "CASE WHEN id % 103 = 0 THEN -product_id - 1 ELSE product_id END",
    },
    "inventory_audit_log": {
        "action_type": "CASE WHEN id % 17 = 9 THEN 'MERGE' ELSE action_type END",
        "record_id": "CASE WHEN id % 13 = 4 THEN NULL ELSE record_id END",
    },
}


def faulty(table: str, df: DataFrame) -> DataFrame:
    """A table with the faults of ``FAULTS`` in it."""
    broken = FAULTS[table]
    return df.select(*[F.expr(broken[c]).cast(df.schema[c].dataType).alias(c) if c in broken else F.col(c) for c in df.columns])


class Model:
    """Lazy access to the inventory model over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = read_raw(self.spark, self.sf_dir, name)
        return self._cache[name]

    @cached_property
    def suppliers(self) -> DataFrame:
        return suppliers(self.raw("supplier"), self.raw("nation"))

    @cached_property
    def products(self) -> DataFrame:
        return products(self.raw("part"), self.raw("supplier"))

    @cached_property
    def purchase_orders(self) -> DataFrame:
        return purchase_orders(self.raw("orders"), self.raw("supplier"))

    @cached_property
    def items(self) -> DataFrame:
        return order_items(self.raw("lineitem"))

    @cached_property
    def ledger(self) -> DataFrame:
        return ledger_events(self.raw("events"))

    @cached_property
    def ledger_bulk(self) -> DataFrame:
        return ledger_bulk(self.raw("lineitem"))

    @cached_property
    def products_synced(self) -> DataFrame:
        return products_synced(self.products, self.ledger_bulk)

    @cached_property
    def products_faulty(self) -> DataFrame:
        return products_faulty(self.products)

    @cached_property
    def ledger_faulty(self) -> DataFrame:
        return ledger_faulty(self.ledger)

    @cached_property
    def audit_log(self) -> DataFrame:
        return audit_log(self.raw("events"))

    @cached_property
    def faulty_tables(self) -> dict[str, DataFrame]:
        tables = {"suppliers": self.suppliers, "products": self.products, "purchase_orders": self.purchase_orders,
                  "purchase_order_items": self.items, "stock_transactions": self.ledger, "inventory_audit_log": self.audit_log}
        return {name: faulty(name, df) for name, df in tables.items()}

    def opening_zero(self) -> DataFrame:
        """Opening stock 0 for every product (guard and running-stock inputs)."""
        return self.products.select(F.col("id").alias("product_id"), F.lit(0).alias("opening_stock"))
