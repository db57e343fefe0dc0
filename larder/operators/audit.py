"""Audit rows for product and order changes (the audit triggers as
set-based jobs).  Comparisons use ``!=``, which is not null-safe: a null on
either side produces no audit row, as ``<>`` does in the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import audit_json
from larder.operators.prefix import Scan, prefix_scan
from larder.sources.schemas import ORDER_AUDIT_ACTOR, PRODUCT_AUDIT_ACTOR


def _when(changed_at):
    """Audit time: now by default, or a given timestamp for repeatable jobs."""
    if changed_at is None:
        return F.current_timestamp()
    if isinstance(changed_at, Column):
        return changed_at
    return F.lit(changed_at).cast("timestamp")


def product_audit_rows(j: DataFrame, changed_at=None) -> DataFrame:
    """Audit-log rows from (record_id, old/new quantity, old/new price)."""
    return _product_rows(j, changed_at)


def _product_rows(j: DataFrame, changed_at=None) -> DataFrame:
    return j.select(
        F.lit("products").alias("table_name"),
        F.lit("UPDATE").alias("action_type"),
        F.col("record_id"),
        "old_quantity", "new_quantity", "old_price", "new_price",
        audit_json(quantity_in_stock=F.col("old_quantity"), price=F.col("old_price")).alias("old_values"),
        audit_json(quantity_in_stock=F.col("new_quantity"), price=F.col("new_price")).alias("new_values"),
        F.lit(PRODUCT_AUDIT_ACTOR).alias("changed_by"),
        _when(changed_at).alias("changed_at"),
    )


def product_audit(old: DataFrame, new: DataFrame, changed_at=None) -> DataFrame:
    """One row per product whose stock or price differs between two snapshots."""
    o = old.select(F.col("id").alias("record_id"), F.col("quantity_in_stock").alias("old_quantity"),
                   F.col("price").alias("old_price"))
    n = new.select(F.col("id").alias("_nid"), F.col("quantity_in_stock").alias("new_quantity"),
                   F.col("price").alias("new_price"))
    j = o.join(n, o.record_id == n._nid, "inner").filter(
        (F.col("old_quantity") != F.col("new_quantity")) | (F.col("old_price") != F.col("new_price")))
    return _product_rows(j, changed_at)


def product_audit_from_guard(guarded: DataFrame, products: DataFrame, changed_at=None) -> DataFrame:
    """One row per accepted ledger row that changed the stock (R3 b)."""
    g = guarded.filter(F.col("accepted") & (F.col("stock_before") != F.col("stock_after")))
    p = products.select(F.col("id").alias("_pid"), F.col("price").alias("_price"))
    j = g.join(p, g.product_id == p._pid, "inner").select(
        F.col("product_id").alias("record_id"),
        F.col("stock_before").cast("int").alias("old_quantity"),
        F.col("stock_after").cast("int").alias("new_quantity"),
        F.col("_price").alias("old_price"),
        F.col("_price").alias("new_price"),
        F.col("id").alias("ledger_id"),
    )
    return _product_rows(j, changed_at)


def order_audit(old: DataFrame, new: DataFrame, changed_at=None) -> DataFrame:
    """One row per order whose status differs between two snapshots."""
    o = old.select(F.col("id").alias("record_id"), F.col("status").alias("old_status"))
    n = new.select(F.col("id").alias("_nid"), F.col("status").alias("new_status"))
    j = o.join(n, o.record_id == n._nid, "inner").filter(F.col("old_status") != F.col("new_status"))
    return order_audit_rows(j, changed_at)


def order_audit_rows(changes: DataFrame, changed_at=None) -> DataFrame:
    """Audit-log rows from changes of status (record_id, old_status, new_status)."""
    return changes.select(
        F.lit("purchase_orders").alias("table_name"),
        F.lit("UPDATE").alias("action_type"),
        "record_id", "old_status", "new_status",
        audit_json(status=F.col("old_status")).alias("old_values"),
        audit_json(status=F.col("new_status")).alias("new_values"),
        F.lit(ORDER_AUDIT_ACTOR).alias("changed_by"),
        _when(changed_at).alias("changed_at"),
    )


def order_audit_from_log(log: DataFrame, order_col="order_id", seq_col="seq", status_col="status",
                         partitions: int | None = None) -> DataFrame:
    """From a log of successive statuses, the prior status of each entry
    (``lag`` as a scan by row rank, so a long log of one order is split; the
    status itself is carried, whatever its text) and one audit row per actual
    change."""
    rows = log.select(F.col(order_col).alias("record_id"), F.col(seq_col).alias("seq"), F.col(status_col).alias("new_status"))
    j = prefix_scan(rows, "record_id", "seq", [Scan("old_status", "prev", F.col("new_status"))], partitions)
    return j.where("old_status != new_status").select(
        "record_id", "seq", "old_status", "new_status", F.lit(ORDER_AUDIT_ACTOR).alias("changed_by"))


PRODUCT_VALUES = "quantity_in_stock INT, price DECIMAL(12,2)"
ORDER_VALUES = "status STRING"


def parse_audit_values(log: DataFrame) -> DataFrame:
    """read the JSON old/new values of audit rows back into typed columns
    (product rows: quantity and price; order rows: status)."""
    is_product = F.col("table_name") == "products"
    old_p, new_p = F.from_json("old_values", PRODUCT_VALUES), F.from_json("new_values", PRODUCT_VALUES)
    old_o, new_o = F.from_json("old_values", ORDER_VALUES), F.from_json("new_values", ORDER_VALUES)
    return log.select(
        "*",
        F.when(is_product, old_p["quantity_in_stock"]).alias("old_quantity_in_stock"),
        F.when(is_product, new_p["quantity_in_stock"]).alias("new_quantity_in_stock"),
        F.when(is_product, old_p["price"]).alias("old_price_value"),
        F.when(is_product, new_p["price"]).alias("new_price_value"),
        F.when(~is_product, old_o["status"]).alias("old_status_value"),
        F.when(~is_product, new_o["status"]).alias("new_status_value"),
    )


def audit_log(*parts: DataFrame) -> DataFrame:
    """Stack audit rows of several kinds into the audit-log table's columns."""
    cols = ["table_name", "action_type", "record_id", "old_values", "new_values", "changed_by", "changed_at"]
    out = None
    for p in parts:
        p = p.select(*cols)
        out = p if out is None else out.unionByName(p)
    return out
