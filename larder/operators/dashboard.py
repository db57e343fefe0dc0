"""The dashboard's one-row figure set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import as_bigint, as_double
from larder.operators.views import low_stock_count, valuation_exact


def dashboard_kpis(products: DataFrame, suppliers: DataFrame, orders: DataFrame) -> DataFrame:
    """Grand totals of the valuation (a second-level rollup, 0 when empty) and
    three filtered counts.  The counts are scalar subqueries: each is a
    partial+final aggregate that returns one value, joined to nothing."""
    valuation = valuation_exact(products)
    alerts = low_stock_count(products)
    open_orders = orders.filter(F.col("status").isin("PENDING", "SHIPPED")).select(F.count(F.lit(1))).scalar()
    active_suppliers = suppliers.filter(F.col("status") == "Active").select(F.count(F.lit(1))).scalar()
    return valuation.agg(
        as_double(F.coalesce(F.sum("total_valuation"), F.lit(0))).alias("total_valuation"),
        as_bigint(F.coalesce(F.sum("total_items"), F.lit(0))).alias("total_items"),
        as_bigint(F.coalesce(F.sum("product_count"), F.lit(0))).alias("total_products"),
    ).select(
        "total_valuation",
        "total_items",
        "total_products",
        as_bigint(alerts).alias("low_stock_alert_count"),
        as_bigint(open_orders).alias("active_po_count"),
        as_bigint(active_suppliers).alias("supplier_count"),
    )
