"""The three analytic views and the figures derived from them.

A1 stock valuation, P1/P2 + J1 low-stock alerts, A2-A4 + J2 supplier
performance, P9 supplier rating, W1/A11 valuation share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import as_bigint, as_double, fractional_days


def is_low_stock(qty="quantity_in_stock", reorder="reorder_level"):
    return F.col(qty) <= F.col(reorder)


def valuation_exact(products: DataFrame) -> DataFrame:
    """Valuation with the value kept in decimal (for exact second-level sums)."""
    return (
        products.filter(F.col("status") == "Active")
        .groupBy("category")
        .agg(
            as_bigint(F.count("id")).alias("product_count"),
            as_bigint(F.sum("quantity_in_stock")).alias("total_items"),
            F.sum(F.col("quantity_in_stock") * F.col("price")).alias("total_valuation"),
        )
    )


def stock_valuation(products: DataFrame) -> DataFrame:
    """Active products by category: count, units and value (value summed in decimal)."""
    v = valuation_exact(products)
    return v.withColumn("total_valuation", as_double("total_valuation"))


def low_stock_count(products: DataFrame):
    """Number of alerts, from the products alone (the supplier join adds no rows: its key is unique)."""
    return products.filter(is_low_stock() & (F.col("status") == "Active")).select(F.count(F.lit(1))).scalar()


def low_stock_alerts(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Active products at or below their reorder level, with supplier contact.

    Left join keeps products without (or with a missing) supplier.  The
    supplier side is a dimension: AQE broadcasts it when its runtime size is
    under the broadcast threshold and keeps the sort-merge join otherwise.
    """
    p = products.filter(is_low_stock() & (F.col("status") == "Active")).alias("p")
    s = suppliers.select("id", "name", "email").alias("s")
    return p.join(s, F.col("p.supplier_id") == F.col("s.id"), "left").select(
        F.col("p.id").alias("product_id"),
        F.col("p.sku").alias("sku"),
        F.col("p.name").alias("product_name"),
        F.col("p.quantity_in_stock").alias("quantity_in_stock"),
        F.col("p.reorder_level").alias("reorder_level"),
        F.col("p.category").alias("category"),
        (F.col("p.reorder_level") * 2 - F.col("p.quantity_in_stock")).alias("recommended_order_qty"),
        F.col("s.id").alias("supplier_id"),
        F.col("s.name").alias("supplier_name"),
        F.col("s.email").alias("supplier_email"),
    )


def order_stats_by_supplier(orders: DataFrame) -> DataFrame:
    """Per-supplier order aggregates, computed before the join (partial + final
    aggregation, so a supplier holding a third of all orders costs no more
    than any other)."""
    delivered = F.col("status") == "DELIVERED"
    lead = F.when(delivered & F.col("delivery_date").isNotNull(),
                  F.unix_micros("delivery_date") - F.unix_micros("order_date"))
    return orders.groupBy("supplier_id").agg(
        F.count("id").alias("_orders"),
        F.sum("total_amount").alias("_spend"),
        F.avg(lead).alias("_lead_micros"),
        F.sum(F.when(delivered, 1).otherwise(0)).alias("_delivered"),
    )


def supplier_performance(suppliers: DataFrame, orders: DataFrame) -> DataFrame:
    """Every supplier with its order count, spend, mean lead time in days
    (delivered and dated orders only) and fulfilment rate in per cent."""
    stats = order_stats_by_supplier(orders)
    s = suppliers.select("id", "name", "contact_name", "email")
    j = s.join(stats, s.id == stats.supplier_id, "left")
    n = F.coalesce(F.col("_orders"), F.lit(0))
    return j.select(
        F.col("id").alias("supplier_id"),
        F.col("name").alias("supplier_name"),
        F.col("contact_name"),
        F.col("email"),
        as_bigint(n).alias("total_orders"),
        as_double(F.coalesce(F.col("_spend"), F.lit(0))).alias("total_spend"),
        (F.col("_lead_micros") / F.lit(86_400_000_000.0)).alias("avg_lead_time_days"),
        (as_double(F.col("_delivered")) / F.nullif(n, F.lit(0)) * 100).alias("fulfillment_rate"),
    )


def lead_time_days(orders: DataFrame) -> DataFrame:
    """Per-order lead time in fractional days (the view's CASE expression)."""
    delivered = (F.col("status") == "DELIVERED") & F.col("delivery_date").isNotNull()
    return orders.select("id", F.when(delivered, fractional_days("delivery_date", "order_date")).alias("lead_days"))


def rating_band(rate="fulfillment_rate"):
    """Badge of a fulfilment rate; the null test must come first."""
    r = F.col(rate)
    return (
        F.when(r.isNull(), "info")
        .when(r >= 80, "success")
        .when(r >= 50, "warning")
        .otherwise("danger")
    )


def supplier_rating(suppliers: DataFrame, orders: DataFrame) -> DataFrame:
    perf = supplier_performance(suppliers, orders)
    return perf.select("supplier_id", "fulfillment_rate", rating_band().alias("rating"))


def valuation_share(products: DataFrame) -> DataFrame:
    """Category value as per cent of the largest category (floor 1).

    The maximum is a scalar subquery over the (small, per-category) valuation,
    not a window over one unpartitioned frame and not a join.
    """
    v = stock_valuation(products)
    peak = v.select(F.max("total_valuation")).scalar()
    return v.select(
        "category",
        "total_valuation",
        (F.col("total_valuation") / F.greatest(peak, F.lit(1.0)) * 100).alias("pct_of_max"),
    )
