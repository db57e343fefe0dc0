"""Views, dashboard and listings on the seed rows (goldens worked out by hand)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larder.operators import dashboard, ledger, listings, views
from tests.conftest import SEED_STOCK, rows


def test_seed_stock_is_ledger_sum(seed):
    got = dict(rows(ledger.ledger_stock(seed["ledger"])))
    assert got == SEED_STOCK


def test_apply_ledger_from_empty_stock(seed):
    got = dict(rows(ledger.apply_ledger(seed["products_empty"], seed["ledger"])))
    assert got == SEED_STOCK


def test_low_stock_alerts(seed):
    got = rows(views.low_stock_alerts(seed["products"], seed["suppliers"]),
               "sku", "quantity_in_stock", "reorder_level", "recommended_order_qty", "supplier_name")
    assert got == [("OFF-PEN-011", 10, 20, 30, "Supplier Two"),
                   ("PKG-TAP-102", 15, 40, 65, "Supplier Three")]


def test_low_stock_keeps_products_without_supplier(spark, seed):
    p = seed["products"].withColumn("supplier_id", F.when(F.col("id") == 5, None).otherwise(F.col("supplier_id")))
    got = rows(views.low_stock_alerts(p, seed["suppliers"]), "sku", "supplier_name")
    assert got == [("OFF-PEN-011", None), ("PKG-TAP-102", "Supplier Three")]


def test_low_stock_ignores_inactive_products(seed):
    p = seed["products"].withColumn("status", F.when(F.col("id") == 7, "Inactive").otherwise(F.col("status")))
    assert rows(views.low_stock_alerts(p, seed["suppliers"]), "sku") == [("OFF-PEN-011",)]


def test_stock_valuation(seed):
    got = rows(views.stock_valuation(seed["products"]))
    assert got == [("Electronics", 3, 89, 27570.0), ("Office Supplies", 2, 170, 1160.0),
                   ("Packaging", 2, 515, 948.0)]


def test_supplier_performance(seed):
    got = rows(views.supplier_performance(seed["suppliers"], seed["orders"]),
               "supplier_id", "total_orders", "total_spend", "avg_lead_time_days", "fulfillment_rate")
    assert got == [(1, 1, 2400.0, 5.0, 100.0), (2, 1, 195.0, None, 0.0), (3, 1, 1280.0, None, 0.0)]


def test_supplier_without_orders(spark, seed):
    four = seed["suppliers"].limit(1).select(
        F.lit(4).cast("bigint").alias("id"), *[c for c in seed["suppliers"].columns if c != "id"])
    s = seed["suppliers"].unionByName(four.withColumn("email", F.lit("x@y.z")))
    got = [r for r in rows(views.supplier_performance(s, seed["orders"]),
                           "supplier_id", "total_orders", "total_spend", "avg_lead_time_days",
                           "fulfillment_rate") if r[0] == 4]
    assert got == [(4, 0, 0.0, None, None)]
    rating = dict(rows(views.supplier_rating(s, seed["orders"]), "supplier_id", "rating"))
    assert rating == {1: "success", 2: "danger", 3: "danger", 4: "info"}


def test_dashboard_kpis(seed):
    got = dashboard.dashboard_kpis(seed["products"], seed["suppliers"], seed["orders"]).collect()
    assert len(got) == 1
    assert tuple(got[0]) == (29678.0, 774, 7, 2, 2, 3)


def test_dashboard_on_empty_tables(spark, seed):
    p = seed["products"].limit(0)
    got = dashboard.dashboard_kpis(p, seed["suppliers"].limit(0), seed["orders"].limit(0)).collect()
    assert tuple(got[0]) == (0.0, 0, 0, 0, 0, 0)


def test_valuation_share(seed):
    got = {r["category"]: round(r["pct_of_max"], 6) for r in views.valuation_share(seed["products"]).collect()}
    assert got["Electronics"] == 100.0
    assert got["Packaging"] == round(948 / 27570 * 100, 6)


def test_listings(seed):
    pl = listings.product_listing(seed["products"], seed["suppliers"])
    assert [r["id"] for r in pl.collect()] == [7, 6, 5, 4, 3, 2, 1]
    assert rows(pl.filter("is_low_stock"), "sku") == [("OFF-PEN-011",), ("PKG-TAP-102",)]
    ol = listings.order_listing(seed["orders"], seed["suppliers"])
    assert [(r["id"], r["is_open"]) for r in ol.collect()] == [(3, True), (2, True), (1, False)]
    sd = listings.supplier_directory(seed["suppliers"])
    assert [r["name"] for r in sd.collect()] == sorted(r[1] for r in rows(seed["suppliers"]))


def test_items_enriched(seed):
    got = rows(listings.order_items_enriched(seed["items"], seed["products"]),
               "order_id", "product_sku", "fully_received")
    assert got == [(1, "ELEC-LAP-001", True), (2, "OFF-PAP-010", False), (2, "OFF-PEN-011", False),
                   (3, "PKG-TAP-102", False)]


def test_orders_nested_and_digest(spark, seed):
    extra = seed["orders"].filter("id = 3").withColumn("id", F.lit(9).cast("bigint"))
    orders = seed["orders"].unionByName(extra)
    nested = listings.orders_nested(orders, seed["suppliers"], seed["items"], seed["products"])
    by_id = {r["id"]: r for r in nested.collect()}
    assert [i["product_sku"] for i in by_id[2]["items"]] == ["OFF-PAP-010", "OFF-PEN-011"]
    assert by_id[9]["items"] == []
    digest = rows(listings.orders_digest(orders, seed["suppliers"], seed["items"], seed["products"]))
    assert digest == rows(listings.nested_digest(nested))
    assert (9, 0, 0, None, None) in digest
    # an order with more items than a page is split into bounded pages
    paged = listings.orders_nested_pages(orders, seed["suppliers"], seed["items"], seed["products"], page_size=1)
    pages = {(r["id"], r["page"]): len(r["items"]) for r in paged.collect()}
    assert pages[(2, 2)] == 1 and pages[(2, 3)] == 1 and max(pages.values()) <= 1
    assert rows(listings.nested_digest(paged)) == digest


def test_recent_movements_and_top(seed):
    rm = listings.recent_movements(seed["ledger"], seed["products"], 5)
    assert rows(rm, "id") == [(7,), (8,), (9,), (10,), (11,)]
    top = listings.low_stock_top(seed["products"], seed["suppliers"], 1).collect()
    assert [(r["sku"], r["total_alerts"], r["remaining"]) for r in top] == [("OFF-PEN-011", 2, 1)]


def test_lookup_and_adhoc(spark, seed):
    keys = spark.createDataFrame([(1,), (1,), (5,), (99,)], "id long")
    assert rows(listings.lookup_by_keys(seed["products"], keys), "id") == [(1,), (5,)]
    got = listings.adhoc_category_filter(spark, seed["products"], "Packaging")
    assert rows(got, "sku") == [("PKG-BOX-101",), ("PKG-TAP-102",)]
    listings.register_views(spark, {"products": seed["products"], "suppliers": seed["suppliers"],
                                    "purchase_orders": seed["orders"]})
    n = listings.adhoc_query(spark, "WITH a AS (SELECT * FROM v_low_stock_alerts) SELECT count(*) FROM a")
    assert n.collect()[0][0] == 2
    assert listings.adhoc_query(spark, "-- a remark\nSELECT 1 AS one;").collect()[0][0] == 1
    before = spark.table("products").count()
    for text in ("WITH a AS (SELECT 1) INSERT INTO products SELECT * FROM a", "DROP VIEW products", "", "/* x */ CREATE TABLE t (a INT)"):
        with pytest.raises(ValueError):
            listings.adhoc_query(spark, text)
    assert spark.table("products").count() == before
