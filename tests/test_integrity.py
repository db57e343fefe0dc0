"""Integrity reports on the seed rows with injected faults."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from larder.operators import integrity
from tests.conftest import rows


def _tables(seed, products=None, ledger=None):
    return {
        "suppliers": seed["suppliers"],
        "products": products if products is not None else seed["products"],
        "purchase_orders": seed["orders"],
        "purchase_order_items": seed["items"],
        "stock_transactions": ledger if ledger is not None else seed["ledger"],
    }


def test_clean_seed_has_no_violations(seed):
    t = _tables(seed)
    assert integrity.check_violations(t).count() == 0
    assert integrity.unique_violations({"products": t["products"], "suppliers": t["suppliers"]}).count() == 0
    assert integrity.fk_violations(t).count() == 0


def test_check_violations(seed):
    p = (seed["products"]
         .withColumn("price", F.when(F.col("id") == 2, F.lit(Decimal("-1.00"))).otherwise(F.col("price")))
         .withColumn("status", F.when(F.col("id") == 3, "Gone").when(F.col("id") == 4, None)
                     .otherwise(F.col("status")))
         .withColumn("name", F.when(F.col("id") == 5, None).otherwise(F.col("name"))))
    got = rows(integrity.check_violations(_tables(seed, products=p)))
    # a CHECK on a null status passes; NOT NULL on name does not
    assert got == [("products", "name_not_null", 5), ("products", "price_nonnegative", 2),
                   ("products", "status_enum", 3)]


def test_unique_and_fd(seed):
    p = seed["products"].withColumn("sku", F.when(F.col("id") == 2, "ELEC-LAP-001").otherwise(F.col("sku")))
    got = rows(integrity.unique_violations({"products": p, "suppliers": seed["suppliers"]}))
    assert got == [("products", "sku", "ELEC-LAP-001", 2, 1)]
    fd = rows(integrity.fd_check([("products", p, ["sku"], ["name"]), ("products", p, ["id"], ["sku"]),
                                  ("products", p, ["category"], ["supplier_id"])]))
    assert fd == [("products", "category", "supplier_id", 0), ("products", "id", "sku", 0),
                  ("products", "sku", "name", 1)]


def test_fk_violations(spark, seed):
    led = seed["ledger"].withColumn("product_id", F.when(F.col("id") == 3, 99).otherwise(F.col("product_id")))
    p = seed["products"].withColumn("supplier_id", F.when(F.col("id") == 1, None).otherwise(F.col("supplier_id")))
    got = rows(integrity.fk_violations(_tables(seed, products=p, ledger=led)))
    assert got == [("stock_transactions", "product_id", 3, 99)]


def test_delete_impact(spark, seed):
    keys = {
        "suppliers": spark.createDataFrame([(1,), (3,)], "id long"),
        "products": spark.createDataFrame([(2,), (7,)], "id long"),
        "purchase_orders": spark.createDataFrame([(2,)], "id long"),
    }
    t = _tables(seed)
    no_orders_for_3 = t["purchase_orders"].filter("supplier_id <> 3")
    t["purchase_orders"] = no_orders_for_3
    t["purchase_order_items"] = t["purchase_order_items"].filter("order_id <> 3")
    got = rows(integrity.delete_impact(t, keys))
    assert ("suppliers", 1, "restricted") in got
    assert ("suppliers", 3, "deleted") in got
    assert {r for r in got if r[2] == "set_null"} == {("products", 6, "set_null"), ("products", 7, "set_null")}
    assert ("products", 2, "deleted") in got and ("products", 7, "deleted") in got
    assert {r for r in got if r[0] == "stock_transactions"} == {
        ("stock_transactions", 2, "cascaded"), ("stock_transactions", 9, "cascaded"),
        ("stock_transactions", 7, "cascaded")}
    assert ("purchase_orders", 2, "deleted") in got
    assert {r for r in got if r[0] == "purchase_order_items"} == {
        ("purchase_order_items", 2, "cascaded"), ("purchase_order_items", 3, "cascaded")}


def test_delete_impact_chained(spark, seed):
    t = _tables(seed)
    keys = {"products": spark.createDataFrame([(7,)], "id long"),
            "purchase_orders": spark.createDataFrame([(3,)], "id long")}
    # judged against the tables as given, item 4 (order 3) still references product 7
    assert ("products", 7, "restricted") in rows(integrity.delete_impact(t, keys))
    # chained: order 3 goes first and cascades item 4, so product 7 can be deleted
    got = rows(integrity.delete_impact(t, keys, chained=True))
    assert ("products", 7, "deleted") in got and ("purchase_order_items", 4, "cascaded") in got
    assert ("stock_transactions", 7, "cascaded") in got
