"""Catalogue writes: patches (test 5), new products and suppliers, JSON ingest, defaults."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from larder.operators import catalog
from tests.conftest import NOW, rows


def _patches(spark, data):
    return spark.createDataFrame(data, "id long, name string, description string, category string, "
                                       "price decimal(12,2), reorder_level int, supplier_id long, status string")


def test_patch_price_writes_audit(spark, seed):
    p = _patches(spark, [(1, None, None, None, Decimal("1250.00"), None, None, None),
                         (2, "New name", None, None, None, None, None, "Inactive"),
                         (3, None, None, None, Decimal("-1.00"), None, None, None),
                         (4, None, None, None, None, None, 99, None),
                         (77, "ghost", None, None, None, None, None, None)])
    outcome, new_products, audit = catalog.patch_products(seed["products"], p, seed["suppliers"], NOW)
    got = {r["product_id"]: r for r in outcome.collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1]["price"] == Decimal("1250.00") and not got[1]["refused"]
    assert got[2]["name"] == "New name" and got[2]["status"] == "Inactive" and got[2]["category"] == "Electronics"
    assert got[3]["refused"] and got[3]["reason"] == "check" and got[3]["price"] == Decimal("99.00")
    assert got[4]["refused"] and got[4]["reason"] == "no_supplier"
    a = audit.collect()
    assert [(r["record_id"], r["old_price"], r["new_price"]) for r in a] == [(1, Decimal("1200.00"),
                                                                              Decimal("1250.00"))]
    assert rows(catalog.patch_audit(seed["products"], p, seed["suppliers"]), "record_id") == [(1,)]
    np_ = {r["id"]: r for r in new_products.collect()}
    assert np_[1]["price"] == Decimal("1250.00") and np_[3]["price"] == Decimal("99.00")


def test_patch_refused_on_negative_stock(spark, seed):
    p = seed["products"].withColumn("quantity_in_stock",
                                    F.when(F.col("id") == 1, -3).otherwise(F.col("quantity_in_stock")))
    outcome, _, _ = catalog.patch_products(
        p, _patches(spark, [(1, None, None, None, Decimal("5.00"), None, None, None)]), seed["suppliers"])
    assert rows(outcome, "product_id", "refused", "reason") == [(1, True, "negative_stock")]


def test_create_products(spark, seed):
    req = spark.createDataFrame(
        [(100, " elec-new-1 ", "A", None, "Electronics", Decimal("10.00"), None, 1),
         (101, "ELEC-NEW-1", "B", None, "Electronics", Decimal("11.00"), 5, 1),
         (102, "ELEC-LAP-001", "C", None, "Electronics", Decimal("1.00"), None, None),
         (103, "x-1", None, None, "Electronics", Decimal("1.00"), None, None),
         (104, "x-2", "D", None, "Electronics", Decimal("-1.00"), None, None),
         (105, "x-3", "E", None, "Electronics", Decimal("2.00"), 0, 99),
         (106, "x-3", "F", None, "Electronics", Decimal("2.00"), 0, 0)],
        "request_id long, sku string, name string, description string, category string, "
        "price decimal(12,2), reorder_level int, supplier_id long")
    new, rejects = catalog.create_products(req, seed["products"], seed["suppliers"], NOW)
    got = rows(new, "id", "sku", "quantity_in_stock", "reorder_level", "supplier_id", "status")
    assert got == [(100, "ELEC-NEW-1", 0, 0, 1, "Active"), (106, "X-3", 0, 0, None, "Active")]
    assert rows(rejects) == [(101, "duplicate_sku"), (102, "duplicate_sku"), (103, "missing_field"),
                             (104, "check"), (105, "no_supplier")]


def test_create_suppliers(spark, seed):
    req = spark.createDataFrame(
        [(10, "N1", "C", "new@x.com", "1", "A"), (11, "N2", "C", "new@x.com", "2", "B"),
         (12, "N3", "C", "one@example.com", "3", "C"), (13, "N4", "C", "other@x.com", "", "D")],
        "request_id long, name string, contact_name string, email string, phone string, address string")
    new, rejects = catalog.create_suppliers(req, seed["suppliers"], NOW)
    assert rows(new, "id", "email", "status") == [(10, "new@x.com", "Active")]
    assert rows(rejects) == [(11, "duplicate_email"), (12, "duplicate_email"), (13, "missing_field")]


def test_ingest_ledger_requests(spark):
    bodies = spark.createDataFrame(
        [(1, '{"product_id": "3", "transaction_type": "IN", "quantity": "7"}'),
         (2, '{"product_id": 3, "transaction_type": "OUT", "quantity": 2, "notes": "sold"}'),
         (3, '{"product_id": "3", "quantity": "7"}'),
         (4, '{"product_id": "3", "transaction_type": "IN", "quantity": "7abc"}'),
         (5, 'not json'),
         (6, '{"product_id": "0", "transaction_type": "IN", "quantity": "1"}')],
        "request_id long, body string")
    ok, bad = catalog.ingest(bodies, "ledger")
    assert rows(ok) == [(1, 3, "IN", 7, "MANUAL", "Manual stock adjustment"), (2, 3, "OUT", 2, "MANUAL", "sold")]
    assert rows(bad) == [(3, "missing_field"), (4, "bad_number"), (5, "bad_json"), (6, "missing_field")]


def test_ingest_nested_order_request(spark):
    bodies = spark.createDataFrame(
        [(1, '{"supplier_id": "2", "items": [{"product_id": "4", "quantity": "3", "unit_price": "6.5"}]}')],
        "request_id long, body string")
    ok, bad = catalog.ingest(bodies, "order")
    r = ok.collect()[0]
    assert r["supplier_id"] == 2 and r["items"][0]["quantity"] == 3 and bad.count() == 0
    assert r["items"][0]["unit_price"] == Decimal("6.50")


def test_with_defaults(spark):
    df = spark.createDataFrame([(1, "S", "N", "C", Decimal("1.00"))],
                               "id long, sku string, name string, category string, price decimal(12,2)")
    r = catalog.with_defaults(df, "products").collect()[0]
    assert (r["quantity_in_stock"], r["reorder_level"], r["status"]) == (0, 10, "Active")


def test_ingest_coerces_and_feeds_create_operators(spark, seed):
    from larder.operators import orders

    products = spark.createDataFrame(
        [(1, '{"sku": " x-9 ", "name": "N", "category": "C", "price": "12.50", "reorder_level": "4"}'),
         (2, '{"sku": "x-10", "name": "N", "category": "C", "price": "twelve"}')],
        "request_id long, body string")
    ok, bad = catalog.ingest(products, "product")
    assert rows(bad) == [(2, "bad_number")]
    new, rejects = catalog.create_products(ok, seed["products"], seed["suppliers"], NOW)
    assert rows(new, "id", "sku", "price", "reorder_level") == [(1, "X-9", Decimal("12.50"), 4)]
    bodies = spark.createDataFrame(
        [(7, '{"supplier_id": "2", "items": [{"product_id": "4", "quantity": "3", "unit_price": "6.50"},'
             ' {"product_id": "5", "quantity": "1"}]}'),
         (8, '{"supplier_id": "2", "items": [{"product_id": "4", "quantity": "many"}]}')],
        "request_id long, body string")
    ok, bad = catalog.ingest(bodies, "order")
    assert rows(bad) == [(8, "bad_number")]
    headers, items = catalog.order_request_items(ok)
    assert rows(items, "request_id", "line", "product_id", "quantity") == [(7, 1, 4, 3), (7, 2, 5, 1)]
    new_orders, new_items, rejects = orders.create_orders(headers, items, seed["products"], seed["suppliers"], NOW)
    # line 2 takes the product's price (12.00): 3 x 6.50 + 1 x 12.00
    assert [(r["id"], r["total_amount"]) for r in new_orders.collect()] == [(7, Decimal("31.50"))]


def test_many_patches_of_one_product(spark, seed):
    """Running values over a product with many patches, some refused, equal one by one."""
    import random

    rnd = random.Random(12)
    data = [(pid, seq, rnd.choice([None, Decimal(rnd.randint(-3, 99))]), rnd.choice([None, rnd.randint(-1, 9)]), rnd.choice([None, None, "Active", "Inactive", "Gone"]))
            for pid, n in ((1, 150), (2, 2), (3, 1)) for seq in rnd.sample(range(10**9), n)]
    patches = spark.createDataFrame(
        [(i, s, None, None, None, p, r, None, st) for i, s, p, r, st in data],
        "id long, seq long, name string, description string, category string, price decimal(12,2), reorder_level int, supplier_id long, status string")
    stored = {r["id"]: r for r in seed["products"].collect()}
    want, audits, now = {}, [], {i: [r["price"], r["reorder_level"], r["status"]] for i, r in stored.items()}
    for pid, s, price, level, status in sorted(data, key=lambda x: (x[0], x[1])):
        old = stored[pid]
        bad = (price if price is not None else old["price"]) < 0 or (level if level is not None else old["reorder_level"]) < 0 or status == "Gone"
        before = now[pid][0]
        if not bad:
            now[pid] = [x if x is not None else y for x, y in zip((price, level, status), now[pid])]
            if now[pid][0] != before:
                audits.append((pid, before, now[pid][0]))
        want[pid, s] = (*now[pid], bad)
    outcome, new, log = catalog.patch_products(seed["products"], patches, seed["suppliers"], NOW)
    got = {(r["product_id"], r["seq"]): (r["price"], r["reorder_level"], r["status"], r["refused"]) for r in outcome.collect()}
    assert got == want
    assert {r["id"]: [r["price"], r["reorder_level"], r["status"]] for r in new.collect()} == now
    assert sorted((r["record_id"], r["old_price"], r["new_price"]) for r in log.collect()) == sorted(audits)
