"""The reference's own test script (steps 2-8) replayed through the library,
checked against the goldens "after the reference's tests" (FIXTURES.md part 2)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from larder.operators import audit, catalog, dashboard, guard, ledger, orders, views
from larder.sources import schemas as S
from tests.conftest import NOW, days, make_ledger, make_orders, make_products, rows


def test_reference_script_steps_2_to_8(spark, seed):
    suppliers = seed["suppliers"]
    empty = make_products(spark)                      # seed: every product starts at 0
    opening = empty.select(F.col("id").alias("product_id"), F.col("quantity_in_stock").alias("opening_stock"))

    # steps 2-4: IN 10, OUT 5, then OUT 34 (stock 24) which the guard refuses
    steps = spark.createDataFrame(
        [(12, 1, "IN", 10, "T2", None, NOW), (13, 1, "OUT", 5, "T3", None, NOW),
         (14, 1, "OUT", 34, "T4", None, NOW)], S.STOCK_TRANSACTIONS)
    full = make_ledger(spark).unionByName(steps)
    g = guard.guard_ledger(opening, full)
    assert rows(g.filter("id >= 12"), "id", "accepted", "stock_after") == [(12, True, 29), (13, True, 24),
                                                                            (14, False, 24)]
    accepted = g.filter("accepted")
    stocked = ledger.apply_ledger_products(empty, accepted)
    assert dict(rows(stocked, "id", "quantity_in_stock")) == {1: 24, 2: 40, 3: 30, 4: 160, 5: 10, 6: 500, 7: 15}
    product_audit_rows = audit.product_audit_from_guard(g, empty, NOW)

    # step 5: price 1200 -> 1250 writes an audit row
    patch = spark.createDataFrame([(1, None, None, None, Decimal("1250.00"), None, None, None)],
                                  "id long, name string, description string, category string, "
                                  "price decimal(12,2), reorder_level int, supplier_id long, status string")
    _, patched, patch_audit = catalog.patch_products(stocked, patch, suppliers, NOW)

    # step 6A: order 4 (supplier 2, 2 x product 4 at 12.00) commits; 6B: a -5 item refuses its whole order
    headers = spark.createDataFrame([(4, 2, days(7)), (5, 2, None)],
                                    "request_id long, supplier_id long, expected_date timestamp")
    req_items = spark.createDataFrame(
        [(4, 1, 4, 2, Decimal("12.00")), (5, 1, 4, 1, Decimal("6.50")), (5, 2, 5, -5, Decimal("12.00"))],
        "request_id long, line int, product_id long, quantity int, unit_price decimal(12,2)")
    new_orders, new_items, rejects = orders.create_orders(headers, req_items, patched, suppliers, NOW)
    assert rows(rejects) == [(5, "check")]
    all_orders = make_orders(spark).unionByName(new_orders.select(*make_orders(spark).columns))
    all_items = seed["items"].unionByName(
        new_items.select(F.lit(5).cast("bigint").alias("id"), "order_id", "product_id", "quantity",
                         "unit_price", "received_quantity"))

    # step 7: an item on DELIVERED order 1 is refused
    cand = spark.createDataFrame([(1, 3, 1, Decimal("99.00"), 0)],
                                 "order_id long, product_id long, quantity int, unit_price decimal(12,2), "
                                 "received_quantity int")
    assert rows(orders.item_guard(cand, all_orders, patched), "accepted", "reason") == [(False, "not_pending")]

    # step 8: stock of product 2 set to 999 by hand; reconcile reports -959, the fix aligns it
    broken = patched.withColumn("quantity_in_stock",
                                F.when(F.col("id") == 2, 999).otherwise(F.col("quantity_in_stock")))
    manual_audit = audit.product_audit(patched, broken, NOW)
    rep = {r["product_id"]: r for r in ledger.reconcile_report(broken, accepted).collect()}
    assert rep[2]["discrepancy"] == -959
    report, fixed, fix_audit = ledger.reconcile_fix(broken, accepted)
    assert not ledger.reconcile_summary(fixed, accepted).collect()[0]["has_discrepancy"]

    # goldens after the tests
    assert dict(rows(fixed, "id", "quantity_in_stock")) == {1: 24, 2: 40, 3: 30, 4: 160, 5: 10, 6: 500, 7: 15}
    val = {r["category"]: (r["product_count"], r["total_items"], r["total_valuation"])
           for r in views.stock_valuation(fixed).collect()}
    assert val == {"Electronics": (3, 94, 34770.0), "Office Supplies": (2, 170, 1160.0),
                   "Packaging": (2, 515, 948.0)}
    kpi = dashboard.dashboard_kpis(fixed, suppliers, all_orders).collect()[0]
    assert (kpi["total_products"], kpi["total_items"], kpi["total_valuation"]) == (7, 779, 36878.0)
    assert (kpi["active_po_count"], kpi["supplier_count"]) == (3, 3)
    perf = {r["supplier_id"]: r for r in views.supplier_performance(suppliers, all_orders).collect()}
    assert (perf[2]["total_orders"], perf[2]["total_spend"], perf[2]["avg_lead_time_days"],
            perf[2]["fulfillment_rate"]) == (2, 219.0, None, 0.0)
    assert (perf[1]["total_orders"], perf[1]["avg_lead_time_days"], perf[1]["fulfillment_rate"]) == (1, 5.0, 100.0)
    totals = rows(orders.order_totals(all_orders, all_items))
    assert totals == [(1, 2400.0, 2400.0, 0.0), (2, 195.0, 185.0, 10.0), (3, 1280.0, 1280.0, 0.0),
                      (4, 24.0, 24.0, 0.0)]
    product_log = audit.audit_log(product_audit_rows, patch_audit, manual_audit, fix_audit)
    assert product_log.count() == 16
    seed_status = make_orders(spark).withColumn("status", F.lit("PENDING"))
    assert audit.order_audit(seed_status, make_orders(spark), NOW).count() == 2
