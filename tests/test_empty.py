"""Every operator accepts empty inputs (an empty ledger, batch or table) and
returns an empty (or zero) result instead of failing."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import (
    audit,
    catalog,
    dashboard,
    guard,
    integrity,
    ledger,
    listings,
    orders,
    views,
)
from tests.conftest import NOW


def test_operators_on_empty_inputs(spark, seed):
    p, s, o, i, led = seed["products"], seed["suppliers"], seed["orders"], seed["items"], seed["ledger"]
    e_led, e_o, e_i = led.limit(0), o.limit(0), i.limit(0)
    opening = p.select(F.col("id").alias("product_id"), F.col("quantity_in_stock").alias("opening_stock"))

    assert guard.guard_ledger(opening, e_led).count() == 0
    assert ledger.running_stock(opening, e_led).count() == 0
    assert ledger.ledger_stock(e_led).count() == 0
    assert sorted(r[1] for r in ledger.apply_ledger(p, e_led).collect()) == sorted(
        r[0] for r in p.select("quantity_in_stock").collect())
    assert ledger.reconcile_summary(p.limit(0), e_led).collect()[0]["discrepancy_count"] == 0

    empty_req = spark.createDataFrame([], "order_id long, seq int, status string")
    out = orders.transition_orders(empty_req, o, i, NOW)
    assert out["outcomes"].count() == 0 and out["ledger"].count() == 0 and out["orders"].count() == 3
    h = spark.createDataFrame([], "request_id long, supplier_id long, expected_date timestamp")
    it = spark.createDataFrame([], "request_id long, line int, product_id long, quantity int, "
                                   "unit_price decimal(12,2)")
    created = orders.create_orders(h, it, p, s, NOW)
    assert all(x.count() == 0 for x in created)
    assert orders.order_totals(e_o, i).count() == 0
    assert orders.item_guard(e_i, o, p).count() == 0

    assert views.supplier_performance(s, e_o).filter("total_orders > 0").count() == 0
    assert views.valuation_share(p.limit(0)).count() == 0
    assert dashboard.dashboard_kpis(p, s, e_o).collect()[0]["active_po_count"] == 0
    assert listings.orders_digest(e_o, s, i, p).count() == 0
    assert listings.recent_movements(e_led, p).count() == 0

    assert audit.product_audit(p.limit(0), p).count() == 0
    log = spark.createDataFrame([], "order_id long, seq int, status string")
    assert audit.order_audit_from_log(log).count() == 0

    pr = spark.createDataFrame([], "request_id long, sku string, name string, description string, "
                                   "category string, price decimal(12,2), reorder_level int, supplier_id long")
    assert all(x.count() == 0 for x in catalog.create_products(pr, p, s, NOW))
    bodies = spark.createDataFrame([], "request_id long, body string")
    assert all(x.count() == 0 for x in catalog.ingest(bodies, "ledger"))

    tables = {"suppliers": s.limit(0), "products": p.limit(0), "purchase_orders": e_o,
              "purchase_order_items": e_i, "stock_transactions": e_led}
    assert integrity.check_violations(tables).count() == 0
    assert integrity.fk_violations(tables).count() == 0
    assert integrity.unique_violations({"products": p.limit(0), "suppliers": s.limit(0)}).count() == 0
    assert integrity.fd_check([("products", p.limit(0), ["sku"], ["name"])]).collect()[0]["violations"] == 0
