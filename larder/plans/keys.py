"""Named queries over a data directory: ``REGISTRY[key](spark, sf_dir) -> DataFrame``.

Each key lays the inventory model over the raw tables (``sources.model``),
derives its request batch from them where it needs one (``sources.requests``)
and runs one library operator.  Results leave through ``boundary``: money as
DOUBLE (summed as decimal inside), timestamps as wall-clock TIMESTAMP_NTZ.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.columns import signed_quantity
from larder.operators import audit, catalog, dashboard, guard, integrity, ledger, listings, orders, views
from larder.session import ship_package
from larder.sources import model, sinks, tables
from larder.sources import requests as R
from larder.sources.model import Model
from larder.sources.schemas import ORDER_AUDIT_ACTOR, TRANSACTION_TYPES
from larder.streaming.ledger_stream import scratch_path

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _run(fn, spark: SparkSession, sf_dir: str) -> DataFrame:
    # Raw timestamps are zone-less; the model's day arithmetic and lead
    # times are defined in UTC, whatever zone the caller's session uses.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return boundary(fn(Model(spark, sf_dir)))


def key(name: str):
    def deco(fn):
        REGISTRY[name] = lambda spark, sf_dir: _run(fn, spark, sf_dir)
        REGISTRY[name].__name__ = name
        REGISTRY[name].__doc__ = fn.__doc__
        return fn

    return deco


def boundary(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# -- views and dashboard ------------------------------------------------------

@key("stock_valuation")
def _stock_valuation(m: Model) -> DataFrame:
    return views.stock_valuation(m.products)


@key("low_stock_alerts")
def _low_stock_alerts(m: Model) -> DataFrame:
    return views.low_stock_alerts(m.products, m.suppliers)


@key("supplier_performance")
def _supplier_performance(m: Model) -> DataFrame:
    return views.supplier_performance(m.suppliers, m.purchase_orders)


@key("supplier_rating")
def _supplier_rating(m: Model) -> DataFrame:
    return views.supplier_rating(m.suppliers, m.purchase_orders)


@key("dashboard_kpis")
def _dashboard_kpis(m: Model) -> DataFrame:
    return dashboard.dashboard_kpis(m.products, m.suppliers, m.purchase_orders)


@key("valuation_share")
def _valuation_share(m: Model) -> DataFrame:
    return views.valuation_share(m.products)


# -- listings and top-k -------------------------------------------------------

@key("product_listing")
def _product_listing(m: Model) -> DataFrame:
    return listings.product_listing(m.products, m.suppliers)


@key("supplier_directory")
def _supplier_directory(m: Model) -> DataFrame:
    return listings.supplier_directory(m.suppliers)


@key("order_listing")
def _order_listing(m: Model) -> DataFrame:
    return listings.order_listing(m.purchase_orders, m.suppliers)


@key("order_items_enriched")
def _order_items_enriched(m: Model) -> DataFrame:
    return listings.order_items_enriched(m.items, m.products)


@key("orders_nested")
def _orders_nested(m: Model) -> DataFrame:
    """The nested order listing, one row per order, read back as a digest of its
    items (count, quantity, sku range)."""
    return listings.nested_digest(listings.orders_nested(m.purchase_orders, m.suppliers, m.items, m.products))


@key("ledger_listing")
def _ledger_listing(m: Model) -> DataFrame:
    return listings.ledger_listing(m.ledger, m.products)


@key("recent_movements")
def _recent_movements(m: Model) -> DataFrame:
    return listings.recent_movements(m.ledger, m.products, 5)


@key("low_stock_top")
def _low_stock_top(m: Model) -> DataFrame:
    return listings.low_stock_top(m.products, m.suppliers, 4)


@key("lookup_by_keys")
def _lookup_by_keys(m: Model) -> DataFrame:
    """Products referenced by the items of pending orders."""
    pending = m.purchase_orders.filter(F.col("status") == "PENDING").select(F.col("id").alias("_oid"))
    items = m.items
    wanted = items.join(pending, items.order_id == pending._oid, "left_semi")
    return listings.lookup_by_keys(m.products, wanted, key="id", keys_col="product_id")


@key("adhoc_category_filter")
def _adhoc_category_filter(m: Model) -> DataFrame:
    return listings.adhoc_category_filter(m.spark, m.products, "PROMO")


# -- ledger -------------------------------------------------------------------

@key("ledger_stock")
def _ledger_stock(m: Model) -> DataFrame:
    """Signed sum per product over the bulk (line-item) ledger."""
    return ledger.ledger_stock(m.ledger_bulk)


@key("ledger_running_stock")
def _ledger_running_stock(m: Model) -> DataFrame:
    return ledger.running_stock(m.opening_zero(), m.ledger)


@key("apply_ledger")
def _apply_ledger(m: Model) -> DataFrame:
    return ledger.apply_ledger(m.products, m.ledger)


@key("ledger_guard")
def _ledger_guard(m: Model) -> DataFrame:
    g = guard.guard_ledger(m.opening_zero(), m.ledger.select("id", "product_id", "transaction_type", "quantity"))
    return g.select("id", "product_id", "transaction_type", "quantity", "accepted",
                    "stock_before", "stock_after", "reason")


@key("reconcile_report")
def _reconcile_report(m: Model) -> DataFrame:
    return ledger.reconcile_report(m.products_synced, m.ledger_bulk)


@key("reconcile_summary")
def _reconcile_summary(m: Model) -> DataFrame:
    return ledger.reconcile_summary(m.products_synced, m.ledger_bulk)


@key("reconcile_fix")
def _reconcile_fix(m: Model) -> DataFrame:
    report, _products, _audit = ledger.reconcile_fix(m.products_synced, m.ledger_bulk)
    return report


# -- orders -------------------------------------------------------------------

@key("item_guard")
def _item_guard(m: Model) -> DataFrame:
    return orders.item_guard(R.item_candidates(m.raw("lineitem")), m.purchase_orders, m.products)


@key("order_totals")
def _order_totals(m: Model) -> DataFrame:
    return orders.order_totals(m.purchase_orders, m.items)


@key("order_create")
def _order_create(m: Model) -> DataFrame:
    headers, items = R.order_requests(m.raw("orders"), m.raw("lineitem"), m.raw("supplier"))
    new_orders, _items, _rejects = orders.create_orders(headers, items, m.products, m.suppliers, R.AS_OF)
    return new_orders.select("id", "supplier_id", "order_date", "expected_date", "total_amount", "status")


def _create(m: Model):
    headers, items = R.order_requests(m.raw("orders"), m.raw("lineitem"), m.raw("supplier"))
    return orders.create_orders(headers, items, m.products, m.suppliers, R.AS_OF)


@key("order_create_items")
def _order_create_items(m: Model) -> DataFrame:
    return _create(m)[1]


@key("order_create_rejects")
def _order_create_rejects(m: Model) -> DataFrame:
    return _create(m)[2]


def _transition(m: Model) -> dict:
    return orders.transition_orders(R.status_requests(m.raw("orders")), m.purchase_orders, m.items, R.AS_OF)


@key("order_transition")
def _order_transition(m: Model) -> DataFrame:
    return _transition(m)["outcomes"]


@key("order_receipt_ledger")
def _order_receipt_ledger(m: Model) -> DataFrame:
    return _transition(m)["ledger"].select("product_id", "transaction_type", "quantity", "reference_id", "notes")


@key("order_audit")
def _order_audit(m: Model) -> DataFrame:
    """One row per applied change of status."""
    return _transition(m)["audit"].withColumn("changed_by", F.lit(ORDER_AUDIT_ACTOR))


@key("order_transition_orders")
def _order_transition_orders(m: Model) -> DataFrame:
    return _transition(m)["orders"].select(
        "id", "supplier_id", "order_date", "expected_date", "delivery_date", "total_amount", "status")


@key("order_transition_items")
def _order_transition_items(m: Model) -> DataFrame:
    return _transition(m)["items"].select("order_id", "product_id", "quantity", "received_quantity")


# -- catalogue ----------------------------------------------------------------

@key("product_patch")
def _product_patch(m: Model) -> DataFrame:
    outcome, _new, _audit = catalog.patch_products(m.products, R.product_patches(m.raw("part")), m.suppliers)
    return outcome


@key("product_patch_products")
def _product_patch_products(m: Model) -> DataFrame:
    """The product table after the patches."""
    _outcome, new, _audit = catalog.patch_products(m.products, R.product_patches(m.raw("part")), m.suppliers)
    return new.select("id", "sku", "price", "reorder_level", "status")


@key("product_audit")
def _product_audit(m: Model) -> DataFrame:
    return catalog.patch_audit(m.products, R.product_patches(m.raw("part")), m.suppliers)


@key("ingest_requests")
def _ingest_requests(m: Model) -> DataFrame:
    accepted, _rejects = catalog.ingest(R.ledger_request_bodies(m.raw("events")), "ledger")
    return accepted


@key("product_create")
def _product_create(m: Model) -> DataFrame:
    new, _rejects = catalog.create_products(R.product_requests(m.raw("part")), m.products, m.suppliers, R.AS_OF)
    return new


@key("supplier_create")
def _supplier_create(m: Model) -> DataFrame:
    new, _rejects = catalog.create_suppliers(R.supplier_requests(m.raw("customer")), m.suppliers, R.AS_OF)
    return new


@key("product_create_rejects")
def _product_create_rejects(m: Model) -> DataFrame:
    return catalog.create_products(R.product_requests(m.raw("part")), m.products, m.suppliers, R.AS_OF)[1]


@key("supplier_create_rejects")
def _supplier_create_rejects(m: Model) -> DataFrame:
    return catalog.create_suppliers(R.supplier_requests(m.raw("customer")), m.suppliers, R.AS_OF)[1]


@key("reconcile_fix_products")
def _reconcile_fix_products(m: Model) -> DataFrame:
    _report, products, _audit = ledger.reconcile_fix(m.products_synced, m.ledger_bulk)
    return products.select("id", "sku", "quantity_in_stock", "price")


@key("reconcile_fix_audit")
def _reconcile_fix_audit(m: Model) -> DataFrame:
    """The audit rows of the fix, with their JSON text."""
    _report, _products, log = ledger.reconcile_fix(m.products_synced, m.ledger_bulk)
    return log.select("table_name", "action_type", "record_id", "old_values", "new_values", "changed_by")


# -- audit log ----------------------------------------------------------------

@key("order_prior_status")
def _order_prior_status(m: Model) -> DataFrame:
    """Each change of status in a log with a status outside the four names."""
    return audit.order_audit_from_log(model.status_log(m.raw("events")))


@key("product_audit_json")
def _product_audit_json(m: Model) -> DataFrame:
    """F8: the audit rows of the patches as stored, old and new values as JSON text."""
    log = catalog.patch_products(m.products, R.product_patches(m.raw("part")), m.suppliers, R.AS_OF)[2]
    return audit.audit_log(log)


@key("audit_values_parsed")
def _audit_values_parsed(m: Model) -> DataFrame:
    """product and order audit rows read back from their JSON text."""
    products = catalog.patch_products(m.products, R.product_patches(m.raw("part")), m.suppliers, R.AS_OF)[2]
    log = audit.audit_log(products, audit.order_audit_rows(_transition(m)["audit"], R.AS_OF))
    return audit.parse_audit_values(log).drop("old_values", "new_values", "changed_at")


@key("audit_log_listing")
def _audit_log_listing(m: Model) -> DataFrame:
    """The audit log by id, newest first."""
    return listings.audit_listing(m.audit_log)


# -- sinks, stored tables, SQL --------------------------------------------------

@key("ledger_append")
def _ledger_append(m: Model) -> DataFrame:
    """S3: three batches appended, one of them twice, and the table read back."""
    path = scratch_path(m.spark, "ledger-append")
    rows = m.ledger.select("id", "product_id", "transaction_type", "quantity")
    for batch_id, kind in enumerate([*TRANSACTION_TYPES, TRANSACTION_TYPES[0]]):
        sinks.append_batch(rows.filter(F.col("transaction_type") == kind), path, batch_id % 3)
    return sinks.read_batches(m.spark, path)


@key("orders_json")
def _orders_json(m: Model) -> DataFrame:
    """The nested orders written as (compressed) JSON lines and read back as a digest."""
    nested = listings.orders_nested(m.purchase_orders, m.suppliers, m.items, m.products)
    path = scratch_path(m.spark, "orders-json")
    sinks.emit_json(nested, path, compression="gzip")
    return listings.nested_digest(m.spark.read.schema(nested.schema).json(path))


@key("bucketed_ledger")
def _bucketed_ledger(m: Model) -> DataFrame:
    """Products and ledger stored in buckets, then listing join and fold without a shuffle."""
    name = f"larder_{uuid.uuid4().hex[:12]}_"
    tables.save_bucketed({"products": m.products, "stock_transactions": m.ledger}, scratch_path(m.spark, "bucketed"), 8, name)
    t = tables.load_bucketed(m.spark, ["products", "stock_transactions"], name)
    rows = listings.ledger_listing(t["stock_transactions"], t["products"], ordered=False)
    return rows.groupBy("product_id", "product_sku").agg(
        F.count(F.lit(1)).alias("movements"), F.sum(signed_quantity()).cast("bigint").alias("stock"))


def _sql_view(m: Model, name: str) -> DataFrame:
    listings.register_views(m.spark, {"products": m.products, "suppliers": m.suppliers, "purchase_orders": m.purchase_orders})
    return listings.adhoc_query(m.spark, f"SELECT * FROM {name}")


@key("sql_stock_valuation")
def _sql_stock_valuation(m: Model) -> DataFrame:
    """A view by its name in SQL."""
    return _sql_view(m, "v_stock_valuation")


@key("sql_low_stock_alerts")
def _sql_low_stock_alerts(m: Model) -> DataFrame:
    return _sql_view(m, "v_low_stock_alerts")


@key("sql_supplier_performance")
def _sql_supplier_performance(m: Model) -> DataFrame:
    return _sql_view(m, "v_supplier_performance")


# -- integrity ----------------------------------------------------------------

def _tables(m: Model, products=None, ledger_df=None) -> dict[str, DataFrame]:
    return {
        "suppliers": m.suppliers,
        "products": products if products is not None else m.products,
        "purchase_orders": m.purchase_orders,
        "purchase_order_items": m.items,
        "stock_transactions": ledger_df if ledger_df is not None else m.ledger,
    }


@key("check_violations")
def _check_violations(m: Model) -> DataFrame:
    return integrity.check_violations(_tables(m, products=m.products_faulty))


@key("unique_violations")
def _unique_violations(m: Model) -> DataFrame:
    return integrity.unique_violations({"suppliers": m.suppliers, "products": m.products_faulty})


@key("fk_violations")
def _fk_violations(m: Model) -> DataFrame:
    return integrity.fk_violations(_tables(m, ledger_df=m.ledger_faulty))


@key("delete_impact")
def _delete_impact(m: Model) -> DataFrame:
    """Deleting inactive suppliers, inactive products and cancelled orders."""
    t = _tables(m)
    return integrity.delete_impact(t, _delete_keys(t))


def _delete_keys(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "suppliers": t["suppliers"].filter(F.col("status") == "Inactive").select("id"),
        "products": t["products"].filter(F.col("status") == "Inactive").select("id"),
        "purchase_orders": t["purchase_orders"].filter(F.col("status") == "CANCELLED").select("id"),
    }


@key("check_violations_all")
def _check_violations_all(m: Model) -> DataFrame:
    """C1 over six tables in which every CHECK is broken, the audit log among them."""
    return integrity.check_violations(m.faulty_tables)


@key("unique_violations_all")
def _unique_violations_all(m: Model) -> DataFrame:
    """C2 with the e-mail of many suppliers in common."""
    t = m.faulty_tables
    return integrity.unique_violations({"suppliers": t["suppliers"], "products": m.products_faulty})


@key("fk_violations_all")
def _fk_violations_all(m: Model) -> DataFrame:
    """C3 with dangling references in all five foreign keys."""
    return integrity.fk_violations(m.faulty_tables)


@key("delete_impact_chained")
def _delete_impact_chained(m: Model) -> DataFrame:
    """C4, one delete after the other: cancelled orders, then inactive products and suppliers."""
    t = _tables(m)
    return integrity.delete_impact(t, _delete_keys(t), chained=True)


@key("fd_check")
def _fd_check(m: Model) -> DataFrame:
    pf = m.products_faulty
    return integrity.fd_check([
        ("products", pf, ["sku"], ["name", "category", "price"]),
        ("products", pf, ["id"], ["sku", "name", "category", "price", "supplier_id"]),
        ("suppliers", m.suppliers, ["email"], ["name"]),
        ("products", pf, ["name"], ["category"]),
    ])


# -- streaming (run to completion with availableNow) ----------------------------

@key("stream_stock")
def _stream_stock(m: Model) -> DataFrame:
    """ST1: live stock per product from the events ledger read as a stream."""
    from larder.streaming import ledger_stream as S

    out = S.run_live_stock(m.spark, S.ledger_stream(m.spark, S.events_path(m.sf_dir)))
    return S.latest_stock(m.spark, out)


@key("stream_guard")
def _stream_guard(m: Model) -> DataFrame:
    """ST2: the guard with per-product state in id order, over the events stream."""
    from larder.streaming import ledger_stream as S

    stream = S.ledger_stream(m.spark, S.events_path(m.sf_dir))
    return m.spark.read.parquet(S.run_closed(m.spark, stream, lambda t: S.ordered_guard(t, m.opening_zero()), "stream-guard"))


@key("stream_low_stock")
def _stream_low_stock(m: Model) -> DataFrame:
    """ST3: alerts from the live stock stream joined to the products per micro-batch."""
    from larder.streaming import ledger_stream as S

    out = S.run_low_stock_alerts(m.spark, S.ledger_stream(m.spark, S.events_path(m.sf_dir)), m.products)
    return m.spark.read.parquet(out).select("product_id", "sku", "product_name", "balance", "reorder_level",
                                            "recommended_order_qty")


@key("stream_audit")
def _stream_audit(m: Model) -> DataFrame:
    """ST4: product audit rows from the accepted rows of the streaming guard."""
    from larder.streaming import ledger_stream as S

    def audit(t):                                    # stream-static join, still one streaming query
        return S.audit_rows(S.ordered_guard(t, m.opening_zero()), m.products)

    out = S.run_closed(m.spark, S.ledger_stream(m.spark, S.events_path(m.sf_dir)), audit, "stream-audit")
    return m.spark.read.parquet(out).select("record_id", "old_quantity", "new_quantity", "old_price",
                                            "new_price", "changed_by")
