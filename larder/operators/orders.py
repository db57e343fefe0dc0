"""Purchase orders: R5 item guard, A7 totals, R6 creation, R7 status
transitions and receipt.

All steps are joins, grouped aggregates and windows over request batches;
no driver-side loop.  Reasons for refusals follow the order in which the
reference would hit them (request validation, BEFORE trigger, CHECK, foreign
key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from larder.functions.columns import order_reference
from larder.operators.prefix import Scan, prefix_scan
from larder.session import checkpoint_dir
from larder.sources.schemas import (
    MSG_INVALID_STATUS,
    MSG_ORDER_NOT_FOUND,
    MSG_TERMINAL_PREFIX,
    MSG_TERMINAL_SUFFIX,
    ORDER_STATUSES,
    RECEIPT_NOTE,
)

TERMINAL = ("DELIVERED", "CANCELLED")
OUTCOMES = ("applied", "terminal", "invalid_status", "not_found")


def _fails(cond) -> F.Column:
    """A CHECK fails only when its predicate is false (null passes)."""
    return F.coalesce(~cond, F.lit(False))


def item_guard(items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """Judge candidate items: allowed only on a PENDING order.

    reason: not_pending (the BEFORE trigger), check (quantity > 0,
    unit_price >= 0, received >= 0; NOT NULL), no_order / no_product (foreign
    keys).  A missing order makes the trigger's subquery null, so the
    trigger passes and the foreign key refuses the row.
    """
    o = orders.select(F.col("id").alias("_oid"), F.col("status").alias("_ostatus"))
    p = products.select(F.col("id").alias("_pid"))
    j = items.join(o, items.order_id == o._oid, "left").join(p, items.product_id == p._pid, "left")
    check = (
        _fails(F.col("quantity") > 0) | F.col("quantity").isNull()
        | _fails(F.col("unit_price") >= 0) | F.col("unit_price").isNull()
        | _fails(F.col("received_quantity") >= 0)
    )
    reason = (
        F.when(F.col("_ostatus").isNotNull() & (F.col("_ostatus") != "PENDING"), "not_pending")
        .when(check, "check")
        .when(F.col("_oid").isNull(), "no_order")
        .when(F.col("_pid").isNull(), "no_product")
    )
    return j.select("order_id", "product_id", reason.isNull().alias("accepted"), reason.alias("reason"))


def order_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Header total against the sum of its items (decimal inside)."""
    it = items.groupBy(F.col("order_id").alias("_oid")).agg(
        F.sum(F.col("quantity") * F.col("unit_price")).alias("_itot"))
    j = orders.join(it, orders.id == it._oid, "left")
    item_total = F.coalesce(F.col("_itot"), F.lit(0))
    return j.select(
        F.col("id").alias("order_id"),
        F.col("total_amount").cast("double").alias("header_total"),
        item_total.cast("double").alias("item_total"),
        (F.col("total_amount") - item_total).cast("double").alias("difference"),
    )


def _falsy_num(c):
    return F.col(c).isNull() | (F.col(c) == 0)


def create_orders(headers: DataFrame, req_items: DataFrame, products: DataFrame, suppliers: DataFrame,
                  as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Create purchase orders from a batch of requests, all or nothing per order.

    headers: (request_id, supplier_id, expected_date); req_items:
    (request_id, line, product_id, quantity, unit_price).  A missing unit
    price takes the product's price (J10).  Returns (orders, items, rejects).
    The order id is the request id.
    """
    p = products.select(F.col("id").alias("_pid"), F.col("price").alias("_pprice"))
    it = req_items.join(p, req_items.product_id == p._pid, "left")
    unit = F.coalesce(F.col("unit_price"), F.col("_pprice"))
    it = it.withColumn("_unit", unit)
    missing = _falsy_num("product_id") | _falsy_num("quantity") | _falsy_num("_unit")
    # first failing item: line * 2 + (0 check | 1 no_product), a number so the
    # grouping stays a hash aggregate (for one line, CHECK fails before the FK)
    bad_code = (F.when((F.col("quantity") < 0) | (F.col("_unit") < 0), 0)
                .when(F.col("_pid").isNull(), 1))
    per_req = it.groupBy(F.col("request_id").alias("_rid")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(missing.cast("int")).alias("_missing"),
        F.min(F.when(~missing, F.col("line").cast("bigint") * 2 + bad_code)).alias("_first_bad"),
        F.sum(F.col("quantity") * F.col("_unit")).alias("_total"),
    )
    s = suppliers.select(F.col("id").alias("_sid"))
    h = headers.join(per_req, headers.request_id == per_req._rid, "left").join(
        s, headers.supplier_id == s._sid, "left")
    reason = (
        F.when(_falsy_num("supplier_id") | (F.coalesce(F.col("_n"), F.lit(0)) == 0), "missing_field")
        .when(F.col("_missing") == 1, "missing_field")
        .when((F.col("_total") < 0) | (F.col("_total").isNotNull() & F.col("_total").try_cast("decimal(12,2)").isNull()), "check")
        .when(F.col("_sid").isNull(), "no_supplier")
        .when(F.col("_first_bad").isNotNull(),
              F.when(F.col("_first_bad") % 2 == 0, "check").otherwise("no_product"))
    )
    h = h.withColumn("_reason", reason)
    rejects = h.filter(F.col("_reason").isNotNull()).select("request_id", F.col("_reason").alias("reason"))
    ok = h.filter(F.col("_reason").isNull())
    ts = as_of if isinstance(as_of, F.Column) else F.lit(as_of).cast("timestamp")
    new_orders = ok.select(
        F.col("request_id").alias("id"), "supplier_id", ts.alias("order_date"), "expected_date",
        F.lit(None).cast("timestamp").alias("delivery_date"),
        F.col("_total").try_cast("decimal(12,2)").alias("total_amount"), F.lit("PENDING").alias("status"),
        ts.alias("created_at"), ts.alias("updated_at"),
    )
    ok_ids = ok.select(F.col("request_id").alias("_okid"))
    new_items = it.join(ok_ids, it.request_id == ok_ids._okid, "left_semi").select(
        F.col("request_id").alias("order_id"), "line", "product_id", "quantity",
        F.col("_unit").cast("decimal(12,2)").alias("unit_price"), F.lit(0).alias("received_quantity"))
    return new_orders, new_items, rejects


def transition_orders(requests: DataFrame, orders: DataFrame, items: DataFrame, as_of,
                      partitions: int | None = None):
    """Apply a batch of status requests (order_id, seq, status).

    ``seq`` orders the requests of one order (integral, unique per order).
    Returns a dict with: outcomes (order_id, seq, old_status, requested,
    outcome), orders (new order rows), items (received quantities set),
    ledger (receipt rows, one IN row per item of each delivered order),
    audit (one row per applied change of status), status_changes (one row
    per order whose status differs after the batch), counts (requests by
    outcome).  The judged requests are checkpointed once and every output is
    read from them; the counters come from the same pass.
    """
    ts = as_of if isinstance(as_of, F.Column) else F.lit(as_of).cast("timestamp")
    r = requests.select("order_id", "seq", F.col("status").alias("requested"))
    valid = F.coalesce(F.col("requested").isin(*ORDER_STATUSES), F.lit(False))
    # The requests applied to an order are its valid requests up to and
    # including the first one that closes it.  So the state before a request
    # needs two running values, computed in one scan by row rank: the first
    # closing request before it and the last valid request before it.
    j = prefix_scan(r, "order_id", "seq", [
        Scan("_first_close", "first", F.when(F.col("requested").isin(*TERMINAL), F.col("requested"))),
        Scan("_last_valid", "last", F.when(valid, F.col("requested"))),
    ], partitions)
    o = orders.select(F.col("id").alias("_oid"), F.col("status").alias("_orig"))
    j = j.join(o, j.order_id == o._oid, "left")
    exists = F.col("_oid").isNotNull()
    orig_closed = F.coalesce(F.col("_orig").isin(*TERMINAL), F.lit(False))
    outcome = (F.when(~valid, "invalid_status").when(~exists, "not_found")
               .when(orig_closed | F.col("_first_close").isNotNull(), "terminal").otherwise("applied"))
    old = F.when(exists, F.when(orig_closed, F.col("_orig")).otherwise(F.coalesce("_first_close", "_last_valid", "_orig")))
    seen = Observation()
    checkpoint_dir(requests.sparkSession)
    j = j.select("order_id", "seq", old.alias("old_status"), "requested", outcome.alias("outcome"), "_orig").observe(
        seen, F.count(F.lit(1)).alias("requests"), *[F.count_if(F.col("outcome") == x).alias(x) for x in OUTCOMES]).checkpoint()
    message = (
        F.when(F.col("outcome") == "invalid_status", F.lit(MSG_INVALID_STATUS))
        .when(F.col("outcome") == "not_found", F.lit(MSG_ORDER_NOT_FOUND))
        .when(F.col("outcome") == "terminal",
              F.concat(F.lit(MSG_TERMINAL_PREFIX), F.lower(F.col("old_status")), F.lit(MSG_TERMINAL_SUFFIX)))
    )
    outcomes = j.select("order_id", "seq", "old_status", "requested", "outcome", message.alias("message"))

    applied = j.filter("outcome = 'applied'")
    final = applied.groupBy(F.col("order_id").alias("_fid")).agg(
        F.max_by("requested", "seq").alias("_final"), F.max("_orig").alias("_from"))
    # R4 per order: the status before the batch against the status after it
    status_changes = final.filter(F.col("_from") != F.col("_final")).select(
        F.col("_fid").alias("record_id"), F.col("_from").alias("old_status"), F.col("_final").alias("new_status"))
    oj = orders.join(final, orders.id == final._fid, "left")
    new_orders = oj.select(*[
        F.coalesce(F.col("_final"), F.col("status")).alias("status") if c == "status"
        else F.when(F.col("_final").isNull(), F.col("delivery_date"))
        .when(F.col("_final") == "DELIVERED", ts).alias("delivery_date") if c == "delivery_date"
        else F.when(F.col("_final").isNotNull(), ts).otherwise(F.col("updated_at")).alias("updated_at")
        if c == "updated_at" else F.col(c)
        for c in orders.columns
    ])

    delivered = applied.filter(F.col("requested") == "DELIVERED").select(F.col("order_id").alias("_did"))
    ij = items.join(delivered, items.order_id == delivered._did, "left")
    new_items = ij.select(*[
        F.when(F.col("_did").isNotNull(), F.col("quantity")).otherwise(F.col("received_quantity"))
        .alias("received_quantity") if c == "received_quantity" else F.col(c)
        for c in items.columns
    ])
    receipts = items.join(delivered, items.order_id == delivered._did, "inner").select(
        "product_id",
        F.lit("IN").alias("transaction_type"),
        "quantity",
        order_reference(F.col("order_id")).alias("reference_id"),
        F.lit(RECEIPT_NOTE).alias("notes"),
        ts.alias("transaction_date"),
        F.col("order_id"),
        F.col("id").alias("item_id"),
    )
    audit = applied.filter(F.col("old_status") != F.col("requested")).select(
        F.col("order_id").alias("record_id"), "seq", "old_status", F.col("requested").alias("new_status"))
    return {"outcomes": outcomes, "orders": new_orders, "items": new_items, "ledger": receipts, "audit": audit,
            "status_changes": status_changes, "counts": seen.get}


def process_status_batch(requests: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame,
                         ledger_id_base: int, as_of) -> dict:
    """The write path of a batch of status requests (R7 -> R2 -> R1, R3, R4).

    Receipt rows of delivered orders get ledger ids ``ledger_id_base + item
    id`` (item order), are judged by the guard against current stock, and
    the accepted ones move the stock.  Returns the transition outputs plus
    ``ledger`` (accepted receipt rows), ``refused`` (receipt rows the guard
    refused, with their order), ``products`` (new stock) and ``audit`` (the
    audit-log rows for products and orders).
    """
    from larder.operators.audit import audit_log, order_audit_rows, product_audit_from_guard
    from larder.operators.guard import guard_ledger
    from larder.operators.ledger import apply_ledger_products

    out = transition_orders(requests, orders, items, as_of)
    receipts = out["ledger"].withColumn("id", (F.lit(ledger_id_base) + F.col("item_id")).cast("bigint"))
    opening = products.select(F.col("id").alias("product_id"), F.col("quantity_in_stock").alias("opening_stock"))
    guarded = guard_ledger(opening, receipts)
    accepted = guarded.filter(F.col("accepted"))
    new_products = apply_ledger_products(products, accepted)
    audit = audit_log(product_audit_from_guard(guarded, products, as_of), order_audit_rows(out["audit"], as_of))
    return {
        **out,
        "ledger": accepted.drop("accepted", "reason"),
        "refused": guarded.filter(~F.col("accepted")).select("order_id", "product_id", "quantity", "reason"),
        "products": new_products,
        "audit": audit,
    }
