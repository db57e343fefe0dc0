"""Purchase orders: creation (tests 6A/6B), item guard (test 7), transitions,
receipts and audits."""

from __future__ import annotations

from decimal import Decimal

import pytest

from larder.operators import orders
from larder.operators.audit import order_audit
from tests.conftest import NOW, SEED_STOCK, days, rows

AS_OF = NOW


def _requests(spark, headers, items):
    h = spark.createDataFrame(headers, "request_id long, supplier_id long, expected_date timestamp")
    i = spark.createDataFrame(items, "request_id long, line int, product_id long, quantity int, "
                                     "unit_price decimal(12,2)")
    return h, i


def test_create_valid_order_and_refuse_negative_item(spark, seed):
    h, i = _requests(
        spark,
        [(4, 2, days(3)), (5, 2, None)],
        [(4, 1, 5, 2, Decimal("12.00")), (5, 1, 4, 1, Decimal("6.50")), (5, 2, 5, -5, Decimal("12.00"))])
    new_orders, new_items, rejects = orders.create_orders(h, i, seed["products"], seed["suppliers"], AS_OF)
    got = new_orders.collect()
    assert [(r["id"], r["status"], r["total_amount"]) for r in got] == [(4, "PENDING", Decimal("24.00"))]
    assert rows(new_items, "order_id", "product_id", "received_quantity") == [(4, 5, 0)]
    assert rows(rejects) == [(5, "check")]


def test_create_fills_unit_price_and_reasons(spark, seed):
    h, i = _requests(
        spark,
        [(10, 1, None), (11, 1, None), (12, 99, None), (13, 0, None), (14, 1, None), (15, 1, None)],
        [(10, 1, 1, 2, None),                     # price taken from product: 2 x 1200
         (11, 1, 1, 0, Decimal("1.00")),          # quantity 0 is a missing field
         (12, 1, 1, 1, Decimal("1.00")),          # unknown supplier
         (13, 1, 1, 1, Decimal("1.00")),          # supplier 0 is missing
         (14, 1, 77, 1, Decimal("1.00")),         # unknown product
         (14, 2, 1, 1, Decimal("1.00"))])         # 15 has no items
    new_orders, _, rejects = orders.create_orders(h, i, seed["products"], seed["suppliers"], AS_OF)
    assert [(r["id"], r["total_amount"]) for r in new_orders.collect()] == [(10, Decimal("2400.00"))]
    assert rows(rejects) == [(11, "missing_field"), (12, "no_supplier"), (13, "missing_field"),
                             (14, "no_product"), (15, "missing_field")]


def test_item_guard(spark, seed):
    cand = spark.createDataFrame(
        [(1, 1, 1, Decimal("1.00"), 0), (2, 3, 1, Decimal("1.00"), 0), (2, 3, -1, Decimal("1.00"), 0),
         (42, 3, 1, Decimal("1.00"), 0), (2, 77, 1, Decimal("1.00"), 0)],
        "order_id long, product_id long, quantity int, unit_price decimal(12,2), received_quantity int")
    got = rows(orders.item_guard(cand, seed["orders"], seed["products"]))
    assert got == [(1, 1, False, "not_pending"), (2, 3, False, "check"), (2, 3, True, None),
                   (2, 77, False, "no_product"), (42, 3, False, "no_order")]


def test_order_totals(seed):
    got = rows(orders.order_totals(seed["orders"], seed["items"]))
    assert got == [(1, 2400.0, 2400.0, 0.0), (2, 195.0, 185.0, 10.0), (3, 1280.0, 1280.0, 0.0)]


def test_transitions_receipt_and_audit(spark, seed):
    req = spark.createDataFrame(
        [(2, 1, "SHIPPED"), (2, 2, "PENDING"), (2, 3, "DELIVERED"), (2, 4, "CANCELLED"),
         (3, 1, "BOGUS"), (3, 2, "SHIPPED"), (1, 1, "PENDING"), (77, 1, "SHIPPED")],
        "order_id long, seq int, status string")
    out = orders.transition_orders(req, seed["orders"], seed["items"], AS_OF)
    got = rows(out["outcomes"], "order_id", "seq", "old_status", "requested", "outcome")
    assert got == [
        (1, 1, "DELIVERED", "PENDING", "terminal"),
        (2, 1, "PENDING", "SHIPPED", "applied"),
        (2, 2, "SHIPPED", "PENDING", "applied"),
        (2, 3, "PENDING", "DELIVERED", "applied"),
        (2, 4, "DELIVERED", "CANCELLED", "terminal"),
        (3, 1, "SHIPPED", "BOGUS", "invalid_status"),
        (3, 2, "SHIPPED", "SHIPPED", "applied"),
        (77, 1, None, "SHIPPED", "not_found"),
    ]
    new = {r["id"]: r for r in out["orders"].collect()}
    assert new[2]["status"] == "DELIVERED" and new[2]["delivery_date"] == AS_OF
    assert new[3]["status"] == "SHIPPED" and new[3]["delivery_date"] is None
    assert new[1]["delivery_date"] == days(-5)
    assert rows(out["ledger"], "product_id", "transaction_type", "quantity", "reference_id") == [
        (4, "IN", 10, "PO-2"), (5, "IN", 10, "PO-2")]
    assert {r["notes"] for r in out["ledger"].collect()} == {"Received stock from Purchase Order"}
    assert rows(out["items"].filter("order_id = 2"), "received_quantity") == [(10,), (10,)]
    # SHIPPED -> SHIPPED makes no audit row
    assert rows(out["audit"], "record_id", "seq", "old_status", "new_status") == [
        (2, 1, "PENDING", "SHIPPED"), (2, 2, "SHIPPED", "PENDING"), (2, 3, "PENDING", "DELIVERED")]
    snap = order_audit(seed["orders"], out["orders"], AS_OF)
    assert rows(snap, "record_id", "old_status", "new_status", "changed_by") == [
        (2, "PENDING", "DELIVERED", "DB_TRIGGER_ORDERS")]


def test_receipt_rows_pass_the_guard(spark, seed):
    from larder.operators import guard

    req = spark.createDataFrame([(2, 1, "DELIVERED")], "order_id long, seq int, status string")
    out = orders.transition_orders(req, seed["orders"], seed["items"], AS_OF)
    led = out["ledger"].selectExpr("order_id * 1000 + product_id AS id", "product_id", "transaction_type",
                                   "quantity", "reference_id", "notes", "transaction_date")
    opening = spark.createDataFrame([(4, -20), (5, SEED_STOCK[5])], "product_id long, opening_stock long")
    g = rows(guard.guard_ledger(opening, led), "product_id", "accepted", "stock_after", "reference_id")
    assert g == [(4, False, -20, "PO-2"), (5, True, 20, "PO-2")]


def test_order_audit_from_log(spark):
    from larder.operators.audit import order_audit_from_log

    log = spark.createDataFrame([(1, 1, "PENDING"), (1, 2, "SHIPPED"), (1, 3, "SHIPPED"), (1, 4, "DELIVERED")],
                                "order_id long, seq int, status string")
    got = rows(order_audit_from_log(log), "record_id", "seq", "old_status", "new_status")
    assert got == [(1, 2, "PENDING", "SHIPPED"), (1, 4, "SHIPPED", "DELIVERED")]


def test_transitions_with_tiny_chunks_equal_default(spark, seed):
    import random

    rnd = random.Random(11)
    statuses = ["PENDING", "SHIPPED", "DELIVERED", "CANCELLED", "BOGUS"]
    data = [(o, q, rnd.choice(statuses)) for o in (1, 2, 3, 4) for q in range(1, rnd.randint(2, 25))]
    req = spark.createDataFrame(data, "order_id long, seq int, status string")
    a = orders.transition_orders(req, seed["orders"], seed["items"], AS_OF, partitions=5)["outcomes"]
    b = orders.transition_orders(req, seed["orders"], seed["items"], AS_OF)["outcomes"]
    assert rows(a) == rows(b)
    # plain sequential reference
    orig = {1: "DELIVERED", 2: "PENDING", 3: "SHIPPED"}
    want = []
    for o in (1, 2, 3, 4):
        cur = orig.get(o)
        for (_, q, st) in sorted(x for x in data if x[0] == o):
            if st not in ("PENDING", "SHIPPED", "DELIVERED", "CANCELLED"):
                want.append((o, q, cur, st, "invalid_status"))
            elif cur is None:
                want.append((o, q, None, st, "not_found"))
            elif cur in ("DELIVERED", "CANCELLED"):
                want.append((o, q, cur, st, "terminal"))
            else:
                want.append((o, q, cur, st, "applied"))
                cur = st
    assert rows(a, "order_id", "seq", "old_status", "requested", "outcome") == sorted(want)


def test_prefix_scan_matches_windows(spark):
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from larder.operators.prefix import Scan, prefix_scan

    rnd = random.Random(5)
    data = [(k, i, rnd.choice([None, rnd.randint(-9, 9)])) for k in (1, 2) for i in rnd.sample(range(200), 60)]
    df = spark.createDataFrame(data, "k long, o long, v long")
    got = prefix_scan(df, "k", "o", [Scan("s", "sum", F.col("v"), True), Scan("m", "max", F.col("v")),
                                     Scan("l", "last", F.col("v")), Scan("p", "prev", F.col("v"))], partitions=17)
    w = Window.partitionBy("k").orderBy("o")
    want = df.select(
        "k", "o", "v",
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"),
        F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("l"),
        F.lag("v").over(w).alias("p"))
    cols = ["k", "o", "v", "s", "m", "l", "p"]
    g = [tuple(r) for r in got.select(*cols).collect()]
    e = [tuple(r) for r in want.select(*cols).collect()]
    # sum over an all-null prefix is 0 in the chunked form and null in SQL
    norm = lambda rs: sorted((k, o, v, s or 0, m, l, p) for (k, o, v, s, m, l, p) in rs)
    assert norm(g) == norm(e)


def test_prefix_scan_first(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from larder.operators.prefix import Scan, prefix_scan

    data = [(1, i, v) for i, v in enumerate([None, None, 3, None, 5, 1, None, 2, 8, None, 4])]
    df = spark.createDataFrame(data, "k long, o long, v long")
    got = prefix_scan(df, "k", "o", [Scan("f", "first", F.col("v")), Scan("fi", "first", F.col("v"), True)], 4)
    w = Window.partitionBy("k").orderBy("o")
    want = df.select("k", "o", F.first("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("f"),
                     F.first("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("fi"))
    assert rows(got, "k", "o", "f", "fi") == rows(want)


def test_transition_messages(spark, seed):
    req = spark.createDataFrame([(1, 1, "PENDING"), (2, 1, "NOPE"), (99, 1, "SHIPPED")],
                                "order_id long, seq int, status string")
    got = rows(orders.transition_orders(req, seed["orders"], seed["items"], AS_OF)["outcomes"], "order_id", "message")
    assert got == [(1, "Cannot change status of an already delivered order."),
                   (2, "Invalid purchase order status."), (99, "Purchase Order not found.")]


def test_audit_log_round_trip(spark, seed):
    from decimal import Decimal as D

    from pyspark.sql import functions as F

    from larder.operators.audit import audit_log, order_audit, parse_audit_values, product_audit

    new_p = seed["products"].withColumn("price", F.when(F.col("id") == 1, F.lit(D("1250.00"))).otherwise(
        F.col("price")))
    new_o = seed["orders"].withColumn("status", F.when(F.col("id") == 3, "DELIVERED").otherwise(F.col("status")))
    log = audit_log(product_audit(seed["products"], new_p, AS_OF), order_audit(seed["orders"], new_o, AS_OF))
    got = {(r["table_name"], r["record_id"]): r for r in parse_audit_values(log).collect()}
    p = got[("products", 1)]
    assert (p["old_quantity_in_stock"], p["old_price_value"], p["new_price_value"]) == (19, D("1200.00"),
                                                                                      D("1250.00"))
    o = got[("purchase_orders", 3)]
    assert (o["old_status_value"], o["new_status_value"], o["changed_by"]) == ("SHIPPED", "DELIVERED",
                                                                             "DB_TRIGGER_ORDERS")


def test_process_status_batch_write_path(spark, seed):
    req = spark.createDataFrame([(2, 1, "DELIVERED"), (3, 1, "CANCELLED")], "order_id long, seq int, status string")
    # product 5 opens below zero: its receipt of 10 still leaves it negative, so it is refused
    from pyspark.sql import functions as F

    products = seed["products"].withColumn(
        "quantity_in_stock", F.when(F.col("id") == 5, -15).otherwise(F.col("quantity_in_stock")))
    out = orders.process_status_batch(req, seed["orders"], seed["items"], products, 1000, AS_OF)
    assert rows(out["ledger"], "id", "product_id", "quantity", "stock_before", "stock_after") == [
        (1002, 4, 10, 160, 170)]
    assert rows(out["refused"]) == [(2, 5, 10, "negative_stock")]
    stock = dict(rows(out["products"], "id", "quantity_in_stock"))
    assert stock[4] == 170 and stock[5] == -15 and stock[1] == 19
    audit = rows(out["audit"], "table_name", "record_id", "changed_by")
    assert audit == [("products", 4, "DB_TRIGGER_PRODUCTS"), ("purchase_orders", 2, "DB_TRIGGER_ORDERS"),
                     ("purchase_orders", 3, "DB_TRIGGER_ORDERS")]


def test_request_without_order_id_is_not_found(spark, seed):
    req = spark.createDataFrame([(None, 1, "SHIPPED"), (2, 1, "SHIPPED")], "order_id long, seq int, status string")
    got = rows(orders.transition_orders(req, seed["orders"], seed["items"], AS_OF)["outcomes"],
               "seq", "requested", "outcome")
    assert got == [(1, "SHIPPED", "applied"), (1, "SHIPPED", "not_found")]


def test_status_changes_equal_snapshot_audit(spark, seed):
    req = spark.createDataFrame([(2, 1, "SHIPPED"), (2, 2, "PENDING"), (3, 1, "SHIPPED"), (1, 1, "PENDING")],
                                "order_id long, seq int, status string")
    out = orders.transition_orders(req, seed["orders"], seed["items"], AS_OF)
    snap = order_audit(seed["orders"], out["orders"], AS_OF)
    # order 2 went PENDING -> SHIPPED -> PENDING: no net change; order 3 SHIPPED -> SHIPPED: none
    assert rows(out["status_changes"]) == rows(snap, "record_id", "old_status", "new_status") == []


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_prefix_scan_of_hot_sparse_and_null_keys_matches_windows(spark, partitions):
    """A hot key with sparse order values, a cold one and the null key, cut anywhere;
    values of several types, carried whole."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from larder.operators.prefix import Scan, prefix_scan

    rnd = random.Random(9)
    data = [(k, i, rnd.choice([None, rnd.randint(-5, 5)]), rnd.choice([None, "a", "b", "zz"]))
            for k, n in ((1, 240), (2, 4), (None, 17)) for i in rnd.sample(range(10**12), n)]
    df = spark.createDataFrame(data, "k long, o long, v long, t string")
    held = {"f": "first", "l": "last", "p": "prev", "s": "sum", "x": "max", "n": "min"}
    scans = [Scan(f"{n}{c}{int(inc)}", op, F.col(c), inc) for n, op in held.items() for c in "vt" for inc in (False, True)
             if (c == "v" or op in ("first", "last", "prev")) and not (op == "prev" and inc)]
    got = prefix_scan(df, "k", "o", scans, partitions)
    w = Window.partitionBy("k").orderBy("o")
    ops = {"first": lambda c: F.first(c, True), "last": lambda c: F.last(c, True), "sum": lambda c: F.sum(F.coalesce(c, F.lit(0))), "max": F.max, "min": F.min}
    want = df.select("*", *[
        (F.lag(s.out[1]).over(w) if s.op == "prev" else ops[s.op](F.col(s.out[1])).over(w.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1))).alias(s.out)
        for s in scans])
    want = want.fillna(0, [s.out for s in scans if s.op == "sum"])
    assert got.columns == want.columns and got.count() == len(data)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert prefix_scan(df.limit(0), "k", "o", scans, partitions).count() == 0


def test_ranked_parts_are_even_for_a_hot_key_with_sparse_ids(spark):
    """40 % of the rows on one key, ids far apart: no part over 1.5 times the mean."""
    from pyspark.sql import functions as F

    from larder.operators.prefix import PART, ranked

    df = spark.range(200_000).select(
        F.when(F.col("id") % 5 < 2, 7).otherwise(F.col("id") % 1000).alias("k"), (F.col("id") * F.col("id") * 1000).alias("o"))
    sizes = [r["count"] for r in ranked(df, "k", "o", 16).groupBy(PART).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 1.5 * 200_000 / 16


def test_prior_status_keeps_any_status(spark):
    """A log with statuses outside the four names loses no row."""
    from larder.operators import audit

    log = [(1, 10, "PENDING"), (1, 20, "ON_HOLD"), (1, 35, "SHIPPED"), (1, 36, "SHIPPED"), (2, 5, "LOST"), (2, 6, "PENDING"), (3, 1, None), (3, 2, "PENDING"), (3, 9, None), (3, 11, "LOST")]
    df = spark.createDataFrame(log, "order_id long, seq long, status string")
    got = rows(audit.order_audit_from_log(df, partitions=4), "record_id", "seq", "old_status", "new_status")
    assert got == [(1, 20, "PENDING", "ON_HOLD"), (1, 35, "ON_HOLD", "SHIPPED"), (2, 6, "LOST", "PENDING")]


def test_transition_outputs_share_one_judgement(spark, seed):
    """The requests are read once, whatever outputs are used, and the counters come with them."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    req = spark.createDataFrame([(2, 1, "SHIPPED"), (2, 2, "DELIVERED"), (2, 3, "PENDING"), (3, 1, "NOPE"), (9, 1, "SHIPPED")],
                                "order_id long, seq long, status string").mapInArrow(count, "order_id long, seq long, status string")
    out = orders.transition_orders(req, seed["orders"], seed["items"], NOW)
    first = read.value
    for name in ("outcomes", "orders", "items", "ledger", "audit", "status_changes"):
        out[name].collect()
    assert read.value == first
    assert out["counts"] == {"requests": 5, "applied": 2, "terminal": 1, "invalid_status": 1, "not_found": 1}
