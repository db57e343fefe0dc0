"""Ledger fold, guard and reconciliation (reference tests 2, 3, 4 and 8)."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.operators import audit, guard, ledger
from larder.sources import schemas as S
from tests.conftest import NOW, SEED_STOCK, rows


def _ledger(spark, entries, start_id=100):
    data = [(start_id + i, p, t, q, "T", None, NOW) for i, (p, t, q) in enumerate(entries)]
    return spark.createDataFrame(data, S.STOCK_TRANSACTIONS)


def _opening(spark, stock):
    return spark.createDataFrame(list(stock.items()), "product_id long, opening_stock long")


def test_in_and_out_change_stock(spark, seed):
    led = _ledger(spark, [(1, "IN", 10), (1, "OUT", 5)])
    got = dict(rows(ledger.apply_ledger(seed["products"], led)))
    assert got[1] == 24 and got[2] == 40


def test_guard_refuses_out_beyond_stock(spark, seed):
    led = _ledger(spark, [(1, "IN", 10), (1, "OUT", 5), (1, "OUT", 34), (1, "OUT", 4)])
    g = guard.guard_ledger(_opening(spark, SEED_STOCK), led)
    got = rows(g, "id", "accepted", "stock_before", "stock_after", "reason")
    assert got == [(100, True, 19, 29, None), (101, True, 29, 24, None),
                   (102, False, 24, 24, "negative_stock"), (103, True, 24, 20, None)]


def test_adjustment_only_adds(spark):
    led = _ledger(spark, [(1, "ADJUSTMENT", 5), (1, "OUT", 5), (1, "OUT", 1)])
    got = rows(guard.guard_ledger(_opening(spark, {1: 0}), led), "accepted", "stock_after")
    assert got == [(False, 0), (True, 0), (True, 5)]


def test_negative_opening_stock(spark):
    # opening -10: a receipt that still leaves it below 0 is refused too
    led = _ledger(spark, [(1, "OUT", 1), (1, "IN", 4), (1, "IN", 12), (1, "OUT", 3), (1, "OUT", 0)])
    got = rows(guard.guard_ledger(_opening(spark, {1: -10}), led), "id", "accepted", "stock_before", "stock_after")
    assert got == [(100, False, -10, -10), (101, False, -10, -10), (102, True, -10, 2),
                   (103, False, 2, 2), (104, False, None, None)]  # a quantity of 0 breaks a CHECK


def test_unknown_product_is_refused(spark):
    led = _ledger(spark, [(42, "OUT", 1), (42, "IN", 3)])
    got = guard.guard_ledger(_opening(spark, {1: 5}), led).select("accepted", "stock_after", "reason").collect()
    assert [tuple(r) for r in got] == [(False, None, "no_product")] * 2


def _random_ledger(seed_value, n, products=4):
    rnd = random.Random(seed_value)
    entries = []
    for _ in range(n):
        t = rnd.choice(["IN", "OUT", "OUT", "ADJUSTMENT"])
        entries.append((rnd.randint(1, products), t, rnd.randint(1, 30)))
    return entries


@pytest.mark.parametrize("chunk", [1, 17, 60])
def test_guard_paths_equal_plain_fold(spark, chunk):
    entries = _random_ledger(7, 400)
    led = _ledger(spark, entries, start_id=0)
    opening = {1: 0, 2: 25, 3: -40, 4: 5}
    got = guard.guard_ledger(_opening(spark, opening), led, partitions=chunk).toPandas()
    ref = guard.guard_reference(pd.DataFrame(list(opening.items()), columns=["product_id", "opening_stock"]),
                                led.toPandas())
    cols = ["id", "accepted", "stock_before", "stock_after"]
    a = got[cols].sort_values("id").reset_index(drop=True).astype("int64")
    b = ref[cols].sort_values("id").reset_index(drop=True).astype("int64")
    pd.testing.assert_frame_equal(a, b)
    assert (~got.accepted).sum() > 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from(["IN", "OUT", "ADJUSTMENT"]), st.integers(1, 20)),
                min_size=1, max_size=60),
       st.integers(-30, 30), st.sampled_from([1, 4, 12]))
def test_guard_property(spark, entries, open1, chunk):
    led = _ledger(spark, entries, start_id=0)
    opening = {1: open1, 2: 0, 3: 10}
    got = guard.guard_ledger(_opening(spark, opening), led, partitions=chunk).toPandas()
    ref = guard.guard_reference(pd.DataFrame(list(opening.items()), columns=["product_id", "opening_stock"]),
                                led.toPandas())
    cols = ["id", "accepted", "stock_before", "stock_after"]
    a = got[cols].sort_values("id").reset_index(drop=True).astype("int64")
    b = ref[cols].sort_values("id").reset_index(drop=True).astype("int64")
    pd.testing.assert_frame_equal(a, b)


def test_fold_balances_matches_reference():
    import numpy as np

    rnd = random.Random(3)
    for b0 in (-25, 0, 7):
        s = np.array([rnd.choice([-1, 1]) * rnd.randint(0, 15) for _ in range(300)])
        acc, before, after, final = guard.fold_balances(b0, s)
        b = b0
        for i, x in enumerate(s):
            assert before[i] == b
            if b + x >= 0:
                b += x
                assert acc[i]
            else:
                assert not acc[i]
            assert after[i] == b
        assert final == b


@pytest.mark.parametrize("chunk", [1, 5])
def test_running_stock(spark, seed, chunk):
    got = rows(ledger.running_stock(_opening(spark, {}), seed["ledger"], partitions=chunk),
               "id", "stock_before", "stock_after")
    assert got[0] == (1, 0, 20) and got[7] == (8, 20, 17) and got[10] == (11, 17, 19)


def test_reconcile_report_and_fix(spark, seed):
    p = seed["products"].withColumn("quantity_in_stock",
                                    F.when(F.col("id") == 2, 999).otherwise(F.col("quantity_in_stock")))
    rep = {r["product_id"]: r for r in ledger.reconcile_report(p, seed["ledger"]).collect()}
    assert rep[2]["computed_stock"] == 40 and rep[2]["discrepancy"] == -959
    assert rep[2]["status_label"] == "Discrepancy" and rep[2]["discrepancy_text"] == "-959"
    assert rep[1]["status_label"] == "Matched" and rep[1]["discrepancy_text"] == "0"
    summary = ledger.reconcile_summary(p, seed["ledger"]).collect()[0]
    assert summary["has_discrepancy"] and summary["discrepancy_count"] == 1
    report, new_products, audit_rows = ledger.reconcile_fix(p, seed["ledger"])
    fixed = {r["product_id"]: r for r in report.collect()}
    assert fixed[2]["actual_stock"] == 40 and fixed[2]["discrepancy"] == -959 and fixed[2]["reconciled"]
    after = ledger.reconcile_summary(new_products, seed["ledger"]).collect()[0]
    assert not after["has_discrepancy"]
    a = audit_rows.collect()
    assert len(a) == 1 and a[0]["old_quantity"] == 999 and a[0]["new_quantity"] == 40
    assert a[0]["changed_by"] == "DB_TRIGGER_PRODUCTS"


def test_reconcile_fix_blocks_negative(spark, seed):
    led = _ledger(spark, [(3, "OUT", 50)], start_id=0)
    report, new_products, _ = ledger.reconcile_fix(seed["products"], led)
    r = {x["product_id"]: x for x in report.collect()}
    assert r[3]["blocked"] and not r[3]["reconciled"] and r[3]["actual_stock"] == 30
    assert r[1]["reconciled"] and r[1]["actual_stock"] == 0


def test_one_overflowing_product_does_not_abort_the_batch(spark, seed):
    """A stock beyond INT is left as it is and reported; the others are applied or fixed."""
    big = 2**31 - 1
    led = seed["ledger"].unionByName(_ledger(spark, [(3, "IN", big), (3, "IN", 5)]))
    p = seed["products"]
    got = {r["product_id"]: r["quantity_in_stock"] for r in ledger.apply_ledger(p, led).collect()}
    assert got[3] == 30 and got[1] == 19 + 19
    assert rows(ledger.ledger_overflows(p, led)) == [(3, 30 + 30 + big + 5, "overflow")]
    report, new_products, log = ledger.reconcile_fix(p.withColumn("quantity_in_stock", F.lit(0)), led)
    r = {x["product_id"]: x for x in report.collect()}
    assert r[3]["blocked"] and not r[3]["reconciled"] and r[3]["actual_stock"] == 0 and r[1]["reconciled"]
    assert {x["id"]: x["quantity_in_stock"] for x in new_products.collect()}[3] == 0
    assert 3 not in {x["record_id"] for x in log.collect()} and log.count() == 6


def test_incremental_batches_equal_one_batch(spark, seed):
    p0 = seed["products_empty"]
    led = seed["ledger"]
    first, second = led.filter("id <= 5"), led.filter("id > 5")
    p1 = ledger.apply_ledger_products(p0, first)
    p2 = ledger.apply_ledger_products(p1, second)
    assert rows(p2, "id", "quantity_in_stock") == rows(ledger.apply_ledger(p0, led))


def test_product_audit_from_guard(spark, seed):
    led = _ledger(spark, [(1, "IN", 10), (1, "OUT", 500), (2, "OUT", 1)])
    g = guard.guard_ledger(_opening(spark, SEED_STOCK), led)
    a = audit.product_audit_from_guard(g, seed["products"])
    assert rows(a, "record_id", "old_quantity", "new_quantity") == [(1, 19, 29), (2, 40, 39)]


def test_product_audit_snapshot_is_null_unsafe(spark, seed):
    new = seed["products"].withColumn(
        "price", F.when(F.col("id") == 1, F.lit(1250).cast("decimal(12,2)"))
        .when(F.col("id") == 2, F.lit(None).cast("decimal(12,2)")).otherwise(F.col("price")))
    a = audit.product_audit(seed["products"], new).collect()
    assert [(r["record_id"], float(r["old_price"]), float(r["new_price"])) for r in a] == [(1, 1200.0, 1250.0)]
    assert '"price":1250.00' in a[0]["new_values"]


def test_guard_refuses_rows_without_product(spark):
    loose = "id long, product_id long, transaction_type string, quantity int, reference_id string, " \
            "notes string, transaction_date timestamp"
    led = _ledger(spark, [(1, "IN", 3)]).unionByName(
        spark.createDataFrame([(200, None, "IN", 5, "T", None, NOW)], loose))
    got = rows(guard.guard_ledger(_opening(spark, {1: 0}), led), "id", "accepted", "stock_after", "reason")
    assert got == [(100, True, 3, None), (200, False, None, "no_product")]


def test_fold_segments_equals_the_fold_of_each_product():
    import numpy as np

    rng = np.random.default_rng(4)
    for n, products in ((3000, 400), (500, 3), (1, 1)):
        prod = np.sort(rng.integers(0, products, n))
        judged = rng.random(n) < 0.9
        s = np.where(judged, rng.integers(-20, 15, n), 0)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(prod)) + 1))
        b0 = rng.integers(0, 30, len(starts))
        acc, before, after, last = guard.fold_segments(b0, s, judged, starts)
        for k, i in enumerate(starts):
            rows_ = slice(i, starts[k + 1] if k + 1 < len(starts) else n)
            on = judged[rows_]
            a, bef, aft, end = guard.fold_balances(b0[k], s[rows_][on])
            assert (acc[rows_][on] == a).all() and not acc[rows_][~on].any()
            assert (before[rows_][on] == bef).all() and (after[rows_][on] == aft).all() and after[rows_][-1] == end
        assert last == end


def test_hot_product_parallel_path_equals_serial_path(spark):
    """One hot product with many refusals: judged over many parts and in one
    part, and both equal the plain fold."""
    rnd = random.Random(21)
    entries = [(1, rnd.choice(["IN", "OUT", "OUT"]), rnd.randint(1, 12)) for _ in range(300)]
    entries += [(2, "OUT", 1), (2, "IN", 2)]
    led = _ledger(spark, entries, start_id=0)
    opening = {1: 3, 2: 0}
    par = guard.guard_ledger(_opening(spark, opening), led, partitions=19).toPandas()
    ser = guard.guard_ledger(_opening(spark, opening), led, partitions=1).toPandas()
    ref = guard.guard_reference(pd.DataFrame(list(opening.items()), columns=["product_id", "opening_stock"]),
                                led.toPandas())
    cols = ["id", "accepted", "stock_before", "stock_after"]
    a, b, c = (x[cols].sort_values("id").reset_index(drop=True).astype("int64") for x in (par, ser, ref))
    pd.testing.assert_frame_equal(a, c)
    pd.testing.assert_frame_equal(b, c)
    assert (~par.accepted).sum() > 20


def test_transfer_functions_equal_separate_folds():
    import numpy as np

    rng = np.random.default_rng(8)
    for k in range(120):
        n, low, width = int(rng.integers(0, 120)), int(rng.integers(0, 25)), int(rng.integers(1, 60))
        top = 25 if k % 2 else 400
        s, t = rng.integers(-top, top * 4 // 5, n), rng.integers(-top, top, 40)
        f = guard.transfer(s, low, low + width - 1)
        want = [guard.fold_balances(b, s)[3] for b in range(low, low + width)]
        assert [guard.value(f, b) for b in range(low, low + width)] == want
        shift = f[1] - f[0]
        assert (shift[1:] != shift[:-1]).all()  # equal neighbours are one interval
        both = guard.compose(f, guard.transfer(t, min(want), max(want)))
        assert [guard.value(both, b) for b in range(low, low + width)] == [guard.fold_balances(b, t)[3] for b in want]
    with pytest.raises(ValueError):
        guard.value(f, low + width)


def test_transfer_function_of_large_quantities_is_small():
    """10**6 possible start stocks, OUT quantities of 10**6: the intervals follow the rows."""
    import numpy as np

    rng = np.random.default_rng(9)
    s = np.where(rng.random(3000) < 0.6, -rng.integers(1, 10**6, 3000), rng.integers(1, 10**6, 3000))
    f = guard.transfer(s, 0, 10**6)
    assert len(f[0]) < 20_000
    for b in rng.integers(0, 10**6, 40).tolist():
        assert guard.value(f, b) == guard.fold_balances(b, s)[3]
    assert guard.transfer(s, 0, 10**6, max_pieces=50) is None


@pytest.mark.parametrize("pieces", [1 << 20, 3])
def test_hot_product_with_large_quantities(spark, pieces):
    """OUT quantities up to 10**6 on a product of sparse ids, over many parts; with
    ``pieces=3`` most functions are given up and their parts wait for exact starts."""
    rnd = random.Random(77)
    entries = [(1, rnd.choice(["IN", "OUT", "OUT"]), rnd.randint(1, 10**6)) for _ in range(600)]
    entries += [(2, "IN", 5), (2, "OUT", 6), (3, "OUT", 1)] * 10
    led = _ledger(spark, entries, start_id=0).withColumn("id", F.col("id") * F.col("id") * 1000)
    opening = {1: 5 * 10**5, 2: 0, 3: 0}
    got = guard.guard_ledger(_opening(spark, opening), led, partitions=24 if pieces > 9 else 9, fan_in=3, max_pieces=pieces).toPandas()
    ref = guard.guard_reference(pd.DataFrame(list(opening.items()), columns=["product_id", "opening_stock"]), led.toPandas())
    cols = ["id", "accepted", "stock_before", "stock_after"]
    a, b = (x[cols].sort_values("id").reset_index(drop=True).astype("int64") for x in (got, ref))
    pd.testing.assert_frame_equal(a, b)
    assert (~got.accepted).sum() > 50


def test_guard_mixed_rows_over_many_parts(spark):
    """Unjudged rows, waiting rows and judged rows of hot products, cut anywhere."""
    rnd = random.Random(5)
    rws = []
    for i in range(500):
        product = rnd.choice([1, 1, 1, 2, 3, None, 99])
        rws.append((i * 7, product, rnd.choice(["IN", "OUT", "OUT", "TRANSFER"]), rnd.choice([None, -1, 1, 4, 30, 200])))
    df = spark.createDataFrame(rws, "id long, product_id long, transaction_type string, quantity int")
    start = {1: -250, 2: 0, 3: -10**6}
    balance, want = dict(start), {}
    for i, p, kind, q in rws:
        if kind == "TRANSFER" or q is None or q <= 0:
            want[i] = (False, None, None, "check")
        elif p not in balance:
            want[i] = (False, None, None, "no_product")
        else:
            before = balance[p]
            after = before + (q if kind == "IN" else -q)
            ok = after >= 0
            balance[p] = after if ok else before
            want[i] = (ok, before, balance[p], None if ok else "negative_stock")
    for partitions in (1, 7, 40):
        got = guard.guard_ledger(_opening(spark, start), df, partitions=partitions, fan_in=2).collect()
        assert {r["id"]: (r["accepted"], r["stock_before"], r["stock_after"], r["reason"]) for r in got} == want


def test_parallel_path_with_many_compose_groups(spark):
    """Hot products whose chunk tables are composed across many groups of 2."""
    rnd = random.Random(33)
    entries = [(rnd.choice([1, 2]), rnd.choice(["IN", "OUT", "OUT", "ADJUSTMENT"]), rnd.randint(1, 9))
               for _ in range(400)]
    led = _ledger(spark, entries, start_id=0)
    opening = {1: 0, 2: 7}
    got = guard.guard_ledger(_opening(spark, opening), led, partitions=50, fan_in=2).toPandas()
    ref = guard.guard_reference(pd.DataFrame(list(opening.items()), columns=["product_id", "opening_stock"]),
                                led.toPandas())
    cols = ["id", "accepted", "stock_before", "stock_after"]
    a, b = (x[cols].sort_values("id").reset_index(drop=True).astype("int64") for x in (got, ref))
    pd.testing.assert_frame_equal(a, b)
    assert (~got.accepted).sum() > 10


def test_parallel_path_with_negative_opening(spark):
    """A hot product opening far below zero: its refused prefix, the lifting
    row and the chunks after it agree with the plain fold."""
    rnd = random.Random(44)
    entries = [(1, rnd.choice(["IN", "OUT", "IN"]), rnd.randint(1, 10)) for _ in range(250)]
    entries[37] = (1, "IN", 70)          # the first row that lifts the stock to >= 0
    entries += [(1, rnd.choice(["OUT", "OUT", "OUT", "IN"]), rnd.randint(1, 12)) for _ in range(250)]
    led = _ledger(spark, entries, start_id=0)
    opening = {1: -60}
    got = guard.guard_ledger(_opening(spark, opening), led, partitions=60, fan_in=3).toPandas()
    ref = guard.guard_reference(pd.DataFrame(list(opening.items()), columns=["product_id", "opening_stock"]),
                                led.toPandas())
    cols = ["id", "accepted", "stock_before", "stock_after"]
    a, b = (x[cols].sort_values("id").reset_index(drop=True).astype("int64") for x in (got, ref))
    pd.testing.assert_frame_equal(a, b)
    assert (a.stock_before < 0).sum() > 3 and (a.stock_before > 0).sum() > 50
    assert (a.accepted[40:] == 0).sum() >= 1          # refusals after the lift too


def test_parallel_path_lift_chunk_with_refusals(spark):
    """The chunk holding the lifting row also refuses rows after it."""
    rnd = random.Random(45)
    head = [(1, "OUT", 3), (1, "IN", 5), (1, "IN", 70), (1, "OUT", 30), (1, "OUT", 5), (1, "IN", 2),
            (1, "OUT", 9), (1, "OUT", 1)]
    tail = [(1, rnd.choice(["OUT", "OUT", "IN"]), rnd.randint(1, 9)) for _ in range(120)]
    led = _ledger(spark, head + tail, start_id=0)          # ids 0-7 form the first chunk of 8
    opening = {1: -60}
    got = guard.guard_ledger(_opening(spark, opening), led, partitions=16, fan_in=4).toPandas()
    ref = guard.guard_reference(pd.DataFrame(list(opening.items()), columns=["product_id", "opening_stock"]),
                                led.toPandas())
    cols = ["id", "accepted", "stock_before", "stock_after"]
    a, b = (x[cols].sort_values("id").reset_index(drop=True).astype("int64") for x in (got, ref))
    pd.testing.assert_frame_equal(a, b)
    assert list(a.accepted[:5]) == [0, 0, 1, 0, 1]
