"""Structured Streaming equals the batch operators (ST1 = A8, ST2 = R2),
including over several micro-batches."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from larder.operators import guard, ledger
from larder.sources.model import Model
from larder.streaming import ledger_stream as S
from tests.conftest import rows

SF = "/root/testdata/sf0.001"


def _split_events(spark, parts=4) -> str:
    """Copy the smallest events table into several files (one per id range)
    so that maxFilesPerTrigger=1 makes several micro-batches."""
    out = S.scratch_path(spark, "events-split")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    n = ev.count()
    for i in range(parts):
        lo, hi = i * n // parts, (i + 1) * n // parts
        ev.filter((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.parquet(
            os.path.join(out, f"part{i}"))
    # flatten: the stream source reads files directly under one directory
    flat = S.scratch_path(spark, "events-flat")
    os.makedirs(flat)
    for i in range(parts):
        d = os.path.join(out, f"part{i}")
        for f in sorted(os.listdir(d)):
            if f.endswith(".parquet"):
                os.link(os.path.join(d, f), os.path.join(flat, f"part-{i}.parquet"))
    return flat


def test_live_stock_equals_batch_sum(spark):
    m = Model(spark, SF)
    out = S.run_live_stock(spark, S.ledger_stream(spark, S.events_path(SF)))
    assert rows(S.latest_stock(spark, out)) == rows(ledger.ledger_stock(m.ledger))
    # over several micro-batches the changelog holds only changed products per batch
    src = _split_events(spark, parts=4)
    out = S.run_live_stock(spark, S.ledger_stream(spark, src, max_files_per_trigger=1))
    log = spark.read.parquet(out)
    assert log.select("batch_id").distinct().count() == 4
    assert rows(S.latest_stock(spark, out)) == rows(ledger.ledger_stock(m.ledger))


def test_live_guard_over_micro_batches(spark):
    m = Model(spark, SF)
    src = _split_events(spark)
    stream = S.ledger_stream(spark, src, max_files_per_trigger=1)
    out = S.run_to_parquet(spark, S.live_guard(stream, m.opening_zero()), "guard-mb")
    got = spark.read.parquet(out)
    want = guard.guard_ledger(m.opening_zero(), m.ledger).select(*got.columns)
    assert "reason" in got.columns
    assert got.count() == 1000
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.filter(~F.col("accepted")).count() == 26


def test_low_stock_alerts_and_audit(spark):
    m = Model(spark, SF)
    out = S.run_low_stock_alerts(spark, S.ledger_stream(spark, S.events_path(SF)), m.products)
    alerts = spark.read.parquet(out)
    stock = ledger.apply_ledger(m.products, m.ledger)
    p = m.products.select("id", "reorder_level", "status")
    touched = m.ledger.select(F.col("product_id").alias("_t")).distinct()
    want = (stock.join(p, stock.product_id == p.id).join(touched, F.col("product_id") == F.col("_t"), "left_semi")
            .filter((F.col("quantity_in_stock") <= F.col("reorder_level")) & (F.col("status") == "Active")))
    assert rows(alerts, "product_id") == rows(want, "product_id")
    # with a stock that puts every touched product below its level, all of them alert
    low = m.products.withColumn("quantity_in_stock", F.lit(-100000))
    out2 = S.run_low_stock_alerts(spark, S.ledger_stream(spark, S.events_path(SF)), low)
    assert spark.read.parquet(out2).count() == touched.join(
        m.products.filter("status = 'Active'"), F.col("_t") == F.col("id"), "left_semi").count()
    g = spark.read.parquet(S.run_to_parquet(spark, S.live_guard(S.ledger_stream(spark, S.events_path(SF)), m.opening_zero()), "g"))
    audit = S.audit_rows(g, m.products)
    assert audit.count() == g.filter("accepted AND stock_before <> stock_after").count()


def test_late_lower_ids_are_judged_on_arrival(spark):
    import datetime as dt

    from larder.streaming.ledger_stream import EVENTS_SCHEMA

    d = S.scratch_path(spark, "late-events")
    os.makedirs(d)
    t = dt.datetime(2024, 1, 1)
    # first file: ids 10, 11 (IN 5, OUT 4); second file: id 1 (OUT 3) arrives later
    first = [(10, t, 7, "signup", 5.0, "{}"), (11, t, 7, "purchase", 4.0, "{}")]
    second = [(1, t, 7, "purchase", 3.0, "{}")]
    for i, rws in enumerate([first, second]):
        tmp = S.scratch_path(spark, f"late-{i}")
        spark.createDataFrame(rws, EVENTS_SCHEMA).coalesce(1).write.parquet(tmp)
        f = [x for x in os.listdir(tmp) if x.endswith(".parquet")][0]
        os.link(os.path.join(tmp, f), os.path.join(d, f"events-{i}.parquet"))
    opening = spark.createDataFrame([(7, 0)], "product_id long, opening_stock long")
    out = S.run_to_parquet(spark, S.live_guard(S.ledger_stream(spark, d, max_files_per_trigger=1), opening), "late")
    got = rows(spark.read.parquet(out), "id", "accepted", "stock_before", "stock_after")
    # in id order the OUT 3 would be refused first; on arrival it finds stock 1 and is refused after 10, 11
    assert got == [(1, False, 1, 1), (10, True, 0, 5), (11, True, 5, 1)]


def test_transform_with_state_equals_apply_with_state(spark):
    m = Model(spark, SF)
    src = _split_events(spark, parts=3)
    outs = []
    for api in ("applyInPandasWithState", "transformWithState"):
        stream = S.ledger_stream(spark, src, max_files_per_trigger=1)
        outs.append(spark.read.parquet(S.run_to_parquet(spark, S.live_guard(stream, m.opening_zero(), api=api),
                                                        f"guard-{api}")))
    a, b = outs
    assert a.count() == 1000 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_streaming_audit_over_micro_batches(spark):
    """ST4 as one streaming query (stateful guard, stream-static join, file
    sink) over several micro-batches equals the batch audit of the guard."""
    from larder.operators import audit as A

    m = Model(spark, SF)
    src = _split_events(spark, parts=3)
    stream = S.ledger_stream(spark, src, max_files_per_trigger=1)
    out = S.run_to_parquet(spark, S.audit_rows(S.live_guard(stream, m.opening_zero()), m.products), "st4")
    got = spark.read.parquet(out).select("record_id", "old_quantity", "new_quantity", "old_price", "new_price")
    batch = A.product_audit_from_guard(guard.guard_ledger(m.opening_zero(), m.ledger), m.products).select(
        "record_id", "old_quantity", "new_quantity", "old_price", "new_price")
    assert got.count() > 900
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_streams_resume_and_read_table_folders(spark):
    """A run into the same output goes on after the last batch (ST1, ST2)."""
    import shutil

    m = Model(spark, SF)
    src = _split_events(spark, parts=4)
    grow = S.scratch_path(spark, "events-grow") + "/events.parquet"
    os.makedirs(grow)
    names = sorted(os.listdir(src))
    for i, f in enumerate(names):  # files of one modification time have no order
        os.utime(os.path.join(src, f), (1_700_000_000 + i, 1_700_000_000 + i))
    out, guarded = S.scratch_path(spark, "resume"), S.scratch_path(spark, "resume-guard")
    for part in (names[:2], names[2:]):
        for f in part:
            shutil.copy2(os.path.join(src, f), os.path.join(grow, f))
        S.run_live_stock(spark, S.ledger_stream(spark, grow, max_files_per_trigger=1), out)
        S.run_to_parquet(spark, S.live_guard(S.ledger_stream(spark, grow, max_files_per_trigger=1), m.opening_zero()), "x", guarded)
    assert rows(S.latest_stock(spark, out)) == rows(ledger.ledger_stock(m.ledger))
    got = spark.read.parquet(guarded)
    want = guard.guard_ledger(m.opening_zero(), m.ledger).select(*got.columns)
    assert got.count() == 1000 and got.exceptAll(want).count() == 0


def test_unsound_rows_are_refused_alike_in_batch_and_stream(spark):
    rws = [(1, 1, "IN", 5), (2, 1, "IN", -5), (3, 1, "TRANSFER", 2), (4, 999, "IN", 3), (5, 1, "OUT", None), (6, 1, "OUT", -3),
           (7, 1, "OUT", 9), (8, None, "IN", 1)]
    df = spark.createDataFrame(rws, "id long, product_id long, transaction_type string, quantity int")
    opening = spark.createDataFrame([(1, 2)], "product_id long, opening_stock long")
    want = {1: (True, None), 2: (False, "check"), 3: (False, "check"), 4: (False, "no_product"), 5: (False, "check"), 6: (False, "check"),
            7: (False, "negative_stock"), 8: (False, "no_product")}
    assert {r["id"]: (r["accepted"], r["reason"]) for r in guard.guard_ledger(opening, df).collect()} == want
    src = S.scratch_path(spark, "unsound")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    got = spark.read.parquet(S.run_to_parquet(spark, S.live_guard(stream, opening), "unsound-out"))
    assert {r["id"]: (r["accepted"], r["reason"]) for r in got.collect()} == want


def _shuffled(spark, order, repeat=()) -> str:
    """The split events as files that arrive in another order than their ids; those in ``repeat`` arrive twice."""
    import shutil

    src = _split_events(spark, parts=max(order) + 1)
    out = S.scratch_path(spark, "events-shuffled")
    os.makedirs(out)
    for at, i in enumerate([*order, *repeat]):
        name = os.path.join(out, f"file-{at}.parquet")
        shutil.copy(os.path.join(src, f"part-{i}.parquet"), name)
        os.utime(name, (1_700_000_000 + at, 1_700_000_000 + at))
    return out


def test_ordered_guard_is_independent_of_file_times(spark, monkeypatch):
    """Files in another order than their ids, small ranges: the verdicts of the batch guard, reasons too."""
    m = Model(spark, SF)
    for ids in (64, S.RANGE):
        monkeypatch.setattr(S, "RANGE", ids)
        stream = S.ledger_stream(spark, _shuffled(spark, [2, 0, 3, 1]), max_files_per_trigger=1)
        got = spark.read.parquet(S.run_closed(spark, stream, lambda t: S.ordered_guard(t, m.opening_zero()), "ordered"))
        want = guard.guard_ledger(m.opening_zero(), m.ledger).select(*got.columns)
        assert got.count() == 1000 and got.exceptAll(want).count() == 0


def test_ordered_guard_waits_for_the_watermark(spark):
    """Rows are judged once the watermark has passed their range of ids, not before, and a
    run goes on where the last one ended."""
    m = Model(spark, SF)
    src, out = _shuffled(spark, [0, 1, 2]), S.scratch_path(spark, "waits")
    control = f"{out}-control"

    def run():
        ledger_ = S.closable(spark, S.ledger_stream(spark, src, max_files_per_trigger=1), control)
        S.run_to_parquet(spark, S.ordered_guard(ledger_, m.opening_zero(), displacement=100), "x", out)
        return spark.read.parquet(out).count()

    assert run() == 0  # all ids lie in the first range
    S.close_ledger(spark, control)
    assert run() == 1000


def test_repeated_files_are_audited_once(spark):
    """A file delivered twice, near its first delivery or behind the watermark, adds no verdict and no audit row."""
    from larder.operators import audit as A

    m = Model(spark, SF)
    batch = A.product_audit_from_guard(guard.guard_ledger(m.opening_zero(), m.ledger), m.products)
    columns = ["record_id", "old_quantity", "new_quantity", "old_price", "new_price"]
    want = batch.select(*columns)
    for displacement in (S.DISPLACEMENT, 300):
        src = _shuffled(spark, [0, 1, 2, 3], repeat=[1, 0, 3])
        stream = S.ledger_stream(spark, src, max_files_per_trigger=1)

        def audit(t):
            return S.audit_rows(S.ordered_guard(t, m.opening_zero(), displacement), m.products)

        got = spark.read.parquet(S.run_closed(spark, stream, audit, "audit-once")).select(*columns)
        assert got.count() == want.count() > 900
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_unsound_rows_wait_and_are_refused_too(spark):
    rws = [(1, 1, "IN", 5), (3, 1, "TRANSFER", 2), (2, 1, "IN", -5), (4, 999, "IN", 3), (6, 1, "OUT", -3), (5, 1, "OUT", None), (7, 1, "OUT", 9), (8, None, "IN", 1)]
    df = spark.createDataFrame(rws, "id long, product_id long, transaction_type string, quantity int")
    opening = spark.createDataFrame([(1, 2)], "product_id long, opening_stock long")
    src = S.scratch_path(spark, "unsound-ordered")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    got = spark.read.parquet(S.run_closed(spark, stream, lambda t: S.ordered_guard(t, opening), "unsound-ordered-out"))
    want = guard.guard_ledger(opening, df).select(*got.columns)
    assert got.count() == len(rws) and got.exceptAll(want).count() == 0


def test_state_is_kept_by_range_and_bucket(spark, tmp_path):
    """Many products with few rows each, and rows without a product among them: neither the ids nor the products have a
    state row of their own, and no product loses its id to its neighbours' nulls."""
    n = 3000
    df = spark.range(2 * n).selectExpr("id", f"if(id % 61 = 5, NULL, id % {n}) AS product_id", f"if(id < {n} AND id % 2 = 0, 'IN', 'OUT') AS transaction_type",
                                       "cast(1 + id % 7 AS int) AS quantity")
    opening = spark.range(n).selectExpr("id AS product_id", "2L AS opening_stock")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    got = spark.read.parquet(S.run_closed(spark, stream, lambda t: S.ordered_guard(t, opening), "x", out))
    want = guard.guard_ledger(opening, df).select(*got.columns)
    assert got.count() == 2 * n and got.exceptAll(want).count() == 0
    metadata = spark.read.format("state-metadata").load(f"{out}/_checkpoint")
    assert metadata.where("operatorName LIKE '%dedupe%'").isEmpty()
    buckets = metadata.where("operatorName = 'applyInPandasWithState'").first()["operatorId"]
    assert 0 < spark.read.format("statestore").option("operatorId", buckets).load(f"{out}/_checkpoint").count() <= S.BUCKETS < n


def test_audit_of_many_products_keeps_few_states(spark, tmp_path):
    """ST4 over more products than buckets, a file delivered twice: the audit of the batch guard, and no state row per id or product."""
    from larder.operators import audit as A

    n = 1500
    df = spark.range(2 * n).selectExpr("id", f"id % {n} AS product_id", "if(id % 3 = 0, 'IN', 'OUT') AS transaction_type", "cast(1 + id % 5 AS int) AS quantity")
    products = spark.range(n).selectExpr("id", "cast(id AS decimal(12,2)) AS price")
    opening = products.selectExpr("id AS product_id", "3L AS opening_stock")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    columns = ["record_id", "old_quantity", "new_quantity", "old_price", "new_price"]
    got = spark.read.parquet(S.run_closed(spark, stream, lambda t: S.audit_rows(S.ordered_guard(t, opening), products), "x", out)).select(*columns)
    want = A.product_audit_from_guard(guard.guard_ledger(opening, df), products).select(*columns)
    assert got.count() == want.count() > n and got.exceptAll(want).count() == 0
    states = spark.read.format("state-metadata").load(f"{out}/_checkpoint")
    assert sorted({r["operatorName"] for r in states.collect()}) == ["applyInPandasWithState", "transformWithStateInPandasExec"]


def test_buckets_are_folded_like_single_products():
    """Rows without a product, unknown products, broken CHECKs, stocks below zero and rows that a join doubled, in
    several frames from spilled runs: the verdicts and balances of every product judged alone."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    n, products = 4000, 40
    t = pd.DataFrame({"id": rng.permutation(n), "product_id": rng.integers(0, products, n), "named": rng.random(n) > 0.02,
                      "transaction_type": rng.choice(["IN", "OUT", "OUT", "ADJUSTMENT", "TRANSFER", None], n), "quantity": rng.integers(-1, 30, n).astype(float)})
    t.loc[rng.random(n) < 0.02, "quantity"] = np.nan
    t.loc[~t["named"], "product_id"] = 0
    t = pd.concat([t, t[t["product_id"] == 5]], ignore_index=True)
    t["known"] = t["named"] & (t["product_id"] % 9 != 3)
    t["opening_stock"] = np.where(t["known"], np.where(t["product_id"] % 5 == 1, -60, 25), 0)
    sign = t["transaction_type"].map({"IN": 1, "OUT": -1, "ADJUSTMENT": 1})
    t["valid"] = (sign.notna() & (t["quantity"].fillna(0) > 0)).astype(bool)
    t["signed"] = (sign.fillna(0) * t["quantity"].fillna(0)).astype("int64")

    frames = list(S.in_id_order((t.iloc[i:i + 100] for i in range(0, len(t), 100)), 300))
    assert sum(map(len, frames)) == len(t) and max(map(len, frames)) < 700 and len(frames) > 5
    assert all(a["id"].max() < b["id"].min() for a, b in zip(frames, frames[1:]))
    stocks, outs = [np.empty(0, "<i8"), np.empty(0, "<i8"), np.empty(0, "?")], []
    for frame in frames:
        out, stocks = S._fold(frame, stocks)
        outs.append(out)
    balances = dict(zip(stocks[0].tolist(), stocks[1].tolist()))

    def plain(x):
        return sorted([tuple(None if pd.isna(v) else v for v in r) for r in x.itertuples(index=False)], key=str)

    singly = []
    for (named, product), rows_ in t.groupby(["named", "product_id"]):
        rows_ = rows_.assign(product_id=product if named else None, opening_stock=rows_["opening_stock"].where(rows_["known"]))
        out, balance = S._judge(rows_, None)
        singly.append(out)
        assert not named or balances[product] == balance
    assert len(balances) == t.loc[t["named"], "product_id"].nunique()
    assert plain(pd.concat(outs)) == plain(pd.concat([x.astype(object) for x in singly]))


def test_compacted_changelog_reads_one_snapshot_and_its_deltas(spark):
    """Snapshots every two batches: the stocks stay right, and neither old batches nor old snapshots are read."""
    import shutil

    m = Model(spark, SF)
    src = _shuffled(spark, list(range(7)))
    out = S.run_live_stock(spark, S.ledger_stream(spark, src, max_files_per_trigger=1), compact_every=2)
    want = rows(ledger.ledger_stock(m.ledger))
    assert S.last_snapshot(spark, out) == 5 and rows(S.latest_stock(spark, out)) == want
    halfway = rows(S.latest_stock(spark, out, upto=2))
    assert halfway != want and len(halfway) > 0
    plan = S.latest_stock(spark, out)._jdf.queryExecution().toString()
    assert "upto=5" in plan and "upto=3" not in plan
    assert re.search(r"PartitionFilters: \[[^\]]*batch_id#\d+[^\]]* > 5", plan), plan
    # a snapshot that was written but not committed is not read
    shutil.copytree(f"{out}-snapshots/upto=1", f"{out}-snapshots/upto=6")
    assert S.last_snapshot(spark, out) == 5 and rows(S.latest_stock(spark, out)) == want
    S.compact(spark, out, 6)
    assert S.last_snapshot(spark, out) == 6 and rows(S.latest_stock(spark, out)) == want


PLAIN_SESSION = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate())
from larder.session import ship_package
from larder.streaming import ledger_stream as S
from tests.conftest import make_products
ship_package(spark)
events = S.scratch_path(spark, "events")
spark.createDataFrame([(1, None, 7, "signup", 5.0, "{}"), (2, None, 7, "purchase", 9.0, "{}"), (3, None, 7, "click", 4.0, "{}")],
                      S.EVENTS_SCHEMA).coalesce(1).write.parquet(events)
products = make_products(spark)
opening = products.select(F.col("id").alias("product_id"), F.lit(0).alias("opening_stock"))
guard = lambda t: S.ordered_guard(t, opening)
out = spark.read.parquet(S.run_closed(spark, S.ledger_stream(spark, events), guard, "g"))
print("guard", sorted(map(tuple, out.select("id", "accepted", "stock_before", "stock_after").collect())))
out = spark.read.parquet(S.run_closed(spark, S.ledger_stream(spark, events), lambda t: S.audit_rows(guard(t), products), "a"))
print("audit", sorted(map(tuple, out.select("record_id", "old_quantity", "new_quantity").collect())))
print("store", spark.conf.get(S.STATE_STORE, "").split(".")[-1])
"""


def test_ordered_guard_in_a_session_with_stock_settings(tmp_path):
    """Spark's own state store is not RocksDB, and a Python process that Spark starts on
    the driver finds the package neither in its folder nor on its path."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", PLAIN_SESSION, root, str(tmp_path / "kept")], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr[-3000:]
    assert "guard [(1, True, 0, 5), (2, False, 5, 5), (3, True, 5, 1)]" in got.stdout
    assert "audit [(7, 0, 5), (7, 5, 1)]" in got.stdout
    assert "store RocksDB" not in got.stdout  # the session's setting is as it was
