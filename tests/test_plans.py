"""Plan shape of every registered query: no cross products, no row-at-a-time
Python, Python batches only where the guard needs them, pruned scans."""

from __future__ import annotations

import contextlib
import io
import re

import __spark_entry__ as E
from larder.plans.keys import REGISTRY

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_no_cross_products_or_row_udfs(spark):
    for name, fn in REGISTRY.items():  # the training-data queries have tests of their own
        if name.startswith("stream_"):
            continue
        plan = _plan(fn(spark, SF))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            assert bad not in plan, (name, bad)
        assert "MapInPandas" not in plan and "FlatMapGroupsInPandas" not in plan, name
        if "MapInArrow" in plan:  # scans by row rank, and the guard
            assert name in ("ledger_guard", "ledger_running_stock", "order_prior_status", "product_patch",
                            "product_patch_products", "product_audit", "product_audit_json", "audit_values_parsed"), name


def test_scans_are_pruned(spark):
    plan = _plan(E.queries()["stock_valuation"](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    part = [s for s in schemas if "p_partkey" in s]
    assert part and all("p_name" not in s for s in part)
    plan = _plan(E.queries()["ledger_stock"](spark, SF))
    li = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan) if "l_partkey" in s]
    assert li and all("l_shipdate" not in s and "l_discount" not in s for s in li)


def test_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F

    df = E.queries()["ledger_listing"](spark, SF).filter(F.col("product_id") == 3)
    plan = _plan(df)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(user_id,3\)", plan), plan


def test_bucketed_tables_need_no_shuffle(spark):
    """Listing join, fold and running sum over tables stored in buckets of the product."""
    import uuid

    from pyspark.sql import functions as F

    from larder.operators import ledger, listings
    from larder.sources.model import Model
    from larder.sources.tables import load_bucketed, save_bucketed
    from larder.streaming.ledger_stream import scratch_path
    from tests.conftest import rows

    m, name = Model(spark, SF), f"t{uuid.uuid4().hex[:8]}_"
    save_bucketed({"products": m.products, "stock_transactions": m.ledger}, scratch_path(spark, "bucketed"), 4, name)
    t = load_bucketed(spark, ["products", "stock_transactions"], name)
    opening = t["products"].select(F.col("id").alias("product_id"), F.lit(0).alias("opening_stock"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables beyond the threshold
    try:
        for df, want in (
            (listings.ledger_listing(t["stock_transactions"], t["products"], ordered=False), listings.ledger_listing(m.ledger, m.products, ordered=False)),
            (ledger.ledger_stock(t["stock_transactions"]), ledger.ledger_stock(m.ledger)),
            (ledger.running_stock_by_bucket(opening, t["stock_transactions"]), ledger.running_stock(m.opening_zero(), m.ledger)),
        ):
            plan = _plan(df)
            assert "Exchange" not in plan, plan
            assert rows(df) == rows(want.select(*df.columns))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for table in t:
            spark.sql(f"DROP TABLE {name}{table}")


def test_recent_movements_take_the_newest_rows_before_the_join(spark):
    from pyspark.sql import functions as F

    from larder.operators import listings
    from larder.sources.model import Model

    m = Model(spark, SF)
    plan = _plan(listings.recent_movements(m.ledger, m.products, 5))
    inner = [len(line) - len(line.lstrip(" +-:")) for line in plan.split("\n\n")[0].splitlines() if "TakeOrderedAndProject" in line]
    assert len(inner) == 2 and inner[0] < inner[1], plan  # one below the join, one above
    # the newest rows name no product: five rows are found further down all the same
    newest = m.ledger.agg(F.max("id")).first()[0]
    led = m.ledger.withColumn("product_id", F.when(F.col("id") > newest - 30, -1).otherwise(F.col("product_id")))
    got = [r["id"] for r in listings.recent_movements(led, m.products, 5).collect()]
    assert got == list(range(newest - 30, newest - 35, -1))
    assert listings.recent_movements(led.where(F.col("product_id") == -1), m.products, 5).count() == 0


def test_delete_impact_has_one_exchange_per_parent(spark):
    """The verdict of a parent: its keys, its rows and its restricting children in one exchange."""
    from larder.operators import integrity
    from larder.plans.keys import _delete_keys, _tables
    from larder.sources.model import Model

    t = _tables(Model(spark, SF))
    plans = []
    checkpoint = type(spark.range(1)).checkpoint

    def seen(self, eager=True):
        plans.append(_plan(self))
        return checkpoint(self, eager)

    type(spark.range(1)).checkpoint = seen
    try:
        for chained in (False, True):
            plans.clear()
            integrity.delete_impact(t, _delete_keys(t), chained=chained).count()
            verdicts = [p.split("\n\n")[0] for p in plans if "_restrict" in p and "LeftAnti" not in p and "LeftSemi" not in p]
            assert verdicts and all(p.count(" Exchange") == 1 for p in verdicts), verdicts
    finally:
        type(spark.range(1)).checkpoint = checkpoint
