"""Driver contract: entry(), queries() and oracle_sql(); sinks."""

from __future__ import annotations

import json
import os

import __spark_entry__ as E
from larder.operators import listings
from larder.plans.keys import REGISTRY
from larder.sources import sinks
from larder.streaming.ledger_stream import scratch_path


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["supplier_id", "supplier_name", "contact_name", "email", "total_orders", "total_spend",
                          "avg_lead_time_days", "fulfillment_rate"]
    assert df.count() == 10


def test_every_key_has_an_oracle():
    o = E.oracle_sql()
    assert len(REGISTRY) >= 50 and set(REGISTRY) <= set(E.queries())
    assert set(REGISTRY) <= set(o) <= set(E.queries())


def test_keys_run_at_smallest_scale(spark):
    # every inventory query builds and runs over the sf0.001 tables
    for name, fn in REGISTRY.items():
        if name.startswith("stream_"):
            continue
        df = fn(spark, "/root/testdata/sf0.001")
        assert df.count() >= 0, name


def test_sinks(spark, seed):
    nested = listings.orders_nested(seed["orders"], seed["suppliers"], seed["items"], seed["products"])
    out = scratch_path(spark, "json")
    sinks.emit_json(nested.select("id", "status", "delivery_date", "items"), out)
    lines = []
    for f in sorted(os.listdir(out)):
        if f.endswith(".json"):
            with open(os.path.join(out, f)) as fh:
                lines += [json.loads(x) for x in fh if x.strip()]
    by_id = {x["id"]: x for x in lines}
    assert len(by_id[2]["items"]) == 2 and by_id[2]["delivery_date"] is None
    table = scratch_path(spark, "append")
    sinks.append(seed["ledger"].limit(3), table)
    sinks.append(seed["ledger"].limit(2), table)
    assert spark.read.parquet(table).count() == 5


def test_append_batch_is_idempotent(spark, seed):
    """A repeated batch leaves the table unchanged, another one adds to it."""
    from tests.conftest import rows

    table, led = scratch_path(spark, "append-batch"), seed["ledger"]
    for _ in range(2):
        sinks.append_batch(led.filter("id <= 4"), table, 1)
    sinks.append_batch(led.filter("id > 4"), table, 2)
    first = rows(sinks.read_batches(spark, table), "id", "batch_id")
    assert first == [(i, 1 if i <= 4 else 2) for i in range(1, 12)]
    sinks.append_batch(led.filter("id <= 4"), table, 1)
    sinks.append_batch(led.limit(0), table, 2)  # nothing to write
    assert rows(sinks.read_batches(spark, table), "id", "batch_id") == first
    assert rows(sinks.read_batches(spark, table, upto=1), "id") == [(i,) for i in range(1, 5)]


def test_configure_for_scale_keeps_cluster_settings(spark):
    from larder.session import configure_for_scale

    before = spark.conf.get("spark.sql.shuffle.partitions")
    applied = configure_for_scale(spark, 100 << 40)
    # shuffle partitions were set when the session was built, so they are kept
    assert "spark.sql.shuffle.partitions" not in applied
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    for k, v in applied.items():
        spark.conf.unset(k)


def test_tables_round_trip(spark, seed):
    from larder.operators import views
    from larder.sources.tables import load_tables, save_tables

    d = scratch_path(spark, "tables")
    save_tables({"suppliers": seed["suppliers"], "products": seed["products"],
                 "purchase_orders": seed["orders"], "purchase_order_items": seed["items"],
                 "stock_transactions": seed["ledger"]}, d)
    t = load_tables(spark, d, ["suppliers", "products", "purchase_orders", "purchase_order_items",
                               "stock_transactions"])
    assert t["products"].schema["price"].dataType.simpleString() == "decimal(12,2)"
    got = sorted(tuple(r) for r in views.stock_valuation(t["products"]).collect())
    assert got[0] == ("Electronics", 3, 89, 27570.0)


def test_package_is_shipped_to_workers(spark):
    """Python workers import larder even when the driver's sys.path was the
    only place it was known: a pandas UDF imports a larder module."""
    from larder.session import ship_package

    ship_package(spark)

    def via_larder(batches):
        from larder.operators.guard import fold_balances

        for pdf in batches:
            yield pdf.assign(id=[int(fold_balances(v, [1])[3]) for v in pdf["id"]])

    got = sorted(r[0] for r in spark.range(3).mapInPandas(via_larder, "id long").collect())
    assert got == [1, 2, 3]


def test_orders_json_writes_whole_rows_in_compressed_files(spark, seed, tmp_path, monkeypatch):
    import gzip
    import json
    from types import SimpleNamespace

    from larder.operators import listings
    from larder.plans import keys

    monkeypatch.setattr(keys, "scratch_path", lambda spark, name: str(tmp_path / name))
    m = SimpleNamespace(spark=spark, purchase_orders=seed["orders"], suppliers=seed["suppliers"], items=seed["items"], products=seed["products"])
    got = sorted(map(tuple, keys._orders_json(m).collect()))
    want = listings.nested_digest(listings.orders_nested(m.purchase_orders, m.suppliers, m.items, m.products))
    assert got == sorted(map(tuple, want.collect())) and len(got) == 3
    written = [f for f in (tmp_path / "orders-json").iterdir() if f.name.startswith("part-")]
    assert written and all(f.name.endswith(".json.gz") for f in written)
    lines = [json.loads(x) for f in written for x in gzip.open(f, "rt")]
    assert sorted((x["id"], len(x["items"]), x["supplier_name"]) for x in lines) == [(1, 1, "Supplier One"), (2, 2, "Supplier Two"), (3, 1, "Supplier Three")]
