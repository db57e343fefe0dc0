"""Skew check: one product holding ~40% of a ledger with sparse ids and large quantities.

    python tools/skew_check.py [sf_dir] [partitions]

Derives a skewed ledger from the events table ('view' and 'click' events all
go to product 0; ids far apart; quantities up to 10**6), then runs, each under
its own job description:

* ``plain``   - running stock with a plain Window.partitionBy(product)
* ``ranked``  - ``ledger.running_stock`` (scan by row rank)
* ``guard``   - ``guard.guard_ledger`` (checked against the row-by-row fold)
* ``transition_plain`` / ``transition`` - order status requests with one
  order holding ~40% of them: a plain per-order window against
  ``orders.transition_orders`` (scan by row rank)

Spark's event log (written to a fresh scratch folder) gives the shuffle
records read by each task; the script prints, per run and per shuffle stage
that reads at least 5% of the rows, the largest task's share of the records.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from larder.functions.columns import signed_quantity  # noqa: E402
from larder.operators import guard, ledger, orders  # noqa: E402
from larder.session import build_session  # noqa: E402
from larder.sources.model import Model  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    parts = int(sys.argv[2]) if len(sys.argv) > 2 else 16
    log_dir = tempfile.mkdtemp(prefix="skew-eventlog-", dir="/tmp")
    spark = build_session(shuffle_partitions=16, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
        "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        # skew-join thresholds scaled down to this data size, as they would be
        # met by a hot key's partition at full scale
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"})
    m = Model(spark, sf_dir)
    hot = F.col("notes").isin("view", "click")
    led = m.ledger.select(
        (F.col("id") * F.col("id") * 10).alias("id"), F.when(hot, F.lit(0).cast("bigint")).otherwise(F.col("product_id")).alias("product_id"),
        "transaction_type", (F.col("quantity") * 7919 % 1_000_003 + 1).cast("int").alias("quantity")).repartition(parts)
    opening = m.opening_zero()
    total = led.count()
    share = led.filter(F.col("product_id") == 0).count() / total

    sc = spark.sparkContext
    sc.setJobDescription("plain")
    w = Window.partitionBy("product_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    plain = led.select("id", "product_id", F.sum(signed_quantity()).over(w).alias("run"))
    plain.write.format("noop").mode("overwrite").save()
    sc.setJobDescription("ranked")
    ledger.running_stock(opening, led, parts).write.format("noop").mode("overwrite").save()
    sc.setJobDescription("guard")
    g = guard.guard_ledger(opening, led, parts).select(
        "id", "product_id", "accepted", "stock_before", "stock_after")
    got = g.toPandas().sort_values("id").reset_index(drop=True)
    # R7 with one order holding ~40% of the status requests (seq = event id)
    sc.setJobDescription(None)
    ev = m.raw("events")
    req = ev.select(
        F.when(F.col("event_type").isin("view", "click"), F.lit(0)).otherwise(F.col("user_id"))
        .cast("bigint").alias("order_id"),
        F.col("event_id").cast("bigint").alias("seq"),
        F.when(F.col("event_type") == "error", "CANCELLED").when(F.col("event_type") == "purchase", "BOGUS")
        .otherwise("SHIPPED").alias("status"))
    sc.setJobDescription("transition_plain")
    wp = Window.partitionBy("order_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    plain_tr = req.select("order_id", "seq", F.max(F.col("status").isin("DELIVERED", "CANCELLED").cast("int"))
                          .over(wp).alias("closed_before"))
    plain_tr.write.format("noop").mode("overwrite").save()
    sc.setJobDescription("transition")
    tr = orders.transition_orders(req, m.purchase_orders, m.items, "2002-01-01", parts)["outcomes"]
    tr_rows = tr.count()
    sc.setJobDescription(None)
    # the same batch in one part
    whole = orders.transition_orders(req, m.purchase_orders, m.items, "2002-01-01", 1)["outcomes"]
    tr_same = tr.exceptAll(whole).count() == 0 and whole.exceptAll(tr).count() == 0
    ref = guard.guard_reference(opening.toPandas(), led.select(
        "id", "product_id", "transaction_type", "quantity").toPandas()).sort_values("id").reset_index(drop=True)
    same = all((got[c].astype("int64").values == ref[c].astype("int64").values).all()
               for c in ["id", "accepted", "stock_before", "stock_after"])
    spark.stop()

    # read per-task shuffle records from the event log
    stage_desc, task_records = {}, defaultdict(list)
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path) or os.path.basename(path).startswith("appstatus"):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    desc = (ev.get("Properties") or {}).get("spark.job.description")
                    for sid in ev.get("Stage IDs", []):
                        stage_desc[sid] = desc
                elif kind == "SparkListenerTaskEnd":
                    metrics = ev.get("Task Metrics") or {}
                    rd = metrics.get("Shuffle Read Metrics") or {}
                    recs = rd.get("Total Records Read", 0)
                    task_records[ev["Stage ID"]].append(recs)
    report = defaultdict(list)
    for sid, recs in sorted(task_records.items()):
        desc = stage_desc.get(sid)
        if desc is None or sum(recs) < total * 0.05:
            continue
        report[desc].append({"stage": sid, "tasks": len(recs), "records": sum(recs),
                             "largest_task_share": round(max(recs) / sum(recs), 3), "largest_to_mean": round(max(recs) * len(recs) / sum(recs), 2)})
    print(json.dumps({"rows": total, "hot_product_share": round(share, 3), "partitions": parts,
                      "guard_equals_plain_fold": bool(same), "transition_rows": tr_rows, "transition_equals_one_part": bool(tr_same), "shuffle_stages": report}))


if __name__ == "__main__":
    main()
