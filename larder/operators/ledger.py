"""Ledger folds: A8 signed sums, W2 running stock, R1 apply, R11/R12 reconcile.

The ledger is an append-only event table keyed by ``id``.  Sums are
commutative (partial + final aggregation, skew-safe).  Running balances are
prefix scans by row rank (``operators.prefix``), so a product that holds a
third of all rows is spread over many tasks whatever its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import as_bigint, signed_quantity
from larder.operators.prefix import Scan, prefix_scan


def ledger_stock(ledger: DataFrame) -> DataFrame:
    """Signed sum per product (IN +, OUT -, ADJUSTMENT +)."""
    return ledger.groupBy("product_id").agg(as_bigint(F.sum(signed_quantity())).alias("stock"))


def with_opening(rows: DataFrame, opening: DataFrame) -> DataFrame:
    """Every ledger row with its product's opening stock: ``_open`` (0 where it has
    none) and ``_known``, whether there is such a product."""
    op = opening.select(F.col("product_id").alias("_opid"), F.col("opening_stock").cast("bigint").alias("_open")).where("_opid IS NOT NULL")
    j = rows.join(op, rows.product_id == op._opid, "left")
    return j.withColumns({"_known": F.col("_opid").isNotNull(), "_open": F.coalesce(F.col("_open"), F.lit(0))}).drop("_opid")


def running_stock(opening: DataFrame, ledger: DataFrame, partitions: int | None = None) -> DataFrame:
    """Unguarded stock before and after every ledger row (W2).  Products
    without an opening row start at 0."""
    t = ledger.select("id", "product_id", "transaction_type", "quantity", signed_quantity().cast("bigint").alias("_s"))
    t = with_opening(prefix_scan(t, "product_id", "id", [Scan("_run", "sum", F.col("_s"), inclusive=True)], partitions), opening)
    after = F.col("_open") + F.col("_run")
    return t.select(
        "id", "product_id", "transaction_type", "quantity",
        as_bigint(after - F.coalesce(F.col("_s"), F.lit(0))).alias("stock_before"),
        as_bigint(after).alias("stock_after"),
    )


def apply_ledger(products: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every product's stock plus the signed sum of the ledger rows (sum
    first, then one join on the product key).  A stock that INT cannot hold is
    not applied: the product keeps its own (see ``ledger_overflows``)."""
    j = _applied(products, ledger)
    return j.select(F.col("id").alias("product_id"),
                    F.coalesce(F.col("_sum").try_cast("int"), F.col("quantity_in_stock")).alias("quantity_in_stock"))


def _applied(products: DataFrame, ledger: DataFrame) -> DataFrame:
    sums = ledger_stock(ledger).withColumnRenamed("product_id", "_lpid")
    j = products.join(sums, products.id == sums._lpid, "left")
    return j.withColumn("_sum", F.col("quantity_in_stock").cast("bigint") + F.coalesce(F.col("stock"), F.lit(0)))


def ledger_overflows(products: DataFrame, ledger: DataFrame) -> DataFrame:
    """Products that ``apply_ledger`` left alone (product_id, stock, reason)."""
    return _applied(products, ledger).where(F.col("_sum").isNotNull() & F.col("_sum").try_cast("int").isNull()).select(
        F.col("id").alias("product_id"), F.col("_sum").alias("stock"), F.lit("overflow").alias("reason"))


def running_stock_by_bucket(opening: DataFrame, ledger: DataFrame) -> DataFrame:
    """W2 over a ledger stored in buckets of its product, sorted by id
    (``sources.tables.save_bucketed``): a plain window, without a shuffle.  A bucket is
    one task, so a ledger with a hot product takes ``running_stock``."""
    w = Window.partitionBy("product_id").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = with_opening(ledger, opening).withColumn("_s", F.coalesce(signed_quantity().cast("bigint"), F.lit(0)))
    after = F.col("_open") + F.sum("_s").over(w)
    return t.select("id", "product_id", "transaction_type", "quantity", as_bigint(after - F.col("_s")).alias("stock_before"),
                    as_bigint(after).alias("stock_after"))


def apply_ledger_products(products: DataFrame, ledger: DataFrame) -> DataFrame:
    """R1 returning full product rows (for chaining batches)."""
    new = apply_ledger(products, ledger).withColumnRenamed("quantity_in_stock", "_new_qty")
    j = products.join(new, products.id == new.product_id, "inner")
    return j.select(*[F.col("_new_qty").alias(c) if c == "quantity_in_stock" else F.col(c)
                      for c in products.columns])


def _reconcile_base(products: DataFrame, ledger: DataFrame) -> DataFrame:
    sums = ledger_stock(ledger).withColumnRenamed("product_id", "_lpid")
    p = products.select("id", "sku", "name", "quantity_in_stock", F.col("price").alias("_price"))
    j = p.join(sums, p.id == sums._lpid, "left")
    computed = F.coalesce(F.col("stock"), F.lit(0))
    return j.select(
        F.col("id").alias("product_id"), "sku", "name", "_price",
        F.col("quantity_in_stock").cast("bigint").alias("actual_stock"),
        computed.cast("bigint").alias("computed_stock"),
        (computed - F.col("quantity_in_stock")).cast("bigint").alias("discrepancy"),
    )


def reconcile_report(products: DataFrame, ledger: DataFrame) -> DataFrame:
    """R11 + P11: recorded stock against the ledger sum, with the page's labels."""
    b = _reconcile_base(products, ledger).drop("_price")
    d = F.col("discrepancy")
    return b.select(
        "*",
        F.lit(False).alias("reconciled"),
        F.when(d != 0, "Discrepancy").otherwise("Matched").alias("status_label"),
        F.when(d > 0, F.concat(F.lit("+"), d.cast("string"))).otherwise(d.cast("string")).alias("discrepancy_text"),
    )


def reconcile_summary(products: DataFrame, ledger: DataFrame) -> DataFrame:
    """Does any product disagree with its ledger, and how many."""
    b = _reconcile_base(products, ledger)
    return b.agg(
        F.coalesce(F.bool_or(F.col("discrepancy") != 0), F.lit(False)).alias("has_discrepancy"),
        as_bigint(F.count_if(F.col("discrepancy") != 0)).alias("discrepancy_count"),
    )


def reconcile_fix(products: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Set stock to the ledger sum where they differ.

    Returns (report, new products, audit rows).  A product whose computed
    stock is negative is not changed (``blocked``; the stock guard would
    refuse it), nor one whose computed stock INT cannot hold.  The report shows the new actual stock and the old
    discrepancy, as the reference does.
    """
    from larder.operators.audit import product_audit_rows

    b = _reconcile_base(products, ledger)
    needs = F.col("discrepancy") != 0
    blocked = needs & ((F.col("computed_stock") < 0) | F.col("computed_stock").try_cast("int").isNull())
    fixed = needs & ~blocked
    report = b.select(
        "product_id", "sku", "name",
        F.when(fixed, F.col("computed_stock")).otherwise(F.col("actual_stock")).alias("actual_stock"),
        "computed_stock", "discrepancy",
        fixed.alias("reconciled"),
        blocked.alias("blocked"),
    )
    fixes = report.filter("reconciled").select(F.col("product_id").alias("_fid"),
                                               F.col("actual_stock").try_cast("int").alias("_fqty"))
    j = products.join(fixes, products.id == fixes._fid, "left")
    new_products = j.select(*[
        F.coalesce(F.col("_fqty"), F.col(c)).alias(c) if c == "quantity_in_stock" else F.col(c)
        for c in products.columns
    ])
    # audit rows from the fixed rows themselves (no diff of two product tables)
    audit = product_audit_rows(b.filter(fixed).select(
        F.col("product_id").alias("record_id"), F.col("actual_stock").cast("int").alias("old_quantity"),
        F.col("computed_stock").try_cast("int").alias("new_quantity"), F.col("_price").alias("old_price"),
        F.col("_price").alias("new_price")))
    return report, new_products, audit
