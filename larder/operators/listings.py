"""Listings, lookups and top-k reports.

Joins are foreign-key equi-joins.  None of them carries a broadcast hint:
dimension sides (suppliers, products) are broadcast by AQE when their runtime
size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and stay
sort-merge joins when they are not, so no side is broadcast unchecked.
"""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import as_bigint
from larder.operators.views import is_low_stock, low_stock_alerts, low_stock_count


def _by_id_desc(df: DataFrame, ordered: bool) -> DataFrame:
    # A global sort is a range shuffle of the whole result; only when asked.
    return df.orderBy(F.col("id").desc()) if ordered else df


def product_listing(products: DataFrame, suppliers: DataFrame, ordered: bool = True) -> DataFrame:
    """All products with supplier name and the page's low-stock flag (no Active test)."""
    s = suppliers.select(F.col("id").alias("_sid"), F.col("name").alias("supplier_name"))
    j = products.join(s, products.supplier_id == s._sid, "left").drop("_sid")
    return _by_id_desc(j.withColumn("is_low_stock", is_low_stock()), ordered)


def supplier_directory(suppliers: DataFrame, ordered: bool = True) -> DataFrame:
    """Suppliers by name (ties by id)."""
    return suppliers.orderBy("name", "id") if ordered else suppliers


def is_open_order(status="status"):
    return F.col(status).isin("PENDING", "SHIPPED")


def order_listing(orders: DataFrame, suppliers: DataFrame, ordered: bool = True) -> DataFrame:
    """Orders with supplier name (inner join, as the reference) and the open flag."""
    s = suppliers.select(F.col("id").alias("_sid"), F.col("name").alias("supplier_name"))
    j = orders.join(s, orders.supplier_id == s._sid, "inner").drop("_sid")
    return _by_id_desc(j.withColumn("is_open", is_open_order()), ordered)


def order_items_enriched(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items with product name and sku, and whether they are fully received."""
    p = products.select(F.col("id").alias("_pid"), F.col("name").alias("product_name"),
                        F.col("sku").alias("product_sku"))
    j = items.join(p, items.product_id == p._pid, "inner")
    return j.select(
        "order_id", "product_id", "quantity", "unit_price", "received_quantity",
        "product_name", "product_sku",
        (F.col("received_quantity") == F.col("quantity")).alias("fully_received"),
    )


def orders_nested(orders: DataFrame, suppliers: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """One row per order with its items as an array of structs in item order (one
    join and one grouping instead of one query per order).  An order without
    items has an empty array.  For orders too large for a row there is
    ``orders_nested_pages``."""
    p = products.select(F.col("id").alias("_pid"), F.col("name").alias("product_name"),
                        F.col("sku").alias("product_sku"))
    # Dealt by order before they are collected: no list can be made smaller ahead of the
    # shuffle, where collecting would only sort (and spill) whole input splits.
    it = items.join(p, items.product_id == p._pid, "inner").drop("_pid").repartition("order_id")
    item_struct = F.struct(*[F.col(c) for c in it.columns if c != "order_id"])
    grouped = it.groupBy(F.col("order_id").alias("_oid")).agg(F.array_sort(F.collect_list(item_struct)).alias("items"))
    base = order_listing(orders, suppliers, ordered=False)
    j = base.join(grouped, base.id == grouped._oid, "left").drop("_oid")
    empty = F.array().cast(grouped.schema["items"].dataType)
    return j.withColumn("items", F.coalesce(F.col("items"), empty))


def orders_nested_pages(orders: DataFrame, suppliers: DataFrame, items: DataFrame, products: DataFrame,
                        page_size: int = 10_000) -> DataFrame:
    """``orders_nested`` in pages: an order with more than ``page_size`` items is
    split by item id range (at most ``page_size`` ids each), so no order is
    gathered into a single row or task.  Output: the order columns,
    supplier_name, ``page`` (0 for orders that fit in one) and ``items``."""
    p = products.select(F.col("id").alias("_pid"), F.col("name").alias("product_name"),
                        F.col("sku").alias("product_sku"))
    it = items.join(p, items.product_id == p._pid, "inner").drop("_pid")
    counts = it.groupBy(F.col("order_id").alias("_coid")).agg(F.count(F.lit(1)).alias("_n"))
    it = it.join(counts, it.order_id == counts._coid, "inner").drop("_coid")
    it = it.withColumn("page", F.when(F.col("_n") > page_size, F.floor(F.col("id") / F.lit(page_size)))
                       .otherwise(F.lit(0)).cast("bigint"))
    item_struct = F.struct(*[F.col(c) for c in it.columns if c not in ("order_id", "_n", "page")])
    grouped = it.groupBy(F.col("order_id").alias("_oid"), "page").agg(
        F.array_sort(F.collect_list(item_struct)).alias("items"))
    base = order_listing(orders, suppliers, ordered=False)
    j = base.join(grouped, base.id == grouped._oid, "left").drop("_oid")
    empty = F.array().cast(grouped.schema["items"].dataType)
    return j.withColumns({"page": F.coalesce(F.col("page"), F.lit(0).cast("bigint")),
                          "items": F.coalesce(F.col("items"), empty)})


def orders_digest(orders: DataFrame, suppliers: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Per-order digest of ``orders_nested`` (item count, quantity, sku range),
    computed with partial aggregates so a huge order never becomes one row."""
    p = products.select(F.col("id").alias("_pid"), F.col("sku").alias("product_sku"))
    it = items.join(p, items.product_id == p._pid, "inner")
    agg = it.groupBy(F.col("order_id").alias("_oid")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("quantity").alias("_q"),
        F.min("product_sku").alias("min_sku"),
        F.max("product_sku").alias("max_sku"),
    )
    base = order_listing(orders, suppliers, ordered=False).select("id")
    j = base.join(agg, base.id == agg._oid, "left")
    return j.select(
        F.col("id").alias("order_id"),
        as_bigint(F.coalesce(F.col("_n"), F.lit(0))).alias("item_count"),
        as_bigint(F.coalesce(F.col("_q"), F.lit(0))).alias("total_quantity"),
        "min_sku",
        "max_sku",
    )


def nested_digest(nested: DataFrame) -> DataFrame:
    """The same digest read back from the nested form, summed over pages if it has any."""
    per_page = nested.select(
        "id",
        F.size("items").alias("_n"),
        F.aggregate("items", F.lit(0).cast("bigint"), lambda acc, x: acc + x["quantity"]).alias("_q"),
        F.array_min(F.transform("items", lambda x: x["product_sku"])).alias("_min"),
        F.array_max(F.transform("items", lambda x: x["product_sku"])).alias("_max"),
    )
    return per_page.groupBy(F.col("id").alias("order_id")).agg(
        as_bigint(F.sum("_n")).alias("item_count"), as_bigint(F.sum("_q")).alias("total_quantity"),
        F.min("_min").alias("min_sku"), F.max("_max").alias("max_sku"))


def ledger_listing(ledger: DataFrame, products: DataFrame, ordered: bool = True) -> DataFrame:
    """Ledger rows with product name and sku."""
    p = products.select(F.col("id").alias("_pid"), F.col("name").alias("product_name"),
                        F.col("sku").alias("product_sku"))
    j = ledger.join(p, ledger.product_id == p._pid, "inner").drop("_pid")
    return _by_id_desc(j, ordered)


def recent_movements(ledger: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    """Newest n ledger rows that have a product.  The newest n rows are taken before
    the join (each task keeps its own top n, then one merge of n x tasks rows).  Only
    where some of them turn out to have no product, which a foreign key rules out, are
    more candidates looked at, each time four times as many."""
    p = products.select(F.col("id").alias("_pid"), F.col("name").alias("product_name"), F.col("sku").alias("product_sku"))
    take = n
    while True:
        newest = ledger.orderBy(F.col("id").desc()).limit(take)
        found = newest.join(p, newest.product_id == p._pid, "inner").drop("_pid").orderBy(F.col("id").desc()).limit(n)
        if found.count() == n or newest.count() < take:
            return found
        take *= 4


def audit_listing(log: DataFrame, ordered: bool = True) -> DataFrame:
    """The audit log, newest first."""
    return _by_id_desc(log, ordered)


def low_stock_top(products: DataFrame, suppliers: DataFrame, n: int = 4) -> DataFrame:
    """First n alerts by product id, with the alert total and how many are not shown."""
    alerts = low_stock_alerts(products, suppliers)
    total = low_stock_count(products)
    top = alerts.orderBy("product_id").limit(n)
    return top.select(
        "product_id", "product_name", "sku", "supplier_name", "quantity_in_stock", "recommended_order_qty",
        as_bigint(total).alias("total_alerts"),
        as_bigint(F.greatest(total - F.lit(n), F.lit(0))).alias("remaining"),
    )


def lookup_by_keys(df: DataFrame, keys: DataFrame, key: str = "id", keys_col: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the key set (a left semi join: each
    row is emitted at most once however often its key repeats in ``keys``)."""
    kc = keys_col or key
    k = keys.select(F.col(kc).alias("_lookup_key"))
    return df.join(k, df[key] == k._lookup_key, "left_semi")


def register_views(spark, tables: dict[str, DataFrame]) -> None:
    """Register tables (and the three views) by name for ad-hoc SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    if "products" in tables:
        from larder.operators.views import stock_valuation

        stock_valuation(tables["products"]).createOrReplaceTempView("v_stock_valuation")
        if "suppliers" in tables:
            low_stock_alerts(tables["products"], tables["suppliers"]).createOrReplaceTempView("v_low_stock_alerts")
    if "suppliers" in tables and "purchase_orders" in tables:
        from larder.operators.views import supplier_performance

        supplier_performance(tables["suppliers"], tables["purchase_orders"]).createOrReplaceTempView(
            "v_supplier_performance")


def adhoc_query(spark, text: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Run a read-only statement over registered views, or over ``tables`` named
    as ``{name}`` in the text.

    The statement is parsed as a subquery, where the grammar admits queries
    only: a command (INSERT, DROP, also behind WITH or a comment) is refused
    before anything runs."""
    body = text.strip().rstrip(";")
    if not body:
        raise ValueError("only SELECT statements are accepted")
    try:
        return spark.sql(f"SELECT * FROM (\n{body}\n)", args=args or {}, **tables)
    except ParseException as e:
        raise ValueError("only SELECT statements are accepted") from e


def adhoc_category_filter(spark, products: DataFrame, category: str) -> DataFrame:
    """The shipped console example: products of one category, through SQL."""
    return adhoc_query(spark, "SELECT * FROM {products} WHERE category = :category", {"category": category}, products=products)
