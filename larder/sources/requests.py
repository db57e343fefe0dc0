"""Request batches for the rule operators, derived from the raw tables.

The reference takes one request per HTTP call; here a batch of requests is a
DataFrame.  For the driver's data the batches are derived by rule from the
raw tables (so they grow with them); the same rules are written as DuckDB
CTEs in ``larder.plans.oracle``.  Each rule mixes valid requests with
ones the operator must refuse (missing fields, CHECK failures, duplicates,
dangling keys, unknown orders).

S2 (``ingest``) parses raw JSON request bodies into typed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.sources import model as M

# Fixed time of the request batches (the transition's "now").
AS_OF = "2002-01-01 00:00:00"


def unused_id(key):
    """An id that no table has, whatever its size: a negative one."""
    return -key.cast("bigint") - 1


def as_of():
    return F.lit(AS_OF).cast("timestamp")


# -- purchase-order status requests (R7) ----------------------------------------

def status_requests(orders: DataFrame) -> DataFrame:
    """(order_id, seq, status).  Every order gets a first request chosen by
    its priority (1 DELIVERED, 2 SHIPPED, 3 CANCELLED, 4 an invalid 'BOGUS',
    5 PENDING); orders of priority 2 and 5 get a second request, DELIVERED;
    open orders of priority 4 also send a request for an unknown order id."""
    k = F.col("o_orderkey").cast("bigint")
    pr = F.col("o_orderpriority")
    first = orders.select(
        k.alias("order_id"), F.lit(1).alias("seq"),
        F.when(pr == "1-URGENT", "DELIVERED").when(pr == "2-HIGH", "SHIPPED")
        .when(pr == "3-MEDIUM", "CANCELLED").when(pr == "4-NOT SPECIFIED", "BOGUS")
        .otherwise("PENDING").alias("status"))
    second = orders.filter(pr.isin("2-HIGH", "5-LOW")).select(
        k.alias("order_id"), F.lit(2).alias("seq"), F.lit("DELIVERED").alias("status"))
    missing = orders.filter((pr == "4-NOT SPECIFIED") & (F.col("o_orderstatus") == "P")).select(
        unused_id(k).alias("order_id"), F.lit(1).alias("seq"), F.lit("SHIPPED").alias("status"))
    return first.unionByName(second).unionByName(missing)


# -- candidate items (R5) -------------------------------------------------------

def item_candidates(lineitem: DataFrame) -> DataFrame:
    """Every line item offered as an item of its order; every 211th part key
    points at an unknown order; line 1 of every 13th supplier has a negative
    quantity."""
    q = F.col("l_quantity").cast("int")
    unit_cents = F.expr(
        "(2 * cast(round(l_extendedprice * 100) as bigint) + cast(l_quantity as bigint))"
        " div (2 * cast(l_quantity as bigint))")
    return lineitem.select(
        F.when(F.col("l_partkey") % 211 == 0, unused_id(F.col("l_orderkey"))).otherwise(F.col("l_orderkey"))
        .cast("bigint").alias("order_id"),
        F.col("l_partkey").cast("bigint").alias("product_id"),
        F.when((F.col("l_suppkey") % 13 == 0) & (F.col("l_linenumber") == 1), -q).otherwise(q).alias("quantity"),
        (unit_cents / 100).cast("decimal(12,2)").alias("unit_price"),
        F.lit(0).alias("received_quantity"),
    )


# -- purchase-order creation requests (R6) ---------------------------------------

def order_requests(orders: DataFrame, lineitem: DataFrame, supplier: DataFrame):
    """(headers, items): one request per order, its line items as request
    items; line 2 leaves the unit price out (the product price fills it);
    line 1 of every 19th order has a negative quantity."""
    po = M.purchase_orders(orders, supplier)
    headers = po.select(F.col("id").alias("request_id"), "supplier_id", "expected_date")
    q = F.col("l_quantity").cast("int")
    unit_cents = F.expr(
        "(2 * cast(round(l_extendedprice * 100) as bigint) + cast(l_quantity as bigint))"
        " div (2 * cast(l_quantity as bigint))")
    items = lineitem.select(
        F.col("l_orderkey").cast("bigint").alias("request_id"),
        F.col("l_linenumber").cast("int").alias("line"),
        F.col("l_partkey").cast("bigint").alias("product_id"),
        F.when((F.col("l_orderkey") % 19 == 0) & (F.col("l_linenumber") == 1), -q).otherwise(q).alias("quantity"),
        F.when(F.col("l_linenumber") == 2, F.lit(None)).otherwise(unit_cents / 100)
        .cast("decimal(12,2)").alias("unit_price"),
    )
    return headers, items


# -- product patches (R8) -----------------------------------------------------------

def product_patches(part: DataFrame) -> DataFrame:
    """One patch per part (seq 1): price + 10 for sizes above 30, price -1 for size
    1 (refused by CHECK), status Inactive for PROMO parts; other fields null (a
    patch with every field null changes nothing).  Parts with sizes above 40
    send a second one (seq 2): price + 20, reorder level 7; those above 45 a
    third (seq 3) with an unknown status, which is refused."""
    k = F.col("p_partkey")
    size = F.col("p_size")
    price = (F.when(size == 1, F.lit(-1.0))
             .when(size > 30, F.col("p_retailprice") + 10)).cast("decimal(12,2)")
    def patch(rows, seq, price=None, reorder_level=None, status=None):
        return rows.select(
            k.cast("bigint").alias("id"), F.lit(seq).alias("seq"),
            *[F.lit(None).cast("string").alias(c) for c in ("name", "description", "category")],
            F.lit(price).cast("decimal(12,2)").alias("price"), F.lit(reorder_level).cast("int").alias("reorder_level"),
            F.lit(None).cast("bigint").alias("supplier_id"), F.lit(status).cast("string").alias("status"))

    later = patch(part.filter(size > 40), 2, price=F.col("p_retailprice") + 20, reorder_level=7).unionByName(
        patch(part.filter(size > 45), 3, price=F.lit(1), status=F.lit("Gone")))
    return later.unionByName(part.select(
        k.cast("bigint").alias("id"),
        F.lit(1).alias("seq"),
        F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("category"),
        price.alias("price"),
        F.lit(None).cast("int").alias("reorder_level"),
        F.lit(None).cast("bigint").alias("supplier_id"),
        F.when(F.col("p_type") == "PROMO", "Inactive").cast("string").alias("status"),
    ))


# -- catalogue creation requests (R9, R10) ----------------------------------------

def product_requests(part: DataFrame) -> DataFrame:
    """New products from the part table: skus come in colliding pairs (key
    div 2); size 49 re-uses an existing sku; sizes 1-2 leave the name out;
    size 50 has a negative price; size 48 names an unknown supplier."""
    k = F.col("p_partkey")
    size = F.col("p_size")
    sku = F.when(size == 49, F.concat(F.col("p_type"), F.lit("-"), k.cast("string"))).otherwise(
        F.concat(F.lit("  "), F.lower(F.col("p_type")), F.lit("-n"), F.expr("p_partkey div 2").cast("string"),
                 F.lit(" ")))
    return part.select(
        unused_id(k).alias("request_id"),
        sku.alias("sku"),
        F.when(size < 3, F.lit(None)).otherwise(F.concat(F.lit("New "), F.col("p_name"))).alias("name"),
        F.col("p_brand").alias("description"),
        F.col("p_type").alias("category"),
        F.when(size == 50, -F.col("p_retailprice")).otherwise(F.col("p_retailprice")).cast("decimal(12,2)")
        .alias("price"),
        F.when(size > 25, size).cast("int").alias("reorder_level"),
        F.when(size == 48, F.lit(999_999_999)).otherwise(k % 7).cast("bigint").alias("supplier_id"),
    )


def supplier_requests(customer: DataFrame) -> DataFrame:
    """New suppliers from the customer table: BUILDING customers take the
    email of the supplier with their key (a clash when that supplier exists);
    MACHINERY customers share emails in pairs; a negative balance leaves the
    phone out."""
    seg = F.col("c_mktsegment")
    key = F.col("c_custkey")
    email = (
        F.when(seg == "BUILDING",
               F.concat(F.lower(F.replace(F.replace(F.col("c_name"), F.lit("Customer"), F.lit("Supplier")),
                                          F.lit("#"), F.lit("-"))), F.lit("@example.com")))
        .when(seg == "MACHINERY",
              F.concat(F.lit("machinery-"), F.expr("c_custkey div 2").cast("string"), F.lit("@example.com")))
        .otherwise(F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("-"))), F.lit("@example.com")))
    )
    return customer.select(
        unused_id(key).alias("request_id"),
        F.col("c_name").alias("name"),
        seg.alias("contact_name"),
        email.alias("email"),
        F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.concat(F.lit("+1-555-"), key.cast("string")))
        .alias("phone"),
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("address"),
    )


# -- raw JSON request bodies (S2) -----------------------------------------------------

LEDGER_REQUEST = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("quantity", T.StringType()),
    T.StructField("notes", T.StringType()),
])

PRODUCT_REQUEST = T.StructType([
    T.StructField("sku", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("reorder_level", T.StringType()),
    T.StructField("supplier_id", T.StringType()),
])

SUPPLIER_REQUEST = T.StructType([
    T.StructField(c, T.StringType()) for c in ("name", "contact_name", "email", "phone", "address")
])

ORDER_ITEM = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("quantity", T.StringType()),
    T.StructField("unit_price", T.StringType()),
])

ORDER_REQUEST = T.StructType([
    T.StructField("supplier_id", T.StringType()),
    T.StructField("expected_date", T.StringType()),
    T.StructField("items", T.ArrayType(ORDER_ITEM)),
])

REQUEST_SCHEMAS = {
    "ledger": LEDGER_REQUEST,
    "product": PRODUCT_REQUEST,
    "supplier": SUPPLIER_REQUEST,
    "order": ORDER_REQUEST,
}


def ledger_request_bodies(events: DataFrame) -> DataFrame:
    """(request_id, body): JSON bodies of manual ledger requests built from
    events; the event's props text is the note; 'error' events send a
    quantity that is not a number and 'signup' events leave the type out."""
    et = F.col("event_type")
    body = F.to_json(F.struct(
        F.col("user_id").cast("string").alias("product_id"),
        F.when(et == "signup", F.lit(None))
        .when(et.isin("purchase", "click"), "OUT").otherwise("IN").alias("transaction_type"),
        F.when(et == "error", F.lit("n/a"))
        .otherwise(F.greatest(F.lit(1), F.ceil(F.col("value"))).cast("string")).alias("quantity"),
        F.col("props").alias("notes"),
    ))
    return events.select(F.col("event_id").cast("bigint").alias("request_id"), body.alias("body"))
