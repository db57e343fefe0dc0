"""Catalogue writes: S2 ingest, R8 patches, R9 new products, R10 new
suppliers, R13 defaults.

Uniqueness inside a batch is decided the way sequential inserts would decide
it: among requests for the same key that pass the earlier checks, the lowest
request id takes the key and later ones are duplicates.  The winner is a
grouped ``min`` (partial aggregation, so a key requested by a third of the
batch is no hot spot) joined back on the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.columns import normalize_sku
from larder.operators.audit import product_audit_rows
from larder.operators.prefix import Scan, prefix_scan
from larder.sources.requests import REQUEST_SCHEMAS
from larder.sources.schemas import DEFAULTS, MANUAL_NOTE, MANUAL_REFERENCE, PRODUCT_STATUSES, TABLES, TRANSACTION_TYPES


def _ts(as_of):
    if as_of is None:
        return F.current_timestamp()
    return as_of if isinstance(as_of, F.Column) else F.lit(as_of).cast("timestamp")


def _blank(c) -> F.Column:
    """JavaScript falsiness of a text field: missing or empty."""
    return F.col(c).isNull() | (F.col(c) == "")


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """Fill the DDL defaults of a table into absent or null columns."""
    schema = TABLES[table]
    defaults = DEFAULTS.get(table, {})
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


# -- S2 ----------------------------------------------------------------------------

def ingest(bodies: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Parse JSON request bodies (request_id, body) of one kind.

    Returns (accepted, rejects).  Numbers are converted with ``try_cast``
    (a value that is not a number is refused, never prefix-parsed).  Only the
    ledger kind is validated field by field here; the other kinds are parsed
    and handed to their operators, which validate them.
    """
    schema = T.StructType(REQUEST_SCHEMAS[kind].fields + [T.StructField("_corrupt_record", T.StringType())])
    # one parse per body: text that is not a JSON object lands in _corrupt_record
    parsed = bodies.select(
        "request_id",
        F.from_json("body", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
        .alias("r"),
    ).withColumn("_bad_json", F.col("r._corrupt_record").isNotNull())
    if kind != "ledger":
        ok = parsed.filter(~F.col("_bad_json")).select("request_id", "r.*").drop("_corrupt_record")
        bad = parsed.filter(F.col("_bad_json")).select("request_id", F.lit("bad_json").alias("reason"))
        ok, bad_numbers = _coerce(ok, kind)
        return ok, bad.unionByName(bad_numbers)
    r = parsed.select(
        "request_id",
        "_bad_json",
        F.col("r.product_id").alias("_pid_text"),
        F.col("r.transaction_type").alias("transaction_type"),
        F.col("r.quantity").alias("_qty_text"),
        F.col("r.notes").alias("_notes"),
    )
    pid = F.expr("try_cast(_pid_text as bigint)")
    qty = F.expr("try_cast(_qty_text as int)")
    r = r.withColumn("product_id", pid).withColumn("quantity", qty)
    reason = (
        F.when(F.col("_bad_json"), "bad_json")
        .when(_blank("_pid_text") | _blank("transaction_type") | _blank("_qty_text"), "missing_field")
        .when(F.col("product_id").isNull() | F.col("quantity").isNull(), "bad_number")
        .when((F.col("product_id") == 0) | (F.col("quantity") == 0), "missing_field")
        .when((F.col("quantity") < 0) | ~F.col("transaction_type").isin(*TRANSACTION_TYPES), "check")
    )
    r = r.withColumn("reason", reason)
    accepted = r.filter(F.col("reason").isNull()).select(
        "request_id", "product_id", "transaction_type", "quantity",
        F.lit(MANUAL_REFERENCE).alias("reference_id"),
        F.when(_blank("_notes"), F.lit(MANUAL_NOTE)).otherwise(F.col("_notes")).alias("notes"),
    )
    rejects = r.filter(F.col("reason").isNotNull()).select("request_id", "reason")
    return accepted, rejects


# Target types of the numeric request fields, per kind (text -> try_cast).
COERCE = {
    "product": {"price": "decimal(12,2)", "reorder_level": "int", "supplier_id": "bigint"},
    "supplier": {},
    "order": {"supplier_id": "bigint", "expected_date": "timestamp"},
}
ITEM_COERCE = {"product_id": "bigint", "quantity": "int", "unit_price": "decimal(12,2)"}


def _bad_number(text, converted):
    return text.isNotNull() & (text != "") & converted.isNull()


def _coerce(ok: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """try_cast the numeric fields of parsed requests; a non-empty value that
    does not convert refuses the request (bad_number).  Empty text is null."""
    casts = COERCE[kind]
    conv = {c: F.expr(f"try_cast(nullif({c}, '') as {t})") for c, t in casts.items()}
    bad = F.lit(False)
    for c in casts:
        bad = bad | _bad_number(F.col(c), conv[c])
    if kind == "order":
        typed_items = F.transform("items", lambda x: F.struct(
            *[x[c].try_cast(t).alias(c) for c, t in ITEM_COERCE.items()]))
        items_bad = F.exists("items", lambda x: reduce(
            lambda a, b: a | b, [_bad_number(x[c], x[c].try_cast(t)) for c, t in ITEM_COERCE.items()]))
        bad = bad | F.coalesce(items_bad, F.lit(False))
        conv["items"] = typed_items
    marked = ok.withColumn("_bad", bad)
    rejects = marked.filter("_bad").select("request_id", F.lit("bad_number").alias("reason"))
    accepted = marked.filter(~F.col("_bad")).withColumns(conv).drop("_bad")
    return accepted, rejects


def order_request_items(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ingested order requests into (headers, items): one item row per
    array element, numbered from 1 (``posexplode``; the explode is per
    request row, so no request's items are gathered anywhere)."""
    headers = orders.select("request_id", "supplier_id", "expected_date")
    items = orders.select("request_id", F.posexplode("items").alias("_pos", "_item")).select(
        "request_id", (F.col("_pos") + 1).cast("int").alias("line"),
        F.col("_item.product_id").alias("product_id"), F.col("_item.quantity").alias("quantity"),
        F.col("_item.unit_price").alias("unit_price"))
    return headers, items


# -- R8 ----------------------------------------------------------------------------

PATCH_FIELDS = ("name", "description", "category", "price", "reorder_level", "supplier_id", "status")


def patch_products(products: DataFrame, patches: DataFrame, suppliers: DataFrame,
                   changed_at=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply patches (id, optional ``seq``, nullable fields; a null keeps the value).

    Several patches of one product apply in ``seq`` order (integral, unique per
    product; one patch per product needs none): each is judged by its own
    values over the stored ones, a refused patch changes nothing, and of the
    others the last value of each field stays.

    Returns (outcome, new products, audit).  outcome has one row per patch with
    the product's values after it, ``refused`` and ``reason``: check (CHECK
    rules), no_supplier (foreign key), negative_stock (the stock guard fires on
    any update of a product whose stock is below zero).  Patches for unknown
    ids change nothing and are not reported (an UPDATE that matches no row).
    """
    seq = F.col("seq").cast("bigint") if "seq" in patches.columns else F.lit(0).cast("bigint")
    pt = patches.select(F.col("id").alias("_pid"), seq.alias("_seq"), *[F.col(c).alias(f"_n_{c}") for c in PATCH_FIELDS])
    j = products.join(pt, products.id == pt._pid, "inner")
    s = suppliers.select(F.col("id").alias("_sid"))
    j = j.join(s, F.col("_n_supplier_id") == s._sid, "left")
    new = {c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) for c in PATCH_FIELDS}
    check = (
        F.coalesce(new["price"] < 0, F.lit(False))
        | F.coalesce(new["reorder_level"] < 0, F.lit(False))
        | F.coalesce(~new["status"].isin(*PRODUCT_STATUSES), F.lit(False))
    )
    reason = (
        F.when(F.col("quantity_in_stock") < 0, "negative_stock")
        .when(check, "check")
        .when(F.col("_n_supplier_id").isNotNull() & F.col("_sid").isNull(), "no_supplier")
    )
    j = j.withColumn("_reason", reason)
    refused = F.col("_reason").isNotNull()
    # the value of a field after a patch: the last one set by an accepted patch so far
    given = {c: F.when(~refused, F.col(f"_n_{c}")) for c in PATCH_FIELDS}
    one = j.withColumns({**{f"_v_{c}": F.coalesce(given[c], F.col(c)) for c in PATCH_FIELDS}, "_old_price": F.col("price")})
    if "seq" in patches.columns:
        # a running value only for products with several patches, by row rank: a product
        # with very many is split over tasks
        several = pt.groupBy(F.col("_pid").alias("_mid")).agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_mid")
        scans = [Scan(f"_l_{c}", "last", given[c], inclusive=True) for c in PATCH_FIELDS] + [Scan("_l_old", "last", given["price"])]
        more = prefix_scan(j.join(several, j._pid == several._mid, "left_semi"), "_pid", "_seq", scans)
        more = more.withColumns({**{f"_v_{c}": F.coalesce(F.col(f"_l_{c}"), F.col(c)) for c in PATCH_FIELDS},
                                 "_old_price": F.coalesce(F.col("_l_old"), F.col("price"))})
        one = one.join(several, one._pid == several._mid, "left_anti").unionByName(more.drop(*[s.out for s in scans]))
    j = one
    outcome = j.select(
        F.col("id").alias("product_id"),
        *([F.col("_seq").alias("seq")] if "seq" in patches.columns else []),
        *[F.col(f"_v_{c}").alias(c) for c in ("name", "category", "price", "reorder_level", "supplier_id", "status")],
        refused.alias("refused"),
        F.col("_reason").alias("reason"),
    )
    # one row per patched product: of each field the value of the last accepted patch that sets it
    changed = j.filter(~refused).groupBy(F.col("_pid").alias("_cid")).agg(
        *[F.max_by(F.col(f"_n_{c}"), F.when(F.col(f"_n_{c}").isNotNull(), F.col("_seq"))).alias(f"_c_{c}") for c in PATCH_FIELDS])
    pj = products.join(changed, products.id == changed._cid, "left")
    new_products = pj.select(*[
        F.coalesce(F.col(f"_c_{c}"), F.col(c)).alias(c) if c in PATCH_FIELDS else F.col(c)
        for c in products.columns
    ])
    # audit rows straight from the patched rows (old and new side by side);
    # a patch never changes the stock, so only a price change is audited
    changed_price = j.filter(~refused & (F.col("_v_price") != F.col("_old_price"))).select(
        F.col("id").alias("record_id"), F.col("quantity_in_stock").alias("old_quantity"),
        F.col("quantity_in_stock").alias("new_quantity"), F.col("_old_price").alias("old_price"),
        F.col("_v_price").alias("new_price"))
    audit = product_audit_rows(changed_price, changed_at)
    return outcome, new_products, audit


def patch_audit(products: DataFrame, patches: DataFrame, suppliers: DataFrame, changed_at=None) -> DataFrame:
    """Audit fields of applied patches (record_id, quantities, prices)."""
    _, _, audit = patch_products(products, patches, suppliers, changed_at)
    return audit.select("record_id", "old_quantity", "new_quantity", "old_price", "new_price")


# -- R9 / R10 --------------------------------------------------------------------

def _first_claims(df: DataFrame, key: str, eligible) -> DataFrame:
    """Per key, the lowest request id among eligible requests."""
    return (df.filter(eligible).groupBy(F.col(key).alias("_wkey"))
            .agg(F.min("request_id").alias("_winner")))


def create_products(requests: DataFrame, products: DataFrame, suppliers: DataFrame,
                    as_of=None) -> tuple[DataFrame, DataFrame]:
    """New products (sku trimmed and upper-cased, stock 0, reorder level
    0 when absent, supplier null when absent).  Returns (products, rejects)
    with reasons missing_field, check, duplicate_sku, no_supplier."""
    r = requests.withColumn("_sku", normalize_sku("sku"))
    r = r.withColumn("_reorder", F.when(F.coalesce(F.col("reorder_level"), F.lit(0)) == 0, F.lit(0))
                     .otherwise(F.col("reorder_level")).cast("int"))
    r = r.withColumn("_supplier", F.when(F.coalesce(F.col("supplier_id"), F.lit(0)) == 0, F.lit(None))
                     .otherwise(F.col("supplier_id")).cast("bigint"))
    missing = _blank("sku") | _blank("name") | _blank("category") | F.col("price").isNull()
    check = (F.col("price") < 0) | (F.col("_reorder") < 0)
    existing = products.select(F.col("sku").alias("_esku")).distinct()
    s = suppliers.select(F.col("id").alias("_sid"))
    r = (r.join(existing, r._sku == existing._esku, "left")
         .join(s, r._supplier == s._sid, "left"))
    r = r.withColumn("_pre", F.when(missing, "missing_field").when(check, "check")
                     .when(F.col("_esku").isNotNull(), "duplicate_sku"))
    fk_ok = F.col("_supplier").isNull() | F.col("_sid").isNotNull()
    wins = _first_claims(r, "_sku", F.col("_pre").isNull() & fk_ok)
    r = r.join(wins, r._sku == wins._wkey, "left")
    reason = (F.when(F.col("_pre").isNotNull(), F.col("_pre"))
              .when(F.col("request_id") == F.col("_winner"), F.lit(None))
              .when(F.col("request_id") > F.col("_winner"), "duplicate_sku")
              .otherwise("no_supplier"))
    r = r.withColumn("_reason", reason)
    ok = r.filter(F.col("_reason").isNull()).select(
        F.col("request_id").alias("id"), F.col("_sku").alias("sku"), "name", "description", "category",
        F.col("price").cast("decimal(12,2)").alias("price"), F.lit(0).alias("quantity_in_stock"),
        F.col("_reorder").alias("reorder_level"), F.col("_supplier").alias("supplier_id"),
        F.lit(None).cast("string").alias("status"), _ts(as_of).alias("created_at"))
    rejects = r.filter(F.col("_reason").isNotNull()).select("request_id", F.col("_reason").alias("reason"))
    return with_defaults(ok, "products"), rejects


def create_suppliers(requests: DataFrame, suppliers: DataFrame, as_of=None) -> tuple[DataFrame, DataFrame]:
    """New suppliers; all five fields required, email unique.  Returns
    (suppliers, rejects) with reasons missing_field, duplicate_email."""
    fields = ("name", "contact_name", "email", "phone", "address")
    missing = F.lit(False)
    for c in fields:
        missing = missing | _blank(c)
    existing = suppliers.select(F.col("email").alias("_eemail")).distinct()
    r = requests.join(existing, requests.email == existing._eemail, "left")
    r = r.withColumn("_pre", F.when(missing, "missing_field")
                     .when(F.col("_eemail").isNotNull(), "duplicate_email"))
    wins = _first_claims(r, "email", F.col("_pre").isNull())
    r = r.join(wins, r.email == wins._wkey, "left")
    reason = (F.when(F.col("_pre").isNotNull(), F.col("_pre"))
              .when(F.col("request_id") == F.col("_winner"), F.lit(None))
              .otherwise("duplicate_email"))
    r = r.withColumn("_reason", reason)
    ok = r.filter(F.col("_reason").isNull()).select(
        F.col("request_id").alias("id"), *fields, F.lit(None).cast("string").alias("status"),
        _ts(as_of).alias("created_at"))
    rejects = r.filter(F.col("_reason").isNotNull()).select("request_id", F.col("_reason").alias("reason"))
    return with_defaults(ok, "suppliers"), rejects
