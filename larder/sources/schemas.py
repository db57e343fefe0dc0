"""Schemas and declared constraints of the six inventory tables, as data.

The integrity jobs (``operators.integrity``) read the constraint lists below;
nothing else hard-codes a rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


SUPPLIERS = T.StructType([
    _f("id", T.LongType(), False),
    _f("name", T.StringType(), False),
    _f("contact_name", T.StringType(), False),
    _f("email", T.StringType(), False),
    _f("phone", T.StringType(), False),
    _f("address", T.StringType(), False),
    _f("status", T.StringType()),
    _f("created_at", T.TimestampType()),
])

PRODUCTS = T.StructType([
    _f("id", T.LongType(), False),
    _f("sku", T.StringType(), False),
    _f("name", T.StringType(), False),
    _f("description", T.StringType()),
    _f("category", T.StringType(), False),
    _f("price", MONEY, False),
    _f("quantity_in_stock", T.IntegerType(), False),
    _f("reorder_level", T.IntegerType(), False),
    _f("supplier_id", T.LongType()),
    _f("status", T.StringType()),
    _f("created_at", T.TimestampType()),
])

PURCHASE_ORDERS = T.StructType([
    _f("id", T.LongType(), False),
    _f("supplier_id", T.LongType(), False),
    _f("order_date", T.TimestampType()),
    _f("expected_date", T.TimestampType()),
    _f("delivery_date", T.TimestampType()),
    _f("total_amount", MONEY),
    _f("status", T.StringType()),
    _f("created_at", T.TimestampType()),
    _f("updated_at", T.TimestampType()),
])

PURCHASE_ORDER_ITEMS = T.StructType([
    _f("id", T.LongType(), False),
    _f("order_id", T.LongType(), False),
    _f("product_id", T.LongType(), False),
    _f("quantity", T.IntegerType(), False),
    _f("unit_price", MONEY, False),
    _f("received_quantity", T.IntegerType()),
])

STOCK_TRANSACTIONS = T.StructType([
    _f("id", T.LongType(), False),
    _f("product_id", T.LongType(), False),
    _f("transaction_type", T.StringType(), False),
    _f("quantity", T.IntegerType(), False),
    _f("reference_id", T.StringType()),
    _f("notes", T.StringType()),
    _f("transaction_date", T.TimestampType()),
])

INVENTORY_AUDIT_LOG = T.StructType([
    _f("id", T.LongType(), False),
    _f("table_name", T.StringType(), False),
    _f("action_type", T.StringType(), False),
    _f("record_id", T.LongType(), False),
    _f("old_values", T.StringType()),
    _f("new_values", T.StringType()),
    _f("changed_by", T.StringType()),
    _f("changed_at", T.TimestampType()),
])

TABLES = {
    "suppliers": SUPPLIERS,
    "products": PRODUCTS,
    "purchase_orders": PURCHASE_ORDERS,
    "purchase_order_items": PURCHASE_ORDER_ITEMS,
    "stock_transactions": STOCK_TRANSACTIONS,
    "inventory_audit_log": INVENTORY_AUDIT_LOG,
}


def not_null_columns(table: str) -> list[str]:
    return [f.name for f in TABLES[table].fields if not f.nullable]


# ---------------------------------------------------------------------------
# The declared rules of the reference schema.  Enumerations,
# CHECK predicates (as Spark SQL text; a CHECK passes when it evaluates to
# NULL), UNIQUE columns, foreign keys with their ON DELETE action, and
# defaults.  These must equal the reference's DDL.
# ---------------------------------------------------------------------------
SUPPLIER_STATUSES = ("Active", "Inactive")
PRODUCT_STATUSES = ("Active", "Inactive")
ORDER_STATUSES = ("PENDING", "SHIPPED", "DELIVERED", "CANCELLED")
TRANSACTION_TYPES = ("IN", "OUT", "ADJUSTMENT")
AUDIT_ACTIONS = ("INSERT", "UPDATE", "DELETE")

CHECKS = {
    "suppliers": [
        ("status_enum", "status IN ('Active', 'Inactive')"),
    ],
    "products": [
        ("price_nonnegative", "price >= 0"),
        ("reorder_level_nonnegative", "reorder_level >= 0"),
        ("status_enum", "status IN ('Active', 'Inactive')"),
    ],
    "purchase_orders": [
        ("total_amount_nonnegative", "total_amount >= 0"),
        ("status_enum", "status IN ('PENDING', 'SHIPPED', 'DELIVERED', 'CANCELLED')"),
    ],
    "purchase_order_items": [
        ("quantity_positive", "quantity > 0"),
        ("unit_price_nonnegative", "unit_price >= 0"),
        ("received_quantity_nonnegative", "received_quantity >= 0"),
    ],
    "stock_transactions": [
        ("transaction_type_enum", "transaction_type IN ('IN', 'OUT', 'ADJUSTMENT')"),
        ("quantity_positive", "quantity > 0"),
    ],
    "inventory_audit_log": [
        ("action_type_enum", "action_type IN ('INSERT', 'UPDATE', 'DELETE')"),
    ],
}

UNIQUE = {
    "suppliers": ["email"],
    "products": ["sku"],
}


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    on_delete: str  # "set_null" | "restrict" | "cascade"


FOREIGN_KEYS = [
    ForeignKey("products", "supplier_id", "suppliers", "set_null"),
    ForeignKey("purchase_orders", "supplier_id", "suppliers", "restrict"),
    ForeignKey("purchase_order_items", "order_id", "purchase_orders", "cascade"),
    ForeignKey("purchase_order_items", "product_id", "products", "restrict"),
    ForeignKey("stock_transactions", "product_id", "products", "cascade"),
]

# Column defaults of the DDL (applied by ``with_defaults``).
DEFAULTS = {
    "suppliers": {"status": "Active"},
    "products": {"quantity_in_stock": 0, "reorder_level": 10, "status": "Active"},
    "purchase_orders": {"total_amount": "0.00", "status": "PENDING"},
    "purchase_order_items": {"received_quantity": 0},
    "inventory_audit_log": {"changed_by": "SYSTEM"},
}

# Fixed texts: actor names of the two audit triggers, notes and reference
# labels of generated ledger rows, and the messages of refused status changes.
PRODUCT_AUDIT_ACTOR = "DB_TRIGGER_PRODUCTS"
ORDER_AUDIT_ACTOR = "DB_TRIGGER_ORDERS"
DEFAULT_ACTOR = "SYSTEM"
RECEIPT_NOTE = "Received stock from Purchase Order"
MANUAL_NOTE = "Manual stock adjustment"
MANUAL_REFERENCE = "MANUAL"
ORDER_REFERENCE_PREFIX = "PO-"
MSG_INVALID_STATUS = "Invalid purchase order status."
MSG_ORDER_NOT_FOUND = "Purchase Order not found."
MSG_TERMINAL_PREFIX = "Cannot change status of an already "
MSG_TERMINAL_SUFFIX = " order."
