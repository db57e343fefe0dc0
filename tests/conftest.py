from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from larder.session import build_session  # noqa: E402
from larder.sources import schemas as S  # noqa: E402

NOW = dt.datetime(2024, 6, 1, 12, 0, 0)


def days(n: float) -> dt.datetime:
    return NOW + dt.timedelta(days=n)


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=8)
    yield s
    s.stop()


# The seed rows whose numbers the goldens depend on (ids, skus,
# categories, prices, reorder levels, suppliers of products, ledger quantities,
# order totals and items).  Names, contacts and addresses are placeholders.
SUPPLIERS = [
    (1, "Supplier One", "Contact One", "one@example.com", "+1-555-0001", "Address 1", "Active", NOW),
    (2, "Supplier Two", "Contact Two", "two@example.com", "+1-555-0002", "Address 2", "Active", NOW),
    (3, "Supplier Three", "Contact Three", "three@example.com", "+1-555-0003", "Address 3", "Active", NOW),
]

PRODUCTS = [
    (1, "ELEC-LAP-001", "Product 1", None, "Electronics", "1200.00", 5, 1),
    (2, "ELEC-MOU-002", "Product 2", None, "Electronics", "45.00", 15, 1),
    (3, "ELEC-KEY-003", "Product 3", None, "Electronics", "99.00", 10, 1),
    (4, "OFF-PAP-010", "Product 4", None, "Office Supplies", "6.50", 50, 2),
    (5, "OFF-PEN-011", "Product 5", None, "Office Supplies", "12.00", 20, 2),
    (6, "PKG-BOX-101", "Product 6", None, "Packaging", "1.80", 100, 3),
    (7, "PKG-TAP-102", "Product 7", None, "Packaging", "3.20", 40, 3),
]

LEDGER = [
    (1, 1, "IN", 20), (2, 2, "IN", 50), (3, 3, "IN", 30), (4, 4, "IN", 200), (5, 5, "IN", 10),
    (6, 6, "IN", 500), (7, 7, "IN", 15), (8, 1, "OUT", 3), (9, 2, "OUT", 10), (10, 4, "OUT", 40),
    (11, 1, "IN", 2),
]

ORDERS = [
    (1, 1, days(-10), days(-6), days(-5), "2400.00", "DELIVERED"),
    (2, 2, days(-2), days(5), None, "195.00", "PENDING"),
    (3, 3, days(-3), days(1), None, "1280.00", "SHIPPED"),
]

ITEMS = [
    (1, 1, 1, 2, "1200.00", 2),
    (2, 2, 4, 10, "6.50", 0),
    (3, 2, 5, 10, "12.00", 0),
    (4, 3, 7, 400, "3.20", 0),
]


def make_suppliers(spark, rows=SUPPLIERS):
    return spark.createDataFrame(rows, S.SUPPLIERS)


def make_products(spark, stock=None, rows=PRODUCTS):
    stock = stock or {}
    data = [(i, sku, name, desc, cat, Decimal(price), stock.get(i, 0), reorder, sup, "Active", NOW)
            for (i, sku, name, desc, cat, price, reorder, sup) in rows]
    return spark.createDataFrame(data, S.PRODUCTS)


def make_ledger(spark, rows=LEDGER):
    data = [(i, p, t, q, "SEED", None, days(-5) if i == 11 else NOW) for (i, p, t, q) in rows]
    return spark.createDataFrame(data, S.STOCK_TRANSACTIONS)


def make_orders(spark, rows=ORDERS):
    data = [(i, s, od, ed, dd, Decimal(t), st, od, od) for (i, s, od, ed, dd, t, st) in rows]
    return spark.createDataFrame(data, S.PURCHASE_ORDERS)


def make_items(spark, rows=ITEMS):
    data = [(i, o, p, q, Decimal(u), r) for (i, o, p, q, u, r) in rows]
    return spark.createDataFrame(data, S.PURCHASE_ORDER_ITEMS)


SEED_STOCK = {1: 19, 2: 40, 3: 30, 4: 160, 5: 10, 6: 500, 7: 15}


@pytest.fixture(scope="session")
def seed(spark):
    """Tables after the seed script: stock equals the ledger sums."""
    return {
        "suppliers": make_suppliers(spark),
        "products": make_products(spark, SEED_STOCK),
        "products_empty": make_products(spark),
        "ledger": make_ledger(spark),
        "orders": make_orders(spark),
        "items": make_items(spark),
    }


def rows(df, *cols):
    """Collect selected columns as a sorted list of tuples."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
