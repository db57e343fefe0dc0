"""The inventory model over the raw tables, as DuckDB CTEs for the oracle.

Mirrors ``larder.sources.model`` definition by definition.  Raw tables are the
driver's pre-registered views (region nation ... conversations).
"""

MODEL_CTES = """
n_sup AS (SELECT count(*) AS n FROM supplier),
suppliers AS (
  SELECT CAST(s.s_suppkey AS BIGINT) AS id,
         s.s_name AS name,
         nt.n_name AS contact_name,
         lower(replace(s.s_name, '#', '-')) || '@example.com' AS email,
         '+1-555-' || CAST(s.s_suppkey AS VARCHAR) AS phone,
         'Nation ' || CAST(s.s_nationkey AS VARCHAR) AS address,
         CASE WHEN s.s_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS status,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at
  FROM supplier s LEFT JOIN nation nt ON s.s_nationkey = nt.n_nationkey
),
products AS (
  SELECT CAST(p_partkey AS BIGINT) AS id,
         p_type || '-' || CAST(p_partkey AS VARCHAR) AS sku,
         p_name AS name,
         p_brand AS description,
         p_type AS category,
         CAST(p_retailprice AS DECIMAL(12,2)) AS price,
         CAST((p_partkey * 37) % 200 AS INTEGER) AS quantity_in_stock,
         CAST(p_size AS INTEGER) AS reorder_level,
         CAST(CASE WHEN p_partkey % 11 = 0 THEN NULL
                   ELSE p_partkey % nullif((SELECT n FROM n_sup), 0) END AS BIGINT) AS supplier_id,
         CASE WHEN p_brand = 'Brand#25' THEN 'Inactive' ELSE 'Active' END AS status,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at
  FROM part
),
purchase_orders AS (
  SELECT CAST(o_orderkey AS BIGINT) AS id,
         CAST(k + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS supplier_id,
         CAST(o_orderdate AS TIMESTAMP) AS order_date,
         CAST(o_orderdate AS TIMESTAMP) + INTERVAL 14 DAY AS expected_date,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 17 <> 0
              THEN CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 30 AS INTEGER)) END AS delivery_date,
         CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount,
         CASE WHEN o_orderstatus = 'F' THEN 'DELIVERED'
              WHEN o_orderstatus = 'O' THEN 'SHIPPED'
              WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'CANCELLED'
              WHEN o_orderstatus = 'P' THEN 'PENDING' END AS status,
         CAST(o_orderdate AS TIMESTAMP) AS created_at,
         CAST(o_orderdate AS TIMESTAMP) AS updated_at
  FROM (SELECT *, o_custkey % nullif((SELECT n FROM n_sup), 0) AS k FROM orders)
),
purchase_order_items AS (
  SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id,
         CAST(l_orderkey AS BIGINT) AS order_id,
         CAST(l_partkey AS BIGINT) AS product_id,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT))
               // (2 * CAST(l_quantity AS BIGINT))) / 100 AS DECIMAL(12,2)) AS unit_price,
         CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS INTEGER) ELSE 0 END AS received_quantity
  FROM lineitem
),
stock_transactions AS (
  SELECT CAST(event_id AS BIGINT) AS id,
         CAST(user_id AS BIGINT) AS product_id,
         CASE WHEN event_type IN ('purchase', 'click') THEN 'OUT'
              WHEN event_type = 'error' THEN 'ADJUSTMENT' ELSE 'IN' END AS transaction_type,
         CAST(greatest(1, ceil(value)) AS INTEGER) AS quantity,
         'EV-' || CAST(event_id AS VARCHAR) AS reference_id,
         event_type AS notes,
         CAST(ts AS TIMESTAMP) AS transaction_date
  FROM events
),
ledger_bulk AS (
  SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id,
         CAST(l_partkey AS BIGINT) AS product_id,
         CASE l_returnflag WHEN 'R' THEN 'IN' WHEN 'N' THEN 'OUT' WHEN 'A' THEN 'ADJUSTMENT' END AS transaction_type,
         CAST(l_quantity AS INTEGER) AS quantity
  FROM lineitem
),
products_synced AS (
  SELECT p.id, p.sku, p.name, p.description, p.category, p.price,
         CAST(coalesce(b.stock, 0) + CASE WHEN p.id % 50 = 0 THEN 7 ELSE 0 END AS INTEGER) AS quantity_in_stock,
         p.reorder_level, p.supplier_id, p.status, p.created_at
  FROM products p LEFT JOIN (
    SELECT product_id, sum(CASE transaction_type WHEN 'IN' THEN quantity WHEN 'OUT' THEN -quantity
                                WHEN 'ADJUSTMENT' THEN quantity ELSE 0 END) AS stock
    FROM ledger_bulk GROUP BY product_id) b ON p.id = b.product_id
),
products_faulty AS (
  SELECT p.id, coalesce(q.sku, p.sku) AS sku, p.name, p.description, p.category,
         CASE WHEN p.id % 97 = 0 THEN -p.price ELSE p.price END AS price,
         p.quantity_in_stock, p.reorder_level, p.supplier_id, p.status, p.created_at
  FROM products p LEFT JOIN products q ON p.id = q.id + 1 AND p.id % 101 = 0
),
ledger_faulty AS (
  SELECT id, CASE WHEN id % 103 = 0 THEN -product_id - 1 ELSE product_id END AS product_id,
         transaction_type, quantity, reference_id, notes, transaction_date
  FROM stock_transactions
)
"""


def with_model(body: str, extra_ctes: str = "", recursive: bool = False) -> str:
    """Prefix a query body with the model CTEs (and optional extra CTEs)."""
    head = "WITH RECURSIVE" if recursive else "WITH"
    ctes = MODEL_CTES.strip()
    if extra_ctes.strip():
        ctes = ctes + ",\n" + extra_ctes.strip()
    return f"{head}\n{ctes}\n{body.strip()}"
