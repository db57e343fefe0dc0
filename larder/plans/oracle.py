"""DuckDB oracle SQL per key (same model CTEs as the Spark side)."""

from __future__ import annotations

from larder.plans.model_sql import with_model
from larder.sources.model import FAULTS

ORACLE: dict[str, str] = {}


def sql(name: str, body: str, extra: str = "", recursive: bool = False) -> None:
    ORACLE[name] = with_model(body, extra, recursive)


# -- views and dashboard ------------------------------------------------------

VALUATION = """
valuation AS (
  SELECT category, CAST(count(id) AS BIGINT) AS product_count,
         CAST(sum(quantity_in_stock) AS BIGINT) AS total_items,
         sum(quantity_in_stock * price) AS total_valuation
  FROM products WHERE status = 'Active' GROUP BY category
)"""

PERFORMANCE = """
perf AS (
  SELECT s.id AS supplier_id, s.name AS supplier_name, s.contact_name, s.email,
         CAST(count(po.id) AS BIGINT) AS total_orders,
         CAST(coalesce(sum(po.total_amount), 0) AS DOUBLE) AS total_spend,
         avg(CASE WHEN po.status = 'DELIVERED' AND po.delivery_date IS NOT NULL
                  THEN epoch_us(po.delivery_date) - epoch_us(po.order_date) END) / 86400000000.0
           AS avg_lead_time_days,
         CAST(sum(CASE WHEN po.status = 'DELIVERED' THEN 1 ELSE 0 END) AS DOUBLE)
           / nullif(count(po.id), 0) * 100 AS fulfillment_rate
  FROM suppliers s LEFT JOIN purchase_orders po ON s.id = po.supplier_id
  GROUP BY s.id, s.name, s.contact_name, s.email
)"""

ALERTS = """
alerts AS (
  SELECT p.id AS product_id, p.sku, p.name AS product_name, p.quantity_in_stock, p.reorder_level,
         p.category, (p.reorder_level * 2) - p.quantity_in_stock AS recommended_order_qty,
         s.id AS supplier_id, s.name AS supplier_name, s.email AS supplier_email
  FROM products p LEFT JOIN suppliers s ON p.supplier_id = s.id
  WHERE p.quantity_in_stock <= p.reorder_level AND p.status = 'Active'
)"""

sql("stock_valuation", """
SELECT category, product_count, total_items, CAST(total_valuation AS DOUBLE) AS total_valuation
FROM valuation""", VALUATION)

sql("low_stock_alerts", "SELECT * FROM alerts", ALERTS)

sql("supplier_performance", "SELECT * FROM perf", PERFORMANCE)

sql("supplier_rating", """
SELECT supplier_id, fulfillment_rate,
       CASE WHEN fulfillment_rate IS NULL THEN 'info' WHEN fulfillment_rate >= 80 THEN 'success'
            WHEN fulfillment_rate >= 50 THEN 'warning' ELSE 'danger' END AS rating
FROM perf""", PERFORMANCE)

sql("dashboard_kpis", """
SELECT CAST(coalesce((SELECT sum(total_valuation) FROM valuation), 0) AS DOUBLE) AS total_valuation,
       CAST(coalesce((SELECT sum(total_items) FROM valuation), 0) AS BIGINT) AS total_items,
       CAST(coalesce((SELECT sum(product_count) FROM valuation), 0) AS BIGINT) AS total_products,
       (SELECT count(*) FROM alerts) AS low_stock_alert_count,
       (SELECT count(*) FROM purchase_orders WHERE status IN ('PENDING', 'SHIPPED')) AS active_po_count,
       (SELECT count(*) FROM suppliers WHERE status = 'Active') AS supplier_count""",
    VALUATION + "," + ALERTS)

sql("valuation_share", """
SELECT category, CAST(total_valuation AS DOUBLE) AS total_valuation,
       CAST(total_valuation AS DOUBLE) / greatest((SELECT max(CAST(total_valuation AS DOUBLE)) FROM valuation), 1.0)
         * 100 AS pct_of_max
FROM valuation""", VALUATION)


# -- listings and top-k -------------------------------------------------------

PRODUCT_COLS = """p.id, p.sku, p.name, p.description, p.category, CAST(p.price AS DOUBLE) AS price,
       p.quantity_in_stock, p.reorder_level, p.supplier_id, p.status, p.created_at"""

ORDER_COLS = """o.id, o.supplier_id, o.order_date, o.expected_date, o.delivery_date,
       CAST(o.total_amount AS DOUBLE) AS total_amount, o.status, o.created_at, o.updated_at"""

LEDGER_COLS = "t.id, t.product_id, t.transaction_type, t.quantity, t.reference_id, t.notes, t.transaction_date"

sql("product_listing", f"""
SELECT {PRODUCT_COLS}, s.name AS supplier_name, p.quantity_in_stock <= p.reorder_level AS is_low_stock
FROM products p LEFT JOIN suppliers s ON p.supplier_id = s.id""")

sql("supplier_directory", "SELECT * FROM suppliers")

sql("order_listing", f"""
SELECT {ORDER_COLS}, s.name AS supplier_name, o.status IN ('PENDING', 'SHIPPED') AS is_open
FROM purchase_orders o JOIN suppliers s ON o.supplier_id = s.id""")

sql("order_items_enriched", """
SELECT i.order_id, i.product_id, i.quantity, CAST(i.unit_price AS DOUBLE) AS unit_price, i.received_quantity,
       p.name AS product_name, p.sku AS product_sku, i.received_quantity = i.quantity AS fully_received
FROM purchase_order_items i JOIN products p ON i.product_id = p.id""")

sql("orders_nested", """
SELECT o.id AS order_id, CAST(count(i.order_id) AS BIGINT) AS item_count,
       CAST(coalesce(sum(i.quantity), 0) AS BIGINT) AS total_quantity,
       min(i.product_sku) AS min_sku, max(i.product_sku) AS max_sku
FROM purchase_orders o JOIN suppliers s ON o.supplier_id = s.id
LEFT JOIN (SELECT i.order_id, i.quantity, p.sku AS product_sku
           FROM purchase_order_items i JOIN products p ON i.product_id = p.id) i ON i.order_id = o.id
GROUP BY o.id""")

sql("ledger_listing", f"""
SELECT {LEDGER_COLS}, p.name AS product_name, p.sku AS product_sku
FROM stock_transactions t JOIN products p ON t.product_id = p.id""")

sql("recent_movements", f"""
SELECT {LEDGER_COLS}, p.name AS product_name, p.sku AS product_sku
FROM stock_transactions t JOIN products p ON t.product_id = p.id
ORDER BY t.id DESC LIMIT 5""")

sql("low_stock_top", """
SELECT product_id, product_name, sku, supplier_name, quantity_in_stock, recommended_order_qty,
       (SELECT count(*) FROM alerts) AS total_alerts,
       greatest((SELECT count(*) FROM alerts) - 4, 0) AS remaining
FROM alerts ORDER BY product_id LIMIT 4""", ALERTS)

sql("lookup_by_keys", f"""
SELECT {PRODUCT_COLS} FROM products p
WHERE p.id IN (SELECT i.product_id FROM purchase_order_items i
               JOIN purchase_orders o ON i.order_id = o.id WHERE o.status = 'PENDING')""")

sql("adhoc_category_filter", f"SELECT {PRODUCT_COLS} FROM products p WHERE p.category = 'PROMO'")


# -- ledger -------------------------------------------------------------------

SIGNED = ("CASE transaction_type WHEN 'IN' THEN quantity WHEN 'OUT' THEN -quantity "
          "WHEN 'ADJUSTMENT' THEN quantity ELSE 0 END")

sql("ledger_stock", f"""
SELECT product_id, CAST(sum({SIGNED}) AS BIGINT) AS stock FROM ledger_bulk GROUP BY product_id""")

sql("ledger_running_stock", f"""
SELECT id, product_id, transaction_type, quantity,
       CAST(run - s AS BIGINT) AS stock_before, CAST(run AS BIGINT) AS stock_after
FROM (SELECT *, sum(s) OVER (PARTITION BY product_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS run
      FROM (SELECT id, product_id, transaction_type, quantity, {SIGNED} AS s FROM stock_transactions))""")

sql("apply_ledger", f"""
SELECT p.id AS product_id, CAST(p.quantity_in_stock + coalesce(l.stock, 0) AS INTEGER) AS quantity_in_stock
FROM products p LEFT JOIN (SELECT product_id, sum({SIGNED}) AS stock FROM stock_transactions GROUP BY product_id) l
  ON p.id = l.product_id""")

GUARD_CTES = f"""
sx AS (
  SELECT id, product_id, transaction_type, quantity, CAST({SIGNED} AS BIGINT) AS s,
         row_number() OVER (PARTITION BY product_id ORDER BY id) AS rn
  FROM stock_transactions
),
g AS (
  SELECT id, product_id, transaction_type, quantity, s, rn, CAST(0 AS BIGINT) AS stock_before,
         s >= 0 AS accepted, CAST(CASE WHEN s >= 0 THEN s ELSE 0 END AS BIGINT) AS stock_after
  FROM sx WHERE rn = 1
  UNION ALL
  SELECT x.id, x.product_id, x.transaction_type, x.quantity, x.s, x.rn, g.stock_after,
         g.stock_after + x.s >= 0,
         CASE WHEN g.stock_after + x.s >= 0 THEN g.stock_after + x.s ELSE g.stock_after END
  FROM g JOIN sx x ON x.product_id = g.product_id AND x.rn = g.rn + 1
)"""

sql("ledger_guard", """
SELECT id, product_id, transaction_type, quantity, accepted, stock_before, stock_after,
       CASE WHEN accepted THEN NULL ELSE 'negative_stock' END AS reason
FROM g""", GUARD_CTES, recursive=True)

RECON = f"""
recon AS (
  SELECT p.id AS product_id, p.sku, p.name, CAST(p.quantity_in_stock AS BIGINT) AS actual_stock,
         CAST(coalesce(l.stock, 0) AS BIGINT) AS computed_stock,
         CAST(coalesce(l.stock, 0) - p.quantity_in_stock AS BIGINT) AS discrepancy
  FROM products_synced p
  LEFT JOIN (SELECT product_id, sum({SIGNED}) AS stock FROM ledger_bulk GROUP BY product_id) l
    ON p.id = l.product_id
)"""

sql("reconcile_report", """
SELECT *, false AS reconciled,
       CASE WHEN discrepancy <> 0 THEN 'Discrepancy' ELSE 'Matched' END AS status_label,
       CASE WHEN discrepancy > 0 THEN '+' || CAST(discrepancy AS VARCHAR) ELSE CAST(discrepancy AS VARCHAR) END
         AS discrepancy_text
FROM recon""", RECON)

sql("reconcile_summary", """
SELECT coalesce(bool_or(discrepancy <> 0), false) AS has_discrepancy,
       CAST(count(*) FILTER (WHERE discrepancy <> 0) AS BIGINT) AS discrepancy_count
FROM recon""", RECON)

sql("reconcile_fix", """
SELECT product_id, sku, name,
       CASE WHEN discrepancy <> 0 AND computed_stock >= 0 THEN computed_stock ELSE actual_stock END AS actual_stock,
       computed_stock, discrepancy,
       discrepancy <> 0 AND computed_stock >= 0 AS reconciled,
       discrepancy <> 0 AND computed_stock < 0 AS blocked
FROM recon""", RECON)


sql("reconcile_fix_products", """
SELECT p.id, p.sku, CAST(CASE WHEN r.discrepancy <> 0 AND r.computed_stock >= 0 THEN r.computed_stock
                              ELSE p.quantity_in_stock END AS INTEGER) AS quantity_in_stock,
       CAST(p.price AS DOUBLE) AS price
FROM products_synced p JOIN recon r ON p.id = r.product_id""", RECON)


# -- orders -------------------------------------------------------------------

UNIT_PRICE = ("CAST(((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT))"
              " // (2 * CAST(l_quantity AS BIGINT))) / 100 AS DECIMAL(12,2))")

sql("item_guard", """
SELECT order_id, product_id, reason IS NULL AS accepted, reason FROM (
  SELECT c.order_id, c.product_id,
         CASE WHEN o.status IS NOT NULL AND o.status <> 'PENDING' THEN 'not_pending'
              WHEN c.quantity IS NULL OR c.quantity <= 0 OR c.unit_price IS NULL OR c.unit_price < 0
                   OR c.received_quantity < 0 THEN 'check'
              WHEN o.id IS NULL THEN 'no_order'
              WHEN p.id IS NULL THEN 'no_product' END AS reason
  FROM cand c LEFT JOIN purchase_orders o ON c.order_id = o.id LEFT JOIN products p ON c.product_id = p.id)""",
    f"""
cand AS (
  SELECT CAST(CASE WHEN l_partkey % 211 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END AS BIGINT) AS order_id,
         CAST(l_partkey AS BIGINT) AS product_id,
         CASE WHEN l_suppkey % 13 = 0 AND l_linenumber = 1 THEN -CAST(l_quantity AS INTEGER)
              ELSE CAST(l_quantity AS INTEGER) END AS quantity,
         {UNIT_PRICE} AS unit_price, 0 AS received_quantity
  FROM lineitem
)""")

sql("order_totals", """
SELECT o.id AS order_id, CAST(o.total_amount AS DOUBLE) AS header_total,
       CAST(coalesce(i.t, 0) AS DOUBLE) AS item_total,
       CAST(o.total_amount - coalesce(i.t, 0) AS DOUBLE) AS difference
FROM purchase_orders o
LEFT JOIN (SELECT order_id, sum(quantity * unit_price) AS t FROM purchase_order_items GROUP BY order_id) i
  ON o.id = i.order_id""")

ORDER_REQUESTS = f"""
oreq AS (
  SELECT CAST(l_orderkey AS BIGINT) AS request_id, CAST(l_linenumber AS INTEGER) AS line,
         CAST(l_partkey AS BIGINT) AS product_id,
         CASE WHEN l_orderkey % 19 = 0 AND l_linenumber = 1 THEN -CAST(l_quantity AS INTEGER)
              ELSE CAST(l_quantity AS INTEGER) END AS quantity,
         CASE WHEN l_linenumber = 2 THEN NULL ELSE {UNIT_PRICE} END AS unit_price
  FROM lineitem
),
oi AS (
  SELECT r.*, p.id AS pid, coalesce(r.unit_price, p.price) AS unit
  FROM oreq r LEFT JOIN products p ON r.product_id = p.id
),
oi2 AS (
  SELECT *, (product_id IS NULL OR product_id = 0 OR quantity IS NULL OR quantity = 0
             OR unit IS NULL OR unit = 0) AS missing,
         CASE WHEN quantity < 0 THEN 'check' WHEN unit < 0 THEN 'check'
              WHEN pid IS NULL THEN 'no_product' END AS bad
  FROM oi
),
oagg AS (
  SELECT request_id, count(*) AS n, max(CAST(missing AS INTEGER)) AS anymiss,
         min(CASE WHEN NOT missing AND bad IS NOT NULL THEN struct_pack(line := line, r := bad) END) AS first_bad,
         sum(quantity * unit) AS total
  FROM oi2 GROUP BY request_id
)"""

ORDER_VERDICTS = """FROM (
  SELECT h.*, CASE WHEN h.supplier_id IS NULL OR h.supplier_id = 0 OR coalesce(h.n, 0) = 0 THEN 'missing_field'
                   WHEN h.anymiss = 1 THEN 'missing_field'
                   WHEN h.total < 0 OR (h.total IS NOT NULL AND TRY_CAST(h.total AS DECIMAL(12,2)) IS NULL) THEN 'check'
                   WHEN h.sid IS NULL THEN 'no_supplier'
                   ELSE h.first_bad.r END AS reason
  FROM (SELECT o.id AS request_id, o.supplier_id, o.expected_date, a.n, a.anymiss, a.first_bad, a.total,
               s.id AS sid
        FROM purchase_orders o LEFT JOIN oagg a ON o.id = a.request_id
        LEFT JOIN suppliers s ON o.supplier_id = s.id) h)"""

sql("order_create", f"""
SELECT request_id AS id, supplier_id, TIMESTAMP '2002-01-01 00:00:00' AS order_date, expected_date,
       CAST(TRY_CAST(total AS DECIMAL(12,2)) AS DOUBLE) AS total_amount, 'PENDING' AS status
{ORDER_VERDICTS}
WHERE reason IS NULL""", ORDER_REQUESTS)

sql("order_create_rejects", f"""
SELECT request_id, reason
{ORDER_VERDICTS}
WHERE reason IS NOT NULL""", ORDER_REQUESTS)

sql("order_create_items", f"""
SELECT request_id AS order_id, line, product_id, quantity, CAST(unit AS DOUBLE) AS unit_price, 0 AS received_quantity
FROM oi2 WHERE request_id IN (SELECT request_id
{ORDER_VERDICTS}
WHERE reason IS NULL)""", ORDER_REQUESTS)

TRANSITION = """
status_req AS (
  SELECT CAST(o_orderkey AS BIGINT) AS order_id, 1 AS seq,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'DELIVERED' WHEN '2-HIGH' THEN 'SHIPPED'
              WHEN '3-MEDIUM' THEN 'CANCELLED' WHEN '4-NOT SPECIFIED' THEN 'BOGUS' ELSE 'PENDING' END AS status
  FROM orders
  UNION ALL SELECT CAST(o_orderkey AS BIGINT), 2, 'DELIVERED' FROM orders
            WHERE o_orderpriority IN ('2-HIGH', '5-LOW')
  UNION ALL SELECT CAST(-o_orderkey - 1 AS BIGINT), 1, 'SHIPPED' FROM orders
            WHERE o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P'
),
tr0 AS (
  SELECT r.order_id, r.seq, r.status AS requested, o.id AS oid, o.status AS orig,
         r.status IN ('PENDING', 'SHIPPED', 'DELIVERED', 'CANCELLED') AS valid
  FROM status_req r LEFT JOIN purchase_orders o ON r.order_id = o.id
),
tr1 AS (
  SELECT *, coalesce(orig IN ('DELIVERED', 'CANCELLED'), false)
            OR coalesce(max(CASE WHEN valid AND requested IN ('DELIVERED', 'CANCELLED') THEN 1 ELSE 0 END)
                OVER (PARTITION BY order_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1
            AS terminal_before
  FROM tr0
),
tr2 AS (SELECT *, valid AND oid IS NOT NULL AND NOT terminal_before AS applied FROM tr1),
tr3 AS (
  SELECT *, coalesce(last_value(CASE WHEN applied THEN requested END IGNORE NULLS)
                     OVER (PARTITION BY order_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                     orig) AS old_status,
         CASE WHEN NOT valid THEN 'invalid_status' WHEN oid IS NULL THEN 'not_found'
              WHEN terminal_before THEN 'terminal' ELSE 'applied' END AS outcome
  FROM tr2
)"""

sql("order_transition", """
SELECT order_id, seq, old_status, requested, outcome,
       CASE outcome WHEN 'invalid_status' THEN 'Invalid purchase order status.'
                    WHEN 'not_found' THEN 'Purchase Order not found.'
                    WHEN 'terminal' THEN 'Cannot change status of an already ' || lower(old_status) || ' order.'
       END AS message
FROM tr3""", TRANSITION)

sql("order_receipt_ledger", """
SELECT i.product_id, 'IN' AS transaction_type, i.quantity, 'PO-' || CAST(i.order_id AS VARCHAR) AS reference_id,
       'Received stock from Purchase Order' AS notes
FROM purchase_order_items i
JOIN (SELECT DISTINCT order_id FROM tr3 WHERE applied AND requested = 'DELIVERED') d ON i.order_id = d.order_id""",
    TRANSITION)

sql("order_audit", """
SELECT order_id AS record_id, seq, old_status, requested AS new_status, 'DB_TRIGGER_ORDERS' AS changed_by
FROM tr3 WHERE applied AND old_status <> requested""", TRANSITION)

sql("order_transition_orders", """
SELECT o.id, o.supplier_id, o.order_date, o.expected_date,
       CASE WHEN f.final IS NULL THEN o.delivery_date WHEN f.final = 'DELIVERED' THEN TIMESTAMP '2002-01-01 00:00:00' END
         AS delivery_date,
       CAST(o.total_amount AS DOUBLE) AS total_amount, coalesce(f.final, o.status) AS status
FROM purchase_orders o
LEFT JOIN (SELECT order_id, arg_max(requested, seq) AS final FROM tr3 WHERE applied GROUP BY order_id) f
  ON o.id = f.order_id""", TRANSITION)

sql("order_transition_items", """
SELECT i.order_id, i.product_id, i.quantity,
       CASE WHEN d.order_id IS NOT NULL THEN i.quantity ELSE i.received_quantity END AS received_quantity
FROM purchase_order_items i
LEFT JOIN (SELECT DISTINCT order_id FROM tr3 WHERE applied AND requested = 'DELIVERED') d ON i.order_id = d.order_id""",
    TRANSITION)


# -- catalogue ----------------------------------------------------------------

PATCH = """
patches AS (
  SELECT CAST(p_partkey AS BIGINT) AS id, CAST(1 AS BIGINT) AS seq,
         CAST(CASE WHEN p_size = 1 THEN -1.0 WHEN p_size > 30 THEN p_retailprice + 10 END
              AS DECIMAL(12,2)) AS n_price, CAST(NULL AS INTEGER) AS n_reorder,
         CASE WHEN p_type = 'PROMO' THEN 'Inactive' END AS n_status
  FROM part
  UNION ALL SELECT p_partkey, 2, CAST(p_retailprice + 20 AS DECIMAL(12,2)), 7, NULL FROM part WHERE p_size > 40
  UNION ALL SELECT p_partkey, 3, 1, NULL, 'Gone' FROM part WHERE p_size > 45
),
pp AS (
  SELECT p.*, x.seq, x.n_price, x.n_reorder, x.n_status,
         CASE WHEN p.quantity_in_stock < 0 THEN 'negative_stock'
              WHEN coalesce(coalesce(x.n_price, p.price) < 0, false)
                   OR coalesce(coalesce(x.n_reorder, p.reorder_level) < 0, false)
                   OR coalesce(coalesce(x.n_status, p.status) NOT IN ('Active', 'Inactive'), false) THEN 'check'
              END AS reason
  FROM products p JOIN patches x ON p.id = x.id
),
ps AS (
  SELECT a.id, a.seq, a.name, a.category, a.supplier_id, a.sku, a.quantity_in_stock, a.reason,
         coalesce((SELECT arg_max(b.n_price, b.seq) FROM pp b WHERE b.id = a.id AND b.seq <= a.seq
                   AND b.reason IS NULL AND b.n_price IS NOT NULL), a.price) AS v_price,
         coalesce((SELECT arg_max(b.n_price, b.seq) FROM pp b WHERE b.id = a.id AND b.seq < a.seq
                   AND b.reason IS NULL AND b.n_price IS NOT NULL), a.price) AS o_price,
         coalesce((SELECT arg_max(b.n_reorder, b.seq) FROM pp b WHERE b.id = a.id AND b.seq <= a.seq
                   AND b.reason IS NULL AND b.n_reorder IS NOT NULL), a.reorder_level) AS v_reorder,
         coalesce((SELECT arg_max(b.n_status, b.seq) FROM pp b WHERE b.id = a.id AND b.seq <= a.seq
                   AND b.reason IS NULL AND b.n_status IS NOT NULL), a.status) AS v_status
  FROM pp a
)"""

sql("product_patch", """
SELECT id AS product_id, seq, name, category, CAST(v_price AS DOUBLE) AS price, v_reorder AS reorder_level, supplier_id,
       v_status AS status, reason IS NOT NULL AS refused, reason
FROM ps""", PATCH)

sql("product_patch_products", """
SELECT id, sku, CAST(v_price AS DOUBLE) AS price, v_reorder AS reorder_level, v_status AS status
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM ps) WHERE r = 1""", PATCH)

sql("product_audit", """
SELECT id AS record_id, quantity_in_stock AS old_quantity, quantity_in_stock AS new_quantity,
       CAST(o_price AS DOUBLE) AS old_price, CAST(v_price AS DOUBLE) AS new_price
FROM ps WHERE reason IS NULL AND v_price <> o_price""", PATCH)

sql("ingest_requests", """
SELECT request_id, product_id, transaction_type, quantity, 'MANUAL' AS reference_id,
       CASE WHEN notes IS NULL OR notes = '' THEN 'Manual stock adjustment' ELSE notes END AS notes
FROM (
  SELECT request_id, pid_text, transaction_type, qty_text, notes,
         TRY_CAST(pid_text AS BIGINT) AS product_id, TRY_CAST(qty_text AS INTEGER) AS quantity
  FROM (
    SELECT request_id, json_extract_string(body, '$.product_id') AS pid_text,
           json_extract_string(body, '$.transaction_type') AS transaction_type,
           json_extract_string(body, '$.quantity') AS qty_text,
           json_extract_string(body, '$.notes') AS notes
    FROM bodies))
WHERE NOT (pid_text IS NULL OR pid_text = '' OR transaction_type IS NULL OR transaction_type = ''
           OR qty_text IS NULL OR qty_text = '')
  AND product_id IS NOT NULL AND quantity IS NOT NULL AND product_id <> 0 AND quantity > 0
  AND transaction_type IN ('IN', 'OUT', 'ADJUSTMENT')""", """
bodies AS (
  SELECT CAST(event_id AS BIGINT) AS request_id,
         json_object('product_id', CAST(user_id AS VARCHAR),
                     'transaction_type', CASE WHEN event_type = 'signup' THEN NULL
                                              WHEN event_type IN ('purchase', 'click') THEN 'OUT' ELSE 'IN' END,
                     'quantity', CASE WHEN event_type = 'error' THEN 'n/a'
                                      ELSE CAST(CAST(greatest(1, ceil(value)) AS BIGINT) AS VARCHAR) END,
                     'notes', props)::VARCHAR AS body
  FROM events
)""")

PRODUCT_REQUESTS = """
preq AS (
  SELECT CAST(-p_partkey - 1 AS BIGINT) AS request_id,
         CASE WHEN p_size = 49 THEN p_type || '-' || CAST(p_partkey AS VARCHAR)
              ELSE '  ' || lower(p_type) || '-n' || CAST(p_partkey // 2 AS VARCHAR) || ' ' END AS sku,
         CASE WHEN p_size < 3 THEN NULL ELSE 'New ' || p_name END AS name,
         p_brand AS description, p_type AS category,
         CAST(CASE WHEN p_size = 50 THEN -p_retailprice ELSE p_retailprice END AS DECIMAL(12,2)) AS price,
         CAST(CASE WHEN p_size > 25 THEN p_size END AS INTEGER) AS reorder_level,
         CAST(CASE WHEN p_size = 48 THEN 999999999 ELSE p_partkey % 7 END AS BIGINT) AS supplier_id
  FROM part
),
pr1 AS (
  SELECT r.*, upper(trim(r.sku)) AS nsku,
         CAST(CASE WHEN coalesce(reorder_level, 0) = 0 THEN 0 ELSE reorder_level END AS INTEGER) AS nreorder,
         CAST(CASE WHEN coalesce(supplier_id, 0) = 0 THEN NULL ELSE supplier_id END AS BIGINT) AS nsupp
  FROM preq r
),
pr2 AS (
  SELECT r.*, e.sku AS esku, s.id AS sid
  FROM pr1 r LEFT JOIN (SELECT DISTINCT sku FROM products) e ON r.nsku = e.sku
  LEFT JOIN suppliers s ON r.nsupp = s.id
),
pr3 AS (
  SELECT *, CASE WHEN sku IS NULL OR sku = '' OR name IS NULL OR name = '' OR category IS NULL OR category = ''
                      OR price IS NULL THEN 'missing_field'
                 WHEN price < 0 OR nreorder < 0 THEN 'check'
                 WHEN esku IS NOT NULL THEN 'duplicate_sku' END AS pre
  FROM pr2
),
pw AS (
  SELECT nsku, min(request_id) AS winner FROM pr3
  WHERE pre IS NULL AND (nsupp IS NULL OR sid IS NOT NULL) GROUP BY nsku
)"""

sql("product_create", """
SELECT request_id AS id, nsku AS sku, name, description, category, CAST(price AS DOUBLE) AS price,
       0 AS quantity_in_stock, nreorder AS reorder_level, nsupp AS supplier_id, 'Active' AS status,
       TIMESTAMP '2002-01-01 00:00:00' AS created_at
FROM (
  SELECT r.*, CASE WHEN pre IS NOT NULL THEN pre WHEN r.request_id = w.winner THEN NULL
                   WHEN r.request_id > w.winner THEN 'duplicate_sku' ELSE 'no_supplier' END AS reason
  FROM pr3 r LEFT JOIN pw w ON r.nsku = w.nsku)
WHERE reason IS NULL""", PRODUCT_REQUESTS)

sql("product_create_rejects", """
SELECT request_id, reason
FROM (
  SELECT r.*, CASE WHEN pre IS NOT NULL THEN pre WHEN r.request_id = w.winner THEN NULL
                   WHEN r.request_id > w.winner THEN 'duplicate_sku' ELSE 'no_supplier' END AS reason
  FROM pr3 r LEFT JOIN pw w ON r.nsku = w.nsku)
WHERE reason IS NOT NULL""", PRODUCT_REQUESTS)

SUPPLIER_REQUESTS = """
sreq AS (
  SELECT CAST(-c_custkey - 1 AS BIGINT) AS request_id, c_name AS name, c_mktsegment AS contact_name,
         CASE WHEN c_mktsegment = 'BUILDING'
                THEN lower(replace(replace(c_name, 'Customer', 'Supplier'), '#', '-')) || '@example.com'
              WHEN c_mktsegment = 'MACHINERY'
                THEN 'machinery-' || CAST(c_custkey // 2 AS VARCHAR) || '@example.com'
              ELSE lower(replace(c_name, '#', '-')) || '@example.com' END AS email,
         CASE WHEN c_acctbal < 0 THEN NULL ELSE '+1-555-' || CAST(c_custkey AS VARCHAR) END AS phone,
         'Nation ' || CAST(c_nationkey AS VARCHAR) AS address
  FROM customer
),
sr2 AS (
  SELECT r.*, CASE WHEN name IS NULL OR name = '' OR contact_name IS NULL OR contact_name = ''
                        OR r.email IS NULL OR r.email = '' OR phone IS NULL OR phone = ''
                        OR address IS NULL OR address = '' THEN 'missing_field'
                   WHEN e.email IS NOT NULL THEN 'duplicate_email' END AS pre
  FROM sreq r LEFT JOIN (SELECT DISTINCT email FROM suppliers) e ON r.email = e.email
),
sw AS (SELECT email, min(request_id) AS winner FROM sr2 WHERE pre IS NULL GROUP BY email)"""

sql("supplier_create", """
SELECT request_id AS id, name, contact_name, email, phone, address, 'Active' AS status,
       TIMESTAMP '2002-01-01 00:00:00' AS created_at
FROM (
  SELECT r.*, CASE WHEN pre IS NOT NULL THEN pre WHEN r.request_id = w.winner THEN NULL
                   ELSE 'duplicate_email' END AS reason
  FROM sr2 r LEFT JOIN sw w ON r.email = w.email)
WHERE reason IS NULL""", SUPPLIER_REQUESTS)


sql("supplier_create_rejects", """
SELECT request_id, reason
FROM (
  SELECT r.*, CASE WHEN pre IS NOT NULL THEN pre WHEN r.request_id = w.winner THEN NULL
                   ELSE 'duplicate_email' END AS reason
  FROM sr2 r LEFT JOIN sw w ON r.email = w.email)
WHERE reason IS NOT NULL""", SUPPLIER_REQUESTS)


# -- integrity ----------------------------------------------------------------

# The rules in full, apart from the list that the operator reads.
sql("check_violations", """
SELECT 'suppliers' AS table_name, 'status_enum' AS rule, id AS row_id FROM suppliers WHERE NOT (status IN ('Active', 'Inactive'))
UNION ALL SELECT 'suppliers', 'id_not_null', id FROM suppliers WHERE id IS NULL
UNION ALL SELECT 'suppliers', 'name_not_null', id FROM suppliers WHERE name IS NULL
UNION ALL SELECT 'suppliers', 'contact_name_not_null', id FROM suppliers WHERE contact_name IS NULL
UNION ALL SELECT 'suppliers', 'email_not_null', id FROM suppliers WHERE email IS NULL
UNION ALL SELECT 'suppliers', 'phone_not_null', id FROM suppliers WHERE phone IS NULL
UNION ALL SELECT 'suppliers', 'address_not_null', id FROM suppliers WHERE address IS NULL
UNION ALL SELECT 'products' AS table_name, 'price_nonnegative' AS rule, id AS row_id FROM products_faulty WHERE NOT (price >= 0)
UNION ALL SELECT 'products' AS table_name, 'reorder_level_nonnegative' AS rule, id AS row_id FROM products_faulty WHERE NOT (reorder_level >= 0)
UNION ALL SELECT 'products' AS table_name, 'status_enum' AS rule, id AS row_id FROM products_faulty WHERE NOT (status IN ('Active', 'Inactive'))
UNION ALL SELECT 'products', 'id_not_null', id FROM products_faulty WHERE id IS NULL
UNION ALL SELECT 'products', 'sku_not_null', id FROM products_faulty WHERE sku IS NULL
UNION ALL SELECT 'products', 'name_not_null', id FROM products_faulty WHERE name IS NULL
UNION ALL SELECT 'products', 'category_not_null', id FROM products_faulty WHERE category IS NULL
UNION ALL SELECT 'products', 'price_not_null', id FROM products_faulty WHERE price IS NULL
UNION ALL SELECT 'products', 'quantity_in_stock_not_null', id FROM products_faulty WHERE quantity_in_stock IS NULL
UNION ALL SELECT 'products', 'reorder_level_not_null', id FROM products_faulty WHERE reorder_level IS NULL
UNION ALL SELECT 'purchase_orders' AS table_name, 'total_amount_nonnegative' AS rule, id AS row_id FROM purchase_orders WHERE NOT (total_amount >= 0)
UNION ALL SELECT 'purchase_orders' AS table_name, 'status_enum' AS rule, id AS row_id FROM purchase_orders WHERE NOT (status IN ('PENDING', 'SHIPPED', 'DELIVERED', 'CANCELLED'))
UNION ALL SELECT 'purchase_orders', 'id_not_null', id FROM purchase_orders WHERE id IS NULL
UNION ALL SELECT 'purchase_orders', 'supplier_id_not_null', id FROM purchase_orders WHERE supplier_id IS NULL
UNION ALL SELECT 'purchase_order_items' AS table_name, 'quantity_positive' AS rule, id AS row_id FROM purchase_order_items WHERE NOT (quantity > 0)
UNION ALL SELECT 'purchase_order_items' AS table_name, 'unit_price_nonnegative' AS rule, id AS row_id FROM purchase_order_items WHERE NOT (unit_price >= 0)
UNION ALL SELECT 'purchase_order_items' AS table_name, 'received_quantity_nonnegative' AS rule, id AS row_id FROM purchase_order_items WHERE NOT (received_quantity >= 0)
UNION ALL SELECT 'purchase_order_items', 'id_not_null', id FROM purchase_order_items WHERE id IS NULL
UNION ALL SELECT 'purchase_order_items', 'order_id_not_null', id FROM purchase_order_items WHERE order_id IS NULL
UNION ALL SELECT 'purchase_order_items', 'product_id_not_null', id FROM purchase_order_items WHERE product_id IS NULL
UNION ALL SELECT 'purchase_order_items', 'quantity_not_null', id FROM purchase_order_items WHERE quantity IS NULL
UNION ALL SELECT 'purchase_order_items', 'unit_price_not_null', id FROM purchase_order_items WHERE unit_price IS NULL
UNION ALL SELECT 'stock_transactions' AS table_name, 'transaction_type_enum' AS rule, id AS row_id FROM stock_transactions WHERE NOT (transaction_type IN ('IN', 'OUT', 'ADJUSTMENT'))
UNION ALL SELECT 'stock_transactions' AS table_name, 'quantity_positive' AS rule, id AS row_id FROM stock_transactions WHERE NOT (quantity > 0)
UNION ALL SELECT 'stock_transactions', 'id_not_null', id FROM stock_transactions WHERE id IS NULL
UNION ALL SELECT 'stock_transactions', 'product_id_not_null', id FROM stock_transactions WHERE product_id IS NULL
UNION ALL SELECT 'stock_transactions', 'transaction_type_not_null', id FROM stock_transactions WHERE transaction_type IS NULL
UNION ALL SELECT 'stock_transactions', 'quantity_not_null', id FROM stock_transactions WHERE quantity IS NULL""")

sql("unique_violations", """
SELECT 'suppliers' AS table_name, 'email' AS column_name, email AS value, CAST(count(*) AS BIGINT) AS n,
       min(id) AS first_id
FROM suppliers WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1
UNION ALL
SELECT 'products', 'sku', sku, CAST(count(*) AS BIGINT), min(id)
FROM products_faulty WHERE sku IS NOT NULL GROUP BY sku HAVING count(*) > 1""")

sql("fk_violations", """
SELECT 'products' AS table_name, 'supplier_id' AS column_name, id AS row_id, supplier_id AS missing_key
FROM products WHERE supplier_id IS NOT NULL AND supplier_id NOT IN (SELECT id FROM suppliers)
UNION ALL
SELECT 'purchase_orders', 'supplier_id', id, supplier_id
FROM purchase_orders WHERE supplier_id IS NOT NULL AND supplier_id NOT IN (SELECT id FROM suppliers)
UNION ALL
SELECT 'purchase_order_items', 'order_id', id, order_id
FROM purchase_order_items WHERE order_id IS NOT NULL AND order_id NOT IN (SELECT id FROM purchase_orders)
UNION ALL
SELECT 'purchase_order_items', 'product_id', id, product_id
FROM purchase_order_items WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT id FROM products)
UNION ALL
SELECT 'stock_transactions', 'product_id', id, product_id
FROM ledger_faulty WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT id FROM products)""")

sql("delete_impact", """
SELECT 'suppliers' AS table_name, id AS row_id,
       CASE WHEN id IN (SELECT supplier_id FROM purchase_orders) THEN 'restricted' ELSE 'deleted' END AS effect
FROM suppliers WHERE status = 'Inactive'
UNION ALL
SELECT 'products', id, 'set_null' FROM products
WHERE supplier_id IN (SELECT id FROM suppliers WHERE status = 'Inactive'
                      AND id NOT IN (SELECT supplier_id FROM purchase_orders))
UNION ALL
SELECT 'products', id,
       CASE WHEN id IN (SELECT product_id FROM purchase_order_items) THEN 'restricted' ELSE 'deleted' END
FROM products WHERE status = 'Inactive'
UNION ALL
SELECT 'stock_transactions', id, 'cascaded' FROM stock_transactions
WHERE product_id IN (SELECT id FROM products WHERE status = 'Inactive'
                     AND id NOT IN (SELECT product_id FROM purchase_order_items))
UNION ALL
SELECT 'purchase_orders', id, 'deleted' FROM purchase_orders WHERE status = 'CANCELLED'
UNION ALL
SELECT 'purchase_order_items', id, 'cascaded' FROM purchase_order_items
WHERE order_id IN (SELECT id FROM purchase_orders WHERE status = 'CANCELLED')""")

sql("fd_check", """
SELECT 'products' AS table_name, 'sku' AS lhs, 'name,category,price' AS rhs,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT sku FROM products_faulty
        GROUP BY sku HAVING count(DISTINCT (name, category, price)) > 1)) AS violations
UNION ALL
SELECT 'products', 'id', 'sku,name,category,price,supplier_id',
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT id FROM products_faulty
        GROUP BY id HAVING count(DISTINCT (sku, name, category, price, supplier_id)) > 1))
UNION ALL
SELECT 'suppliers', 'email', 'name',
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT email FROM suppliers
        GROUP BY email HAVING count(DISTINCT name) > 1))
UNION ALL
SELECT 'products', 'name', 'category',
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT name FROM products_faulty
        GROUP BY name HAVING count(DISTINCT category) > 1))""")


# -- streaming ----------------------------------------------------------------

sql("stream_stock", f"""
SELECT product_id, CAST(sum({SIGNED}) AS BIGINT) AS stock FROM stock_transactions GROUP BY product_id""")

sql("stream_guard", """
SELECT id, product_id, transaction_type, quantity, accepted, stock_before, stock_after,
       CASE WHEN accepted THEN NULL ELSE 'negative_stock' END AS reason
FROM g""",
    GUARD_CTES, recursive=True)

sql("stream_low_stock", f"""
SELECT p.id AS product_id, p.sku, p.name AS product_name, p.quantity_in_stock + l.stock AS balance,
       p.reorder_level, p.reorder_level * 2 - (p.quantity_in_stock + l.stock) AS recommended_order_qty
FROM products p
JOIN (SELECT product_id, CAST(sum({SIGNED}) AS BIGINT) AS stock FROM stock_transactions GROUP BY product_id) l
  ON p.id = l.product_id
WHERE p.quantity_in_stock + l.stock <= p.reorder_level AND p.status = 'Active'""")

sql("stream_audit", """
SELECT g.product_id AS record_id, CAST(g.stock_before AS INTEGER) AS old_quantity,
       CAST(g.stock_after AS INTEGER) AS new_quantity, CAST(p.price AS DOUBLE) AS old_price,
       CAST(p.price AS DOUBLE) AS new_price, 'DB_TRIGGER_PRODUCTS' AS changed_by
FROM g JOIN products p ON g.product_id = p.id
WHERE g.accepted AND g.stock_before <> g.stock_after""", GUARD_CTES, recursive=True)


# -- audit log, sinks, stored tables, SQL ---------------------------------------

AUDIT_JSON = "'{{\"quantity_in_stock\":' || CAST({q} AS VARCHAR) || ',\"price\":' || CAST(CAST({p} AS DECIMAL(12,2)) AS VARCHAR) || '}}'"

sql("reconcile_fix_audit", f"""
SELECT 'products' AS table_name, 'UPDATE' AS action_type, r.product_id AS record_id,
       {AUDIT_JSON.format(q='r.actual_stock', p='p.price')} AS old_values,
       {AUDIT_JSON.format(q='r.computed_stock', p='p.price')} AS new_values, 'DB_TRIGGER_PRODUCTS' AS changed_by
FROM recon r JOIN products_synced p ON p.id = r.product_id
WHERE r.discrepancy <> 0 AND r.computed_stock >= 0""", RECON)

sql("order_prior_status", """
SELECT order_id AS record_id, seq, old_status, status AS new_status, 'DB_TRIGGER_ORDERS' AS changed_by
FROM (SELECT *, lag(status) OVER (PARTITION BY order_id ORDER BY seq) AS old_status FROM status_log)
WHERE old_status <> status""", """
status_log AS (
  SELECT CAST(user_id AS BIGINT) AS order_id, CAST(event_id AS BIGINT) AS seq,
         CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'SHIPPED' WHEN 'click' THEN 'DELIVERED'
                         WHEN 'purchase' THEN 'CANCELLED' WHEN 'error' THEN 'ON_HOLD' END AS status
  FROM events
)""")

sql("product_audit_json", f"""
SELECT 'products' AS table_name, 'UPDATE' AS action_type, id AS record_id,
       {AUDIT_JSON.format(q='quantity_in_stock', p='o_price')} AS old_values,
       {AUDIT_JSON.format(q='quantity_in_stock', p='v_price')} AS new_values,
       'DB_TRIGGER_PRODUCTS' AS changed_by, TIMESTAMP '2002-01-01 00:00:00' AS changed_at
FROM ps WHERE reason IS NULL AND v_price <> o_price""", PATCH)

sql("audit_values_parsed", """
SELECT 'products' AS table_name, 'UPDATE' AS action_type, id AS record_id, 'DB_TRIGGER_PRODUCTS' AS changed_by,
       quantity_in_stock AS old_quantity_in_stock, quantity_in_stock AS new_quantity_in_stock,
       CAST(o_price AS DOUBLE) AS old_price_value, CAST(v_price AS DOUBLE) AS new_price_value,
       CAST(NULL AS VARCHAR) AS old_status_value, CAST(NULL AS VARCHAR) AS new_status_value
FROM ps WHERE reason IS NULL AND v_price <> o_price
UNION ALL
SELECT 'purchase_orders', 'UPDATE', order_id, 'DB_TRIGGER_ORDERS', NULL, NULL, NULL, NULL, old_status, requested
FROM tr3 WHERE applied AND old_status <> requested""", PATCH + "," + TRANSITION)

AUDIT_LOG = """
audit_events AS (
  SELECT CAST(event_id AS BIGINT) AS id, 'products' AS table_name,
         CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS action_type,
         CAST(user_id AS BIGINT) AS record_id, CAST(NULL AS VARCHAR) AS old_values, props AS new_values,
         'SYSTEM' AS changed_by, CAST(ts AS TIMESTAMP) AS changed_at
  FROM events
)"""

sql("audit_log_listing", "SELECT * FROM audit_events", AUDIT_LOG)

sql("ledger_append", """
SELECT id, product_id, transaction_type, quantity,
       CAST(CASE transaction_type WHEN 'IN' THEN 0 WHEN 'OUT' THEN 1 ELSE 2 END AS BIGINT) AS batch_id
FROM stock_transactions""")

sql("bucketed_ledger", f"""
SELECT t.product_id, p.sku AS product_sku, CAST(count(*) AS BIGINT) AS movements, CAST(sum({SIGNED}) AS BIGINT) AS stock
FROM stock_transactions t JOIN products p ON t.product_id = p.id GROUP BY t.product_id, p.sku""")

ORACLE["orders_json"] = ORACLE["orders_nested"]
for _view in ("stock_valuation", "low_stock_alerts", "supplier_performance"):
    ORACLE[f"sql_{_view}"] = ORACLE[_view]


# -- integrity over tables in which every rule is broken --------------------------

_SOUND = {"inventory_audit_log": "audit_events"}


def _faulty(table: str) -> str:
    changed = ", ".join(f"{text} AS {column}" for column, text in FAULTS[table].items())
    return f"bad_{table} AS (SELECT * REPLACE ({changed}) FROM {_SOUND.get(table, table)})"


BROKEN = AUDIT_LOG + "," + ",".join(_faulty(t) for t in FAULTS)

_RULES = {
    "suppliers": {"status_enum": "status IN ('Active', 'Inactive')"},
    "products": {"price_nonnegative": "price >= 0", "reorder_level_nonnegative": "reorder_level >= 0",
                 "status_enum": "status IN ('Active', 'Inactive')"},
    "purchase_orders": {"total_amount_nonnegative": "total_amount >= 0",
                        "status_enum": "status IN ('PENDING', 'SHIPPED', 'DELIVERED', 'CANCELLED')"},
    "purchase_order_items": {"quantity_positive": "quantity > 0", "unit_price_nonnegative": "unit_price >= 0",
                             "received_quantity_nonnegative": "received_quantity >= 0"},
    "stock_transactions": {"transaction_type_enum": "transaction_type IN ('IN', 'OUT', 'ADJUSTMENT')",
                           "quantity_positive": "quantity > 0"},
    "inventory_audit_log": {"action_type_enum": "action_type IN ('INSERT', 'UPDATE', 'DELETE')"},
}
_NOT_NULL = {
    "suppliers": "id name contact_name email phone address",
    "products": "id sku name category price quantity_in_stock reorder_level",
    "purchase_orders": "id supplier_id",
    "purchase_order_items": "id order_id product_id quantity unit_price",
    "stock_transactions": "id product_id transaction_type quantity",
    "inventory_audit_log": "id table_name action_type record_id",
}

sql("check_violations_all", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{rule}' AS rule, id AS row_id FROM bad_{t} WHERE {broken}"
    for t in _RULES
    for rule, broken in [*((r, f"NOT ({p})") for r, p in _RULES[t].items()), *((f"{c}_not_null", f"{c} IS NULL") for c in _NOT_NULL[t].split())]),
    BROKEN)

sql("unique_violations_all", """
SELECT 'suppliers' AS table_name, 'email' AS column_name, email AS value, CAST(count(*) AS BIGINT) AS n, min(id) AS first_id
FROM bad_suppliers WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1
UNION ALL
SELECT 'products', 'sku', sku, CAST(count(*) AS BIGINT), min(id)
FROM products_faulty WHERE sku IS NOT NULL GROUP BY sku HAVING count(*) > 1""", BROKEN)

sql("fk_violations_all", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, id AS row_id, CAST({c} AS BIGINT) AS missing_key "
    f"FROM bad_{t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT id FROM bad_{parent})"
    for t, c, parent in (("products", "supplier_id", "suppliers"), ("purchase_orders", "supplier_id", "suppliers"),
                         ("purchase_order_items", "order_id", "purchase_orders"), ("purchase_order_items", "product_id", "products"),
                         ("stock_transactions", "product_id", "products"))), BROKEN)

# Orders first: their items go with them and restrict no product any more; suppliers come last,
# when the cancelled orders are gone.
sql("delete_impact_chained", """
SELECT 'purchase_orders' AS table_name, id AS row_id, 'deleted' AS effect FROM gone_orders
UNION ALL SELECT 'purchase_order_items', id, 'cascaded' FROM purchase_order_items WHERE order_id IN (SELECT id FROM gone_orders)
UNION ALL SELECT 'products', id, CASE WHEN id IN (SELECT product_id FROM left_items) THEN 'restricted' ELSE 'deleted' END
FROM products WHERE status = 'Inactive'
UNION ALL SELECT 'stock_transactions', id, 'cascaded' FROM stock_transactions WHERE product_id IN (SELECT id FROM gone_products)
UNION ALL SELECT 'suppliers', id, CASE WHEN id IN (SELECT supplier_id FROM left_orders) THEN 'restricted' ELSE 'deleted' END
FROM suppliers WHERE status = 'Inactive'
UNION ALL SELECT 'products', id, 'set_null' FROM products
WHERE id NOT IN (SELECT id FROM gone_products)
  AND supplier_id IN (SELECT id FROM suppliers WHERE status = 'Inactive' AND id NOT IN (SELECT supplier_id FROM left_orders))""", """
gone_orders AS (SELECT id FROM purchase_orders WHERE status = 'CANCELLED'),
left_orders AS (SELECT * FROM purchase_orders WHERE id NOT IN (SELECT id FROM gone_orders)),
left_items AS (SELECT * FROM purchase_order_items WHERE order_id NOT IN (SELECT id FROM gone_orders)),
gone_products AS (SELECT id FROM products WHERE status = 'Inactive' AND id NOT IN (SELECT product_id FROM left_items))""")
