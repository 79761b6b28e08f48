"""Canonical depot tables as DuckDB CTEs over the pre-registered TPC-H views.

Mirrors ``depotlens.sources.tpch`` (same mapping, written independently in
SQL).  ``with_tables('batches', ...)`` returns a ``WITH`` clause holding the
requested tables and everything they depend on.
"""
from __future__ import annotations

AS_OF = "DATE '2001-08-01'"
AS_OF_TS = "TIMESTAMP '2001-08-01 00:00:00'"

CTES: dict[str, tuple[list[str], str]] = {
    "depots": ([], """
        SELECT r_name AS depot_id, 'CLIENT-' || CAST(r_regionkey % 2 AS VARCHAR) AS client_id,
               r_name AS region, r_regionkey <> 4 AS is_active
        FROM region"""),
    "products": ([], """
        SELECT p_brand AS product_id, p_brand AS canonical_name,
               CASE n % 6 WHEN 0 THEN 'antibiotic' WHEN 1 THEN 'cold_chain' WHEN 2 THEN 'vitamin'
                          WHEN 3 THEN 'pain_relief' WHEN 4 THEN 'cardiac' ELSE 'respiratory' END AS product_category,
               n % 6 = 1 AS is_cold_chain,
               CASE WHEN n % 6 = 1 THEN CAST(2.0 AS DOUBLE) END AS storage_temp_min,
               CASE WHEN n % 6 = 1 THEN CAST(8.0 AS DOUBLE) END AS storage_temp_max,
               CAST(180 + 30 * (n % 12) AS INTEGER) AS default_shelf_life_days,
               CAST(3 + n % 10 AS INTEGER) AS lead_time_days,
               CAST(10 + n * 2.5 AS DECIMAL(10,2)) AS ptr
        FROM (SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part) b"""),
    "supplier_depot": ([], """
        SELECT s_suppkey, r_name AS depot_id
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "stock_movements": (["supplier_depot"], f"""
        SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                              CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS movement_id,
               sd.depot_id, p_brand AS product_id,
               sd.depot_id || '-' || CAST(l_partkey AS VARCHAR) AS batch_id,
               l_partkey AS part_key,
               CASE WHEN l_returnflag = 'N' THEN 'IN' WHEN l_returnflag = 'A' THEN 'OUT'
                    WHEN l_linestatus = 'F' THEN 'RETURN' WHEN l_linenumber % 2 = 1 THEN 'WRITE_OFF'
                    ELSE 'TRANSFER' END AS movement_type,
               l_quantity AS quantity, CAST(l_shipdate AS TIMESTAMP) AS created_at, l_orderkey AS order_key
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier_depot sd ON l_suppkey = sd.s_suppkey
        WHERE l_shipdate <= {AS_OF_TS}"""),
    "batches": (["stock_movements"], f"""
        SELECT batch_id, depot_id, product_id, batch_id AS batch_number,
               {AS_OF} + CAST(min(part_key) % 400 - 200 AS INTEGER) AS expiry_date,
               CAST(trunc(sum(CASE WHEN movement_type = 'IN' THEN quantity ELSE 0.0 END)) AS INTEGER) AS quantity_received,
               CAST(trunc(greatest(sum(CASE WHEN movement_type = 'IN' THEN quantity ELSE 0.0 END)
                                - sum(CASE WHEN movement_type = 'OUT' THEN quantity ELSE 0.0 END), 0.0)) AS INTEGER) AS quantity_remaining,
               min(created_at) AS created_at
        FROM stock_movements GROUP BY batch_id, depot_id, product_id"""),
    "invoices": ([], f"""
        SELECT o_orderkey AS id, r_name AS depot_id, CAST(o_custkey AS VARCHAR) AS retailer_id,
               'INV-' || CAST(o_custkey % 40 AS VARCHAR) AS invoice_number,
               CAST(o_orderdate AS DATE) AS invoice_date,
               CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount,
               CASE o_orderstatus WHEN 'F' THEN 'SETTLED' WHEN 'P' THEN 'PARTIAL' ELSE 'PENDING' END AS status,
               CAST(o_orderdate AS TIMESTAMP) AS created_at
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey
        WHERE o_orderdate <= {AS_OF_TS}"""),
    "payments": (["invoices"], f"""
        SELECT * FROM (
          SELECT 'PAY-' || CAST(id AS VARCHAR) AS id, depot_id,
                 CASE WHEN id % 8 < 4 THEN CAST(id AS VARCHAR) END AS invoice_id, retailer_id,
                 CAST(total_amount * CASE WHEN id % 4 = 0 THEN CAST(1 AS DECIMAL(3,2))
                                          WHEN id % 4 = 1 THEN CAST(0.5 AS DECIMAL(3,2))
                                          ELSE CAST(0.05 AS DECIMAL(3,2)) END AS DECIMAL(12,2)) AS amount_paid,
                 created_at + INTERVAL 15 DAY AS collected_at
          FROM invoices WHERE id % 4 <> 3) x
        WHERE collected_at <= {AS_OF_TS}"""),
    "payment_transactions": (["payments", "supplier_depot"], f"""
        SELECT depot_id, amount_paid AS amount, 'INFLOW' AS transaction_type,
               CAST(collected_at AS DATE) AS transaction_date FROM payments
        UNION ALL
        SELECT sd.depot_id, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(12,2)),
               'OUTFLOW', CAST(l_shipdate AS DATE)
        FROM lineitem JOIN supplier_depot sd ON l_suppkey = sd.s_suppkey
        WHERE l_linenumber = 1 AND l_shipdate <= {AS_OF_TS}"""),
    "retailers": ([], """
        SELECT CAST(c_custkey AS VARCHAR) AS id, r_name AS depot_id, c_name AS name,
               CAST(50000 AS DECIMAL(12,2)) AS credit_limit,
               CAST(c_acctbal AS DECIMAL(12,2)) AS current_outstanding
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "discount_schemes": ([], """
        SELECT 'SCH-' || r_name AS id, r_name AS depot_id,
               '{"type":"' || CASE WHEN r_regionkey = 4 THEN 'flat' ELSE 'percent' END
               || '","value":' || CAST(r_regionkey + 5 AS VARCHAR) || '}' AS terms
        FROM region"""),
    "readings": ([], """
        SELECT event_id AS reading_id, 'DEV' || CAST(user_id AS VARCHAR) AS device_id, r_name AS depot_id,
               CAST(CAST(value AS DECIMAL(10,2)) % 12 AS DOUBLE) AS temperature,
               CAST(ts AS TIMESTAMP) AS ts
        FROM events JOIN region ON user_id % 5 = r_regionkey"""),
}


def with_tables(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause for the canonical tables ``names`` (dependencies
    first) followed by ``extra`` (name, sql) CTEs in the given order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1]}\n)" for n in order]
    parts += [f"{n} AS ({sql}\n)" for n, sql in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""


#: Conditions that hide facts created after AS_OF in the tables above.
BOUNDS = [f"        WHERE l_shipdate <= {AS_OF_TS}", f"        WHERE o_orderdate <= {AS_OF_TS}", f"        WHERE collected_at <= {AS_OF_TS}"]


def unbounded(sql: str) -> str:
    """The statement over facts of all dates."""
    for b in BOUNDS:
        sql = sql.replace(b, "")
    return sql
