"""Oracle SQL (DuckDB) per registered query."""
from __future__ import annotations

import re

from ..functions.numeric import sql_py_round
from .cte import AS_OF, AS_OF_TS, CTES, unbounded, with_tables

CTES_DEPOTS = CTES["depots"][1]


def _rewrite_round(sql: str) -> str:
    """Replace every ``round(expr, n)`` by Python-exact rounding SQL (see
    ``functions.numeric``), innermost calls first."""
    out, i = [], 0
    pat = re.compile(r"(?<![A-Za-z0-9_])round\(", re.I)
    while True:
        m = pat.search(sql, i)
        if not m:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:m.start()])
        depth, j, args, start = 1, m.end(), [], m.end()
        while depth:
            ch = sql[j]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    args.append(sql[start:j])
            elif ch == "," and depth == 1:
                args.append(sql[start:j])
                start = j + 1
            j += 1
        n = int(args[1].strip()) if len(args) > 1 else 0
        out.append(sql_py_round(_rewrite_round(args[0]), n))
        i = j

ORACLE: dict[str, str] = {}

DAILY_DEMAND = f"""
    SELECT sm.product_id, sm.depot_id, CAST(sm.created_at AS DATE) AS date, sum(sm.quantity) AS units_sold,
           p.product_category, p.is_cold_chain, d.region AS depot_region
    FROM stock_movements sm JOIN products p ON p.product_id = sm.product_id
         JOIN depots d ON d.depot_id = sm.depot_id
    WHERE sm.movement_type = 'OUT' AND sm.created_at >= {AS_OF_TS} - INTERVAL 60 DAY
      AND sm.created_at <= {AS_OF_TS}
    GROUP BY sm.product_id, sm.depot_id, CAST(sm.created_at AS DATE), p.product_category, p.is_cold_chain, d.region"""

FILLED = """
    SELECT g.product_id, g.depot_id, g.date, coalesce(s.units_sold, 0) AS units_sold,
           g.product_category, g.is_cold_chain, g.depot_region
    FROM (SELECT p.*, CAST(unnest(generate_series(b.lo, b.hi, INTERVAL 1 DAY)) AS DATE) AS date
          FROM (SELECT product_id, depot_id, min(product_category) AS product_category,
                       bool_or(is_cold_chain) AS is_cold_chain, min(depot_region) AS depot_region
                FROM sales GROUP BY product_id, depot_id) p,
               (SELECT min(date) AS lo, max(date) AS hi FROM sales) b) g
    LEFT JOIN sales s ON s.product_id = g.product_id AND s.depot_id = g.depot_id AND s.date = g.date"""

ORACLE["demand_forecast"] = with_tables("products", "depots", "stock_movements", extra=[
    ("sales", DAILY_DEMAND), ("filled", FILLED),
    ("idx", """SELECT *, row_number() OVER (PARTITION BY product_id, depot_id ORDER BY date) - 1 AS x,
                    row_number() OVER (PARTITION BY product_id, depot_id ORDER BY date DESC) AS rd
             FROM filled"""),
]) + """
SELECT product_id, depot_id,
       round(greatest(avg(units_sold) FILTER (WHERE rd <= 30), 0) * 14, 2) AS predicted_units_14d,
       round(greatest(avg(units_sold) FILTER (WHERE rd <= 30), 0), 4) AS predicted_daily_rate,
       round(CASE WHEN count(*) < 5 THEN 0 ELSE coalesce(regr_slope(units_sold, x), 0) END, 4) AS demand_trend_slope
FROM idx GROUP BY product_id, depot_id"""


def R6(sql: str, cols: list[str]) -> str:
    """Round the listed double columns to 6 decimals (mirrors ``rounded``)."""
    if not cols:
        return sql
    rep = ", ".join(f"round({c}, 6) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) r6"


SALES_CTES = [("sales", DAILY_DEMAND)]

# ---------------------------------------------------------------- demand
ORACLE["daily_demand"] = R6(with_tables("products", "depots", "stock_movements", extra=SALES_CTES)
                            + "SELECT * FROM sales", ["units_sold"])
ORACLE["fill_missing_dates"] = R6(with_tables("products", "depots", "stock_movements",
                                              extra=SALES_CTES + [("filled", FILLED)])
                                  + "SELECT * FROM filled", ["units_sold"])

FESTIVALS = ", ".join(f"(DATE '{d}')" for d in [
    "2025-10-02", "2025-10-12", "2025-10-20", "2025-10-23", "2025-11-05", "2025-11-15",
    "2025-12-25", "2026-01-14", "2026-01-26", "2026-03-14", "2026-04-06", "2026-04-14",
    "2026-06-13", "2026-08-15", "2026-09-29", "2026-10-20", "2026-11-08"])

DEMAND_FEATURE_COLS = ["lag_1", "lag_7", "lag_14", "lag_30", "rolling_avg_7", "rolling_avg_30", "rolling_std_7",
                       "month_sin", "month_cos", "day_of_week_sin", "day_of_week_cos", "is_festival_week",
                       "season_code", "product_category_enc", "depot_region_enc", "is_cold_chain"]
DEMAND_DOUBLES = ["units_sold", "lag_1", "lag_7", "lag_14", "lag_30", "rolling_avg_7", "rolling_avg_30",
                  "rolling_std_7", "month_sin", "month_cos", "day_of_week_sin", "day_of_week_cos"]

FEATURES_ALL = f"""
    SELECT f.product_id, f.depot_id, f.date, f.units_sold,
           lag(units_sold, 1) OVER w AS lag_1, lag(units_sold, 7) OVER w AS lag_7,
           lag(units_sold, 14) OVER w AS lag_14, lag(units_sold, 30) OVER w AS lag_30,
           CASE WHEN count(units_sold) OVER w7 >= 3 THEN avg(units_sold) OVER w7 END AS rolling_avg_7,
           CASE WHEN count(units_sold) OVER w30 >= 10 THEN avg(units_sold) OVER w30 END AS rolling_avg_30,
           CASE WHEN count(units_sold) OVER w7 >= 3 THEN coalesce(stddev_samp(units_sold) OVER w7, 0.0)
                ELSE 0.0 END AS rolling_std_7,
           sin(6.283185307179586 * month(f.date) / 12) AS month_sin,
           cos(6.283185307179586 * month(f.date) / 12) AS month_cos,
           sin(6.283185307179586 * (isodow(f.date) - 1) / 7) AS day_of_week_sin,
           cos(6.283185307179586 * (isodow(f.date) - 1) / 7) AS day_of_week_cos,
           CAST(EXISTS (SELECT 1 FROM (VALUES {FESTIVALS}) fx(d) WHERE abs(date_diff('day', fx.d, f.date)) <= 7)
                AS INTEGER) AS is_festival_week,
           CASE WHEN month(f.date) IN (11, 12, 1, 2) THEN 0 WHEN month(f.date) IN (3, 4, 5) THEN 1
                WHEN month(f.date) IN (6, 7, 8, 9) THEN 2 ELSE 3 END AS season_code,
           coalesce(cc.code, -1) AS product_category_enc, coalesce(rc.code, -1) AS depot_region_enc,
           CAST(f.is_cold_chain AS INTEGER) AS is_cold_chain
    FROM filled f
    LEFT JOIN (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
               FROM (SELECT DISTINCT product_category AS v FROM filled WHERE product_category IS NOT NULL)) cc
           ON cc.v = f.product_category
    LEFT JOIN (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
               FROM (SELECT DISTINCT depot_region AS v FROM filled WHERE depot_region IS NOT NULL)) rc
           ON rc.v = f.depot_region
    WINDOW w AS (PARTITION BY f.product_id, f.depot_id ORDER BY f.date),
           w7 AS (PARTITION BY f.product_id, f.depot_id ORDER BY f.date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
           w30 AS (PARTITION BY f.product_id, f.depot_id ORDER BY f.date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"""

_FEAT_BASE = with_tables("products", "depots", "stock_movements",
                         extra=SALES_CTES + [("filled", FILLED), ("feats", FEATURES_ALL)])
ORACLE["demand_features"] = R6(_FEAT_BASE + """
    SELECT * FROM feats WHERE lag_1 IS NOT NULL AND lag_7 IS NOT NULL AND lag_14 IS NOT NULL
      AND lag_30 IS NOT NULL AND rolling_avg_7 IS NOT NULL AND rolling_avg_30 IS NOT NULL""", DEMAND_DOUBLES)

_med = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM feats)) AS {c}"
                 for c in DEMAND_FEATURE_COLS)
ORACLE["inference_median_fill"] = R6(_FEAT_BASE + f"SELECT product_id, depot_id, date, units_sold, {_med} FROM feats",
                                     DEMAND_DOUBLES + ["is_festival_week", "season_code", "product_category_enc",
                                                       "depot_region_enc", "is_cold_chain"])

ORACLE["trend_slope"] = R6(with_tables("products", "depots", "stock_movements", extra=SALES_CTES) + """
    SELECT product_id, depot_id,
           CASE WHEN count(*) < 5 THEN 0.0 ELSE coalesce(regr_slope(units_sold, x), 0.0) END AS demand_trend_slope
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY product_id, depot_id ORDER BY date) - 1 AS DOUBLE) AS x
          FROM sales) GROUP BY product_id, depot_id""", ["demand_trend_slope"])

FORECAST = ORACLE["demand_forecast"].split("WITH ", 1)[1]  # reused as a CTE body below
FORECAST_CTES = SALES_CTES + [("filled", FILLED), (
    "idx", """SELECT *, row_number() OVER (PARTITION BY product_id, depot_id ORDER BY date) - 1 AS x,
                    row_number() OVER (PARTITION BY product_id, depot_id ORDER BY date DESC) AS rd
             FROM filled"""), ("forecast", """
    SELECT product_id, depot_id,
       round(greatest(avg(units_sold) FILTER (WHERE rd <= 30), 0) * 14, 2) AS predicted_units_14d,
       round(greatest(avg(units_sold) FILTER (WHERE rd <= 30), 0), 4) AS predicted_daily_rate,
       round(CASE WHEN count(*) < 5 THEN 0 ELSE coalesce(regr_slope(units_sold, x), 0) END, 4) AS demand_trend_slope
    FROM idx GROUP BY product_id, depot_id""")]

# ---------------------------------------------------------------- ledger
BALANCE = """(coalesce(sum(CASE WHEN movement_type IN ('IN', 'RETURN') THEN quantity ELSE 0.0 END), 0.0)
            - coalesce(sum(CASE WHEN movement_type IN ('OUT', 'WRITE_OFF') THEN quantity ELSE 0.0 END), 0.0))"""
ORACLE["current_stock"] = with_tables("stock_movements") + f"""
    SELECT depot_id, product_id, CAST(trunc({BALANCE}) AS BIGINT) AS current_stock
    FROM stock_movements GROUP BY depot_id, product_id"""
ORACLE["batch_stock"] = with_tables("stock_movements") + f"""
    SELECT batch_id, CAST(trunc({BALANCE}) AS BIGINT) AS batch_stock FROM stock_movements GROUP BY batch_id"""

SOLD = ("sold", "SELECT batch_id, sum(quantity) AS sold_qty FROM stock_movements "
                "WHERE movement_type = 'OUT' GROUP BY batch_id")
LEDGER = f"""
    SELECT b.depot_id, b.batch_id, b.batch_number, b.product_id, p.canonical_name, p.product_category,
           b.expiry_date, b.quantity_received - coalesce(s.sold_qty, 0.0) AS quantity_remaining,
           CASE WHEN b.expiry_date < {AS_OF} THEN 'expired'
                WHEN b.expiry_date < {AS_OF} + 30 THEN 'expiring_soon' ELSE 'active' END AS status
    FROM batches b JOIN products p ON p.product_id = b.product_id LEFT JOIN sold s ON s.batch_id = b.batch_id
    WHERE b.quantity_received - coalesce(s.sold_qty, 0.0) > 0"""
ORACLE["stock_ledger"] = R6(with_tables("batches", "products", extra=[SOLD]) + LEDGER, ["quantity_remaining"])
ORACLE["stock_by_product"] = R6(with_tables("batches", "products", extra=[SOLD, ("ledger", LEDGER)]) + """
    SELECT l.*, t.product_total, t.product_batches FROM ledger l JOIN (
        SELECT depot_id, product_id, sum(quantity_remaining) AS product_total, count(*) AS product_batches
        FROM ledger GROUP BY depot_id, product_id) t ON t.depot_id = l.depot_id AND t.product_id = l.product_id""",
                                ["quantity_remaining", "product_total"])
ORACLE["batch_timeline"] = R6(with_tables("batches", "products") + """
    SELECT h.batch_id, h.batch_number, h.product_id, h.canonical_name, h.expiry_date, h.quantity_received,
           h.quantity_sold, h.quantity_received - h.quantity_sold AS quantity_remaining,
           CASE WHEN h.quantity_received - h.quantity_sold > 0 THEN 'active' ELSE 'depleted' END AS status,
           m.movement_id, m.movement_type, m.quantity, m.created_at AS moved_at
    FROM (SELECT b.*, p.canonical_name, coalesce(s.quantity_sold, 0.0) AS quantity_sold
          FROM batches b JOIN products p ON p.product_id = b.product_id
          LEFT JOIN (SELECT batch_id, sum(CASE WHEN movement_type = 'OUT' THEN quantity ELSE 0.0 END) AS quantity_sold
                     FROM stock_movements GROUP BY batch_id) s ON s.batch_id = b.batch_id) h
    LEFT JOIN stock_movements m ON m.batch_id = h.batch_id""",
                              ["quantity_sold", "quantity_remaining", "quantity"])

# ---------------------------------------------------------------- expiry
ACTIVE = f"""
    SELECT b.batch_id, b.product_id, b.depot_id, b.expiry_date, b.quantity_received,
           b.quantity_received - coalesce(s.sold_qty, 0.0) AS quantity_remaining,
           p.product_category, p.is_cold_chain, p.default_shelf_life_days, p.ptr, b.created_at
    FROM batches b JOIN products p ON p.product_id = b.product_id LEFT JOIN sold s ON s.batch_id = b.batch_id
    WHERE b.expiry_date > {AS_OF} AND b.quantity_received - coalesce(s.sold_qty, 0.0) > 0"""
ACTIVE_CTES = [SOLD, ("active", ACTIVE)]
ORACLE["active_batches"] = R6(with_tables("batches", "products", extra=ACTIVE_CTES)
                              + "SELECT * EXCLUDE (ptr) FROM active", ["quantity_remaining"])

VELOCITY = f"""
    SELECT b.batch_id,
           CASE WHEN coalesce(v.recent_out, 0.0) / (30.0 / 7.0) = 0.0
                THEN coalesce(v.total_out, 0.0) / greatest(
                     floor((epoch(CAST(least(b.expiry_date, {AS_OF}) AS TIMESTAMP)) - epoch(b.created_at)) / 86400) / 7.0, 1.0)
                ELSE coalesce(v.recent_out, 0.0) / (30.0 / 7.0) END AS sales_velocity_weekly
    FROM batches b LEFT JOIN (
        SELECT batch_id, sum(CASE WHEN created_at >= {AS_OF_TS} - INTERVAL 30 DAY THEN quantity ELSE 0.0 END) AS recent_out,
               sum(quantity) AS total_out
        FROM stock_movements WHERE movement_type = 'OUT' GROUP BY batch_id) v ON v.batch_id = b.batch_id"""
ORACLE["sales_velocity"] = R6(with_tables("batches") + VELOCITY, ["sales_velocity_weekly"])

CAT_RISK = ("CASE lower(product_category) WHEN 'antibiotic' THEN 0.25 WHEN 'cold_chain' THEN 0.40 "
            "WHEN 'seasonal_otc' THEN 0.35 WHEN 'vitamin' THEN 0.15 WHEN 'pain_relief' THEN 0.10 "
            "WHEN 'antidiabetic' THEN 0.20 WHEN 'cardiac' THEN 0.20 WHEN 'gi' THEN 0.18 "
            "WHEN 'respiratory' THEN 0.22 WHEN 'thyroid' THEN 0.12 ELSE 0.20 END")
# month of 2001-08-01 is 8: peak for all-year categories, not for antibiotic/vitamin/respiratory/otc_cold
PEAK = ("CASE WHEN replace(lower(coalesce(product_category, '')), ' ', '_') IN "
        "('antibiotic','otc_cold','vitamin','respiratory') THEN "
        "CAST(month(" + AS_OF + ") IN (SELECT unnest(CASE replace(lower(product_category), ' ', '_') "
        "WHEN 'antibiotic' THEN [10,11,12,1,2,3] WHEN 'otc_cold' THEN [10,11,12,1,2] "
        "WHEN 'vitamin' THEN [10,11,12,1] ELSE [10,11,12,1,2] END)) AS INTEGER) "
        "WHEN replace(lower(coalesce(product_category, '')), ' ', '_') = 'ors' THEN CAST(month(" + AS_OF + ") IN (6,7,8,9) AS INTEGER) "
        "WHEN replace(lower(coalesce(product_category, '')), ' ', '_') = 'gi' THEN CAST(month(" + AS_OF + ") IN (4,5,6,7,8,9) AS INTEGER) "
        "ELSE 1 END")
EXPIRY_FEATURES = f"""
    SELECT x.batch_id, x.product_id, x.depot_id,
           CAST(coalesce(x.sales_velocity_weekly, 0.0) AS DOUBLE) AS sales_velocity_weekly,
           CAST(coalesce(x.days_till_expiry, 0) AS DOUBLE) AS days_till_expiry,
           CAST(coalesce(least(greatest(x.days_till_expiry / x.shelf_life_days, 0.0), 1.0), 0.0) AS DOUBLE) AS pct_life_remaining,
           CAST(coalesce(x.seasonality_flag, 0) AS DOUBLE) AS seasonality_flag,
           CAST(coalesce(x.demand_trend_slope, 0.0) AS DOUBLE) AS demand_trend_slope,
           CAST(coalesce(least(x.sales_velocity_weekly / greatest(coalesce(c.avg_cat_velocity, 1.0), 0.1), 5.0), 0.0) AS DOUBLE) AS velocity_ratio,
           CAST(coalesce(x.category_risk_score, 0.0) AS DOUBLE) AS category_risk_score,
           CAST(coalesce(x.is_cold_chain, 0) AS DOUBLE) AS is_cold_chain,
           CAST(coalesce(x.shelf_life_days, 0) AS DOUBLE) AS shelf_life_days,
           x.label
    FROM (
        SELECT b.batch_id, b.product_id, b.depot_id, p.product_category,
               coalesce(v.sales_velocity_weekly, 0.0) AS sales_velocity_weekly,
               date_diff('day', {AS_OF}, b.expiry_date) AS days_till_expiry,
               greatest(p.default_shelf_life_days, 1) AS shelf_life_days,
               {PEAK} AS seasonality_flag,
               coalesce(f.demand_trend_slope, 0.0) AS demand_trend_slope,
               {CAT_RISK} AS category_risk_score,
               CAST(p.is_cold_chain AS INTEGER) AS is_cold_chain,
               CASE WHEN b.expiry_date < {AS_OF} THEN CAST(b.quantity_remaining > 0 AS INTEGER) END AS label
        FROM batches b JOIN products p ON p.product_id = b.product_id
        LEFT JOIN velocity v ON v.batch_id = b.batch_id
        LEFT JOIN forecast f ON f.product_id = b.product_id AND f.depot_id = b.depot_id) x
    LEFT JOIN (SELECT product_category, avg(sales_velocity_weekly) AS avg_cat_velocity
               FROM (SELECT p.product_category, coalesce(v.sales_velocity_weekly, 0.0) AS sales_velocity_weekly
                     FROM batches b JOIN products p ON p.product_id = b.product_id
                     LEFT JOIN velocity v ON v.batch_id = b.batch_id) WHERE product_category IS NOT NULL
               GROUP BY product_category) c ON c.product_category = x.product_category"""
EXPIRY_FEATURE_DOUBLES = ["sales_velocity_weekly", "days_till_expiry", "pct_life_remaining", "seasonality_flag",
                          "demand_trend_slope", "velocity_ratio", "category_risk_score", "is_cold_chain",
                          "shelf_life_days"]
ORACLE["expiry_features"] = R6(with_tables("batches", "products", "depots", extra=FORECAST_CTES + [
    ("velocity", VELOCITY)]) + EXPIRY_FEATURES, EXPIRY_FEATURE_DOUBLES)

FORMULA = f"""
    SELECT batch_id, product_id, depot_id,
           round(least(least(greatest(1.0 - greatest(date_diff('day', {AS_OF}, expiry_date), 0)
                                        / greatest(coalesce(default_shelf_life_days, 365), 1), 0.0), 1.0) * 0.6
                       + 0.5 * 0.4, 1.0), 3) AS expiry_risk_score,
           CAST({AS_OF} + CAST(floor(greatest(quantity_remaining, 0.0) / (1.0 / 7.0)) AS INTEGER) + 14 AS DATE)
               AS recommended_liquidation_date,
           'formula' AS method
    FROM active"""
ORACLE["expiry_risk_formula"] = with_tables("batches", "products", extra=ACTIVE_CTES) + FORMULA

ORACLE["expiry_model_gate"] = with_tables("batches") + f"""
    SELECT depot_id, expired_count, data_days, expired_count >= 50 AND data_days >= 180 AS use_model
    FROM (SELECT depot_id,
                 count(*) FILTER (WHERE expiry_date < {AS_OF} AND quantity_remaining > 0) AS expired_count,
                 CAST(coalesce(floor((epoch({AS_OF_TS}) - epoch(min(created_at))) / 86400), 0) AS BIGINT) AS data_days
          FROM batches GROUP BY depot_id)"""

# ---------------------------------------------------------------- stock-out, FEFO
ORACLE["stockout_risk"] = with_tables("products", "depots", "stock_movements", extra=FORECAST_CTES) + f"""
    SELECT s.depot_id, s.product_id, round(greatest(s.stock, 0.0), 2) AS current_stock,
           round(greatest(s.stock, 0.0) / greatest(coalesce(f.predicted_daily_rate, 0.0), 0.01), 1) AS days_until_stockout,
           CAST(coalesce(p.lead_time_days, 7) AS DOUBLE) AS lead_time_days,
           greatest(s.stock, 0.0) / greatest(coalesce(f.predicted_daily_rate, 0.0), 0.01)
               < CAST(coalesce(p.lead_time_days, 7) AS DOUBLE) AS will_stockout
    FROM (SELECT depot_id, product_id, {BALANCE} AS stock FROM stock_movements GROUP BY depot_id, product_id) s
    JOIN products p ON p.product_id = s.product_id
    LEFT JOIN forecast f ON f.depot_id = s.depot_id AND f.product_id = s.product_id
    WHERE s.stock >= 0"""
ORACLE["stockout_risk_offline"] = with_tables("products", "depots", "stock_movements", extra=FORECAST_CTES) + f"""
    SELECT s.depot_id, s.product_id, round(greatest(s.stock, 0.0), 2) AS current_stock,
           round(greatest(s.stock, 0.0) / greatest(coalesce(f.predicted_daily_rate, 0.01), 0.01), 1) AS days_until_stockout,
           CAST(coalesce(p.lead_time_days, 7) AS DOUBLE) AS lead_time_days,
           greatest(s.stock, 0.0) / greatest(coalesce(f.predicted_daily_rate, 0.01), 0.01)
               < CAST(coalesce(p.lead_time_days, 7) AS DOUBLE) AS will_stockout
    FROM (SELECT depot_id, product_id, CAST(CAST(trunc({BALANCE}) AS BIGINT) AS DOUBLE) AS stock
          FROM stock_movements GROUP BY depot_id, product_id) s
    JOIN products p ON p.product_id = s.product_id
    LEFT JOIN forecast f ON f.depot_id = s.depot_id AND f.product_id = s.product_id"""

FEFO = """
    SELECT *, CAST(row_number() OVER (PARTITION BY depot_id ORDER BY priority_score, batch_id) AS INTEGER) AS priority_rank
    FROM (SELECT a.batch_id, a.product_id, a.depot_id, a.expiry_date, CAST(a.quantity_remaining AS DOUBLE) AS remaining_qty,
                 round(coalesce(e.expiry_risk_score, 0.0), 3) AS expiry_risk_score,
                 coalesce(e.expiry_risk_score, 0.0) > 0.6 AS ml_override,
                 date_diff('day', DATE '2001-08-01', a.expiry_date) AS days_till_expiry,
                 round(CASE WHEN coalesce(e.expiry_risk_score, 0.0) > 0.6 THEN -(coalesce(e.expiry_risk_score, 0.0) * 1000)
                            ELSE CAST(date_diff('day', DATE '2001-08-01', a.expiry_date) AS DOUBLE) END, 4) AS priority_score
          FROM active a LEFT JOIN formula e ON e.batch_id = a.batch_id)"""
ORACLE["fefo_rank"] = with_tables("batches", "products", extra=ACTIVE_CTES + [("formula", FORMULA)]) + FEFO

# ---------------------------------------------------------------- anomaly
ANOM_MV = ("amv", "SELECT * REPLACE (CASE WHEN order_key % 31 = 0 THEN quantity * 6 ELSE quantity END AS quantity) "
                  "FROM stock_movements")
BASELINES = f"""
    SELECT m.depot_id, p.product_category, avg(m.quantity) AS mean,
           CASE WHEN stddev_samp(m.quantity) IS NULL OR stddev_samp(m.quantity) = 0 THEN 1.0
                ELSE stddev_samp(m.quantity) END AS std
    FROM amv m JOIN products p ON p.product_id = m.product_id
    WHERE m.created_at >= {AS_OF_TS} - INTERVAL 30 DAY AND m.created_at <= {AS_OF_TS}
    GROUP BY m.depot_id, p.product_category"""
ORACLE["category_baselines"] = R6(with_tables("stock_movements", "products", extra=[ANOM_MV]) + BASELINES,
                                  ["mean", "std"])
ORACLE["anomaly_features"] = R6(with_tables("stock_movements", "products", "batches",
                                            extra=[ANOM_MV, ("base", BASELINES)]) + f"""
    SELECT m.movement_id, m.batch_id, m.product_id, m.depot_id,
           hour(m.created_at) AS hour_of_day, isodow(m.created_at) - 1 AS day_of_week,
           CAST(greatest(coalesce(floor((epoch(m.created_at) - epoch(b.created_at)) / 86400), 0), 0) AS INTEGER)
               AS batch_age_days,
           CASE m.movement_type WHEN 'IN' THEN 0 WHEN 'OUT' THEN 1 WHEN 'RETURN' THEN 2 WHEN 'WRITE_OFF' THEN 3
                WHEN 'TRANSFER' THEN 4 ELSE 0 END AS movement_type_enc,
           CASE WHEN bs.mean IS NULL THEN 0.0 ELSE (m.quantity - bs.mean) / bs.std END AS quantity_zscore,
           (m.quantity - coalesce(pa.product_avg, m.quantity)) / greatest(coalesce(pa.product_avg, 1.0), 1.0)
               AS velocity_deviation,
           m.quantity
    FROM amv m JOIN products p ON p.product_id = m.product_id
    LEFT JOIN batches b ON b.batch_id = m.batch_id
    LEFT JOIN base bs ON bs.depot_id = m.depot_id AND bs.product_category = p.product_category
    LEFT JOIN (SELECT depot_id, product_id, avg(quantity) AS product_avg FROM amv
               WHERE created_at >= {AS_OF_TS} - INTERVAL 30 DAY AND created_at <= {AS_OF_TS}
               GROUP BY depot_id, product_id) pa ON pa.depot_id = m.depot_id AND pa.product_id = m.product_id""",
                                ["quantity_zscore", "velocity_deviation", "quantity"])
ANOMALY_FLAGS = f"""
    SELECT * FROM (
      SELECT m.depot_id, m.movement_id, m.batch_id, m.product_id, round(z, 2) AS z_score,
             CASE WHEN z > 2.5 THEN 'ANOMALY_HOLD' WHEN z > 2.0 THEN 'ANOMALY_ALERT' END AS action,
             CAST(m.quantity AS DOUBLE) AS quantity, m.movement_type
      FROM (SELECT m.*, CASE WHEN bs.mean IS NULL THEN 0.0
                             ELSE abs(m.quantity - bs.mean) / greatest(bs.std, 1.0) END AS z
            FROM amv m JOIN products p ON p.product_id = m.product_id
            LEFT JOIN base bs ON bs.depot_id = m.depot_id AND bs.product_category = p.product_category
            WHERE m.created_at >= {AS_OF_TS} - INTERVAL 2 DAY AND m.created_at <= {AS_OF_TS}) m)
    WHERE action IS NOT NULL"""
ORACLE["anomaly_flags"] = with_tables("stock_movements", "products",
                                      extra=[ANOM_MV, ("base", BASELINES)]) + ANOMALY_FLAGS
ORACLE["temperature_anomalies"] = R6(with_tables("readings") + """
    SELECT reading_id, device_id, depot_id, temperature, ts, z AS z_score,
           CASE WHEN z > 2.5 THEN 'ANOMALY_HOLD' WHEN z > 2.0 THEN 'ANOMALY_ALERT' END AS action,
           coalesce(z > 2.0, false) AS is_excursion
    FROM (SELECT r.*, CASE WHEN b.mean IS NULL AND r.temperature IS NOT NULL THEN 0.0
                           ELSE abs((r.temperature - b.mean) / b.std) END AS z
          FROM readings r LEFT JOIN (
              SELECT device_id, avg(temperature) AS mean,
                     CASE WHEN stddev_samp(temperature) IS NULL OR stddev_samp(temperature) = 0 THEN 1.0
                          ELSE stddev_samp(temperature) END AS std
              FROM readings GROUP BY device_id) b ON b.device_id = r.device_id) r""",
                                     ["temperature", "z_score"])



# ---------------------------------------------------------------- views and decisions (critical = 0.75)
ACT = "depot_id IN (SELECT depot_id FROM depots WHERE is_active)"
SALES_ACTIVE = DAILY_DEMAND.replace("WHERE sm.movement_type = 'OUT'", "WHERE d.is_active AND sm.movement_type = 'OUT'")
NIGHT_CTES = [("sales", SALES_ACTIVE)] + FORECAST_CTES[1:] + ACTIVE_CTES + [("formula", FORMULA)] + [
    ("dem", f"SELECT *, {AS_OF} AS run_date FROM forecast"),
    ("exp", f"SELECT *, {AS_OF} AS run_date FROM formula WHERE {ACT}"),
    ("stockout", f"""SELECT *, {AS_OF} AS run_date FROM (
        SELECT s.depot_id, s.product_id, round(greatest(s.stock, 0.0), 2) AS current_stock,
               round(greatest(s.stock, 0.0) / greatest(coalesce(f.predicted_daily_rate, 0.0), 0.01), 1) AS days_until_stockout,
               CAST(coalesce(p.lead_time_days, 7) AS DOUBLE) AS lead_time_days,
               greatest(s.stock, 0.0) / greatest(coalesce(f.predicted_daily_rate, 0.0), 0.01)
                   < CAST(coalesce(p.lead_time_days, 7) AS DOUBLE) AS will_stockout
        FROM (SELECT depot_id, product_id, {BALANCE} AS stock FROM stock_movements GROUP BY depot_id, product_id) s
        JOIN products p ON p.product_id = s.product_id
        LEFT JOIN forecast f ON f.depot_id = s.depot_id AND f.product_id = s.product_id
        WHERE s.stock >= 0) WHERE {ACT}"""),
    ("fefo", f"SELECT *, {AS_OF} AS run_date FROM ({FEFO}) WHERE {ACT}"),
    ANOM_MV, ("base", BASELINES),
    ("flags", f"SELECT *, {AS_OF} AS run_date FROM ({ANOMALY_FLAGS}) WHERE {ACT}"),
    ("cash", f"""SELECT d.depot_id, coalesce(CAST(g.net AS DOUBLE), 0.0) < 0 AS cashflow_negative
        FROM depots d LEFT JOIN (
            SELECT depot_id, sum(CASE WHEN transaction_type = 'INFLOW' THEN amount
                                      WHEN transaction_type = 'OUTFLOW' THEN -amount ELSE 0 END) AS net
            FROM payment_transactions WHERE transaction_date >= {AS_OF} - 14 AND transaction_date <= {AS_OF}
            GROUP BY depot_id) g ON g.depot_id = d.depot_id WHERE d.is_active"""),
    ("v_expiry", """SELECT e.depot_id, e.batch_id, e.expiry_risk_score, e.recommended_liquidation_date, e.method,
                           e.run_date, b.product_id, b.quantity_remaining AS remaining_qty,
                           CAST(p.ptr AS DOUBLE) AS ptr, p.canonical_name AS product_name
                    FROM exp e JOIN batches b ON b.batch_id = e.batch_id JOIN products p ON p.product_id = b.product_id"""),
    ("v_stockout", """SELECT s.*, p.canonical_name AS product_name, d.predicted_units_14d
                      FROM stockout s JOIN products p ON p.product_id = s.product_id
                      LEFT JOIN dem d ON d.product_id = s.product_id AND d.depot_id = s.depot_id
                                     AND d.run_date = s.run_date"""),
    ("v_fefo", """SELECT b.product_id, f.depot_id, f.run_date, f.batch_id, f.priority_rank, f.priority_score,
                         f.ml_override, f.expiry_risk_score, f.days_till_expiry,
                         b.quantity_remaining AS units_available, b.expiry_date, p.canonical_name AS product_name,
                         d.predicted_units_14d
                  FROM fefo f JOIN batches b ON b.batch_id = f.batch_id JOIN products p ON p.product_id = b.product_id
                  LEFT JOIN dem d ON d.product_id = b.product_id AND d.depot_id = f.depot_id AND d.run_date = f.run_date"""),
    ("v_anomaly", """SELECT f.* EXCLUDE (product_id), f.product_id, p.canonical_name AS product_name
                     FROM flags f LEFT JOIN products p ON p.product_id = f.product_id"""),
    ("d_anomaly", """SELECT depot_id, 'AnomalyAgent' AS agent,
                            CASE WHEN action = 'ANOMALY_HOLD' THEN 'ANOMALY_HOLD' ELSE 'ANOMALY_ALERT' END AS action_type,
                            CASE WHEN action = 'ANOMALY_HOLD' THEN 'APPROVE' ELSE 'NOTIFY' END AS approval_tier,
                            batch_id, product_id, 'anomaly_' || coalesce(batch_id, '') AS conflict_key, 1 AS rule_no,
                            coalesce(product_name, 'Unknown') || ': Z-score ' || printf('%.1f', round(coalesce(z_score, 0.0), 1))
                            || ' on ' || coalesce(movement_type, '') || ' of ' || printf('%.0f', round(coalesce(quantity, 0.0), 0))
                            || ' units — ' || CASE WHEN action = 'ANOMALY_HOLD' THEN 'batch HELD pending investigation.'
                                                   ELSE 'flagged for review.' END AS reason
                     FROM v_anomaly"""),
    ("d_expiry", """SELECT depot_id, 'ExpiryPreventionAgent' AS agent,
                           CASE WHEN r >= 0.75 THEN 'SUGGEST_LIQUIDATION' ELSE 'FLAG_PRIORITY_DISPATCH' END AS action_type,
                           CASE WHEN r >= 0.75 THEN 'APPROVE' ELSE 'NOTIFY' END AS approval_tier,
                           batch_id, product_id, 'expiry_' || batch_id AS conflict_key, 2 AS rule_no,
                           CASE WHEN r >= 0.75 THEN
                                nm || ': expiry risk ' || printf('%.0f', round(r, 2) * 100) || '% — critical. Liquidate by '
                                || liq || ' or lose ₹' || format('{:,.0f}', round(round(rem * ptr0, 2), 0)) || '.'
                           ELSE nm || ': expiry risk ' || printf('%.0f', round(r, 2) * 100) || '% — priority dispatch recommended.'
                           END AS reason
                    FROM (SELECT *, coalesce(expiry_risk_score, 0.0) AS r, coalesce(CAST(remaining_qty AS DOUBLE), 0.0) AS rem,
                                 coalesce(ptr, 0.0) AS ptr0, coalesce(product_name, 'Unknown') AS nm,
                                 coalesce(CAST(recommended_liquidation_date AS VARCHAR), '') AS liq FROM v_expiry)
                    WHERE r >= 0.60"""),
    ("liq", "SELECT DISTINCT depot_id, product_id FROM v_expiry WHERE expiry_risk_score >= 0.75"),
    ("held", "SELECT DISTINCT depot_id, batch_id FROM v_anomaly WHERE action = 'ANOMALY_HOLD'"),
    ("d_reorder", """SELECT depot_id, 'ReorderAgent' AS agent, 'SUGGEST_REORDER' AS action_type,
                            CASE WHEN dd < ld THEN 'APPROVE' ELSE 'NOTIFY' END AS approval_tier,
                            CAST(NULL AS VARCHAR) AS batch_id, product_id, 'reorder_' || product_id AS conflict_key,
                            3 AS rule_no,
                            nm || ': stock out in ' || printf('%.0f', round(dd, 0)) || ' days (lead time '
                            || printf('%.0f', round(ld, 0)) || ' days). Suggest ordering ' || CAST(qty AS VARCHAR)
                            || ' units.' || CASE WHEN neg THEN ' [qty reduced 30% — cashflow negative]' ELSE '' END AS reason
                     FROM (SELECT *, CASE WHEN neg THEN greatest(CAST(floor(q0 * (1 - 0.3)) AS BIGINT), 1) ELSE q0 END AS qty
                           FROM (SELECT s.*, coalesce(CAST(s.days_until_stockout AS DOUBLE), 0.0) AS dd,
                                        coalesce(CAST(s.lead_time_days AS DOUBLE), 7.0) AS ld,
                                        greatest(CAST(floor(coalesce(CAST(s.predicted_units_14d AS DOUBLE), 0.0)) AS BIGINT), 1) AS q0,
                                        coalesce(c.cashflow_negative, false) AS neg,
                                        coalesce(s.product_name, 'Unknown') AS nm
                                 FROM v_stockout s LEFT JOIN cash c ON c.depot_id = s.depot_id
                                 WHERE NOT EXISTS (SELECT 1 FROM liq l WHERE l.depot_id = s.depot_id
                                                   AND l.product_id = s.product_id)))
                     WHERE dd < ld * 1.5"""),
    ("d_dispatch", """SELECT depot_id, 'DispatchAgent' AS agent, 'DISPATCH_PLAN' AS action_type, 'AUTO' AS approval_tier,
                             batch_id, product_id, 'dispatch_' || batch_id AS conflict_key, 4 AS rule_no,
                             nm || ': dispatch ' || printf('%.0f', round(u, 0)) || ' units (expires in '
                             || CAST(days_till_expiry AS VARCHAR) || 'd, rank #' || CAST(priority_rank AS VARCHAR) || ')'
                             AS reason
                      FROM (SELECT f.*, least(coalesce(CAST(f.units_available AS DOUBLE), 0.0),
                                              coalesce(CAST(f.predicted_units_14d AS DOUBLE), d.predicted_units_14d, 0.0)) AS u,
                                   coalesce(f.product_name, 'Unknown') AS nm
                            FROM v_fefo f LEFT JOIN dem d ON d.depot_id = f.depot_id AND d.product_id = f.product_id
                            WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.depot_id = f.depot_id AND h.batch_id = f.batch_id))
                      WHERE u > 0"""),
]
_NIGHT = with_tables("depots", "products", "stock_movements", "batches", "payment_transactions", extra=NIGHT_CTES)
ORACLE["v_expiry_predictions"] = R6(_NIGHT + "SELECT * FROM v_expiry", ["ptr"])
ORACLE["v_stockout_risks"] = R6(_NIGHT + "SELECT * FROM v_stockout",
                                ["current_stock", "days_until_stockout", "lead_time_days", "predicted_units_14d"])
ORACLE["v_fefo_rankings"] = R6(_NIGHT + "SELECT * FROM v_fefo",
                               ["priority_score", "expiry_risk_score", "predicted_units_14d"])
ORACLE["v_anomaly_flags"] = R6(_NIGHT + "SELECT * FROM v_anomaly", ["z_score", "quantity"])
ORACLE["anomaly_decisions"] = _NIGHT + "SELECT * FROM d_anomaly"
ORACLE["expiry_decisions"] = _NIGHT + "SELECT * FROM d_expiry"
ORACLE["reorder_decisions"] = _NIGHT + "SELECT * FROM d_reorder"
ORACLE["dispatch_decisions"] = _NIGHT + "SELECT * FROM d_dispatch"
ORACLE["resolve_decisions"] = _NIGHT + f"""
    SELECT *, CAST(row_number() OVER (PARTITION BY depot_id ORDER BY priority, rule_no, conflict_key, batch_id,
                                      product_id) AS INTEGER) AS seq, {AS_OF} AS run_date
    FROM (SELECT *, CASE action_type WHEN 'ANOMALY_HOLD' THEN 1 WHEN 'SUGGEST_LIQUIDATION' THEN 2
                     WHEN 'FLAG_PRIORITY_DISPATCH' THEN 3 WHEN 'SUGGEST_REORDER' THEN 4 WHEN 'DISPATCH_PLAN' THEN 5
                     WHEN 'ANOMALY_ALERT' THEN 6 ELSE 99 END AS priority
          FROM (SELECT * FROM d_anomaly UNION ALL SELECT * FROM d_expiry UNION ALL SELECT * FROM d_dispatch
                UNION ALL SELECT * FROM d_reorder r WHERE NOT EXISTS (
                    SELECT 1 FROM d_expiry e WHERE e.action_type = 'SUGGEST_LIQUIDATION'
                      AND e.depot_id = r.depot_id AND e.product_id = r.product_id)))"""
ORACLE["run_status"] = _NIGHT + """
    SELECT d.depot_id, CASE WHEN NOT EXISTS (SELECT 1 FROM dem x WHERE x.depot_id = d.depot_id) THEN 'FAILED'
                            WHEN NOT EXISTS (SELECT 1 FROM exp x WHERE x.depot_id = d.depot_id)
                              OR NOT EXISTS (SELECT 1 FROM fefo x WHERE x.depot_id = d.depot_id) THEN 'PARTIAL'
                            ELSE 'SUCCESS' END AS status
    FROM depots d WHERE d.is_active"""

ORACLE = {k: _rewrite_round(v) for k, v in ORACLE.items()}

# ---------------------------------------------------------------- reconciliation (appended before rewrite)
OPEN = """SELECT id, retailer_id, depot_id, invoice_date, total_amount,
                 CAST(row_number() OVER (PARTITION BY retailer_id ORDER BY invoice_date, id) AS INTEGER) AS pos
          FROM invoices WHERE status IN ('PENDING', 'PARTIAL')"""
ORACLE["open_invoices"] = with_tables("invoices", extra=[("open", OPEN)]) + \
    "SELECT * REPLACE (CAST(total_amount AS DOUBLE) AS total_amount) FROM open"
EXACT = """SELECT p.id AS payment_id, arg_min(o.id, o.pos) AS invoice_id, min(o.pos) AS pos
           FROM payments p JOIN open o ON o.retailer_id = p.retailer_id
           WHERE o.total_amount < 0 OR o.total_amount > 0 AND abs(p.amount_paid - o.total_amount) <= 0.01 * o.total_amount
           GROUP BY p.id"""
PARTIAL = """SELECT p.id AS payment_id, arg_min(o.id, o.pos) AS invoice_id,
                    arg_min(o.total_amount, o.pos) AS total_amount, min(o.pos) AS pos
             FROM payments p JOIN open o ON o.retailer_id = p.retailer_id
             WHERE o.total_amount <> 0
               AND CASE WHEN o.total_amount > 0 THEN 0.10 * o.total_amount <= p.amount_paid AND p.amount_paid < o.total_amount
                        ELSE 0.10 * o.total_amount >= p.amount_paid AND p.amount_paid > o.total_amount END
             GROUP BY p.id"""
REC_CTES = [("open", OPEN), ("exact", EXACT), ("partial", PARTIAL)]
ORACLE["match_exact"] = with_tables("invoices", "payments", extra=REC_CTES) + "SELECT * FROM exact"
ORACLE["match_partial"] = with_tables("invoices", "payments", extra=REC_CTES) + \
    "SELECT * REPLACE (CAST(total_amount AS DOUBLE) AS total_amount) FROM partial"


def _bundles(n: int, pay_source: str) -> str:
    cols = ", ".join(f"o{i}.pos" for i in range(1, n + 1))
    ids = ", ".join(f"CAST(o{i}.id AS VARCHAR)" for i in range(1, n + 1))
    total = " + ".join(f"o{i}.total_amount" for i in range(1, n + 1))
    joins = " ".join(f"JOIN open o{i} ON o{i}.retailer_id = p.retailer_id"
                     + (f" AND o{i}.pos > o{i-1}.pos" if i > 1 else "") for i in range(1, n + 1))
    return f"""SELECT p.id AS payment_id, {n} AS n, [{n}, {cols}] AS ord, [{ids}] AS ids
               FROM {pay_source} p {joins}
               WHERE {total} < 0 OR {total} > 0 AND abs(p.amount_paid - ({total})) <= 0.02 * ({total})"""


REST = ("rest", "SELECT * FROM payments WHERE id NOT IN (SELECT payment_id FROM exact) "
                "AND id NOT IN (SELECT payment_id FROM partial)")
CONSOL = ("consol", "SELECT payment_id, arg_min(n, ord) AS n, arg_min(ids, ord) AS ids FROM ("
          + " UNION ALL ".join(_bundles(n, "rest") for n in range(2, 6)) + ") GROUP BY payment_id")
ORACLE["match_consolidated"] = with_tables("invoices", "payments", extra=REC_CTES + [REST, CONSOL]) + \
    "SELECT payment_id, n, array_to_string(ids, ',') AS invoice_ids FROM consol"
CASCADE = """
    SELECT p.id AS payment_id, p.retailer_id, p.depot_id,
           CASE WHEN e.payment_id IS NOT NULL THEN 'SETTLED' WHEN pa.payment_id IS NOT NULL THEN 'PARTIAL'
                WHEN c.payment_id IS NOT NULL THEN 'SETTLED' ELSE 'ADVANCE' END AS reconciliation_status,
           CASE WHEN e.payment_id IS NOT NULL THEN 'exact_match' WHEN pa.payment_id IS NOT NULL THEN 'partial_payment'
                WHEN c.payment_id IS NOT NULL THEN 'consolidated_payment' ELSE 'advance_payment' END AS rule,
           CASE WHEN e.payment_id IS NOT NULL THEN 100 WHEN pa.payment_id IS NOT NULL THEN 85
                WHEN c.payment_id IS NOT NULL THEN 90 ELSE 70 END AS confidence,
           CASE WHEN e.payment_id IS NOT NULL THEN CAST(e.invoice_id AS VARCHAR)
                WHEN pa.payment_id IS NOT NULL THEN CAST(pa.invoice_id AS VARCHAR)
                WHEN c.payment_id IS NOT NULL THEN array_to_string(c.ids, ',') ELSE '' END AS matched_invoices,
           CASE WHEN e.payment_id IS NULL AND pa.payment_id IS NOT NULL THEN pa.total_amount - p.amount_paid
                ELSE CAST(0 AS DECIMAL(12,2)) END AS balance_remaining
    FROM payments p LEFT JOIN exact e ON e.payment_id = p.id LEFT JOIN partial pa ON pa.payment_id = p.id
    LEFT JOIN consol c ON c.payment_id = p.id"""
CASCADE_CTES = REC_CTES + [REST, CONSOL, ("cascade", CASCADE)]
ORACLE["match_cascade"] = with_tables("invoices", "payments", extra=CASCADE_CTES) + \
    "SELECT * REPLACE (CAST(balance_remaining AS DOUBLE) AS balance_remaining) FROM cascade"
ORACLE["apply_scheme"] = with_tables("invoices", "payments", "discount_schemes", extra=CASCADE_CTES) + """
    SELECT payment_id, reconciliation_status,
           CAST(CASE WHEN applies THEN greatest(CAST(balance_remaining AS DECIMAL(14,4)) - ded, 0)
                     ELSE CAST(balance_remaining AS DECIMAL(14,4)) END AS DOUBLE) AS balance_remaining,
           CAST(CASE WHEN applies THEN ded END AS DOUBLE) AS scheme_deduction
    FROM (SELECT c.*, c.reconciliation_status = 'PARTIAL' AND coalesce(json_extract_string(s.terms, '$.type') = 'percent', false) AS applies,
                 CAST(CAST(c.balance_remaining AS DOUBLE) * CAST(json_extract_string(s.terms, '$.value') AS DOUBLE) / 100
                      AS DECIMAL(14,4)) AS ded
          FROM cascade c LEFT JOIN discount_schemes s ON s.depot_id = c.depot_id)"""
# One movement of every batch per step.
ORACLE["apply_stock_out"] = R6(with_tables("stock_movements", extra=[
    ("moves", """SELECT batch_id, movement_id, movement_type, quantity,
                        row_number() OVER (PARTITION BY batch_id ORDER BY created_at, movement_id) AS k FROM stock_movements"""),
    ("folded", """
        SELECT batch_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS movement_id, true AS accepted, CAST(0 AS DOUBLE) AS stock_after
        FROM (SELECT DISTINCT batch_id FROM moves)
        UNION ALL
        SELECT m.batch_id, m.k, m.movement_id, m.movement_type NOT IN ('OUT', 'WRITE_OFF') OR f.stock_after >= m.quantity,
               f.stock_after + CASE WHEN m.movement_type IN ('IN', 'RETURN') THEN m.quantity
                                    WHEN m.movement_type IN ('OUT', 'WRITE_OFF') AND f.stock_after >= m.quantity THEN -m.quantity ELSE 0 END
        FROM folded f JOIN moves m ON m.batch_id = f.batch_id AND m.k = f.k + 1""")]).replace(
    "WITH ", "WITH RECURSIVE ", 1).replace("moves AS (", "moves AS MATERIALIZED (") + """
    SELECT batch_id, movement_id, accepted, stock_after FROM folded WHERE k > 0""", ["stock_after"])
# One payment of every retailer per step; ``gone`` holds the positions settled so far.
SEQUENTIAL = """
    SELECT retailer_id, 0 AS k, CAST([] AS INTEGER[]) AS gone, CAST(NULL AS VARCHAR) AS payment_id, CAST(NULL AS VARCHAR) AS rule,
           CAST([] AS INTEGER[]) AS used FROM (SELECT DISTINCT retailer_id FROM payments)
    UNION ALL
    SELECT retailer_id, k, CASE WHEN rule IN ('exact_match', 'consolidated_payment') THEN list_concat(gone, used) ELSE gone END, payment_id, rule, used
    FROM (SELECT retailer_id, k, gone, payment_id,
                 CASE WHEN e IS NOT NULL THEN 'exact_match' WHEN pa IS NOT NULL THEN 'partial_payment'
                      WHEN b IS NOT NULL THEN 'consolidated_payment' ELSE 'advance_payment' END AS rule,
                 CASE WHEN e IS NOT NULL THEN [e] WHEN pa IS NOT NULL THEN [pa] WHEN b IS NOT NULL THEN b[2:] ELSE [] END AS used
          FROM (SELECT s.retailer_id, s.k + 1 AS k, s.gone, p.id AS payment_id,
                       list_min(list_filter(c.exact_pos, lambda x: NOT list_contains(s.gone, x))) AS e,
                       list_min(list_filter(c.partial_pos, lambda x: NOT list_contains(s.gone, x))) AS pa,
                       list_min(list_filter(c.bundles, lambda x: NOT list_has_any(s.gone, x[2:]))) AS b
                FROM seq s JOIN ordered p ON p.retailer_id = s.retailer_id AND p.ord = s.k + 1 JOIN choices c ON c.id = p.id))"""
ORDERED = ("ordered", "SELECT *, row_number() OVER (PARTITION BY retailer_id ORDER BY collected_at, id) AS ord FROM payments")
CHOICES = ("choices", """SELECT p.id, exact_pos, partial_pos, bundles FROM payments p
    LEFT JOIN (SELECT p.id, list(o.pos) FILTER (o.total_amount < 0 OR o.total_amount > 0 AND abs(p.amount_paid - o.total_amount) <= 0.01 * o.total_amount) AS exact_pos,
                      list(o.pos) FILTER (CASE WHEN o.total_amount > 0 THEN 0.10 * o.total_amount <= p.amount_paid AND p.amount_paid < o.total_amount
                        WHEN o.total_amount < 0 THEN 0.10 * o.total_amount >= p.amount_paid AND p.amount_paid > o.total_amount ELSE false END) AS partial_pos
               FROM payments p JOIN open o ON o.retailer_id = p.retailer_id GROUP BY p.id) USING (id)
    LEFT JOIN (SELECT payment_id AS id, list(ord) AS bundles FROM (""" + " UNION ALL ".join(_bundles(n, "payments") for n in range(2, 6)) + ") GROUP BY 1) USING (id)")
ORACLE["match_sequential"] = with_tables("invoices", "payments", extra=[("open", OPEN), ORDERED, CHOICES, ("seq", SEQUENTIAL)]).replace("WITH ", "WITH RECURSIVE ", 1).replace(
    "ordered AS (", "ordered AS MATERIALIZED (").replace("choices AS (", "choices AS MATERIALIZED (") + """
    SELECT s.payment_id, s.retailer_id, CASE rule WHEN 'partial_payment' THEN 'PARTIAL' WHEN 'advance_payment' THEN 'ADVANCE' ELSE 'SETTLED' END AS reconciliation_status,
           rule, CASE rule WHEN 'exact_match' THEN 100 WHEN 'partial_payment' THEN 85 WHEN 'consolidated_payment' THEN 90 ELSE 70 END AS confidence,
           coalesce((SELECT string_agg(CAST(o.id AS VARCHAR), ',' ORDER BY o.pos) FROM open o WHERE o.retailer_id = s.retailer_id AND list_contains(s.used, o.pos)), '') AS matched_invoices,
           CASE rule WHEN 'partial_payment' THEN CAST((SELECT o.total_amount FROM open o WHERE o.retailer_id = s.retailer_id AND o.pos = s.used[1]) - p.amount_paid AS DOUBLE)
                ELSE 0.0 END AS balance_remaining
    FROM seq s JOIN payments p ON p.id = s.payment_id WHERE s.k > 0"""
PAID = ("paid", "SELECT invoice_id, sum(amount_paid) AS paid FROM payments WHERE invoice_id IS NOT NULL "
                "GROUP BY invoice_id")
ORACLE["retailer_statement"] = R6(with_tables("invoices", "payments", "retailers", extra=[PAID]) + f"""
    SELECT i.retailer_id, r.name AS retailer_name, CAST(r.current_outstanding AS DOUBLE) AS outstanding_total,
           CAST(r.credit_limit AS DOUBLE) AS credit_limit, i.id AS invoice_id, i.invoice_number, i.invoice_date,
           CAST(i.total_amount AS DOUBLE) AS total_amount, i.status,
           CAST(coalesce(p.paid, 0) AS DOUBLE) AS amount_paid,
           CAST(i.total_amount - coalesce(p.paid, 0) AS DOUBLE) AS balance_due,
           date_diff('day', i.invoice_date, {AS_OF}) AS days_overdue
    FROM invoices i LEFT JOIN paid p ON p.invoice_id = CAST(i.id AS VARCHAR)
    LEFT JOIN retailers r ON r.id = i.retailer_id""",
                                     ["outstanding_total", "credit_limit", "total_amount", "amount_paid", "balance_due"])
ORACLE["aging_report"] = R6(with_tables("invoices", "payments", extra=[PAID]) + f"""
    SELECT depot_id, count_0_30, CAST(t1 AS DOUBLE) AS total_0_30, count_31_60, CAST(t2 AS DOUBLE) AS total_31_60,
           count_60_plus, CAST(t3 AS DOUBLE) AS total_60_plus, CAST(t1 + t2 + t3 AS DOUBLE) AS total_outstanding
    FROM (SELECT i.depot_id,
                 count(*) FILTER (WHERE d <= 30) AS count_0_30, coalesce(sum(CASE WHEN d <= 30 THEN due END), 0) AS t1,
                 count(*) FILTER (WHERE d BETWEEN 31 AND 60) AS count_31_60,
                 coalesce(sum(CASE WHEN d BETWEEN 31 AND 60 THEN due END), 0) AS t2,
                 count(*) FILTER (WHERE d > 60) AS count_60_plus, coalesce(sum(CASE WHEN d > 60 THEN due END), 0) AS t3
          FROM (SELECT i.*, date_diff('day', i.invoice_date, {AS_OF}) AS d,
                       i.total_amount - coalesce(p.paid, 0) AS due
                FROM invoices i LEFT JOIN paid p ON p.invoice_id = CAST(i.id AS VARCHAR)
                WHERE i.status <> 'SETTLED') i
          GROUP BY i.depot_id)""",
                            ["total_0_30", "total_31_60", "total_60_plus", "total_outstanding"])
ORACLE["dso"] = R6(with_tables("invoices", "retailers") + f"""
    SELECT r.id AS retailer_id,
           CAST(trunc(coalesce(CAST(r.current_outstanding AS DOUBLE), 0.0) /
                CASE WHEN coalesce(CAST(s.sales AS DOUBLE), 0.0) > 0 THEN CAST(s.sales AS DOUBLE) / 30 ELSE 0.01 END)
                AS BIGINT) AS dso_days,
           'stable' AS trend, coalesce(CAST(s.sales AS DOUBLE), 0.0) AS last_30d_collections
    FROM retailers r LEFT JOIN (SELECT retailer_id, sum(total_amount) AS sales FROM invoices
                                WHERE invoice_date >= {AS_OF} - 30 GROUP BY retailer_id) s ON s.retailer_id = r.id""",
                   ["last_30d_collections"])
ORACLE["duplicate_invoices"] = with_tables("invoices") + """
    SELECT id, depot_id, invoice_number, created_at, dup AS is_duplicate,
           CASE WHEN dup THEN prev_id END AS matching_invoice_id, CASE WHEN dup THEN 100.0 END AS similarity_score
    FROM (SELECT *, coalesce(prev_id IS NOT NULL AND prev_created_at >= created_at - INTERVAL 7 DAY, false) AS dup
          FROM (SELECT id, depot_id, invoice_number, created_at,
                       lag(id) OVER w AS prev_id, lag(created_at) OVER w AS prev_created_at
                FROM invoices WINDOW w AS (PARTITION BY depot_id, invoice_number ORDER BY created_at, id)))"""
ORACLE["net_cashflow"] = R6(with_tables("depots", "payment_transactions") + f"""
    SELECT d.depot_id, coalesce(CAST(g.net AS DOUBLE), 0.0) AS net_14d,
           coalesce(CAST(g.net AS DOUBLE), 0.0) < 0 AS cashflow_negative
    FROM depots d LEFT JOIN (
        SELECT depot_id, sum(CASE WHEN transaction_type = 'INFLOW' THEN amount
                                  WHEN transaction_type = 'OUTFLOW' THEN -amount ELSE 0 END) AS net
        FROM payment_transactions WHERE transaction_date >= {AS_OF} - 14 AND transaction_date <= {AS_OF}
        GROUP BY depot_id) g ON g.depot_id = d.depot_id""", ["net_14d"])

ORACLE = {k: _rewrite_round(v) for k, v in ORACLE.items()}

# ---------------------------------------------------------------- drift
_DRIFT_LONG = " UNION ALL ".join(
    f"SELECT side, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM li"
    for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
PSI_SQL = f"""
WITH li AS (SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'base' ELSE 'curr' END AS side, * FROM lineitem),
long AS ({_DRIFT_LONG}),
bounds AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY feature),
totals AS (SELECT feature, side, count(*) AS n FROM long GROUP BY feature, side),
b0 AS (SELECT l.feature, l.side, l.value, b.lo, b.hi,
              least(CAST(floor((l.value - b.lo) * (10.0 / (b.hi - b.lo))) AS INTEGER), 9) AS i0
       FROM long l JOIN bounds b ON b.feature = l.feature WHERE l.value IS NOT NULL AND b.hi > b.lo),
b1 AS (SELECT *, CASE WHEN value < CAST(i0 AS DOUBLE) * ((hi - lo) / 10.0) + lo THEN i0 - 1 ELSE i0 END AS i1 FROM b0),
b2 AS (SELECT feature, side, CASE WHEN i1 <> 9 AND value >= CASE WHEN i1 + 1 >= 10 THEN hi
                                ELSE CAST(i1 + 1 AS DOUBLE) * ((hi - lo) / 10.0) + lo END THEN i1 + 1 ELSE i1 END AS bin
       FROM b1
       UNION ALL SELECT l.feature, l.side, 9 FROM long l JOIN bounds b ON b.feature = l.feature
       WHERE l.value IS NOT NULL AND b.hi = b.lo),
counts AS (SELECT feature, side, bin, count(*) AS c FROM b2 GROUP BY ALL),
grid AS (SELECT feature, unnest(range(0, 10)) AS bin FROM bounds),
shares AS (
  SELECT g.feature, g.bin,
         greatest(coalesce(cb.c, 0) / greatest(coalesce(tb.n, 0), 1), 1e-6) AS b,
         greatest(coalesce(cc.c, 0) / greatest(coalesce(tc.n, 0), 1), 1e-6) AS c
  FROM grid g
  LEFT JOIN counts cb ON cb.feature = g.feature AND cb.bin = g.bin AND cb.side = 'base'
  LEFT JOIN totals tb ON tb.feature = g.feature AND tb.side = 'base'
  LEFT JOIN counts cc ON cc.feature = g.feature AND cc.bin = g.bin AND cc.side = 'curr'
  LEFT JOIN totals tc ON tc.feature = g.feature AND tc.side = 'curr'),
psi AS (SELECT feature, round(sum((c - b) * ln(c / b)), 4) AS psi FROM shares GROUP BY feature)
"""
ORACLE["psi"] = _rewrite_round(PSI_SQL + "SELECT * FROM psi")
ORACLE["drift_report"] = _rewrite_round(PSI_SQL + """,
rep AS (SELECT *, CASE WHEN psi >= 0.20 THEN 'drift_alert' WHEN psi >= 0.10 THEN 'slight_drift' ELSE 'stable' END AS status
        FROM psi)
SELECT *, (SELECT coalesce(bool_or(status = 'drift_alert'), false) FROM rep) AS needs_retraining,
       (SELECT count(*) FILTER (WHERE status = 'drift_alert') FROM rep) AS n_features_drifted FROM rep""")

# ---------------------------------------------------------------- cold chain
PARSED = ("parsed", """SELECT reading_id AS message_id, depot_id, device_id, temperature,
                              to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)) AS ts, false AS dead_letter
                       FROM readings""")
THRESH = ("thresh", f"""
    SELECT d.device_id, d.depot_id, coalesce(l.p_min, 2.0) AS threshold_min, coalesce(l.p_max, 8.0) AS threshold_max
    FROM (SELECT DISTINCT device_id, depot_id FROM readings) d
    LEFT JOIN (SELECT s.depot_id, max(p.storage_temp_min) AS p_min, min(p.storage_temp_max) AS p_max
               FROM (SELECT DISTINCT depot_id, product_id FROM batches
                     WHERE expiry_date > {AS_OF} AND quantity_remaining > 0) s
               JOIN products p ON p.product_id = s.product_id
               WHERE p.is_cold_chain AND p.storage_temp_min IS NOT NULL AND p.storage_temp_max IS NOT NULL
               GROUP BY s.depot_id) l ON l.depot_id = d.depot_id""")
FLAGGED = ("flagged", """
    SELECT p.message_id, p.depot_id, p.device_id, p.temperature, p.ts,
           coalesce(t.threshold_min, 2.0) AS threshold_min, coalesce(t.threshold_max, 8.0) AS threshold_max,
           p.temperature < coalesce(t.threshold_min, 2.0) OR p.temperature > coalesce(t.threshold_max, 8.0) AS is_excursion
    FROM parsed p LEFT JOIN thresh t ON t.device_id = p.device_id""")
_CC = with_tables("readings", "batches", "products", extra=[PARSED, THRESH, FLAGGED])
ORACLE["parse_readings"] = _rewrite_round(R6(_CC + "SELECT * FROM parsed", ["temperature"]))
ORACLE["device_thresholds"] = _CC + "SELECT * FROM thresh"
ORACLE["flag_excursions"] = _rewrite_round(R6(_CC + "SELECT * FROM flagged",
                                              ["temperature", "threshold_min", "threshold_max"]))
ORACLE["device_heartbeat"] = _CC + "SELECT device_id, max(ts) AS last_seen_at FROM parsed GROUP BY device_id"
ORACLE["excursion_alerts"] = _CC + """
    SELECT device_id, depot_id, ts, 'TEMPERATURE_EXCURSION' AS alert_type, 'QUEUED' AS status
    FROM flagged WHERE is_excursion"""
ORACLE["request_bursts"] = """
WITH hits AS (
  SELECT event_id AS hit_id, 'user' AS kind, CAST(user_id AS VARCHAR) AS key, CAST(ts AS TIMESTAMP) AS ts FROM events
  UNION ALL
  SELECT event_id + 1000000000000, 'ip', 'ip-' || CAST(user_id % 7 AS VARCHAR), CAST(ts AS TIMESTAMP) FROM events),
l AS (SELECT *, lag(ts) OVER (PARTITION BY kind, key ORDER BY ts, hit_id) AS prev_ts FROM hits),
s AS (SELECT *, max(CASE WHEN prev_ts IS NULL OR floor(epoch(ts)) - floor(epoch(prev_ts)) > 60 THEN ts END)
                  OVER (PARTITION BY kind, key ORDER BY ts, hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  AS session_start FROM l)
SELECT hit_id, kind, key, ts, session_start,
       CAST(row_number() OVER (PARTITION BY kind, key, session_start ORDER BY ts, hit_id) AS INTEGER) AS hit_in_session,
       row_number() OVER (PARTITION BY kind, key, session_start ORDER BY ts, hit_id)
           > CASE kind WHEN 'user' THEN 500 ELSE 100 END AS over_limit
FROM s"""

# ---------------------------------------------------------------- quality and ingest
SALES_12M_CLIENT = DAILY_DEMAND.replace("INTERVAL 60 DAY", "INTERVAL 365 DAY").replace(
    "WHERE sm.movement_type = 'OUT'", "WHERE d.client_id = 'CLIENT-0' AND sm.movement_type = 'OUT'")
SALES_12M = ("sales12", DAILY_DEMAND.replace("INTERVAL 60 DAY", "INTERVAL 365 DAY"))
_Q = with_tables("products", "depots", "stock_movements", "batches", extra=SALES_CTES + [SALES_12M])
ORACLE["client_demand_12m"] = _rewrite_round(R6(with_tables("products", "depots", "stock_movements")
                                                + SALES_12M_CLIENT, ["units_sold"]))
_nulls = " UNION ALL ".join(
    f"""SELECT 'nulls_{c}' AS "check", CASE WHEN n_{c} * 100.0 / n > 5 THEN 'error' ELSE 'warning' END AS severity,
               '{c}: ' || printf('%.1f', n_{c} * 100.0 / n) || '% nulls' AS message FROM agg WHERE n_{c} > 0"""
    for c in ["product_id", "depot_id", "date", "units_sold"])
ORACLE["validate_sales"] = _Q.rstrip().rstrip("\n") + f""",
agg AS (SELECT count(*) AS n, count(*) FILTER (WHERE product_id IS NULL) AS n_product_id,
               count(*) FILTER (WHERE depot_id IS NULL) AS n_depot_id, count(*) FILTER (WHERE date IS NULL) AS n_date,
               count(*) FILTER (WHERE units_sold IS NULL) AS n_units_sold,
               count(*) FILTER (WHERE units_sold < 0) AS neg, count(*) FILTER (WHERE date > {AS_OF} + 1) AS fut,
               (SELECT min(c) FROM (SELECT count(date) AS c FROM sales GROUP BY product_id, depot_id)) AS min_days
        FROM sales)
{_nulls}
UNION ALL SELECT 'negative_units', 'error', 'units_sold contains negative values' FROM agg WHERE neg > 0
UNION ALL SELECT 'future_dates', 'warning', 'Some dates are in the future' FROM agg WHERE fut > 0
UNION ALL SELECT 'short_history', 'warning', 'Some product-depot pairs have < 30 days history (min='
          || CAST(min_days AS VARCHAR) || '). Lag warmup rows will be dropped.' FROM agg WHERE min_days < 30"""
ORACLE["validate_batches"] = with_tables("batches") + f"""
    SELECT 'expired_batches' AS "check", 'warning' AS severity, CAST(past AS VARCHAR) || ' batches are already expired'
           AS message
    FROM (SELECT count(*) FILTER (WHERE expiry_date < {AS_OF}) AS past FROM batches) WHERE past > 0"""
ORACLE["training_sufficiency"] = _Q + f"""
    SELECT c.client_id, coalesce(s.span_days, 0) AS span_days, coalesce(e.expired, 0) AS expired_batches,
           CASE WHEN s.span_days IS NULL THEN 'GLOBAL' WHEN s.span_days >= 180 AND coalesce(e.expired, 0) >= 50 THEN 'BOTH'
                WHEN s.span_days >= 90 THEN 'DEMAND' ELSE 'GLOBAL' END AS training_mode,
           CASE WHEN s.span_days IS NULL THEN 'no sales data' END AS reason
    FROM (SELECT DISTINCT client_id FROM depots) c
    LEFT JOIN (SELECT d.client_id, CAST(date_diff('day', min(x.date), max(x.date)) AS INTEGER) AS span_days
               FROM sales12 x JOIN depots d ON d.depot_id = x.depot_id GROUP BY d.client_id) s ON s.client_id = c.client_id
    LEFT JOIN (SELECT d.client_id, count(*) FILTER (WHERE b.expiry_date < {AS_OF}) AS expired
               FROM batches b JOIN depots d ON d.depot_id = b.depot_id GROUP BY d.client_id) e ON e.client_id = c.client_id"""
ORACLE["row_constraints"] = with_tables("supplier_depot") + """
    SELECT invoice_id, line_no, concat_ws(',', CASE WHEN coalesce(quantity <= 0, true) THEN 'quantity_not_positive' END,
                                              CASE WHEN coalesce(mrp <= 0, true) THEN 'mrp_not_positive' END,
                                              CASE WHEN coalesce(ptr <= 0, true) THEN 'ptr_not_positive' END,
                                              CASE WHEN coalesce(gst_percent < 0 OR gst_percent > 28, true)
                                                   THEN 'gst_out_of_range' END) AS violations,
           NOT (coalesce(quantity <= 0, true) OR coalesce(mrp <= 0, true) OR coalesce(ptr <= 0, true)
                OR coalesce(gst_percent < 0 OR gst_percent > 28, true)) AS is_valid
    FROM (SELECT l_orderkey AS invoice_id, l_linenumber AS line_no, CAST(l_quantity AS INTEGER) AS quantity,
                 l_extendedprice / l_quantity * 1.2 AS mrp, l_extendedprice / l_quantity AS ptr,
                 l_tax * 400 AS gst_percent
          FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier_depot sd ON l_suppkey = sd.s_suppkey)"""
RAW_OUT = ("raw_out", """
    SELECT sm.product_id, sm.depot_id, CAST(sm.created_at AS DATE) AS date, sm.quantity AS units_sold,
           p.product_category, p.is_cold_chain, d.region AS depot_region
    FROM stock_movements sm JOIN products p ON p.product_id = sm.product_id JOIN depots d ON d.depot_id = sm.depot_id
    WHERE sm.movement_type = 'OUT'""")
_R = with_tables("products", "depots", "stock_movements", extra=[RAW_OUT])
ORACLE["collapse_duplicates"] = _rewrite_round(R6(_R + """
    SELECT product_id, depot_id, date, sum(units_sold) AS units_sold, min(product_category) AS product_category,
           min(is_cold_chain) AS is_cold_chain, min(depot_region) AS depot_region
    FROM raw_out GROUP BY product_id, depot_id, date""", ["units_sold"]))
ORACLE["positive_sales_filter"] = _rewrite_round(R6(_R + """
    SELECT * FROM (SELECT * REPLACE (units_sold - 5 AS units_sold) FROM raw_out)
    WHERE units_sold > 0 AND date IS NOT NULL AND product_id IS NOT NULL""", ["units_sold"]))
ORACLE["union_sources"] = _Q + """
    SELECT 'recent' AS _source, count(*) AS rows, min(date) AS min_date, max(date) AS max_date FROM sales
    UNION ALL SELECT 'client', count(*), min(date), max(date) FROM sales12"""
ORACLE["ingest_frame"] = _rewrite_round(R6(with_tables("stock_movements") + """
    SELECT CAST(created_at AS DATE) AS date, product_id, quantity AS units_sold, depot_id, batch_id AS batch_number,
           movement_id AS invoice_number, 'unknown' AS product_category, false AS is_cold_chain,
           'unknown' AS depot_region
    FROM stock_movements WHERE movement_type = 'OUT'""", ["units_sold"]))
ORACLE["unpivot_drug_sales"] = _rewrite_round(R6(with_tables("products", "stock_movements") + """
    SELECT d.date, p.product_id, coalesce(s.u, 0.0) AS units_sold, 'pharma_default' AS depot_id, substr(p.product_id, 1, 3) AS product_category,
           false AS is_cold_chain
    FROM (SELECT DISTINCT CAST(created_at AS DATE) AS date FROM stock_movements WHERE movement_type = 'OUT') d
    CROSS JOIN (SELECT product_id FROM products) p
    LEFT JOIN (SELECT CAST(created_at AS DATE) AS date, product_id, sum(quantity) AS u FROM stock_movements
               WHERE movement_type = 'OUT' GROUP BY ALL) s ON s.date = d.date AND s.product_id = p.product_id""",
                                                 ["units_sold"]))

# ---------------------------------------------------------------- training
ORACLE["chronological_split"] = _rewrite_round(R6(with_tables("products", "depots", "stock_movements",
                                                              extra=SALES_CTES) + """
    SELECT *, CASE WHEN date_diff('day', DATE '1970-01-01', date) <
                        (SELECT quantile_cont(CAST(date_diff('day', DATE '1970-01-01', date) AS DOUBLE), 0.8) FROM sales)
                   THEN 'train' ELSE 'test' END AS split
    FROM sales""", ["units_sold"]))
_FOLDS = [('1999-02-01', '2000-01-31', '2000-02-01', '2000-04-30'),
          ('1999-02-01', '2000-04-30', '2000-05-01', '2000-07-31'),
          ('1999-02-01', '2000-07-31', '2000-08-01', '2000-10-31'),
          ('1999-02-01', '2000-10-31', '2000-11-01', '2001-01-31'),
          ('1999-02-01', '2001-01-31', '2001-02-01', '2001-08-01')]
_FOLD_VALUES = ", ".join(f"({i + 1 if i < 4 else 0}, DATE '{a}', DATE '{b}', DATE '{c}', DATE '{d}')"
                         for i, (a, b, c, d) in enumerate(_FOLDS))
SALES_3Y = ("sales3", DAILY_DEMAND.replace("INTERVAL 60 DAY", "INTERVAL 1095 DAY"))
ORACLE["walk_forward_folds"] = _rewrite_round(R6(with_tables("products", "depots", "stock_movements",
                                                             extra=[SALES_3Y]) + f"""
    SELECT * FROM (
      SELECT s.*, f.fold,
             CASE WHEN s.depot_id = 'MIDDLE EAST' THEN 'train'
                  WHEN s.date BETWEEN f.tr_s AND f.tr_e THEN 'train'
                  WHEN s.date BETWEEN f.te_s AND f.te_e THEN 'test' END AS role
      FROM sales3 s, (VALUES {_FOLD_VALUES}) f(fold, tr_s, tr_e, te_s, te_e))
    WHERE role IS NOT NULL""", ["units_sold"]))
DAILY_BY_PRODUCT = ("dbp", """SELECT CAST(created_at AS DATE) AS date, product_id, sum(quantity) AS units_sold
                              FROM stock_movements WHERE movement_type = 'OUT' GROUP BY ALL""")
SYN = ("syn", """
    SELECT m.product_id, m.month, m.sold, q.received FROM
      (SELECT product_id, date_trunc('month', date) AS month, sum(units_sold) AS sold FROM dbp GROUP BY ALL) m
      JOIN (SELECT product_id, greatest(quantile_cont(sold, 0.75), 1.0) AS received
            FROM (SELECT product_id, date_trunc('month', date) AS month, sum(units_sold) AS sold FROM dbp GROUP BY ALL)
            GROUP BY product_id) q ON q.product_id = m.product_id""")
_SYN_BASE = with_tables("stock_movements", extra=[DAILY_BY_PRODUCT, SYN])
ORACLE["synthesise_batches"] = _rewrite_round(R6(_SYN_BASE + """
    SELECT product_id || '_' || strftime(month, '%Y-%m') AS batch_id, product_id, 'pharma_global' AS depot_id,
           CAST(month AS DATE) + 365 AS expiry_date, received AS quantity_received,
           greatest(received - sold, 0.0) AS quantity_remaining, 'pain_relief' AS product_category,
           false AS is_cold_chain, 365.0 AS default_shelf_life_days, CAST(month AS TIMESTAMP) AS created_at
    FROM syn""", ["quantity_received", "quantity_remaining", "default_shelf_life_days"]))
ORACLE["synthesise_movements"] = _rewrite_round(R6(_SYN_BASE + """
    SELECT product_id || '_' || strftime(month, '%Y-%m') AS batch_id, sold AS quantity, 'OUT' AS movement_type,
           CAST(CAST(month AS DATE) + 15 AS TIMESTAMP) AS created_at
    FROM syn WHERE sold > 0""", ["quantity"]))
ORACLE["time_series_folds"] = with_tables("batches") + """
    SELECT batch_id, created_at, _pos,
           CASE WHEN _pos - 1 >= n - 5 * t THEN CAST(floor((_pos - 1 - (n - 5 * t)) / t) AS INTEGER) END AS test_fold,
           CASE WHEN (CASE WHEN _pos - 1 < n - 5 * t THEN 0 ELSE CAST(floor((_pos - 1 - (n - 5 * t)) / t) AS INTEGER) + 1 END) < 5
                THEN (CASE WHEN _pos - 1 < n - 5 * t THEN 0 ELSE CAST(floor((_pos - 1 - (n - 5 * t)) / t) AS INTEGER) + 1 END)
           END AS first_train_fold
    FROM (SELECT batch_id, created_at, CAST(row_number() OVER (ORDER BY created_at, batch_id) AS INTEGER) AS _pos,
                 count(*) OVER () AS n, floor(count(*) OVER () / 6) AS t FROM batches)"""
_SCORED = ("scored", """SELECT batch_id, label, 1.0 / (1.0 + sales_velocity_weekly) AS score
                        FROM (""" + EXPIRY_FEATURES + ") WHERE label IS NOT NULL")
_SC_BASE = with_tables("batches", "products", "depots", extra=FORECAST_CTES + [("velocity", VELOCITY), _SCORED])
ORACLE["stratified_folds"] = _SC_BASE + """
    SELECT batch_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(batch_id || ':42'), batch_id) - 1) % 5 AS INTEGER) AS fold
    FROM scored"""
ORACLE["model_auc"] = _rewrite_round(R6(_SC_BASE + """
    SELECT (rs - npos * (npos + 1) / 2) / (npos * nneg) AS auc, npos, nneg FROM (
      SELECT sum(CASE WHEN label = 1 THEN rk ELSE 0 END) AS rs, count(*) FILTER (WHERE label = 1) AS npos,
             count(*) FILTER (WHERE label = 0) AS nneg
      FROM (SELECT label, (min(r) OVER (PARTITION BY score) + max(r) OVER (PARTITION BY score)) / 2.0 AS rk
            FROM (SELECT label, score, row_number() OVER (ORDER BY score, label) AS r FROM scored)))""", ["auc"]))
ORACLE["recall_threshold"] = _rewrite_round(R6(_SC_BASE + """
    SELECT coalesce(max(t), 0.5) AS threshold FROM (
      SELECT t, sum(tp) OVER (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctp
      FROM (SELECT score AS t, count(*) FILTER (WHERE label = 1) AS tp FROM scored GROUP BY score))
    WHERE ctp >= 0.85 * (SELECT count(*) FILTER (WHERE label = 1) FROM scored)""", ["threshold"]))
ORACLE["confusion_counts"] = _SC_BASE + """
    SELECT count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp,
           count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn
    FROM scored"""
ORACLE["demand_mape"] = _rewrite_round(R6(with_tables("products", "depots", "stock_movements", extra=FORECAST_CTES) + """
    SELECT avg(abs(s.units_sold - f.predicted_daily_rate) / s.units_sold) AS mape
    FROM sales s JOIN forecast f ON f.product_id = s.product_id AND f.depot_id = s.depot_id
    WHERE s.units_sold > 0""", ["mape"]))

# ---------------------------------------------------------------- invoice text, names, ledger updates
ORACLE["extract_invoice_fields"] = with_tables("invoices") + r"""
    SELECT invoice_id,
           nullif(regexp_extract(text, '(?i)(?:invoice|inv|bill)\s*(?:no|number|#)[:\s]*([A-Z0-9/-]+)', 1), '')
               AS invoice_number,
           nullif(regexp_extract(text, '\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b', 1), '') AS invoice_date_text,
           TRY_CAST(replace(nullif(regexp_extract(text, '(?i)(?:total|amount)[:\s₹]*([0-9,]+\.?\d*)', 1), ''), ',', '')
                    AS DOUBLE) AS total_amount
    FROM (SELECT id AS invoice_id,
                 'TAX INVOICE Invoice No: ' || invoice_number || ' Date: ' || strftime(invoice_date, '%d/%m/%Y')
                 || ' Total: ' || format('{:,.2f}', CAST(total_amount AS DOUBLE)) || ' Thank you' AS text
          FROM invoices)"""
LINES = ("lines", """
    SELECT invoice_id, line_no, product_id, batch_id, quantity,
           CAST((unit_c * 24 + 10) // 20 AS DECIMAL(12,0)) / 100 AS mrp, CAST(unit_c AS DECIMAL(12,0)) / 100 AS ptr,
           gst_percent
    FROM (SELECT l_orderkey AS invoice_id, l_linenumber AS line_no, p_brand AS product_id,
                 sd.depot_id || '-' || CAST(l_partkey AS VARCHAR) AS batch_id, CAST(l_quantity AS INTEGER) AS quantity,
                 (CAST(round(l_extendedprice * 100) AS BIGINT) * 2 + CAST(l_quantity AS BIGINT))
                     // (CAST(l_quantity AS BIGINT) * 2) AS unit_c,
                 l_tax * 400 AS gst_percent
          FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier_depot sd ON l_suppkey = sd.s_suppkey)""")
LINE_CONF = ("lconf", """
    SELECT l.invoice_id, l.line_no,
           round(least(100.0 / 100 * 40
                 + CASE WHEN b.batch_number IS NOT NULL AND b.batch_number <> '' THEN 20.0 ELSE 0.0 END
                 + CASE WHEN b.expiry_date IS NOT NULL THEN 20.0 ELSE 0.0 END
                 + CASE WHEN l.quantity IS NOT NULL AND l.quantity <> 0 THEN 10.0 ELSE 0.0 END
                 + CASE WHEN l.mrp IS NOT NULL AND l.mrp <> 0 THEN 5.0 ELSE 0.0 END
                 + CASE WHEN l.ptr IS NOT NULL AND l.ptr <> 0 THEN 5.0 ELSE 0.0 END, 100.0), 1) AS confidence
    FROM lines l LEFT JOIN batches b ON b.batch_id = l.batch_id""")
_LC = with_tables("batches", "invoices", "supplier_depot", extra=[LINES, LINE_CONF])
ORACLE["line_confidence"] = _rewrite_round(R6(_LC + "SELECT *, confidence < 80 AS needs_correction FROM lconf",
                                              ["confidence"]))
ORACLE["invoice_confidence"] = _rewrite_round(R6(_LC + """
    SELECT invoice_id, invoice_confidence, invoice_confidence < 80 AS needs_review FROM (
      SELECT i.id AS invoice_id, round(coalesce(c.c, 0.0), 1) AS invoice_confidence
      FROM invoices i LEFT JOIN (SELECT invoice_id, avg(confidence) AS c FROM lconf GROUP BY invoice_id) c
           ON c.invoice_id = i.id)""", ["invoice_confidence"]))
ORACLE["invoice_lines"] = _rewrite_round(R6(with_tables("batches", "invoices", "products", "supplier_depot",
                                                        extra=[LINES]) + """
    SELECT i.depot_id, l.invoice_id, i.invoice_number, l.line_no, l.product_id, p.canonical_name, l.batch_id,
           b.batch_number, b.expiry_date, l.quantity,
           coalesce(CAST(l.mrp AS DOUBLE), 0.0) AS mrp,
           coalesce(CAST(l.ptr AS DOUBLE), 0.0) AS ptr,
           coalesce(l.gst_percent, 0.0) AS gst_percent
    FROM lines l JOIN invoices i ON i.id = l.invoice_id JOIN products p ON p.product_id = l.product_id
    LEFT JOIN batches b ON b.batch_id = l.batch_id""", ["mrp", "ptr", "gst_percent"]))
RECEIPTS = ("receipts", f"""
    SELECT b.depot_id, l.product_id, b.batch_number,
           CASE WHEN l.line_no % 2 = 1 THEN b.expiry_date ELSE {AS_OF} + 365 END AS expiry_date, l.quantity
    FROM lines l JOIN invoices i ON i.id = l.invoice_id
    JOIN batches b ON b.batch_id = l.batch_id""")
ORACLE["apply_stock_in"] = with_tables("batches", "invoices", "supplier_depot", extra=[LINES, RECEIPTS, (
    "r", "SELECT depot_id, product_id, batch_number, expiry_date, sum(quantity) AS add FROM receipts GROUP BY ALL")]) + \
    f"""
    SELECT b.batch_id, b.depot_id, b.product_id, b.batch_number, b.expiry_date,
           CAST(b.quantity_received + coalesce(r.add, 0) AS BIGINT) AS quantity_received,
           CAST(b.quantity_remaining + coalesce(r.add, 0) AS BIGINT) AS quantity_remaining, b.created_at
    FROM batches b LEFT JOIN r ON r.depot_id = b.depot_id AND r.product_id = b.product_id
         AND r.batch_number = b.batch_number AND r.expiry_date = b.expiry_date
    UNION ALL
    SELECT substr(sha256(concat_ws('|', r.depot_id, r.product_id, r.batch_number, CAST(r.expiry_date AS VARCHAR))), 1, 32),
           r.depot_id, r.product_id, r.batch_number, r.expiry_date, CAST(r.add AS BIGINT), CAST(r.add AS BIGINT),
           CAST({AS_OF} AS TIMESTAMP)
    FROM r WHERE NOT EXISTS (SELECT 1 FROM batches b WHERE b.depot_id = r.depot_id AND b.product_id = r.product_id
                             AND b.batch_number = r.batch_number AND b.expiry_date = r.expiry_date)"""
RAW_NAMES = ("raw", """
    SELECT p_partkey, p_name,
           CASE p_partkey % 3 WHEN 0 THEN rev
                WHEN 1 THEN substr(p_name, 1, pos) || substr(p_name, pos + 2, 10000)
                ELSE substr(rev, 1, pos) || substr(rev, pos + 2, 10000) END AS raw_name
    FROM (SELECT p_partkey, p_name, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS rev,
                 CAST(p_partkey % greatest(length(p_name), 1) AS INTEGER) AS pos FROM part)""")
ORACLE["enrich_aliases"] = "WITH " + RAW_NAMES[0] + " AS (" + RAW_NAMES[1] + ")" + """
    SELECT p.product_id, coalesce(a.aliases, '') AS aliases
    FROM (SELECT DISTINCT p_name AS product_id FROM part) p
    LEFT JOIN (SELECT p_name AS product_id, string_agg(DISTINCT a, '|' ORDER BY a) AS aliases
               FROM (SELECT p_name, lower(trim(raw_name)) AS a FROM raw) WHERE a <> '' GROUP BY p_name) a
         ON a.product_id = p.product_id"""
ORACLE["compliance_snapshot"] = _CC.replace("WITH ", "WITH depots AS (" + CTES_DEPOTS + "),", 1) + """
    SELECT d.depot_id, CAST(coalesce(a.n, 0) AS BIGINT) AS open_issues,
           CASE WHEN coalesce(a.n, 0) = 0 THEN 'ok' ELSE 'attention' END AS status
    FROM depots d LEFT JOIN (SELECT depot_id, count(*) AS n FROM flagged WHERE is_excursion GROUP BY depot_id) a
         ON a.depot_id = d.depot_id"""
ORACLE["confirm_invoice"] = with_tables("invoices", "batches", "supplier_depot", extra=[LINES]) + f"""
    SELECT i.id, CASE WHEN c.invoice_id IS NOT NULL THEN 'SETTLED' ELSE i.status END AS status
    FROM invoices i LEFT JOIN (
        SELECT DISTINCT l.invoice_id FROM lines l
        JOIN (SELECT id FROM invoices) r ON r.id = l.invoice_id
        JOIN batches b ON b.batch_id = l.batch_id) c ON c.invoice_id = i.id"""
ORACLE["category_codes"] = with_tables("products", "depots", "stock_movements", extra=SALES_CTES) + """
    SELECT kind, value, CAST(row_number() OVER (PARTITION BY kind ORDER BY value) - 1 AS INTEGER) AS code
    FROM (SELECT DISTINCT 'product_category' AS kind, product_category AS value FROM sales
          WHERE product_category IS NOT NULL
          UNION SELECT DISTINCT 'depot_region', depot_region FROM sales WHERE depot_region IS NOT NULL)"""
ORACLE["scope_to_depot"] = _rewrite_round(R6(with_tables("stock_movements") +
                                             "SELECT * FROM stock_movements WHERE depot_id = 'ASIA'", ["quantity"]))

ORACLE["store_sales"] = R6("""
    SELECT CAST(s.store AS VARCHAR) AS depot_id, s.date, s.units_sold, CASE WHEN n_nationkey < 20 THEN substr(n_name, 1, 1) END AS product_category,
           CASE WHEN n_nationkey < 20 THEN n_name END AS depot_region, CAST(s.store AS VARCHAR) || '_generic' AS product_id, false AS is_cold_chain
    FROM (SELECT c_nationkey AS store, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS units_sold,
                 max(CAST(o_custkey % 7 <> 0 AS INTEGER)) AS is_open
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) s JOIN nation ON n_nationkey = s.store
    WHERE is_open = 1 AND units_sold > 0""", ["units_sold"])
ORACLE["wide_daily_sales"] = R6(unbounded(with_tables("stock_movements")) + """
    SELECT d.date, p.product_id, coalesce(s.u, 0.0) AS units_sold, 'pharma_default' AS depot_id, substr(p.product_id, 1, 3) AS product_category, false AS is_cold_chain
    FROM (SELECT DISTINCT CAST(created_at AS DATE) AS date FROM stock_movements) d
    CROSS JOIN (VALUES ('IN01', 'IN'), ('OUT1', 'OUT'), ('RET1', 'RETURN')) p(product_id, movement_type)
    LEFT JOIN (SELECT CAST(created_at AS DATE) AS date, movement_type, sum(quantity) AS u FROM stock_movements GROUP BY ALL) s
      ON s.date = d.date AND s.movement_type = p.movement_type""", ["units_sold"])
ORACLE["otc_sales"] = R6(unbounded(with_tables("stock_movements")) + """
    SELECT CAST(strftime(created_at, '%d-%m-%Y') AS VARCHAR) AS date, product_id, quantity AS units_sold, depot_id, batch_id AS batch_number,
           movement_id AS invoice_number, 'unknown' AS product_category, false AS is_cold_chain, 'unknown' AS depot_region
    FROM stock_movements WHERE movement_type = 'OUT'""", ["units_sold"])
_SINK = with_tables("stock_movements", "depots", extra=[("sink", f"""
    SELECT depot_id, product_id, CAST(created_at AS DATE) AS run_date, sum(quantity) AS units FROM stock_movements
    WHERE movement_type = 'OUT' AND CAST(created_at AS DATE) > {AS_OF} - 3 GROUP BY ALL""")])
ORACLE["sink_upsert"] = R6(_SINK + "SELECT * REPLACE (CASE WHEN run_date > DATE '2001-07-30' AND depot_id <> 'ASIA' THEN 2 * units ELSE units END AS units) FROM sink", ["units"])
ORACLE["sink_replace_partition"] = R6(_SINK + f"""
    SELECT * REPLACE (CASE WHEN run_date = {AS_OF} AND depot_id = 'EUROPE' THEN units + 1 ELSE units END AS units) FROM sink
    WHERE NOT (run_date = {AS_OF} AND depot_id = 'ASIA')""", ["units"])
ORACLE["sink_insert_ignore"] = R6(_SINK + """
    SELECT * REPLACE (CASE WHEN depot_id IN ('ASIA', 'EUROPE') THEN units ELSE units + 1 END AS units),
           CASE WHEN depot_id IN ('ASIA', 'EUROPE') THEN 'APPROVED' ELSE 'PENDING' END AS status FROM sink""", ["units"])
ORACLE["sink_append_log"] = R6(_SINK + f"SELECT s.* FROM sink s, (VALUES (1), (2)) v(n) WHERE run_date = {AS_OF}", ["units"])
ORACLE["run_status_fallback"] = with_tables("depots") + """
    SELECT depot_id, stage, CASE WHEN depot_id <> 'ASIA' THEN 'SUCCESS' WHEN stage = 'stockout' THEN 'SKIPPED' ELSE 'FALLBACK' END AS outcome
    FROM depots, (VALUES ('demand'), ('expiry'), ('stockout'), ('fefo')) s(stage) WHERE is_active"""

# Operators without a "now" take all facts, and those that learn from or check
# a history take all of it.
WHOLE = """current_stock batch_stock stock_ledger stock_by_product batch_timeline apply_stock_in apply_stock_out confirm_invoice
    invoice_lines line_confidence invoice_confidence retailer_statement open_invoices match_exact match_partial match_consolidated
    match_cascade match_sequential apply_scheme duplicate_invoices collapse_duplicates positive_sales_filter ingest_frame
    unpivot_drug_sales synthesise_batches synthesise_movements scope_to_depot time_series_folds extract_invoice_fields""".split()
HISTORY = {"validate_sales": 60, "chronological_split": 60, "category_codes": 60, "walk_forward_folds": 1095, "training_sufficiency": 365,
           "union_sources": 365}
for _k in [*WHOLE, *HISTORY]:
    ORACLE[_k] = unbounded(ORACLE[_k])
for _k, _days in HISTORY.items():
    _window = f" AND sm.created_at >= {AS_OF_TS} - INTERVAL {_days} DAY\n      AND sm.created_at <= {AS_OF_TS}"
    assert _window in ORACLE[_k], _k
    ORACLE[_k] = ORACLE[_k].replace(_window, "")
