"""FEFO, stock-out, expiry formula and anomaly thresholds (cf. the
reference's inference tests)."""
import datetime as dt

from depotlens.operators import anomaly, expiry, fefo, stockout

AS_OF = "2025-06-01"
D0 = dt.date(2025, 6, 1)


def _active(spark, rows):
    return spark.createDataFrame(rows, "batch_id string, product_id string, depot_id string, expiry_date date, "
                                       "quantity_remaining double")


def test_fefo_order_and_override(spark):
    a = _active(spark, [("B1", "P", "D", D0 + dt.timedelta(days=90), 10.0),
                        ("B2", "P", "D", D0 + dt.timedelta(days=30), 10.0),
                        ("B3", "P", "D", D0 + dt.timedelta(days=180), 10.0)])
    r = {x.batch_id: x for x in fefo.fefo_rank(a, None, AS_OF).collect()}
    assert [b for _, b in sorted((x.priority_rank, x.batch_id) for x in r.values())] == ["B2", "B1", "B3"]
    risk = spark.createDataFrame([("B3", 0.88)], "batch_id string, expiry_risk_score double")
    r = {x.batch_id: x for x in fefo.fefo_rank(a, risk, AS_OF).collect()}
    assert r["B3"].priority_rank == 1 and r["B3"].ml_override and r["B3"].priority_score == -880.0
    risk = spark.createDataFrame([("B3", 0.6)], "batch_id string, expiry_risk_score double")
    assert not {x.batch_id: x for x in fefo.fefo_rank(a, risk, AS_OF).collect()}["B3"].ml_override  # strict


def test_stockout_arithmetic(spark):
    stock = spark.createDataFrame([("D", "P", 50.0, 7.0), ("D", "Q", -5.0, None)],
                                  "depot_id string, product_id string, units_available double, lead_time_days double")
    fc = spark.createDataFrame([("D", "P", 5.0)], "depot_id string, product_id string, predicted_daily_rate double")
    r = {x.product_id: x for x in stockout.stockout_risk_offline(stock, fc).collect()}
    assert r["P"].days_until_stockout == 10.0 and not r["P"].will_stockout
    assert r["Q"].current_stock == 0.0 and r["Q"].lead_time_days == 7.0 and r["Q"].will_stockout


def test_expiry_formula_and_liquidation(spark):
    a = spark.createDataFrame([("B1", "P", "D", D0 + dt.timedelta(days=50), 100.0, 100)],
                              "batch_id string, product_id string, depot_id string, expiry_date date, "
                              "quantity_remaining double, default_shelf_life_days int")
    r = expiry.expiry_risk_formula(a, AS_OF).collect()[0]
    assert r.expiry_risk_score == round(min((1 - 50 / 100) * 0.6 + 0.2, 1.0), 3)
    assert r.recommended_liquidation_date == D0 + dt.timedelta(days=int(100 / (1 / 7)) + 14)


def test_anomaly_thresholds(spark):
    mv = spark.createDataFrame(
        [(f"M{i}", "B", "P", "D", 10.0, "OUT", dt.datetime(2025, 5, 10)) for i in range(10)]
        + [("X1", "B", "P", "D", 25.0, "OUT", dt.datetime(2025, 5, 31, 12)),
           ("X2", "B", "P", "D", 10.0, "OUT", dt.datetime(2025, 5, 31, 12))],
        "movement_id string, batch_id string, product_id string, depot_id string, quantity double, "
        "movement_type string, created_at timestamp")
    prod = spark.createDataFrame([("P", "antibiotic")], "product_id string, product_category string")
    flags = {r.movement_id: r for r in anomaly.anomaly_flags(mv, prod, AS_OF).collect()}
    assert set(flags) == {"X1"} and flags["X1"].action == "ANOMALY_HOLD"


def test_temperature_anomalies_keep_all_rows(spark):
    r = spark.createDataFrame([("D1", float(t)) for t in [5, 5, 5, 5, 5, 5, 5, 5, 5, 30]] + [("D2", 4.0)],
                              "device_id string, temperature double")
    out = anomaly.temperature_anomalies(r).collect()
    assert len(out) == 11
    assert sum(1 for x in out if x.is_excursion) == 1
    assert [x.z_score for x in out if x.device_id == "D2"] == [0.0]
