"""Decision rules (cf. the reference's agent tests)."""
import datetime as dt

from depotlens.config import Config
from depotlens.operators import decisions

CFG = Config()


def _expiry_view(spark, rows):
    return spark.createDataFrame(rows, "depot_id string, batch_id string, product_id string, expiry_risk_score double, "
                                       "remaining_qty double, ptr double, product_name string, "
                                       "recommended_liquidation_date date, method string")


def test_expiry_tiers_and_loss(spark):
    v = _expiry_view(spark, [("D", "B1", "P1", 0.90, 100.0, 50.0, "Para", dt.date(2025, 7, 1), "model"),
                             ("D", "B2", "P2", 0.72, 10.0, 5.0, "Ibu", dt.date(2025, 7, 1), "model"),
                             ("D", "B3", "P3", 0.30, 10.0, 5.0, "Cet", dt.date(2025, 7, 1), "model")])
    r = {x.batch_id: x for x in decisions.expiry_decisions(v, CFG).collect()}
    assert set(r) == {"B1", "B2"}
    assert (r["B1"].action_type, r["B1"].approval_tier) == ("SUGGEST_LIQUIDATION", "APPROVE")
    assert (r["B2"].action_type, r["B2"].approval_tier) == ("FLAG_PRIORITY_DISPATCH", "NOTIFY")
    assert "₹5,000" in r["B1"].reason and '"estimated_loss_if_ignored_inr":5000.0' in r["B1"].payload
    assert r["B1"].conflict_key == "expiry_B1"


def _stockout_view(spark, rows):
    return spark.createDataFrame(rows, "depot_id string, product_id string, product_name string, "
                                       "days_until_stockout double, lead_time_days double, current_stock double, "
                                       "predicted_units_14d double")


def test_reorder_tiers_and_cash(spark):
    v = _stockout_view(spark, [("D", "P1", "A", 3.0, 7.0, 10.0, 100.0), ("D", "P2", "B", 9.0, 7.0, 10.0, 100.0),
                               ("D", "P3", "C", 20.0, 7.0, 10.0, 100.0)])
    none = spark.createDataFrame([], "depot_id string, product_id string")
    pos = spark.createDataFrame([("D", False)], "depot_id string, cashflow_negative boolean")
    r = {x.product_id: x for x in decisions.reorder_decisions(v, none, pos).collect()}
    assert set(r) == {"P1", "P2"}
    assert r["P1"].approval_tier == "APPROVE" and r["P2"].approval_tier == "NOTIFY"
    neg = spark.createDataFrame([("D", True)], "depot_id string, cashflow_negative boolean")
    r = {x.product_id: x for x in decisions.reorder_decisions(v, none, neg).collect()}
    assert "Suggest ordering 70 units" in r["P1"].reason
    liq = spark.createDataFrame([("D", "P1")], "depot_id string, product_id string")
    assert {x.product_id for x in decisions.reorder_decisions(v, liq, pos).collect()} == {"P2"}


def test_resolve_suppresses_reorder_and_orders(spark):
    v = _expiry_view(spark, [("D", "B1", "P1", 0.90, 100.0, 50.0, "Para", dt.date(2025, 7, 1), "model")])
    so = _stockout_view(spark, [("D", "P1", "A", 3.0, 7.0, 10.0, 100.0), ("D", "P2", "B", 3.0, 7.0, 10.0, 100.0)])
    none = spark.createDataFrame([], "depot_id string, product_id string")
    pos = spark.createDataFrame([("D", False)], "depot_id string, cashflow_negative boolean")
    out = decisions.resolve_decisions([decisions.expiry_decisions(v, CFG),
                                       decisions.reorder_decisions(so, none, pos)]).collect()
    got = sorted((x.seq, x.action_type, x.product_id) for x in out)
    assert got == [(1, "SUGGEST_LIQUIDATION", "P1"), (2, "SUGGEST_REORDER", "P2")]


def test_run_rule_unknown_name():
    import pytest
    with pytest.raises(ValueError):
        decisions.run_rule("nope", {}, CFG)


def test_run_status(spark):
    o = spark.createDataFrame([("A", "demand", "FAILED"), ("B", "demand", "SUCCESS"), ("B", "fefo", "FALLBACK"),
                               ("C", "demand", "SUCCESS")], "depot_id string, stage string, outcome string")
    assert {r.depot_id: r.status for r in decisions.run_status(o).collect()} == {
        "A": "FAILED", "B": "PARTIAL", "C": "SUCCESS"}
