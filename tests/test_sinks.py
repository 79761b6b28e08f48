"""Table commits, the nightly run over two dates, and what survives a re-run."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from depotlens.operators import decisions
from depotlens.plans import nightly, sinks
from depotlens.plans.catalog import Catalog
from depotlens.plans.queries import DECISION_CONFIG

D1, D2 = dt.date(2025, 1, 1), dt.date(2025, 1, 2)
SCHEMA = "depot_id string, product_id string, run_date date, v double"


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def read(spark, path, schema=SCHEMA, dates=None):
    return sorted((tuple(r) for r in sinks.DatedTable(spark, path).read(schema, dates).collect()), key=str)


def test_upsert(spark, tmp_path):
    path, key = f"{tmp_path}/t", ["depot_id", "product_id", "run_date"]
    sinks.upsert_by_key(rows(spark, ("A", "P", D1, 1.0), ("A", "Q", D1, 2.0), ("A", "P", D2, 3.0)), path, key)
    again = rows(spark, ("A", "P", D1, 9.0), ("B", "P", D1, 4.0))
    for _ in range(2):
        sinks.upsert_by_key(again, path, key)
        assert read(spark, path) == [("A", "P", D1, 9.0), ("A", "P", D2, 3.0), ("A", "Q", D1, 2.0), ("B", "P", D1, 4.0)]
    assert read(spark, path, dates=["2025-01-02"]) == [("A", "P", D2, 3.0)]


def test_replace_partition_clears_targets_left_empty(spark, tmp_path):
    path = f"{tmp_path}/t"
    first = rows(spark, ("A", "P", D1, 1.0), ("B", "P", D1, 2.0), ("A", "P", D2, 3.0))
    sinks.replace_partition(first, path, first)
    targets = rows(spark, ("A", None, D1, None), ("C", None, D1, None))
    # rows outside the targets are not part of the fresh set
    sinks.replace_partition(rows(spark, ("C", "P", D1, 5.0), ("A", "X", D2, 6.0)), path, targets)
    assert read(spark, path) == [("A", "P", D2, 3.0), ("B", "P", D1, 2.0), ("C", "P", D1, 5.0)]
    sinks.replace_partition(rows(spark), path, rows(spark, ("B", None, D1, None), ("C", None, D1, None), ("A", None, D2, None)))
    assert read(spark, path) == []


def test_crash_before_the_manifest_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    sinks.append_log(rows(spark, ("A", "P", D1, 1.0)), path)

    def crash(self, number, state):
        raise OSError("lost the driver")
    monkeypatch.setattr(sinks.DatedTable, "_publish", crash)
    with pytest.raises(OSError):
        sinks.upsert_by_key(rows(spark, ("A", "P", D1, 2.0)), path, ["depot_id", "product_id", "run_date"])
    monkeypatch.undo()
    assert read(spark, path) == [("A", "P", D1, 1.0)]


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """The one that comes second reads the other's commit and starts over."""
    path, publish, met = f"{tmp_path}/t", sinks.DatedTable._publish, []

    def late(self, number, state):
        if not met:
            met.append(number)
            sinks.append_log(rows(spark, ("B", "P", D1, 2.0)), path)
        return publish(self, number, state)
    monkeypatch.setattr(sinks.DatedTable, "_publish", late)
    sinks.append_log(rows(spark, ("A", "P", D1, 1.0)), path)
    assert read(spark, path) == [("A", "P", D1, 1.0), ("B", "P", D1, 2.0)]


def test_only_target_dates_are_read(spark, tmp_path):
    path, key = f"{tmp_path}/t", ["depot_id", "product_id", "run_date"]
    sinks.upsert_by_key(rows(spark, ("A", "P", D1, 1.0), ("A", "P", D2, 3.0)), path, key)
    before = sinks.DatedTable(spark, path).manifest()[1]
    sinks.upsert_by_key(rows(spark, ("A", "P", D2, 4.0)), path, key)
    after = sinks.DatedTable(spark, path).manifest()[1]
    assert after["2025-01-01"] == before["2025-01-01"] and after["2025-01-02"] != before["2025-01-02"]


def test_insert_ignore(spark, tmp_path):
    path, key = f"{tmp_path}/t", ["depot_id", "product_id", "run_date"]
    sinks.insert_ignore(rows(spark, ("A", "k", D1, 2.0), ("A", "k", D1, 1.0), ("A", None, D1, 7.0)), path, key, ["v"])
    sinks.insert_ignore(rows(spark, ("A", "k", D1, 0.0), ("A", None, D1, 0.0), ("A", "k", D2, 5.0)), path, key, ["v"])
    assert read(spark, path) == [("A", "k", D1, 1.0), ("A", "k", D2, 5.0), ("A", None, D1, 7.0)]


def test_previous_day_takes_over(spark):
    today = rows(spark, ("A", "P", D2, 1.0))
    before = rows(spark, ("A", "P", D1, 9.0), ("B", "P", D1, 7.0), ("C", "P", dt.date(2024, 12, 31), 8.0))
    deps = spark.createDataFrame([("A",), ("B",), ("C",)], "depot_id string")
    got = sorted((x.depot_id, x.v, x.source) for x in nightly.previous_run_fallback(today, before, deps, "2025-01-02").collect())
    assert got == [("A", 1.0, "CURRENT"), ("B", 7.0, "FALLBACK")]


class Shut(Catalog):
    """A day on which one depot's movements are missing."""

    @property
    def movements(self):
        return super().movements.where("depot_id <> 'ASIA'")


def test_nightly_over_two_dates(spark, tmp_path):
    out, sf = str(tmp_path), "/root/testdata/sf0.01"
    first = nightly.run_nightly(Catalog(spark, sf, as_of="2001-07-31", materialize=True), out, DECISION_CONFIG)
    assert {r.status for r in first.collect()} == {"SUCCESS"}
    # ASIA has nothing today: it goes on with yesterday's rows
    second = {r.depot_id: r.status for r in nightly.run_nightly(Shut(spark, sf, as_of="2001-08-01", materialize=True), out, DECISION_CONFIG).collect()}
    assert second.pop("ASIA") == "PARTIAL" and set(second.values()) == {"SUCCESS"}
    table = lambda t: spark.read.parquet(*[f"{out}/{t}/{f}" for fs in sinks.DatedTable(spark, f"{out}/{t}").manifest()[1].values() for f in fs])
    log = table("pipeline_run_logs")
    assert tuple(decisions.run_summary(log.where("run_date = '2001-08-01'")).first()) == (len(second) + 1, len(second), 1, 0)
    assert table("demand_predictions").where("run_date = '2001-08-01' AND depot_id = 'ASIA'").isEmpty()

    # a person approves an action; the run is repeated
    actions = table("agent_actions").where("run_date = '2001-08-01'").checkpoint()
    one = actions.orderBy("depot_id", "conflict_key").first().conflict_key
    approved = actions.withColumn("status", F.when(F.col("conflict_key") == one, "APPROVED").otherwise(F.col("status")))
    sinks.upsert_by_key(approved, f"{out}/agent_actions", ["depot_id", "conflict_key", "run_date"])
    snapshot = lambda: {t: sorted(map(str, table(t).collect())) for t in ("demand_predictions", "expiry_predictions", "stockout_calculations", "fefo_rankings", "agent_actions", "pipeline_run_logs")}
    before = snapshot()
    nightly.run_nightly(Shut(spark, sf, as_of="2001-08-01", materialize=True), out, DECISION_CONFIG)
    assert snapshot() == before
    assert table("agent_actions").where("status = 'APPROVED'").count() == actions.where(F.col("conflict_key") == one).count()
