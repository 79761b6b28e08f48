"""Product matching vs brute force, stock-out fold, sinks, config,
fallback, registry, bursts, stream (file source + availableNow)."""
import datetime as dt
import itertools
import os
import tempfile

from pyspark.sql import functions as F

from depotlens.config import Config, resolve_config
from depotlens.functions.similarity import token_sort_ratio
from depotlens.operators import invoices, ledger, sessions, training
from depotlens.plans import nightly, sinks
from depotlens.streaming import coldchain


def test_token_sort_ratio_definition():
    assert token_sort_ratio("paracetamol 500mg", "500mg paracetamol") == 100.0
    assert token_sort_ratio("abc", "") == 0.0
    assert round(token_sort_ratio("abcd", "abce"), 4) == 75.0


def test_match_products_equals_full_cross_product(spark):
    master = ["paracetamol 500mg", "ibuprofen 400mg", "amoxicillin 250mg", "cetirizine 10mg", "azithromycin"]
    aliases = {"ibuprofen 400mg": ["brufen"]}
    prods = spark.createDataFrame(
        [(f"P{i}", m, aliases.get(m)) for i, m in enumerate(master)],
        "product_id string, canonical_name string, aliases array<string>")
    raws = ["500mg paracetamol", "ibuprofen 40mg", "amoxcillin 250mg", "brufen", "zzz", "cetirizine", "azithromycn"]
    raw = spark.createDataFrame([(r,) for r in raws], "raw_name string")
    got = {r.raw_name: (r.matched_name, r.product_id) for r in invoices.match_products(raw, prods).collect()}
    # brute force over every choice, in the reference's order: canonical names
    # sorted, each followed by its aliases; the first best score wins
    choices = []
    for m in sorted(master):
        pid = f"P{master.index(m)}"
        choices.append((m, pid))
        choices += [(a, pid) for a in (aliases.get(m) or [])]
    for r in raws:
        best = None
        for name, pid in choices:
            s = token_sort_ratio(r, name)
            if s >= 75 and (best is None or s > best[0]):
                best = (s, name, pid)
        assert got.get(r) == ((best[1], best[2]) if best else None), r


def test_resolve_config_order(spark):
    rows = spark.createDataFrame([(None, "anomaly_hold_threshold", "3.0"), ("D1", "anomaly_hold_threshold", "4.0")],
                                 "depot_id string, key string, value string")
    deps = spark.createDataFrame([("D1",), ("D2",)], "depot_id string")
    r = {(x.depot_id, x.key): x.value for x in resolve_config(rows, deps).collect()}
    assert r[("D1", "anomaly_hold_threshold")] == "4.0"
    assert r[("D2", "anomaly_hold_threshold")] == "3.0"
    assert r[("D2", "fefo_override_threshold")] == "0.6"
    assert Config().with_overrides(x=1).get("x") == 1


def test_model_versions_and_rollback(spark):
    reg = spark.createDataFrame(
        [("demand", 1, dt.datetime(2025, 1, 1), False), ("demand", 2, dt.datetime(2025, 2, 1), False),
         ("demand", 3, dt.datetime(2025, 3, 1), True)],
        "model_name string, version int, trained_at timestamp, is_active boolean")
    v = {r.version: r for r in training.model_versions(reg).collect()}
    assert v[3].recency == 1 and v[3].is_latest_active
    rb = {r.version: r.is_active for r in training.rollback(reg, "demand").collect()}
    assert rb == {1: False, 2: True, 3: False}


def test_request_bursts_limits(spark):
    t0 = dt.datetime(2025, 1, 1)
    hits = [(i, "ip", "A", t0 + dt.timedelta(seconds=10 * i)) for i in range(105)]
    hits += [(1000, "ip", "A", t0 + dt.timedelta(hours=2))]
    df = spark.createDataFrame(hits, "hit_id long, kind string, key string, ts timestamp")
    r = sessions.request_bursts(df).collect()
    over = sorted(x.hit_id for x in r if x.over_limit)
    assert over == list(range(100, 105))
    assert [x.hit_in_session for x in r if x.hit_id == 1000] == [1]


def test_stream_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="dl-stream-")
    src = os.path.join(base, "in")
    rows = [(1, "depots/D1/temperature", '{"device_id":"X","temp":9.5,"ts":1700000000}', dt.datetime(2023, 11, 14)),
            (2, "depots/D1/temperature", '{"device_id":"X","temp":5.0,"ts":1700000060}', dt.datetime(2023, 11, 14)),
            (1, "depots/D1/temperature", '{"device_id":"X","temp":9.5,"ts":1700000000}', dt.datetime(2023, 11, 14)),
            (4, "bad", "not json", dt.datetime(2023, 11, 14))]
    spark.createDataFrame(rows, "message_id long, topic string, payload string, received_at timestamp") \
         .write.parquet(src)
    th = spark.createDataFrame([("X", "D1", 2.0, 8.0)],
                               "device_id string, depot_id string, threshold_min double, threshold_max double")
    q1, q2 = coldchain.run_stream(spark, src, th, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q1.awaitTermination()
    q2.awaitTermination()
    log = sinks.DatedTable(spark, os.path.join(base, "out", "temperature_log"), "reading_date").read(
        "message_id long, device_id string, temperature double, is_excursion boolean")
    assert log.count() == 2  # the redelivered message is dropped
    assert log.where("is_excursion").count() == 1
    assert spark.read.parquet(os.path.join(base, "out", "dead_letter")).count() == 1
    assert spark.read.parquet(os.path.join(base, "out", "alerts")).count() == 1


def test_onboard_client_from_csv(spark):
    from depotlens.config import DEFAULTS
    from depotlens.operators import demand as dem
    from depotlens.plans.catalog import Catalog
    from depotlens.plans.queries import _client_export
    c = Catalog(spark, "/root/testdata/sf0.01")
    path = os.path.join(tempfile.mkdtemp(prefix="dl-onboard-"), "client.csv")
    _client_export(c).where(F.col("GODOWN") == "ASIA").coalesce(1).write.option("header", True).csv(path)
    feats = dem.demand_features(dem.fill_missing_dates(dem.daily_demand(c.movements, c.products, c.depots, c.as_of,
                                                                        days=365)), DEFAULTS["festival_dates"])
    gmodel, _ = training.train_demand(feats, dem.FEATURE_COLS, max_iter=5)
    r = training.onboard_client(spark, path, "CLIENT-X", gmodel, c.as_of)
    assert r["decision"] in ("SUFFICIENT_FOR_DEMAND", "SUFFICIENT_FOR_BOTH")
    assert isinstance(r["demand_deployed"], bool) and r["expiry_deployed"] is False


def test_expiry_fit_is_not_dealt_by_class(spark, monkeypatch):
    """Two classes dealt by hash over many partitions would leave two tasks;
    the rows weighted for the fit stay where they were."""
    from pyspark.sql import DataFrame
    rows = [(float(i), float(i % 7), i % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, label int").repartition(8).localCheckpoint()
    parts, keep = [], DataFrame.checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a, **k: parts.append(self.groupBy(F.spark_partition_id()).count().count()) or self.localCheckpoint())
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        training.train_expiry(df, ["a", "b"], num_trees=2)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert parts == [8]
