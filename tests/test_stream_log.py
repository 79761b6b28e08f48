"""The stream's micro-batches: redeliveries, late readings, heartbeats, replays."""
import datetime as dt

from depotlens.plans.sinks import DatedTable
from depotlens.streaming import coldchain

MESSAGES = "message_id long, topic string, payload string, received_at timestamp"
LOG = "message_id long, device_id string, temperature double, ts timestamp, late boolean, batch_id long"
T0 = 1_700_000_000


def message(ident, device, temp, ts, depot="D1"):
    body = f'"temp":{temp}' + (f',"device_id":"{device}"' if device else "") + (f',"ts":{ts}' if ts else "")
    return (ident, f"depots/{depot}/temperature", "{" + body + "}", dt.datetime(2023, 11, 15, 0, 0, 30))


def run(spark, home, rows, number, devices=(("X", "D1", 2.0, 8.0),)):
    th = spark.createDataFrame(list(devices), "device_id string, depot_id string, threshold_min double, threshold_max double")
    batch = coldchain.parse_readings(spark.createDataFrame(rows, MESSAGES)).drop("dead_letter")
    coldchain.log_batch(batch, number, th, home, "10 minutes")


def log(spark, home):
    rows = DatedTable(spark, f"{home}/temperature_log", "reading_date").read(LOG).collect()
    return sorted((r.message_id or 0, r.device_id, r.temperature, r.late, r.batch_id) for r in rows)


def beats(spark, home):
    rows = DatedTable(spark, f"{home}/heartbeat", "shard").read("device_id string, last_seen_at timestamp, shard string").collect()
    return {r.device_id: int(r.last_seen_at.replace(tzinfo=dt.timezone.utc).timestamp()) for r in rows}


def test_batches_keep_late_and_colliding_readings_and_drop_redeliveries(spark, tmp_path):
    home = str(tmp_path)
    first = [message(1, "X", 5.0, T0), message(2, None, 9.0, T0), message(3, None, 1.0, T0), message(None, "Z", 4.0, T0), message(None, "Z", 4.0, T0)]
    run(spark, home, first, 0)
    assert [r[0] for r in log(spark, home)] == [0, 0, 1, 2, 3]  # two unknown devices in one second, two rows without id
    second = [message(1, "X", 5.0, T0), message(4, "X", 9.5, T0 - 3600), message(5, "X", 5.5, T0 - 60), message(6, "Y", 5.0, T0 - 90_000), message(6, "Y", 5.0, T0 - 90_000)]
    run(spark, home, second, 1)
    got = log(spark, home)
    assert [(r[0], r[3]) for r in got if r[4] == 1] == [(4, True), (5, False), (6, False)]  # Y was not seen before
    assert beats(spark, home) == {"X": T0, "unknown": T0, "Z": T0, "Y": T0 - 90_000}  # X does not go back
    assert [r.device_id for r in spark.read.parquet(f"{home}/alerts/batch_id=1").collect()] == ["X"]
    assert [r.message_id for r in spark.read.parquet(f"{home}/late/batch_id=1").collect()] == [4]
    # a batch that runs again changes nothing, rows without id included
    run(spark, home, second, 1)
    run(spark, home, first, 0)
    assert log(spark, home) == got and beats(spark, home)["X"] == T0
    assert spark.read.parquet(f"{home}/alerts/batch_id=1").count() == 1


def test_message_dated_by_arrival_comes_again_after_midnight(spark, tmp_path):
    home = str(tmp_path)
    row = message(7, "X", 5.0, None)
    run(spark, home, [(*row[:3], dt.datetime(2023, 11, 14, 23, 59, 50))], 0)
    run(spark, home, [row], 1)
    assert [r[0] for r in log(spark, home)] == [7]


def test_device_of_two_depots_has_one_row_and_the_tightest_range(spark):
    th = spark.createDataFrame([("X", "D1", 2.0, 8.0), ("X", "D2", 3.0, 9.0)], "device_id string, depot_id string, threshold_min double, threshold_max double")
    rows = spark.createDataFrame([("X", 2.5), ("X", 5.0), ("Q", 8.5)], "device_id string, temperature double")
    got = sorted((r.device_id, r.temperature, r.threshold_min, r.threshold_max, r.is_excursion) for r in coldchain.flag_excursions(rows, th).collect())
    assert got == [("Q", 8.5, 2.0, 8.0, True), ("X", 2.5, 3.0, 8.0, True), ("X", 5.0, 3.0, 8.0, False)]


def test_empty_batch(spark, tmp_path):
    batch = coldchain.parse_readings(spark.createDataFrame([], MESSAGES)).drop("dead_letter")
    th = spark.createDataFrame([], "device_id string, depot_id string, threshold_min double, threshold_max double")
    coldchain.log_batch(batch, 0, th, str(tmp_path), "10 minutes")
    assert log(spark, str(tmp_path)) == []
