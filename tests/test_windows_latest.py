"""Ledger of windows, keyed merges (batch and stream) and arrays without loss."""

import datetime as dt
import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wattline.operators import reshape as R
from wattline.operators.coverage import month_windows
from wattline.session import scratch_path
from wattline.sinks import latest as LT
from wattline.sinks import windows as WN
from wattline.sinks import writers as S
from wattline.streaming.ingest import load_latest


def ledger(spark, path):
    return {(r["area"], str(r["window_start"])[:7]): (r["state"], r["tries"], r["rows"]) for r in WN.read_ledger(spark, path, "area").collect()}


def outcomes(spark, *rows):
    return spark.createDataFrame([(a, dt.date.fromisoformat(w + "-01"), s, n) for a, w, s, n in rows],
                                 "area STRING, window_start DATE, state STRING, rows LONG")


def test_a_ledger_knows_what_is_to_be_fetched(spark):
    path = scratch_path(spark, "t-ledger")
    keys = spark.createDataFrame([("NO1",), ("a=/ b",), (None,)], "area STRING")
    WN.create_ledger(spark, path, "area")
    assert ledger(spark, path) == {} and WN.to_fetch(WN.read_ledger(spark, path, "area")).collect() == []
    WN.plan_windows(spark, path, month_windows(keys, "area", "2021-01-01", "2021-02-28"), "area")
    assert set(ledger(spark, path).values()) == {("planned", 0, 0)} and len(ledger(spark, path)) == 6
    WN.record_tries(spark, path, outcomes(spark, ("NO1", "2021-01", "landed", 7), ("NO1", "2021-02", "failed", 0), (None, "2021-01", "refused", None),
                                          ("a=/ b", "2021-01", "failed", 0)), "area")
    WN.record_tries(spark, path, outcomes(spark, ("NO1", "2021-02", "failed", 0), ("a=/ b", "2021-01", "landed", None), ("NO1", "2021-01", "failed", 0)), "area")
    WN.plan_windows(spark, path, month_windows(keys, "area", "2021-01-01", "2021-03-31"), "area")
    got = ledger(spark, path)
    assert got == {("NO1", "2021-01"): ("landed", 2, 7), ("NO1", "2021-02"): ("failed", 2, 0), ("NO1", "2021-03"): ("planned", 0, 0),
                   ("a=/ b", "2021-01"): ("landed", 2, 0), ("a=/ b", "2021-02"): ("planned", 0, 0), ("a=/ b", "2021-03"): ("planned", 0, 0),
                   (None, "2021-01"): ("refused", 1, 0), (None, "2021-02"): ("planned", 0, 0), (None, "2021-03"): ("planned", 0, 0)}
    led = WN.read_ledger(spark, path, "area")
    assert WN.to_fetch(led).count() == 6 and WN.to_fetch(led, 2).count() == 5


@pytest.mark.parametrize("bad", [[("NO9", "2021-01", "landed", 1)], [("NO1", "2021-01", "landed", 1)] * 2, [("NO1", "2021-01", "lost", 1)],
                                 [("NO1", "2021-02", "landed", 1), ("NO1", "2021-01", None, 1)]])
def test_a_wrong_outcome_changes_nothing(spark, bad):
    path = scratch_path(spark, "t-ledger")
    WN.create_ledger(spark, path, "area")
    WN.plan_windows(spark, path, month_windows(spark.createDataFrame([("NO1",)], "area STRING"), "area", "2021-01-01", "2021-02-28"), "area")
    before = ledger(spark, path)
    with pytest.raises((PySparkException, Py4JJavaError)):
        WN.record_tries(spark, path, outcomes(spark, *bad), "area")
    assert ledger(spark, path) == before


FLAT = "priceArea STRING, productionGroup STRING, startTime STRING, endTime STRING, lastUpdatedTime STRING, quantityKwh DOUBLE"


def plain_latest(rows):
    best = {}
    for r in rows:
        rank = tuple((v is not None, v) for v in (r[4], r[3], r[5]))
        if r[:3] not in best or rank > best[r[:3]][0]:
            best[r[:3]] = (rank, r)
    return sorted((r for _, r in best.values()), key=str)


def some_rows(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["NO1", None]), rng.choice(["hydro", "wind"]), rng.choice([None, "bad/day", "2021-01-01T00:00", "2021-01-01T01:00", "2021-01-02T00:00"]),
             "e", rng.choice([None, "2021-02", "2021-03"]), rng.choice([None, 1.0, 2.5])) for _ in range(n)]


@pytest.fixture
def store(spark):
    base = scratch_path(spark, "t-latest")
    S.create_namespace(spark, "wl_latest", f"{base}/db")
    name = "wl_latest.t_" + base.rsplit("-", 1)[-1]
    LT.create_latest_table(spark, name, FLAT, f"{base}/table")
    return name, base


def stored(spark, name):
    return sorted((tuple(r)[:6] for r in spark.table(name).collect()), key=str)


def test_merges_keep_the_latest_row_of_a_key(spark, store):
    name, base = store
    keys = ["priceArea", "productionGroup", "startTime"]
    seen = []
    for seed, n in ((1, 6), (2, 0), (3, 25), (3, 25), (4, 3)):
        rows = some_rows(seed, n)
        seen += rows
        LT.merge_latest(spark.createDataFrame(rows, FLAT), name, f"{base}/merges", keys, "lastUpdatedTime", "startTime")
        assert stored(spark, name) == plain_latest(seen)


def test_a_merge_rewrites_only_the_days_it_names(spark, store):
    name, base = store
    def merge(day, value, updated):
        df = spark.createDataFrame([("NO1", "hydro", f"{day}T00:00", "e", updated, value)], FLAT)
        return LT.merge_latest(df, name, f"{base}/merges", ["priceArea", "productionGroup", "startTime"], "lastUpdatedTime", "startTime")
    merge("2021-01-01", 1.0, "a")
    merge("2021-01-02", 2.0, "a")
    files = {r["day"]: r["f"] for r in spark.table(name).select("day", F.input_file_name().alias("f")).collect()}
    assert merge("2021-01-02", 3.0, "b") == 1 and merge("2021-01-02", 9.0, "a") == 1
    after = {r["day"]: r["f"] for r in spark.table(name).select("day", F.input_file_name().alias("f")).collect()}
    assert after["2021-01-01"] == files["2021-01-01"] and after["2021-01-02"] != files["2021-01-02"]
    assert [r[5] for r in stored(spark, name)] == [1.0, 3.0]


def test_overlapping_batches_of_a_stream_give_one_row_per_key_after_a_restart(spark, store, tmp_path):
    name, base = store
    def land(file, hours, updated, quantity):
        entries = [{"priceArea": "NO1", "productionGroup": "hydro", "startTime": f"2021-01-01T{h:02}:00", "endTime": "e",
                    "lastUpdatedTime": updated, "quantityKwh": quantity} for h in hours]
        (tmp_path / file).write_text(json.dumps({"data": [{"priceArea": "NO1", "attributes": {"productionPerGroupMbaHour": entries}}]}))
    def run():
        load_latest(spark, f"file:{tmp_path}", name, f"{base}/merges", f"{base}/checkpoint")
        return {r[2][11:13]: r[5] for r in stored(spark, name)}
    land("a.json", range(0, 3), "2021-02", 1.0)
    assert run() == {"00": 1.0, "01": 1.0, "02": 1.0}
    land("b.json", range(2, 5), "2021-03", 2.0)  # shares hour 2, corrected
    land("c.json", range(0, 1), "2021-01", 9.0)  # older than what is stored
    want = {"00": 1.0, "01": 1.0, "02": 2.0, "03": 2.0, "04": 2.0}
    assert run() == want and run() == want


def test_chunks_one_after_the_other_are_the_whole_list(spark):
    rng = random.Random(5)
    hours = [dt.datetime(2021, 1, 1), dt.datetime(2021, 1, 31, 23, 30), dt.datetime(2021, 2, 1), None]
    rows = [(rng.choice(hours[:1] * 6 + hours), rng.choice([None, 1.0, 2.0, 3.0]), rng.choice([None, 7.0, 8.0])) for _ in range(400)]
    df = spark.createDataFrame(rows, "time TIMESTAMP_NTZ, `a.b` DOUBLE, c DOUBLE").repartition(5)
    got = R.metric_chunks(df, ["a.b", "c"], scratch_path(spark, "t-chunks"), size=32).collect()
    assert all(1 <= len(r["Trend over Time"]) <= 32 for r in got)
    null_first = lambda v: (v is not None, v)
    for metric, at in (("a.b", 1), ("c", 2)):
        for month in ((2021, 1), (2021, 2), (None, None)):
            mine = sorted((r for r in got if r["Metric"] == metric and (r["year"], r["month"]) == month), key=lambda r: r["chunk"])
            assert [r["chunk"] for r in mine] == list(range(len(mine))) and all(len(r["Trend over Time"]) == 32 for r in mine[:-1])
            want = sorted((r for r in rows if ((r[0].year, r[0].month) if r[0] else (None, None)) == month), key=lambda r: tuple(map(null_first, r)))
            assert [v for r in mine for v in r["Trend over Time"]] == [r[at] for r in want]
    assert R.metric_chunks(df.limit(0), ["a.b", "c"], scratch_path(spark, "t-chunks")).collect() == []
