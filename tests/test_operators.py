"""Operator semantics on small literal inputs."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from wattline.operators import aggregates as A
from wattline.operators import filters as FL
from wattline.operators import ingest as I
from wattline.operators import labels as L
from wattline.operators import normalize as NZ
from wattline.operators import reshape as R
from wattline.operators.coverage import month_windows, window_coverage
from wattline.operators.profile import profile
from wattline.sources import files as SRC
from wattline.sources.schemas import PAYLOAD_RECORD, PRODUCTION

FACTS = "pricearea string, productiongroup string, quantitykwh double"


def facts(spark, rows):
    return spark.createDataFrame(rows, FACTS)


def as_dict(rows, k, v):
    return {r[k]: r[v] for r in rows}


def test_null_key_and_all_null_group_app_form(spark):
    df = facts(spark, [("x", "b", 1.0), ("x", "a", 2.0), ("x", None, 3.0), ("x", "c", None)])
    assert as_dict(A.group_totals(df).collect(), "productiongroup", "quantitykwh") == {"a": 2.0, "b": 1.0, "c": 0.0}


def test_null_key_and_all_null_group_notebook_form(spark):
    df = facts(spark, [("x", "b", 1.0), ("x", "a", 2.0), ("x", None, 3.0), ("x", "c", None)])
    got = as_dict(A.area_group_totals(df).collect(), "productiongroup", "Total_Kwh")
    assert got == {"a": 2.0, "b": 1.0, "c": None, None: 3.0}


def test_grouping_sets_total(spark):
    df = facts(spark, [("NO1", "hydro", 2.0), ("NO2", "hydro", 3.0), ("NO1", None, 7.0), ("NO2", "wind", None)])
    got = {(r["pricearea"], r["productiongroup"]): r["Total_Kwh"] for r in A.area_group_with_total(df).collect()}
    assert got[("NO1", "hydro")] == 2.0 and got[("NO2", "hydro")] == 3.0
    assert got[("Total", "hydro")] == 5.0
    assert got[("NO1", None)] == 7.0          # per-area rows keep the NULL group
    assert ("Total", None) not in got         # the all-area re-aggregation drops it
    assert got[("NO2", "wind")] is None and got[("Total", "wind")] == 0.0


def test_zero_total_guard(spark):
    df = facts(spark, [("x", "a", 0.0), ("x", "b", 0.0)])
    assert FL.keep_if_positive_total(A.group_totals(df), "quantitykwh").count() == 0
    empty = facts(spark, []).filter(F.lit(False))
    assert FL.keep_if_positive_total(A.group_totals(empty), "quantitykwh").count() == 0


def test_shares_per_area_and_guard(spark):
    df = facts(spark, [("NO1", "hydro", 3.0), ("NO1", "wind", 1.0), ("NO2", "hydro", 0.0)])
    out = A.shares(A.area_group_totals(df), "pricearea", "Total_Kwh").collect()
    got = {(r["pricearea"], r["productiongroup"]): r["share"] for r in out}
    assert got == {("NO1", "hydro"): 0.75, ("NO1", "wind"): 0.25}


def test_grand_total_of_empty_is_zero(spark):
    assert A.grand_total(facts(spark, []).filter(F.lit(False))).first()["total"] == 0.0


def test_daily_drops_null_day_and_group(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, 1, 5), "a", 1.0), (None, "a", 2.0),
                                (dt.datetime(2021, 1, 1, 7), None, 4.0), (dt.datetime(2021, 1, 1, 9), "a", 3.0)],
                               "starttime timestamp_ntz, productiongroup string, quantitykwh double")
    r = A.daily_group_totals(df).collect()
    assert [(x["date"], x["productiongroup"], x["quantitykwh"]) for x in r] == [(dt.datetime(2021, 1, 1), "a", 4.0)]


def test_empty_group_set_keeps_all_rows(spark):
    df = facts(spark, [("x", "a", 1.0), ("x", "b", 2.0)])
    assert FL.in_groups(df, []).count() == 2
    assert FL.in_groups(df, None).count() == 2
    assert FL.in_groups(df, ["b"]).count() == 1


def test_area_sentinels_keep_all(spark):
    df = facts(spark, [("NO1", "a", 1.0), ("NO2", "b", 2.0)])
    for s in (None, "Total", "All Areas"):
        assert FL.in_area(df, s).count() == 2
    assert FL.in_area(df, "NO2").count() == 1


def test_month_filters(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 3),), (dt.datetime(2021, 1, 9),), (dt.datetime(2021, 3, 1),)],
                               "time timestamp_ntz")
    assert FL.in_month(df, "time", 1).count() == 2
    assert FL.in_month(df, "time", 1, year=2021).count() == 1
    assert FL.in_month_range(df, "time", 1, 3).count() == 3
    assert FL.in_named_month(df, "time", "March").count() == 1
    assert FL.in_named_month(df, "time", "All months").count() == 3


def test_text_year_month(spark):
    df = spark.createDataFrame([("2021-01-01T00:00:00+01:00",), ("2021-02-01T00:00:00+01:00",), ("bad",)], "starttime string")
    assert FL.text_year_month(df, "starttime", 2021, 1).count() == 1


def test_scale_normal_constant_all_null_nan(spark):
    df = spark.createDataFrame([(1.0, 5.0, None, float("nan")), (3.0, 5.0, None, 1.0), (None, None, None, 3.0)],
                               "a double, c double, n double, z double")
    app = NZ.scale_min_max(df, ["a", "c", "n", "z"], mode="keep_nulls").collect()
    nb = NZ.scale_min_max(df, ["a", "c", "n", "z"], mode="zero_fill").collect()
    assert [r["a"] for r in app] == [0.0, 1.0, None]
    assert [r["c"] for r in app] == [0.0, 0.0, None]
    assert [r["c"] for r in nb] == [0.0, 0.0, 0.0]
    assert [r["n"] for r in app] == [None, None, None] and [r["n"] for r in nb] == [None, None, None]
    assert [r["z"] for r in app] == [None, 0.0, 1.0]  # NaN is a missing value (S9)


def test_scale_with_stats_from_another_scope(spark):
    rows = spark.createDataFrame([(0.0,), (10.0,), (5.0,)], "a double")
    shown = rows.filter("a = 5.0")
    assert shown.transform(lambda d: NZ.scale_min_max(d, ["a"], stats_from=rows)).first()["a"] == 0.5
    assert NZ.scale_min_max(shown, ["a"]).first()["a"] == 0.0


def test_column_min_max_single_scan(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 2.0)], "`a.b` double, c double")
    got = {r["metric"]: (r["min_value"], r["max_value"]) for r in NZ.column_min_max(df, ["a.b", "c"]).collect()}
    assert got == {"a.b": (1.0, 3.0), "c": (2.0, 4.0)}


def test_unpivot_dotted_and_unit_names(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, 1), 1.0, 2)], "time timestamp_ntz, `a.b` double, `wind (m/s)` int")
    cols = NZ.metric_columns(df)
    long = R.to_long(df, ["time"], cols).collect()
    assert {(r["Metric"], r["Normalized Value"]) for r in long} == {("a.b", 1.0), ("wind (m/s)", 2.0)}


def test_metric_panels_numbering(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, 1), 1.0, 2.0)], "time timestamp_ntz, x double, y double")
    got = {r["Metric"]: r["panel"] for r in R.metric_panels(df, ["x", "y"]).collect()}
    assert got == {"x": 1, "y": 2}


def test_ordered_arrays_keep_nulls_and_order(spark):
    df = spark.createDataFrame([("m", 3, 30.0), ("m", 1, None), ("m", 2, 20.0), ("k", 1, 5.0)],
                               "Metric string, t int, v double")
    got = {r["Metric"]: r["Trend over Time"] for r in R.ordered_arrays(df, ["Metric"], ["t"], "v").collect()}
    assert got == {"m": [None, 20.0, 30.0], "k": [5.0]}


def test_flatten_missing_and_empty_lists(spark):
    recs = [{"priceArea": "NO1", "attributes": {"productionPerGroupMbaHour": [
                {"priceArea": None, "productionGroup": "hydro", "startTime": "s", "endTime": "e",
                 "lastUpdatedTime": "u", "quantityKwh": 1.0}]}},
            {"priceArea": "NO2", "attributes": {"productionPerGroupMbaHour": None}},
            {"priceArea": "NO3", "attributes": {"productionPerGroupMbaHour": []}},
            {"priceArea": "NO4", "attributes": None}]
    df = spark.createDataFrame(recs, PAYLOAD_RECORD)
    out = I.flatten_hourly(df).collect()
    assert len(out) == 1
    assert out[0]["priceArea"] == "NO1"  # the batch key fills a NULL inner area (S13)


def test_landed_json_integer_quantity_becomes_double(spark, tmp_path):
    doc = {"data": [{"priceArea": "NO1", "attributes": {"productionPerGroupMbaHour": [
        {"priceArea": "NO1", "productionGroup": "wind", "startTime": "a", "endTime": "b",
         "lastUpdatedTime": "c", "quantityKwh": 1}]}}]}
    p = tmp_path / "resp.json"
    p.write_text(json.dumps(doc, indent=4))
    flat = I.flatten_hourly(SRC.read_landed_payloads(spark, str(p))).collect()
    assert flat[0]["quantityKwh"] == 1.0 and isinstance(flat[0]["quantityKwh"], float)
    p2 = tmp_path / "nodata.json"
    p2.write_text(json.dumps({"links": {}}))
    assert SRC.read_landed_payloads(spark, str(p2)).count() == 0


def test_declared_schema_rejects_null(spark):
    df = spark.createDataFrame([("NO1", None, "s", "e", "u", 1.0)],
                               "priceArea string, productionGroup string, startTime string, endTime string, "
                               "lastUpdatedTime string, quantityKwh double")
    with pytest.raises(Exception, match="NULL in required field productionGroup"):
        SRC.apply_schema(df, PRODUCTION).collect()
    with pytest.raises(Exception):
        SRC.records_frame(spark, [("NO1", None, "s", "e", "u", 1.0)], PRODUCTION).collect()


def test_lower_case_and_clash(spark):
    df = spark.createDataFrame([(1, 2)], "priceArea int, quantityKwh int")
    assert I.lower_case_columns(df).columns == ["pricearea", "quantitykwh"]
    with pytest.raises(ValueError):
        I.lower_case_columns(spark.createDataFrame([(1, 2)], "`a` int, `A` int"))


def test_row_ids_unique_and_union(spark):
    a = spark.range(0, 1000, numPartitions=7)
    b = spark.range(1000, 1500, numPartitions=3)
    u = I.with_row_id(I.union_batches([a, b]))
    r = u.agg(F.count("*").alias("n"), F.count_distinct("ind").alias("k")).first()
    assert r["n"] == r["k"] == 1500


def test_stamp_key(spark):
    assert I.stamp_key(spark.range(2), "priceArea", "NO5").select("priceArea").distinct().first()[0] == "NO5"


def test_pick_list_sentinel_first(spark):
    df = facts(spark, [("NO2", "a", 1.0), ("NO1", "b", 1.0), ("NO2", "c", 1.0), (None, "d", 1.0)])
    assert [r["value"] for r in L.pick_list(df, "pricearea", "Total").collect()] == ["Total", "NO1", "NO2"]


def test_first_rows_top_k(spark):
    df = spark.range(100).withColumn("k", (F.col("id") * 37) % 100)
    assert [r["k"] for r in L.first_rows(df, 5, ["k"]).collect()] == [0, 1, 2, 3, 4]


def test_month_windows_2021(spark):
    keys = spark.createDataFrame([(a,) for a in ["NO1", "NO2", "NO3", "NO4", "NO5"]], "pricearea string")
    w = month_windows(keys, "pricearea", "2021-01-01", "2021-12-31").orderBy("pricearea", "window_start").collect()
    assert len(w) == 60
    last = w[-1]
    assert last["window_end"] == dt.date(2021, 12, 31)
    assert last["end_param"] == "2022-01-01T00:00:00+01:00"


def test_month_windows_clipped_and_mid_month(spark):
    keys = spark.createDataFrame([("NO1",)], "pricearea string")
    w = month_windows(keys, "pricearea", "2021-01-01", "2021-02-10").orderBy("window_start").collect()
    assert [r["window_end"] for r in w] == [dt.date(2021, 1, 31), dt.date(2021, 2, 10)]
    m = month_windows(keys, "pricearea", "2021-01-15", "2021-12-31").orderBy("window_start").first()
    assert m["window_end"] == dt.date(2021, 2, 14)
    with pytest.raises(ValueError):
        month_windows(keys, "pricearea", "2021-01-31", "2021-12-31")


def test_window_coverage_shows_empty_windows(spark):
    from tests.conftest import SF_MID
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet")
    cov = window_coverage(li, li, "l_returnflag", "l_shipdate", "1995-01-01", "2001-12-31")
    rows = cov.collect()
    assert len(rows) == 252
    dec = {r["l_returnflag"]: r["n_rows"] for r in rows if r["window_start"] == dt.date(2001, 12, 1)}
    assert dec == {"A": 0, "N": 0, "R": 0}
    assert sum(r["n_rows"] for r in rows) == li.count()


def test_profile_counts(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, "x")], "a double, b string")
    got = {r["column"]: (r["data_type"], r["non_null"], r["n_rows"]) for r in profile(df).collect()}
    assert got == {"a": ("double", 2, 3), "b": ("string", 1, 3)}


def test_nan_is_not_a_number_after_scaling(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,), (4.0,)], "a double")
    vals = [r["a"] for r in NZ.scale_min_max(df, ["a"]).collect()]
    assert vals[0] is None and not any(isinstance(v, float) and math.isnan(v) for v in vals)


def test_area_selection_from_summary(spark):
    df = facts(spark, [("NO1", "hydro", 2.0), ("NO2", "hydro", 3.0), ("NO2", "wind", 1.0)])
    summary = A.area_group_with_total(df)
    tot = {r["productiongroup"]: r["Total_Kwh"] for r in A.area_selection(summary, "Total").collect()}
    assert tot == {"hydro": 5.0, "wind": 1.0}
    assert A.area_selection(summary, "NO2").count() == 2


def test_selector_options(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, 1), 1.0)], "time timestamp_ntz, `temperature_2m (°C)` double")
    assert L.column_options(df) == ["All Columns", "temperature_2m (°C)"]
    assert L.month_options()[:2] == ["All months", "January"] and len(L.month_options()) == 13


def test_month_range_defaults_to_full_range(spark):
    df = spark.createDataFrame([(dt.datetime(2020, m, 1),) for m in (1, 6, 12)], "time timestamp_ntz")
    assert FL.in_month_range(df, "time").count() == 3
    assert FL.in_month_range(df, "time", first=6).count() == 2
    assert FL.in_month_range(df, "time", last=6).count() == 2


def test_wider_timestamp_shapes_parse(spark):
    # S6: one column may carry other ISO shapes; Spark parses them where pandas' inferred format would not.
    from wattline.functions.timeops import lenient_utc
    rows = spark.createDataFrame([("2021-01-01T00:00:00.500+01:00",), ("2021-01-02",)], "s string") \
        .select(lenient_utc("s").alias("t")).collect()
    assert rows[0]["t"] == dt.datetime(2020, 12, 31, 23, 0, 0, 500000)
    assert rows[1]["t"] == dt.datetime(2021, 1, 2)


def test_malformed_payload_fails_instead_of_vanishing(spark, tmp_path):
    p = tmp_path / "broken.json"
    p.write_text('{"data": [{"priceArea": "NO1", "attributes": ')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        SRC.read_landed_payloads(spark, str(p)).count()


def test_batches_are_not_deduplicated(spark):
    # S18: a record landed twice (overlapping request bounds) stays twice.
    a = facts(spark, [("NO1", "hydro", 1.0)])
    assert I.union_batches([a, a]).count() == 2


def test_area_and_group_options():
    assert L.area_options() == ["All Areas", "NO1", "NO2", "NO3", "NO4", "NO5"]
    assert L.group_options() == ["hydro", "wind", "thermal", "solar", "other"]


def test_flatten_adds_batch_key_when_entries_lack_it(spark):
    schema = "priceArea string, attributes struct<productionPerGroupMbaHour: array<struct<productionGroup: string, quantityKwh: double>>>"
    df = spark.createDataFrame([("NO4", {"productionPerGroupMbaHour": [{"productionGroup": "wind", "quantityKwh": 2.0}]})], schema)
    out = I.flatten_hourly(df).collect()
    assert out[0].asDict() == {"priceArea": "NO4", "productionGroup": "wind", "quantityKwh": 2.0}


def test_month_with_year_is_half_open_across_year_end(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 11, 30, 23, 59, 59),), (dt.datetime(2021, 12, 1),),
                                (dt.datetime(2021, 12, 31, 23, 59, 59, 999999),), (dt.datetime(2022, 1, 1),)],
                               "time timestamp_ntz")
    got = sorted(r["time"] for r in FL.in_month(df, "time", 12, year=2021).collect())
    assert got == [dt.datetime(2021, 12, 1), dt.datetime(2021, 12, 31, 23, 59, 59, 999999)]


def test_metric_series_one_row_per_metric_and_month(spark):
    rows = [(dt.datetime(2021, 1, 1, h), float(h), None if h == 1 else 10.0 - h) for h in (2, 0, 1)] + \
           [(dt.datetime(2021, 2, 1, 0), 7.0, 7.0)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, `temperature_2m (°C)` double, `wind (m/s)` double")
    got = {(r["Metric"], r["month"]): r["Trend over Time"] for r in R.metric_series(df, NZ.metric_columns(df)).collect()}
    assert got[("temperature_2m (°C)", 1)] == [0.0, 1.0, 2.0]
    assert got[("wind (m/s)", 1)] == [10.0, None, 8.0]
    assert got[("wind (m/s)", 2)] == [7.0]


def test_records_under_declared_schema(spark):
    ok = {"priceArea": "NO1", "productionGroup": "hydro", "startTime": "s", "endTime": "e",
          "lastUpdatedTime": "u", "quantityKwh": 1.5}
    df = SRC.records_frame(spark, [dict(ok, extra="dropped")], PRODUCTION)
    assert df.columns == [f.name for f in PRODUCTION.fields] and df.first()["quantityKwh"] == 1.5
    missing = {k: v for k, v in ok.items() if k != "endTime"}
    with pytest.raises(Exception):
        SRC.records_frame(spark, [missing], PRODUCTION).collect()
    with pytest.raises(Exception):
        SRC.records_frame(spark, [dict(ok, quantityKwh=1)], PRODUCTION).collect()


def test_month_windows_empty_when_start_after_end(spark):
    keys = spark.createDataFrame([("NO1",)], "pricearea string")
    assert month_windows(keys, "pricearea", "2021-03-01", "2021-02-01").count() == 0
    one = month_windows(keys, "pricearea", "2021-03-01", "2021-03-01").collect()
    assert [(r["window_start"], r["window_end"]) for r in one] == [(dt.date(2021, 3, 1), dt.date(2021, 3, 1))]


def test_window_coverage_shows_planned_keys_without_rows(spark):
    facts = spark.createDataFrame([("A", dt.datetime(2021, 1, 31, 23)), ("A", dt.datetime(2021, 3, 1)), ("C", dt.datetime(2021, 1, 1)),
                                   (None, dt.datetime(2021, 2, 2))], "area string, t timestamp_ntz")
    keys = spark.createDataFrame([("A",), ("B",), ("B",), (None,)], "area string")
    got = {(r["area"], r["window_start"].month): r["n_rows"]
           for r in window_coverage(facts, keys, "area", "t", "2021-01-01", "2021-02-28").collect()}
    assert got == {("A", 1): 1, ("A", 2): 0, ("B", 1): 0, ("B", 2): 0, (None, 1): 0, (None, 2): 1}


def test_month_windows_refuse_drifting_starts_of_a_column(spark):
    keys = spark.createDataFrame([("A", dt.date(2021, 1, 31))], "area string, d date")
    with pytest.raises(Exception, match="day 1..28"):
        month_windows(keys, "area", F.lit("2021-01-31"), "2021-12-31").collect()


def test_metric_series_takes_one_value_per_hour(spark):
    rows = [(dt.datetime(2021, 1, 1, 0, m), float(m)) for m in range(0, 60, 5)] + [(dt.datetime(2021, 1, 1, 1), None)]
    got = R.metric_series(spark.createDataFrame(rows, "time timestamp_ntz, x double"), ["x"]).collect()
    assert [r["Trend over Time"] for r in got] == [[55.0, None]]


@pytest.mark.parametrize("doc, n", [([], 0), ({}, 0), ({"data": None}, 0), ({"data": []}, 0), ({"links": {}}, 0),
                                    ([{"priceArea": "A"}], 1), ({"data": [{"priceArea": "A"}, {"x": 1}]}, 2)])
def test_landed_documents_of_known_shapes(spark, tmp_path, doc, n):
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=2))
    assert SRC.read_landed_payloads(spark, str(tmp_path)).count() == n


@pytest.mark.parametrize("doc", [3, "text", [1, 2], {"data": 5}, {"data": [1]}, {"priceArea": "A", "attributes": {}}])
def test_landed_documents_of_unknown_shapes_fail(spark, tmp_path, doc):
    (tmp_path / "d.json").write_text(json.dumps(doc))
    with pytest.raises(Exception):
        SRC.read_landed_payloads(spark, str(tmp_path)).collect()


def test_landed_list_flattens_like_an_envelope(spark, tmp_path):
    recs = [{"priceArea": "A", "attributes": {"productionPerGroupMbaHour": [{"priceArea": None, "quantityKwh": 1}]}}]
    for name, doc in (("list", recs), ("envelope", {"data": recs})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "d.json").write_text(json.dumps(doc, indent=2))
    a, b = (I.flatten_hourly(SRC.read_landed_payloads(spark, str(tmp_path / n))).collect() for n in ("list", "envelope"))
    assert a == b and len(a) == 1 and a[0]["priceArea"] == "A" and a[0]["quantityKwh"] == 1.0


def test_lenient_time_needs_a_full_date(spark):
    from wattline.functions.timeops import lenient_utc
    texts = ["10:30", "2021", "2021-05", "2021-05-06", " 2021-05-06T01:00:00Z", "2021-05-06 01:00:00+02:00", "x2021-05-06", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(lenient_utc("t")).collect()]
    assert got == [None, None, None, dt.datetime(2021, 5, 6), dt.datetime(2021, 5, 6, 1), dt.datetime(2021, 5, 5, 23), None, None]


def test_csv_missing_values_agree_with_pandas(spark, tmp_path):
    import pandas as pd
    from wattline.operators.aggregates import group_totals
    from wattline.operators.profile import profile
    p = tmp_path / "g.csv"
    p.write_text("productiongroup,quantitykwh\na,1.5\na,NaN\na,NA\nb,\nb,2\n")
    df, pdf = SRC.read_csv(spark, str(p)), pd.read_csv(p)
    assert {r["column"]: r["non_null"] for r in profile(df).collect()} == pdf.count().to_dict()
    assert {r[0]: r[1] for r in group_totals(df).collect()} == pdf.groupby("productiongroup")["quantitykwh"].sum().to_dict()


def test_share_label_of_the_null_group(spark):
    from wattline.functions.text import percent_label
    df = spark.createDataFrame([(None, 0.5), ("a", 0.25)], "g string, s double")
    assert [r[0] for r in df.select(percent_label(F.col("g"), F.col("s"))).collect()] == ["unknown, 50.0%", "a, 25.0%"]
