"""Literal edge cases of FIXTURES.md section 3 (time, labels, colours, encode)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattline.functions import calendar as C
from wattline.functions.colours import axis_of, colour_of
from wattline.functions.text import percent_label, thousands, url_quote
from wattline.functions.timeops import (day_floor, day_label, day_month_year_label, iso_midnight,
                                        lenient_utc, month_window_end, month_year_label,
                                        strict_timestamp, text_part)


def one(spark, *cols, data=None, schema="s string"):
    df = spark.createDataFrame(data or [("x",)], schema)
    return df.select(*cols).collect()


def test_offset_text_to_utc_winter_and_summer(spark):
    rows = spark.createDataFrame([("2021-01-01T00:00:00+01:00",), ("2021-07-01T00:00:00+02:00",)], "s string") \
        .select(lenient_utc("s").alias("t"), F.month(lenient_utc("s")).alias("m"),
                text_part("s", 6, 2).alias("tm"), day_floor(lenient_utc("s")).alias("d")).collect()
    assert rows[0]["t"] == dt.datetime(2020, 12, 31, 23, 0)
    assert (rows[0]["m"], rows[0]["tm"]) == (12, "01")
    assert rows[0]["d"] == dt.datetime(2020, 12, 31)
    assert rows[1]["t"] == dt.datetime(2021, 6, 30, 22, 0)
    assert (rows[1]["m"], rows[1]["tm"]) == (6, "07")


def test_lenient_parse_gives_null_for_bad_or_null(spark):
    rows = spark.createDataFrame([("junk",), (None,)], "s string").select(lenient_utc("s").alias("t")).collect()
    assert [r["t"] for r in rows] == [None, None]


def test_strict_parse_fails_on_bad_text(spark):
    df = spark.createDataFrame([("junk",)], "s string").select(strict_timestamp("s"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.collect()


def test_strict_parse_reads_iso_text(spark):
    r = one(spark, strict_timestamp(F.lit("2020-01-01T00:00")).alias("t"))
    assert r[0]["t"] == dt.datetime(2020, 1, 1)


def test_month_names_both_ways(spark):
    assert C.month_number("March") == 3
    with pytest.raises(ValueError):
        C.month_number("Smarch")
    r = one(spark, C.month_name(F.lit(3)).alias("n"), C.month_number_of_name(F.lit("December")).alias("k"),
            C.month_number_of_name(F.lit("nope")).alias("u"))[0]
    assert (r["n"], r["k"], r["u"]) == ("March", 12, None)


def test_thousands_and_percent_labels(spark):
    r = one(spark, thousands(F.lit(1234567.5)).alias("a"), thousands(F.lit(2.5)).alias("b"),
            percent_label(F.lit("hydro"), F.lit(0.61234)).alias("c"))[0]
    assert (r["a"], r["b"], r["c"]) == ("1,234,568", "2", "hydro, 61.2%")


def test_colour_lookup_and_axis(spark):
    r = spark.createDataFrame([("hydro",), ("nuclear",), (None,)], "g string") \
        .select(colour_of(F.col("g")).alias("c"), axis_of(F.col("g")).alias("a")).collect()
    assert [x["c"] for x in r] == ["#1f77b4", "#AAAAAA", "#AAAAAA"]
    assert [x["a"] for x in r] == ["primary", "secondary", "secondary"]


def test_encode_request_bound(spark):
    r = one(spark, url_quote(F.lit("2021-01-01T00:00:00+01:00")).alias("e"))[0]
    assert r["e"] == "2021-01-01T00%3A00%3A00%2B01%3A00"


def test_window_end_and_iso_midnight(spark):
    d = spark.createDataFrame([(dt.date(2021, 1, 15), dt.date(2021, 12, 31)),
                               (dt.date(2021, 2, 1), dt.date(2021, 2, 10))], "s date, e date")
    r = d.select(month_window_end(F.col("s"), F.col("e")).alias("w"),
                 iso_midnight(F.col("s")).alias("i")).collect()
    assert r[0]["w"] == dt.date(2021, 2, 14)
    assert r[1]["w"] == dt.date(2021, 2, 10)
    assert r[0]["i"] == "2021-01-15T00:00:00+01:00"


def test_axis_date_texts(spark):
    r = one(spark, month_year_label(F.lit(dt.datetime(2021, 3, 5))).alias("a"),
            day_label(F.lit(dt.datetime(2021, 3, 5))).alias("b"),
            day_month_year_label(F.lit(dt.datetime(2021, 3, 5))).alias("c"))[0]
    assert (r["a"], r["b"], r["c"]) == ("Mar 2021", "05", "05 Mar 2021")
