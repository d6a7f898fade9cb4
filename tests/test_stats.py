"""Stored statistics, sorted files and loads checked before they are shown."""

import math

import pytest
from pyspark.sql import functions as F

from wattline.operators import normalize as NZ
from wattline.plans.checks import rows_read
from wattline.session import scratch_path
from wattline.sinks import curate as C
from wattline.sinks import stats as ST
from wattline.sinks import writers as S
from wattline.sinks.loads import LoadError

DDL = "t INT, month INT, a DOUBLE, b DOUBLE, none DOUBLE"
ROWS = [(1, 1, 1.0, float("nan"), None), (2, 1, 3.0, 7.0, None), (3, 1, None, 7.0, None), (4, 2, float("nan"), -1.0, None),
        (5, 2, 9.0, None, float("nan")), (6, None, 5.0, 7.0, None)]
METRICS = ["a", "b", "none"]


def _written(spark, rows, **kw):
    path, stats = scratch_path(spark, "stats-data"), scratch_path(spark, "stats")
    n = ST.write_with_stats(spark.createDataFrame(rows, DDL), path, stats, ["month"], METRICS, **kw)
    return spark.read.schema(DDL).parquet(path), stats, path, n


@pytest.mark.parametrize("mode", ["keep_nulls", "zero_fill"])
@pytest.mark.parametrize("months", [None, [1], [2], [1, 2]])
def test_stored_statistics_scale_like_a_scan(spark, mode, months):
    table, stats, _, n = _written(spark, ROWS, sort_by=["t"])
    assert n == len(ROWS)
    stored = ST.stored_stats(spark, stats, METRICS)
    if months:
        table, stored = table.filter(F.col("month").isin(months)), stored.filter(F.col("month").isin(months))
    plain = NZ.scale_min_max(table, METRICS, mode=mode)
    got = NZ.scale_min_max(table, METRICS, mode=mode, stored=stored)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_statistics_per_partition(spark):
    _, stats, _, _ = _written(spark, ROWS)
    got = {(r["month"], r["metric"]): (r["n"], r["min_value"], r["max_value"], r["rows"])
           for r in ST.stored_stats(spark, stats, METRICS).collect()}
    assert len(got) == 9
    assert got[1, "a"] == (2, 1.0, 3.0, 3) and got[1, "b"] == (2, 7.0, 7.0, 3) and got[2, "a"] == (1, 9.0, 9.0, 2)
    assert got[2, "none"] == (0, None, None, 2) and got[None, "b"] == (1, 7.0, 7.0, 1)


def test_scaling_with_stored_statistics_reads_the_table_once(spark):
    path, stats = scratch_path(spark, "once"), scratch_path(spark, "once-stats")
    df = spark.range(5000).select((F.col("id") % 4).cast("int").alias("month"), F.sin("id").alias("x"))
    ST.write_with_stats(df, path, stats, ["month"], ["x"])
    table, stored = spark.read.schema(df.schema).parquet(path), ST.stored_stats(spark, stats, ["x"])
    out = NZ.scale_min_max(table, ["x"], stored=stored)
    assert 5000 <= rows_read(spark, out.collect) <= 5000 + 5  # and a row per partition and metric, and the table's
    assert rows_read(spark, NZ.scale_min_max(table, ["x"]).collect) == 10_000
    assert math.isclose(max(r["x"] for r in out.collect()), 1.0)


def test_unfinished_or_missing_statistics_are_refused(spark):
    _, stats, _, _ = _written(spark, ROWS)
    with pytest.raises(ST.StatsError, match="other"):
        ST.stored_stats(spark, stats, ["a", "other"])
    whole = spark.read.parquet(stats)
    partial = scratch_path(spark, "partial")
    whole.filter("metric IS NOT NULL").write.parquet(partial)
    with pytest.raises(ST.StatsError, match="finished"):
        ST.stored_stats(spark, partial, ["a"])


def test_a_failed_write_leaves_no_statistics(spark):
    _, stats, path, _ = _written(spark, ROWS)
    bad = spark.createDataFrame(ROWS, DDL).withColumn("a", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        ST.write_with_stats(bad, path, stats, ["month"], METRICS)
    with pytest.raises(ST.StatsError):
        ST.stored_stats(spark, stats, METRICS)


def test_an_empty_table_has_statistics_without_rows(spark):
    table, stats, _, n = _written(spark, [])
    assert n == 0 and ST.stored_stats(spark, stats, METRICS).count() == 0
    assert NZ.scale_min_max(table, METRICS, stored=ST.stored_stats(spark, stats, METRICS)).collect() == []


def test_columns_of_odd_names_and_clashes(spark):
    path, stats = scratch_path(spark, "odd"), scratch_path(spark, "odd-stats")
    df = spark.createDataFrame([(1, 2.0, 4.0, "x"), (1, 6.0, 8.0, "y")], "`p.art` INT, rows DOUBLE, `n.a b` DOUBLE, metric STRING")
    ST.write_with_stats(df, path, stats, ["p.art"], ["rows", "n.a b"])
    got = {r["metric"]: (r["min_value"], r["max_value"]) for r in ST.stored_stats(spark, stats, ["rows", "n.a b"]).collect()}
    assert got == {"rows": (2.0, 6.0), "n.a b": (4.0, 8.0)}


def test_one_area_of_a_month_skips_rows_of_sorted_files(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("month"), F.concat(F.lit("NO"), (F.col("id") % 5 + 1).cast("string")).alias("pricearea"),
                               F.element_at(F.array(*map(F.lit, ["hydro", "wind", "solar"])), (F.col("id") % 3 + 1).cast("int")).alias("productiongroup"),
                               F.xxhash64("id").alias("key"), F.sqrt("id").alias("quantitykwh"))
    plain, laid = scratch_path(spark, "plain"), scratch_path(spark, "laid")
    S.overwrite_partitioned(df, plain, ["month"])
    S.overwrite_partitioned(df, laid, ["month"], sort_by=["pricearea", "productiongroup"], bloom=["key"], row_group_bytes=256 * 1024)

    def chosen(path):
        return spark.read.schema(df.schema).parquet(path).filter("month = 1 AND pricearea = 'NO3' AND productiongroup = 'wind'")
    read_plain = rows_read(spark, lambda: chosen(plain).agg(F.sum("quantitykwh")).collect())
    read_laid = rows_read(spark, lambda: chosen(laid).agg(F.sum("quantitykwh")).collect())
    assert read_plain == n and read_laid < n / 3
    assert chosen(plain).exceptAll(chosen(laid)).isEmpty() and chosen(laid).count() == chosen(plain).count() == n // 15

    def lookup(path):
        key = spark.range(77, 78).select(F.xxhash64("id").alias("key"))
        return spark.read.schema(df.schema).parquet(path).filter(F.col("key") == key.first()["key"])
    assert lookup(laid).collect() == lookup(plain).collect()
    assert rows_read(spark, lambda: lookup(laid).collect()) < n / 3


def test_a_load_with_clashing_ids_leaves_the_stored_table_as_it_was(spark, tmp_path, monkeypatch):
    base = scratch_path(spark, "clash")
    entry = {"priceArea": "NO1", "productionGroup": "hydro", "startTime": "2021-01-01T00:00:00+01:00",
             "endTime": "2021-01-01T01:00:00+01:00", "lastUpdatedTime": "2021-01-02T00:00:00+01:00", "quantityKwh": 1.5}
    import json
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"priceArea": "NO1", "attributes": {"productionPerGroupMbaHour": [entry] * 3}}]}))
    args = (spark, str(tmp_path), "wl_clash.stored", f"{base}/t", f"{base}/c")
    C.load_and_curate(*args, namespace_location=f"{base}/db")
    before = sorted(spark.table("wl_clash.stored").collect())
    given = C.with_row_id
    for bad in (lambda df, above=None: given(df).withColumn("ind", F.lit(0).cast("long")),
                lambda df, above=None: given(df)):  # repeated ids; ids that the table has
        monkeypatch.setattr(C, "with_row_id", bad)
        with pytest.raises(LoadError):
            C.load_and_curate(*args, namespace_location=f"{base}/db", recreate=False)
        assert sorted(spark.table("wl_clash.stored").collect()) == before
    monkeypatch.setattr(C, "with_row_id", given)
    C.load_and_curate(*args, namespace_location=f"{base}/db", recreate=False)
    assert spark.table("wl_clash.stored").count() == 6
    assert S.key_is_unique(spark.table("wl_clash.stored"), "ind").first()["unique"]
