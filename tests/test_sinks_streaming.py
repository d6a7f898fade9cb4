"""Writes, read-back checks, table append and the streaming ingest (SNK-01..07, CCH-02)."""

import json

import pytest
from pyspark.sql import functions as F

from wattline.session import scratch_path
from wattline.sinks import writers as S
from wattline.sources import files as SRC
from wattline.sources.schemas import STORED_TABLE_DDL
from wattline.sources.tables import cached, read_table
from wattline.streaming.ingest import load_available


def test_table_recreate_append_read(spark):
    base = scratch_path(spark, "t")
    S.create_namespace(spark, "wl_test", f"{base}/db")
    S.create_namespace(spark, "wl_test", f"{base}/db")  # idempotent
    S.recreate_table(spark, "wl_test.prod", STORED_TABLE_DDL, f"{base}/prod")
    df = spark.createDataFrame([(1, "NO1", "hydro", "s", "e", 2.5, "u")],
                               "IND long, priceArea string, productionGroup string, startTime string, "
                               "endTime string, quantityKwh double, lastUpdatedTime string")
    S.append_table(df, "wl_test.prod")
    S.append_table(df, "wl_test.prod")
    back = read_table(spark, "wl_test.prod")
    assert back.count() == 2
    assert S.key_is_unique(back, "ind").first()["unique"] is False
    S.recreate_table(spark, "wl_test.prod", STORED_TABLE_DDL, f"{base}/prod")  # same folder
    assert read_table(spark, "wl_test.prod").count() == 0
    S.recreate_table(spark, "wl_test.managed", STORED_TABLE_DDL)
    S.append_table(df, "wl_test.managed")
    S.recreate_table(spark, "wl_test.managed", STORED_TABLE_DDL)
    assert read_table(spark, "wl_test.managed").count() == 0
    with pytest.raises(ValueError):
        S.append_table(df.drop("quantityKwh"), "wl_test.prod")


def test_partitioned_overwrite_prunes_and_checks(spark):
    path = scratch_path(spark, "p")
    df = spark.range(0, 300).select(F.col("id"), (F.col("id") % 3).alias("month"))
    S.overwrite_partitioned(df, path, ["month"])
    back = spark.read.parquet(path)
    chk = S.read_back_check(300, back).first()
    assert (chk["written"], chk["read_back"], chk["match"]) == (300, 300, True)
    S.overwrite_partitioned(df.filter("id < 30"), path, ["month"])
    assert spark.read.parquet(path).count() == 30
    from wattline.plans.checks import plan_text
    assert "PartitionFilters: [isnotnull(month" in plan_text(spark.read.parquet(path).filter("month = 1"))


def test_json_landing_and_document_read(spark):
    path = scratch_path(spark, "docs")
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "name string, age double").withColumn("_id", F.lit(1))
    S.land_json(df, path)
    back = SRC.read_documents(spark, path)
    assert "_id" not in back.columns and back.count() == 2


def test_csv_sources(spark, tmp_path):
    p = tmp_path / "planets.csv"
    p.write_text("planet,distance,diameter\nMercury,0.387 AU,4878 km\nVenus,0.723 AU,12104 km\n")
    df = SRC.read_csv(spark, str(p))
    assert df.columns == ["planet", "distance", "diameter"] and df.count() == 2
    w = tmp_path / "series.csv"
    w.write_text("time,temperature_2m (°C),wind_direction_10m (°)\n2020-01-01T00:00,-2.2,284\n2020-01-01T01:00,-2.5,283\n")
    s = SRC.read_series_csv(spark, str(w))
    assert dict(s.dtypes)["time"] == "timestamp_ntz"
    assert s.count() == 2
    assert SRC.read_series_csv(spark, str(p)).columns == ["planet", "distance", "diameter"]


def test_to_driver_returns_every_row(spark):
    assert len(S.to_driver(spark.range(11))) == 11


def test_cached_releases(spark):
    df = spark.range(10)
    with cached(df) as c:
        assert c.is_cached
        assert c.count() == 10
    assert not df.is_cached


def _land(path, area, n, start):
    doc = {"data": [{"priceArea": area, "attributes": {"productionPerGroupMbaHour": [
        {"priceArea": area, "productionGroup": "hydro", "startTime": f"t{start + i}", "endTime": "e",
         "lastUpdatedTime": "u", "quantityKwh": float(i)} for i in range(n)]}}]}
    path.write_text(json.dumps(doc))


def test_stream_loads_each_file_once(spark, tmp_path):
    land = tmp_path / "landing"
    land.mkdir()
    _land(land / "a.json", "NO1", 3, 0)
    _land(land / "b.json", "NO2", 2, 100)
    out, ck = scratch_path(spark, "flat"), scratch_path(spark, "ck")
    load_available(spark, str(land), out, ck)
    assert spark.read.parquet(out).count() == 5
    load_available(spark, str(land), out, ck)  # rerun: nothing new, nothing duplicated
    assert spark.read.parquet(out).count() == 5
    _land(land / "c.json", "NO3", 4, 200)
    load_available(spark, str(land), out, ck)
    back = spark.read.parquet(out)
    assert back.count() == 9
    assert back.select("startTime").distinct().count() == 9


def test_batch_folders_and_single_scan_read(spark):
    from wattline.operators.ingest import stamp_key, union_batches
    path = scratch_path(spark, "lb")
    df = spark.createDataFrame([("NO1", 1.0), ("NO2", 2.0), ("NO 9/x", 3.0)], "area string, q double")
    S.land_json(df, path, partition_by=["area"])
    found = SRC.batch_folders(spark, path, "area")
    assert [a for a, _ in found] == ["NO 9/x", "NO1", "NO2"]  # unforeseen keys are found too
    u = union_batches([stamp_key(spark.read.schema("q double").json(f), "area", a) for a, f in found])
    assert sorted((r["area"], r["q"]) for r in u.collect()) == [("NO 9/x", 3.0), ("NO1", 1.0), ("NO2", 2.0)]
    assert SRC.batch_folders(spark, path + "-missing", "area") == []


def test_observed_write_count(spark):
    path = scratch_path(spark, "obs")
    assert S.overwrite_partitioned_counted(spark.range(123).withColumn("p", F.col("id") % 2), path, ["p"]) == 123


def test_utc_zone_restores_and_keeps_semantics(spark):
    from wattline.functions.timeops import lenient_utc
    from wattline.session import utc_zone
    key = "spark.sql.session.timeZone"
    spark.conf.set(key, "Europe/Oslo")
    try:
        with utc_zone(spark):
            df = spark.createDataFrame([("2021-01-01T00:00:00+01:00",)], "s string").select(lenient_utc("s").alias("t"))
        assert spark.conf.get(key) == "Europe/Oslo"
        import datetime as dt
        assert df.first()["t"] == dt.datetime(2020, 12, 31, 23, 0)
    finally:
        spark.conf.set(key, "UTC")


def test_read_back_schema_check(spark):
    path = scratch_path(spark, "schema")
    df = spark.range(10).select("id", (F.col("id") % 2).cast("int").alias("p"), F.lit("x").alias("s"))
    S.overwrite_partitioned(df, path, ["p"])
    back = spark.read.parquet(path)
    assert S.read_back_check(10, back, df.schema).first()["schema_match"] is True
    other = df.withColumn("s", F.lit(1.0))
    assert S.read_back_check(10, back, other.schema).first()["schema_match"] is False


def test_load_and_curate_chain_and_pruned_month(spark, tmp_path):
    from wattline.plans.checks import plan_text
    from wattline.sinks.curate import curated_month, load_and_curate
    land = tmp_path / "landing"
    land.mkdir()
    for name, area, start in (("a.json", "NO1", "2021-01-31T23:00:00+01:00"), ("b.json", "NO2", "2021-02-01T00:00:00+01:00")):
        doc = {"data": [{"priceArea": area, "attributes": {"productionPerGroupMbaHour": [
            {"priceArea": area, "productionGroup": "hydro", "startTime": start, "endTime": "e",
             "lastUpdatedTime": "u", "quantityKwh": 2}]}}]}
        (land / name).write_text(json.dumps(doc, indent=4))
    base = scratch_path(spark, "cur")
    check = load_and_curate(spark, str(land), "wl_cur.stored", f"{base}/t", f"{base}/c",
                            namespace_location=f"{base}/db").first()
    assert (check["written"], check["match"], check["schema_match"]) == (2, True, True)
    jan = curated_month(spark, f"{base}/c", 2021, 1)
    assert [r["pricearea"] for r in jan.collect()] == ["NO1"]   # local text month, not UTC
    assert "PartitionFilters: [isnotnull(year" in plan_text(jan)
    assert read_table(spark, "wl_cur.stored").count() == 2


def test_read_batches_in_one_scan_with_a_null_key(spark):
    from pyspark.sql import types as T
    path = scratch_path(spark, "rb")
    area = F.when(F.col("id") % 10 > 0, (F.col("id") % 10).cast("string"))
    df = spark.range(400).select(area.alias("area"), F.col("id").cast("double").alias("q"))
    S.land_json(df, path, partition_by=["area"])
    schema = T.StructType([T.StructField("q", T.DoubleType())])
    back = SRC.read_batches(spark, path, "area", schema)
    key = lambda r: (r["area"] or "", r["q"])
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))
    assert back.filter("area IS NULL").count() == 40
    assert SRC.read_batches(spark, path + "-none", "area", schema).count() == 0


def test_document_read_under_a_schema_treats_nan_as_missing(spark):
    path = scratch_path(spark, "docs2")
    S.land_json(spark.range(20).select(F.when(F.col("id") > 4, F.col("id").cast("double")).otherwise(float("nan")).alias("q")), path)
    assert SRC.read_documents(spark, path, schema="q DOUBLE").filter("q IS NULL").count() == 5


def test_append_refuses_unknown_columns(spark):
    base = scratch_path(spark, "strict")
    S.create_namespace(spark, "wl_test", f"{base}/db")
    S.recreate_table(spark, "wl_test.strict", "a BIGINT", f"{base}/it's")
    S.append_table(spark.range(2).toDF("A"), "wl_test.strict")
    with pytest.raises(ValueError, match="not in the table"):
        S.append_table(spark.range(2).selectExpr("id AS a", "id AS b"), "wl_test.strict")
    assert spark.table("wl_test.strict").count() == 2


def test_overwrite_replaces_all_partitions_in_dynamic_mode(spark):
    path, key = scratch_path(spark, "dyn"), "spark.sql.sources.partitionOverwriteMode"
    S.overwrite_partitioned(spark.range(30).withColumn("p", F.col("id") % 3), path, ["p"])
    spark.conf.set(key, "dynamic")
    try:
        S.overwrite_partitioned(spark.range(10).withColumn("p", F.lit(0)), path, ["p"])
    finally:
        spark.conf.unset(key)
    assert spark.read.parquet(path).count() == 10


def test_ids_of_later_loads_lie_above_earlier_ones(spark, tmp_path):
    from wattline.sinks.curate import load_and_curate
    _land(tmp_path / "a.json", "NO1", 3, 0)
    base = scratch_path(spark, "twice")
    args = (spark, str(tmp_path), "wl_twice.stored", f"{base}/t", f"{base}/c")
    load_and_curate(*args, namespace_location=f"{base}/db")
    check = load_and_curate(*args, namespace_location=f"{base}/db", recreate=False).first()
    assert check["written"] == 6 and check["match"]
    assert S.key_is_unique(read_table(spark, "wl_twice.stored"), "ind").first()["unique"]


def test_an_empty_load_writes_no_rows(spark, tmp_path):
    from wattline.sinks.curate import load_and_curate
    (tmp_path / "e.json").write_text('{"data": []}')
    base = scratch_path(spark, "empty")
    check = load_and_curate(spark, str(tmp_path), "wl_empty.stored", f"{base}/t", f"{base}/c",
                            namespace_location=f"{base}/db").first()
    assert (check["written"], check["read_back"], check["match"]) == (0, 0, True)
