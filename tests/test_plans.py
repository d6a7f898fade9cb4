"""Plan shape: pushdown, pruning, single scans, no Python or cartesian products."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from wattline.operators import filters as FL
from wattline.operators import normalize as NZ
from wattline.plans import views as V
from wattline.plans.checks import plan_text, rows_read, summary
from wattline.plans.queries import QUERIES
from wattline.session import scratch_path

WRITERS = {"normalized_stored_stats", "sorted_selection", "landed_dump", "streamed_latest", "metric_chunks", "windows_tried", "published_loads", "summary_by_loads", "batch_union", "streamed_ingest", "json_round_trip", "table_append_read",
           "csv_round_trip", "partitioned_overwrite", "read_back_check",
           "curate_from_landing", "curated_january", "month_range_pruned", "pie_from_summary", "summary_choices",
           "utc_january_pruned", "row_id_across_loads", "landed_list", "csv_with_gaps", "group_totals_with_nan"}
# Passes over the table: scaling needs its statistics first, coverage its planned keys.
PASSES = {"normalized_long": 2, "normalized_all_rows": 2, "normalized_keep_nulls": 2, "window_coverage": 2,
          "area_coverage": 2, "grand_total": 2,
          "hourly_one_area": 2}  # a global sort of rows samples its input first
TABLES = {"events", "lineitem"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_no_python_no_cartesian_few_passes(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    s = summary(df)
    assert s["python"] == 0
    assert s["cartesian"] == 0
    text = plan_text(df)
    rows = max(V.table(spark, SF_SMALL, t).count() for t in TABLES if f"/{t}.parquet" in text)
    assert rows_read(spark, df.collect) <= PASSES.get(name, 1) * rows + 4  # literal rows count too


@pytest.mark.parametrize("name", ["pie_from_summary", "summary_choices"])
def test_choices_from_the_summary_read_the_facts_once(spark, name):
    facts = V.table(spark, SF_SMALL, "events").count()
    read = rows_read(spark, lambda: QUERIES[name](spark, SF_SMALL).collect())
    summary_rows = 6 * 7  # areas and Total x groups and NULL, at most
    assert facts <= read <= facts + 2 * summary_rows


@pytest.mark.parametrize("name", sorted(WRITERS))
def test_writing_keys_use_no_python_and_no_cartesian(spark, name):
    s = summary(QUERIES[name](spark, SF_SMALL))
    assert s["python"] == 0 and s["cartesian"] == 0


def test_text_month_filter_reaches_the_scan(spark):
    path = scratch_path(spark, "pt")
    V.production_text(spark, SF_SMALL).write.parquet(path)
    jan = FL.text_year_month(spark.read.parquet(path), "starttime", 2024, 1)
    assert "StringStartsWith(starttime,2024-01)" in plan_text(jan)


def test_month_with_year_is_a_pushed_range(spark):
    w = V.weather(spark, SF_SMALL)
    t = plan_text(FL.in_month(w, "time", 3, year=1996))
    assert "GreaterThanOrEqual(l_shipdate,1996-03-01T00:00)" in t
    assert "LessThan(l_shipdate,1996-04-01T00:00)" in t


def test_group_filter_pushed(spark):
    t = plan_text(FL.in_groups(V.production(spark, SF_SMALL), ["view"]))
    assert "EqualTo(event_type,view)" in t or "In(event_type" in t


def test_stats_are_one_subquery(spark):
    w = V.weather(spark, SF_SMALL)
    t = plan_text(NZ.scale_min_max(w, NZ.metric_columns(w)))
    assert t.count("Subquery:") == 1
    assert "CartesianProduct" not in t and "NestedLoopJoin" not in t


def test_projection_prunes_columns(spark):
    t = plan_text(QUERIES["single_metric"](spark, SF_SMALL))
    assert "ReadSchema: struct<l_extendedprice:double,l_shipdate:timestamp_ntz>" in t


def test_aggregates_are_two_phase(spark):
    t = plan_text(QUERIES["daily_by_group"](spark, SF_SMALL))
    assert "partial_sum" in t


def test_top_k_not_full_sort(spark):
    t = plan_text(QUERIES["first_five"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in t


def test_guard_subquery_reuses_the_aggregate_shuffle(spark):
    df = QUERIES["pie_all_areas"](spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in final  # the total is computed from the same shuffle, no second scan


def test_partitioned_write_uses_rebalance(spark):
    from wattline.plans.views import weather
    w = weather(spark, SF_SMALL).withColumn("year", F.year("time"))
    t = plan_text(w.hint("rebalance", "year"))
    assert "REBALANCE_PARTITIONS_BY_COL" in t


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_single_partition_exchanges_carry_partials_only(spark, name):
    from wattline.plans.checks import single_partition_inputs
    feeds = single_partition_inputs(QUERIES[name](spark, SF_SMALL))
    assert all(f == "partial" for f in feeds), feeds


def test_hot_partition_value_is_split_across_writers(spark):
    import os
    from wattline.sinks.writers import overwrite_partitioned_counted
    n = 300_000
    df = spark.range(0, n, numPartitions=8).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 12 + 1).alias("month"))
    path = scratch_path(spark, "hot")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "256k")
    try:
        written = overwrite_partitioned_counted(df, path, ["month"])
    finally:
        spark.conf.set(key, before)
    assert written == n
    hot = [f for f in os.listdir(os.path.join(path.replace("file:", ""), "month=1")) if f.endswith(".parquet")]
    assert len(hot) > 1  # the month holding a third of the rows went to several writers
    assert spark.read.parquet(path).count() == n


@pytest.mark.parametrize("name", ["daily_by_group", "normalized_long", "window_coverage", "share_of_area"])
def test_final_plans_are_whole_stage_compiled(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "*(" in final and "Python" not in final


@pytest.mark.parametrize("name", sorted(V.TABLE_SCHEMAS))
def test_declared_table_schemas_match_the_files(spark, name):
    from pyspark.sql.types import _parse_datatype_string
    inferred = spark.read.parquet(f"{SF_SMALL}/{name}.parquet").schema
    declared = _parse_datatype_string(V.TABLE_SCHEMAS[name])
    assert [(f.name, f.dataType) for f in inferred] == [(f.name, f.dataType) for f in declared]


def test_rows_read_sees_rescans_subqueries_and_dropped_branches(spark):
    ev = V.table(spark, SF_SMALL, "events")
    n = ev.count()
    two = ev.select("event_id").union(ev.select("user_id"))
    assert rows_read(spark, two.collect) == 2 * n
    shared = ev.groupBy("event_type").agg(F.sum("value").alias("s"))
    assert rows_read(spark, shared.collect) == n
    total = ev.select(F.sum("value")).scalar()
    assert rows_read(spark, ev.filter(F.col("value") < total).collect) == 2 * n
    from wattline.operators import aggregates as A
    from wattline.plans.views import production_text
    lazy = A.area_selection(A.area_group_with_total(production_text(spark, SF_SMALL)), "Total")
    assert rows_read(spark, lazy.collect) == 2 * n  # why the summary is stored before choices are served


def test_hot_group_shuffles_partials_not_rows(spark):
    from wattline.operators import aggregates as A
    from wattline.plans.checks import shuffle_records_written
    n, tasks = 300_000, 8
    facts = spark.range(0, n, numPartitions=tasks).select(
        F.lit("NO1").alias("pricearea"),
        F.when(F.col("id") % 3 == 0, F.lit("hydro")).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string")))
         .alias("productiongroup"),
        F.lit(1.0).alias("quantitykwh"))
    totals = A.group_totals(facts)
    got = {r["productiongroup"]: r["quantitykwh"] for r in totals.collect()}
    assert got["hydro"] == n / 3
    groups = len(got)
    assert shuffle_records_written(totals) <= tasks * groups  # one partial row per group per task
    raw = facts.repartition("productiongroup")  # what a per-key repartition would move
    raw.collect()
    assert shuffle_records_written(raw) == n


def test_month_filters_prune_the_month_layout(spark):
    path = scratch_path(spark, "wm")
    w = V.weather(spark, SF_SMALL)
    from wattline.sinks.writers import overwrite_partitioned
    overwrite_partitioned(w.withColumn("year", F.year("time")).withColumn("month", F.month("time")),
                          path, ["year", "month"])
    back = spark.read.parquet(path)
    one = FL.in_month(back, "time", 3, partition_month="month")
    rng = FL.in_month_range(back, "time", 2, 4, partition_month="month")
    assert "PartitionFilters: [isnotnull(month" in plan_text(one) and "(month#" in plan_text(one)
    assert "PartitionFilters: [isnotnull(month" in plan_text(rng)
    assert one.count() == FL.in_month(w, "time", 3).count()
    assert rng.count() == FL.in_month_range(w, "time", 2, 4).count()
