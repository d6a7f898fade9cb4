"""Loads published after their checks: ids, ledger, repeats and the summary by deltas."""

import pytest
from pyspark.sql import functions as F

from wattline.operators import aggregates as A
from wattline.session import scratch_path
from wattline.sinks import loads as LD
from wattline.sinks import writers as S

KEYS, VALUE = ["pricearea", "productiongroup"], "quantitykwh"
DDL = "ind BIGINT, pricearea STRING, productiongroup STRING, quantitykwh DECIMAL(18,2)"
ROWS = "pricearea STRING, productionGroup STRING, quantitykwh DECIMAL(18,2)"


@pytest.fixture
def store(spark):
    base = scratch_path(spark, "t-loads")
    S.create_namespace(spark, "wl_loads", f"{base}/db")
    name = "wl_loads.t_" + base.rsplit("-", 1)[-1]
    LD.create_load_table(spark, name, DDL, base, KEYS, VALUE)

    def publish(df, load):
        return LD.publish_load(spark, df, name, load, base, KEYS, VALUE)
    return name, base, publish


def rows(spark, n, area="NO1", parts=3):
    return spark.range(0, n, 1, parts).select(F.lit(area).alias("pricearea"), F.when(F.col("id") % 3 > 0, F.lit("hydro")).alias("productionGroup"),
                                              (F.col("id") / 4).cast("decimal(18,2)").alias("quantitykwh"))


def test_ids_are_dense_and_unique_over_loads_and_repeats_add_nothing(spark, store):
    name, _, publish = store
    assert publish(rows(spark, 100), "a") and publish(rows(spark, 7, "it's", 1), "b'1") and not publish(rows(spark, 100), "a")
    got = spark.table(name)
    assert sorted(r["ind"] for r in got.collect()) == list(range(107))
    assert sorted(LD.loads_of(spark, name)) == ["a", "b'1"] and got.filter("load = 'a'").count() == 100


@pytest.mark.parametrize("bad", [
    lambda df: df.withColumn("ind", F.lit(500).cast("long")),                        # one id for all rows, outside the range
    lambda df: df.withColumn("ind", F.monotonically_increasing_id()),                # ids of the first load again
    lambda df: df.withColumn("ind", F.lit(10).cast("long") + F.pmod(F.xxhash64("quantitykwh"), F.lit(2))),
    lambda df: df.drop("quantitykwh"), lambda df: df.withColumn("more", F.lit(1))])
def test_a_bad_load_leaves_table_and_summary_unchanged(spark, store, bad):
    name, base, publish = store
    publish(rows(spark, 10, parts=1), "a")
    before = [sorted(map(tuple, spark.table(t).collect()), key=str) for t in (name, f"{name}_sums")]
    with pytest.raises(LD.LoadError):
        publish(bad(rows(spark, 10, parts=1)), "b")
    assert [sorted(map(tuple, spark.table(t).collect()), key=str) for t in (name, f"{name}_sums")] == before
    assert publish(rows(spark, 10, parts=1), "b")  # the repeated load gets a clean range
    ids = [r["ind"] for r in spark.table(name).collect()]
    assert len(set(ids)) == 20
    ledger = spark.read.parquet(f"{base}/ledger").orderBy("first").collect()
    ends = [r["first"] + r["rows"] for r in ledger]
    assert all(r["first"] >= end for r, end in zip(ledger[1:], ends))


def test_summary_by_deltas_equals_a_recompute(spark, store):
    name, _, publish = store
    for load, df in (("a", rows(spark, 50)), ("b", rows(spark, 20, "NO2")), ("a", rows(spark, 50)), ("none", rows(spark, 0)),
                     ("nulls", rows(spark, 4, None).withColumn("quantitykwh", F.lit(None).cast("decimal(18,2)")))):
        publish(df, load)
    got = A.area_group_with_total(LD.load_sums(spark, name))
    want = A.area_group_with_total(spark.table(name))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert LD.load_sums(spark, name).agg(F.sum("n")).first()[0] == 70


def test_sums_of_a_load_that_is_not_visible_do_not_count(spark, store):
    name, base, publish = store
    publish(rows(spark, 5), "a")
    want = sorted(map(str, LD.load_sums(spark, name).collect()))
    LD._show(spark, f"{name}_sums", "lost", f"{base}/{name}_sums")  # as after a crash between the two steps
    assert sorted(map(str, LD.load_sums(spark, name).collect())) == want
    assert publish(rows(spark, 5), "lost") and LD.load_sums(spark, name).agg(F.sum("n")).first()[0] == 10


def test_an_empty_table_has_an_empty_summary(spark, store):
    assert LD.loads_of(spark, store[0]) == [] and LD.load_sums(spark, store[0]).collect() == []


def test_summary_and_publishing_read_no_published_rows(spark, store):
    from wattline.plans.checks import plan_text
    name, base, publish = store
    publish(rows(spark, 50), "a")
    text = plan_text(A.area_group_with_total(LD.load_sums(spark, name)))
    assert "/sums" in text or "_sums" in text
    assert "/rows" not in text
