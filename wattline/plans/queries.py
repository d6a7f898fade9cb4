"""Registered queries: one per operator family of SURVEY 7.4, each with a DuckDB oracle.

Every query reads the driver's tables (through the views) over whole
tables; results grow with the input.  Queries that exercise sinks write to
a fresh folder under the session's shared ``spark.checkpoint.dir`` and
return the read-back DataFrame.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.calendar import month_name
from wattline.functions.timeops import (day_month_year_label, day_label, lenient_utc,
                                        month_year_label, strict_timestamp)
from wattline.operators import aggregates as A
from wattline.operators import filters as FL
from wattline.operators import ingest as I
from wattline.operators import labels as L
from wattline.operators import normalize as NZ
from wattline.operators import reshape as R
from wattline.operators.coverage import month_windows, window_coverage
from wattline.operators.profile import profile
from wattline.plans import views as V
from wattline.session import scratch_path, utc_zone
from wattline.sinks import loads as LD
from wattline.sinks import stats as ST
from wattline.sinks import windows as WN
from wattline.sinks import writers as S
from wattline.sinks.curate import curated_month, load_and_curate, with_text_month
from wattline.sinks.latest import create_latest_table
from wattline.sources import files as SRC
from wattline.sources.schemas import CURATED_COLUMNS, PAYLOAD_RECORD, PRODUCTION, STORED_TABLE_DDL
from wattline.sources.tables import read_table
from wattline.streaming.ingest import load_available, load_latest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Parameters of the registered selections (the data is January 2024).
YEAR, MONTH = 2024, 1
ONE_AREA = "NO3"
SOME_GROUPS = ["view", "click"]
MONTH_RANGE = (2, 4)

# ---------------------------------------------------------------- SQL views
_SQL_VIEWS = {
    "P": """P AS (SELECT event_id, 'NO' || CAST(user_id % 5 + 1 AS VARCHAR) AS pricearea,
        event_type AS productiongroup, date_trunc('hour', ts) AS starttime,
        CAST(value AS DECIMAL(18,2)) AS quantitykwh FROM events)""",
    "PT": """PT AS (SELECT event_id, pricearea,
        CASE WHEN event_id % 89 = 0 THEN NULL ELSE productiongroup END AS productiongroup,
        CASE WHEN event_id % 97 = 0 THEN 'bad'
             ELSE strftime(starttime, '%Y-%m-%dT%H:%M:%S') || '+01:00' END AS starttime,
        quantitykwh FROM P)""",
    "U": """U AS (SELECT event_id, pricearea, productiongroup,
        CAST(try_strptime(starttime, '%Y-%m-%dT%H:%M:%S%z') AT TIME ZONE 'UTC' AS TIMESTAMP) AS starttime,
        quantitykwh FROM PT)""",
    "R": """R AS (SELECT event_id, pricearea AS "priceArea", productiongroup AS "productionGroup",
        strftime(starttime, '%Y-%m-%dT%H:%M:%S') || '+01:00' AS "startTime",
        strftime(starttime + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') || '+01:00' AS "endTime",
        strftime(starttime + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') || '+01:00' AS "lastUpdatedTime",
        CAST(quantitykwh AS DOUBLE) AS "quantityKwh" FROM P)""",
    "W": """W AS (SELECT l_shipdate AS "time", l_quantity, l_extendedprice, l_discount, l_tax
        FROM lineitem)""",
    "WG": """WG AS (SELECT l_shipdate AS "time", l_quantity, l_extendedprice, l_discount, l_tax,
        CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(1.0 AS DOUBLE) END AS l_flat FROM lineitem)""",
}
_VIEW_DEPS = {"PT": ["P"], "U": ["P", "PT"], "R": ["P"]}


def _with(*names: str, extra: str = "") -> str:
    order: list[str] = []
    for n in names:
        for d in _VIEW_DEPS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    parts = [_SQL_VIEWS[n] for n in order] + ([extra] if extra else [])
    return "WITH " + ",\n".join(parts) + "\n"


def register(name: str, sql: str | None):
    """Register a query; it is built (analysed) under the UTC session zone.

    Times are naive UTC throughout; building the whole plan under UTC keeps
    parsing and truncation exact whatever zone the caller's session uses.
    """
    def deco(fn: Query) -> Query:
        @functools.wraps(fn)
        def built_in_utc(spark: SparkSession, d: str) -> DataFrame:
            with utc_zone(spark):
                return fn(spark, d)
        QUERIES[name] = built_in_utc
        if sql is not None:
            ORACLE[name] = sql
        return built_in_utc
    return deco


def _rows_double(df: DataFrame, col: str = "quantitykwh") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("double"))


def _dates_as_midnight(df: DataFrame, *cols: str) -> DataFrame:
    """Registered results carry window bounds as midnight timestamps.

    The operators return dates; pandas receives a Spark date as a Python
    date but a DuckDB DATE as a timestamp, so both sides of the check use
    timestamps (the oracle casts its dates the same way).
    """
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    with utc_zone(spark):
        return V.production_text(spark, d).withColumn("starttime", lenient_utc("starttime"))


_ROW_COLS = "event_id, pricearea, productiongroup, starttime, CAST(quantitykwh AS DOUBLE) AS quantitykwh"
_COLOUR_SQL = ("COALESCE(CASE productiongroup WHEN 'hydro' THEN '#1f77b4' WHEN 'wind' THEN '#17becf' "
               "WHEN 'thermal' THEN '#7f7f7f' WHEN 'solar' THEN '#e377c2' WHEN 'other' THEN '#2ca02c' END, "
               "'#AAAAAA')")
_AXIS_SQL = "CASE WHEN productiongroup = 'hydro' THEN 'primary' ELSE 'secondary' END"

# ------------------------------------------------- production: daily series


_DAILY_SQL = _with("U") + """SELECT CAST(date_trunc('day', starttime) AS TIMESTAMP) AS "date", productiongroup,
  COALESCE(CAST(SUM(quantitykwh) AS DOUBLE), 0.0) AS quantitykwh
FROM U WHERE starttime IS NOT NULL AND productiongroup IS NOT NULL {cond}
GROUP BY 1, 2 ORDER BY 1, 2"""


@register("daily_by_group", _DAILY_SQL.format(cond=""))
def daily_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: parse offset text to UTC, select, total per day and group."""
    sel = FL.production_selection(_parsed(spark, d), area=None, groups=None, month=None)
    return A.daily_group_totals(sel).orderBy("date", "productiongroup")


@register("daily_filtered", _DAILY_SQL.format(
    cond="AND pricearea = 'NO2' AND productiongroup IN ('view', 'click') AND month(starttime) = 1"))
def daily_filtered(spark: SparkSession, d: str) -> DataFrame:
    """FLT-08 with all three selections set (area, groups, month by name)."""
    sel = FL.production_selection(_parsed(spark, d), area="NO2", groups=SOME_GROUPS, month="January")
    return A.daily_group_totals(sel).orderBy("date", "productiongroup")


# ---------------------------------------------------- production: pie data
_PIE_SQL = _with("PT", extra="""G AS (SELECT productiongroup,
  COALESCE(CAST(SUM(quantitykwh) AS DOUBLE), 0.0) AS quantitykwh
  FROM PT WHERE productiongroup IS NOT NULL {cond} GROUP BY 1)""") + \
    "SELECT productiongroup, quantitykwh{extra} FROM G WHERE (SELECT SUM(quantitykwh) FROM G) > 0"


@register("pie_all_areas", _PIE_SQL.format(cond="", extra=""))
def pie_all_areas(spark: SparkSession, d: str) -> DataFrame:
    """AGG-04 + FLT-09: group totals over all areas, shown only if the total is > 0."""
    g = A.area_group_totals_for(V.production_text(spark, d), "All Areas")
    return FL.keep_if_positive_total(g, "quantitykwh").orderBy("productiongroup")


@register("pie_one_area", _PIE_SQL.format(cond=f"AND pricearea = '{ONE_AREA}'", extra=""))
def pie_one_area(spark: SparkSession, d: str) -> DataFrame:
    """AGG-05 + FLT-03 + FLT-09: group totals within one area."""
    g = A.area_group_totals_for(V.production_text(spark, d), ONE_AREA)
    return FL.keep_if_positive_total(g, "quantitykwh").orderBy("productiongroup")


@register("group_colour", _PIE_SQL.format(cond="", extra=", " + _COLOUR_SQL + " AS colour"))
def group_colour(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-11/JN-03: pie slices with their colours (default for unknown groups)."""
    return L.with_colour(pie_all_areas(spark, d))


# ------------------------------------------------ production: area summary


@register("area_group_total", _with("PT") + """SELECT pricearea, productiongroup,
  CAST(SUM(quantitykwh) AS DOUBLE) AS "Total_Kwh" FROM PT GROUP BY 1, 2""")
def area_group_total(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01: yearly total per (area, group); NULL group kept."""
    return A.area_group_totals(V.production_text(spark, d))


_GSETS = """FROM PT GROUP BY GROUPING SETS ((pricearea, productiongroup), (productiongroup))
HAVING NOT (GROUPING(pricearea) = 1 AND productiongroup IS NULL)"""


@register("area_group_with_total", _with("PT") + """SELECT
  CASE WHEN GROUPING(pricearea) = 1 THEN 'Total' ELSE pricearea END AS pricearea, productiongroup,
  CASE WHEN GROUPING(pricearea) = 1 THEN COALESCE(CAST(SUM(quantitykwh) AS DOUBLE), 0.0)
       ELSE CAST(SUM(quantitykwh) AS DOUBLE) END AS "Total_Kwh"
""" + _GSETS)
def area_group_with_total(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01 + AGG-02 + FLT-07: per-area totals plus ``Total`` rows re-aggregated from them (one scan)."""
    return A.area_group_with_total(V.production_text(spark, d))


@register("pie_from_summary", _with("PT", extra="""S AS (SELECT
  CASE WHEN GROUPING(pricearea) = 1 THEN 'Total' ELSE pricearea END AS pricearea, productiongroup,
  CASE WHEN GROUPING(pricearea) = 1 THEN COALESCE(CAST(SUM(quantitykwh) AS DOUBLE), 0.0)
       ELSE CAST(SUM(quantitykwh) AS DOUBLE) END AS "Total_Kwh"
""" + _GSETS + """),
X AS (SELECT * FROM S WHERE pricearea = 'Total')""") +
    'SELECT * FROM X WHERE (SELECT SUM("Total_Kwh") FROM X) > 0')
def pie_from_summary(spark: SparkSession, d: str) -> DataFrame:
    """CCH-01 + FLT-07 + FLT-09: the notebook pie, served from the stored summary."""
    return FL.keep_if_positive_total(A.area_selection(_stored_summary(spark, d), "Total"), "Total_Kwh")


def _stored_summary(spark: SparkSession, d: str) -> DataFrame:
    """The per-area summary with ``Total`` rows, written once; choices read its few rows, never the facts."""
    path = scratch_path(spark, "summary")
    A.area_group_with_total(V.production_text(spark, d)).write.parquet(path)
    return spark.read.schema("pricearea STRING, productiongroup STRING, Total_Kwh DOUBLE").parquet(path)


@register("summary_choices", _with("PT", extra="""S AS (SELECT
  CASE WHEN GROUPING(pricearea) = 1 THEN 'Total' ELSE pricearea END AS pricearea, productiongroup,
  CASE WHEN GROUPING(pricearea) = 1 THEN COALESCE(CAST(SUM(quantitykwh) AS DOUBLE), 0.0)
       ELSE CAST(SUM(quantitykwh) AS DOUBLE) END AS "Total_Kwh"
""" + _GSETS + ")") + f"SELECT pricearea AS choice, productiongroup, \"Total_Kwh\" FROM S WHERE pricearea IN ('Total', '{ONE_AREA}')")
def summary_choices(spark: SparkSession, d: str) -> DataFrame:
    """CCH-01 + CCH-02 + FLT-07: two choices served from one stored summary; the facts are read once."""
    summary = _stored_summary(spark, d)
    return A.area_selection(summary, "All Areas").unionByName(A.area_selection(summary, ONE_AREA)) \
        .withColumnRenamed("pricearea", "choice")


@register("grand_total", _with("PT") + """SELECT COALESCE(CAST(SUM(quantitykwh) AS DOUBLE), 0.0) AS total,
  COALESCE(CAST(SUM(quantitykwh) FILTER (WHERE pricearea = 'NO9') AS DOUBLE), 0.0) AS total_of_none FROM PT""")
def grand_total(spark: SparkSession, d: str) -> DataFrame:
    """AGG-07: the total over all rows, and 0.0 over a selection without rows."""
    pt = V.production_text(spark, d)
    none = A.grand_total(FL.in_area(pt, "NO9"))
    return A.grand_total(pt).withColumn("total_of_none", none.scalar())


_SHARE_SQL = _with("PT", extra="""S AS (SELECT
  CASE WHEN GROUPING(pricearea) = 1 THEN 'Total' ELSE pricearea END AS pricearea, productiongroup,
  CASE WHEN GROUPING(pricearea) = 1 THEN COALESCE(SUM(quantitykwh), 0) ELSE SUM(quantitykwh) END AS tk
""" + _GSETS + """),
A AS (SELECT pricearea, SUM(tk) AS at FROM S GROUP BY 1),
SH AS (SELECT S.pricearea, S.productiongroup, CAST(S.tk AS DOUBLE) AS "Total_Kwh",
  CAST(A.at AS DOUBLE) AS area_total, CAST(S.tk AS DOUBLE) / CAST(A.at AS DOUBLE) AS share
  FROM S JOIN A ON S.pricearea = A.pricearea WHERE A.at > 0)""")


def _shares(spark: SparkSession, d: str) -> DataFrame:
    summary = A.area_group_with_total(V.production_text(spark, d), raw=True)
    return A.shares(summary, "pricearea", "Total_Kwh")


@register("share_of_area", _SHARE_SQL + "SELECT * FROM SH")
def share_of_area(spark: SparkSession, d: str) -> DataFrame:
    """AGG-07 + AGG-08 + FLT-09: each group's share of its area (and of ``Total``)."""
    return _shares(spark, d)


@register("share_label", _SHARE_SQL + """SELECT *, format('{:,.0f}', area_total) AS total_label,
  printf('%s, %.1f%%', COALESCE(productiongroup, 'unknown'), share * 100) AS label FROM SH""")
def share_label(spark: SparkSession, d: str) -> DataFrame:
    """FN-09 + FN-10: legend labels of the pie; the NULL group is labelled ``unknown``."""
    return L.share_labels(_shares(spark, d))


# ------------------------------------------------- production: hourly lines
_LOCAL_JAN = "substring(starttime, 1, 4) = '2024' AND substring(starttime, 6, 2) = '01'"


@register("hourly_all_areas", _with("PT") + f"""SELECT starttime, productiongroup,
  CAST(SUM(quantitykwh) AS DOUBLE) AS quantitykwh FROM PT WHERE {_LOCAL_JAN}
GROUP BY 1, 2 ORDER BY 1, 2""")
def hourly_all_areas(spark: SparkSession, d: str) -> DataFrame:
    """FLT-06 + AGG-03 + SRT-01: the ``Total`` line chart of the first month."""
    jan = FL.text_year_month(V.production_text(spark, d), "starttime", YEAR, MONTH)
    return A.hourly_group_totals(jan).orderBy("starttime", "productiongroup")


@register("hourly_one_area", _with("PT") + f"""SELECT {_ROW_COLS} FROM PT
WHERE {_LOCAL_JAN} AND pricearea = '{ONE_AREA}' ORDER BY starttime, event_id""")
def hourly_one_area(spark: SparkSession, d: str) -> DataFrame:
    """FLT-06 + FLT-03 + SRT-01: one area's rows of the first month in time order."""
    jan = FL.text_year_month(V.production_text(spark, d), "starttime", YEAR, MONTH)
    return _rows_double(FL.in_area(jan, ONE_AREA)).orderBy("starttime", "event_id")


@register("axis_tag", _with("PT") + f"""SELECT starttime, productiongroup,
  CAST(SUM(quantitykwh) AS DOUBLE) AS quantitykwh, {_AXIS_SQL} AS axis, {_COLOUR_SQL} AS colour
FROM PT WHERE {_LOCAL_JAN} GROUP BY 1, 2""")
def axis_tag(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-12 + PRJ-11: dual-axis line data, dominant group on the primary axis."""
    return L.with_colour(L.with_axis(hourly_all_areas(spark, d)))


@register("ordered_group_series", _with("P") + f"""SELECT starttime, productiongroup,
  CAST(SUM(quantitykwh) AS DOUBLE) AS quantitykwh, {_COLOUR_SQL} AS colour
FROM P GROUP BY 1, 2 ORDER BY productiongroup, starttime""")
def ordered_group_series(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-10 + SRT-01: hourly totals, one ordered run per group (global range sort)."""
    h = A.hourly_group_totals(V.production(spark, d))
    return R.ordered_series(L.with_colour(h), "productiongroup", "starttime")


@register("series_arrays", _with("P", extra="""H AS (SELECT productiongroup, starttime,
  CAST(SUM(quantitykwh) AS DOUBLE) AS v FROM P WHERE month(starttime) = 1 GROUP BY 1, 2)""") +
    """SELECT productiongroup, CAST(year(starttime) AS INTEGER) AS "year",
  CAST(month(starttime) AS INTEGER) AS "month", list(v ORDER BY starttime) AS "Trend over Time"
FROM H GROUP BY 1, 2, 3""")
def series_arrays(spark: SparkSession, d: str) -> DataFrame:
    """FLT-01 + PRJ-09: per group and month, the hourly totals as one ordered array.

    Totals are taken per hour first, so an array holds at most 744 values
    whatever the number of facts.
    """
    jan = FL.in_month(V.production(spark, d), "starttime", MONTH)
    h = A.hourly_group_totals(jan)
    return R.ordered_arrays(h, ["productiongroup", F.year("starttime").alias("year"),
                                F.month("starttime").alias("month")], ["starttime"], "quantitykwh")


# ------------------------------------------------ production: time and month


@register("local_january", _with("PT") + f"SELECT {_ROW_COLS} FROM PT WHERE {_LOCAL_JAN}")
def local_january(spark: SparkSession, d: str) -> DataFrame:
    """FLT-06 + FN-05: January by the local text (S3)."""
    return _rows_double(FL.text_year_month(V.production_text(spark, d), "starttime", YEAR, MONTH))


@register("utc_january", _with("U") + f"SELECT {_ROW_COLS} FROM U WHERE month(starttime) = 1")
def utc_january(spark: SparkSession, d: str) -> DataFrame:
    """FLT-05 + FN-02 + FN-03 + FN-06: January by month name after conversion to UTC (S3)."""
    return _rows_double(FL.in_named_month(_parsed(spark, d), "starttime", "January"))


@register("utc_january_pruned", _with("U", extra="""L AS (SELECT event_id, starttime AS local_text FROM PT)""") + """SELECT
  U.event_id, pricearea, productiongroup, U.starttime, CAST(quantitykwh AS DOUBLE) AS quantitykwh,
  CAST(substring(local_text, 1, 4) AS INTEGER) AS "year", CAST(substring(local_text, 6, 2) AS INTEGER) AS "month"
FROM U JOIN L USING (event_id) WHERE month(U.starttime) = 1""")
def utc_january_pruned(spark: SparkSession, d: str) -> DataFrame:
    """FLT-05 on the month layout of the local text: neighbour months prune, the UTC month decides."""
    path = scratch_path(spark, "by-local-month")
    pt = _rows_double(V.production_text(spark, d))
    S.overwrite_partitioned(with_text_month(pt), path, ["year", "month"])
    back = spark.read.schema(with_text_month(pt).schema).parquet(path)
    return FL.in_named_month(back.withColumn("starttime", lenient_utc("starttime")), "starttime", "January",
                             partition_month="month")


@register("lenient_time_shapes", _with("P", extra="""T AS (SELECT event_id, event_id % 5 AS k,
  strftime(starttime, '%Y-%m-%d') AS day, strftime(starttime, '%H:%M') AS hm, starttime FROM P)""") + """SELECT event_id,
  CASE k WHEN 2 THEN CAST(day AS TIMESTAMP) WHEN 3 THEN starttime WHEN 4 THEN starttime - INTERVAL 2 HOUR END AS starttime
FROM T""")
def lenient_time_shapes(spark: SparkSession, d: str) -> DataFrame:
    """FN-02 on other shapes: a bare time or year is no time; a date, a zone Z and an offset are."""
    s, k = F.col("starttime"), F.col("event_id") % 5
    text = F.when(k == 0, F.date_format(s, "HH:mm")).when(k == 1, F.date_format(s, "yyyy")) \
        .when(k == 2, F.date_format(s, "yyyy-MM-dd")).when(k == 3, F.date_format(s, "yyyy-MM-dd'T'HH:mm:ss'Z'")) \
        .otherwise(F.date_format(s, "yyyy-MM-dd HH:mm:ss'+02:00'"))
    return V.production(spark, d).select("event_id", lenient_utc(text).alias("starttime"))


@register("lenient_time", _with("U") + "SELECT event_id, starttime FROM U")
def lenient_time(spark: SparkSession, d: str) -> DataFrame:
    """FN-02: offset text to naive UTC; ``bad`` becomes NULL."""
    return _parsed(spark, d).select("event_id", "starttime")


@register("strict_time", _with("P") + "SELECT event_id, starttime FROM P")
def strict_time(spark: SparkSession, d: str) -> DataFrame:
    """FN-01: well-formed text parsed strictly (malformed text would fail the job)."""
    p = V.production(spark, d)
    txt = p.select("event_id", F.date_format("starttime", "yyyy-MM-dd HH:mm:ss").alias("t"))
    return txt.select("event_id", strict_timestamp("t").alias("starttime"))


@register("groups_in_set", _with("P") + f"""SELECT {_ROW_COLS} FROM P
WHERE productiongroup IN ('view', 'click')""")
def groups_in_set(spark: SparkSession, d: str) -> DataFrame:
    """FLT-04: rows of the chosen groups."""
    return _rows_double(FL.in_groups(V.production(spark, d), SOME_GROUPS))


@register("groups_empty_set", _with("P") + f"SELECT {_ROW_COLS} FROM P")
def groups_empty_set(spark: SparkSession, d: str) -> DataFrame:
    """FLT-04: an empty choice keeps every row."""
    return _rows_double(FL.in_groups(V.production(spark, d), []))


@register("batch_counts", _with("P") + """SELECT pricearea, CAST(year(starttime) AS INTEGER) AS "year",
  CAST(month(starttime) AS INTEGER) AS "month", count(*) AS n_rows FROM P GROUP BY 1, 2, 3""")
def batch_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12: rows per (area, month) batch."""
    p = V.production(spark, d)
    return A.batch_counts(p, ["pricearea", F.year("starttime").alias("year"),
                              F.month("starttime").alias("month")])


@register("pick_list", _with("PT") + """SELECT 0 AS ord, 'Total' AS value
UNION ALL SELECT DISTINCT 1 AS ord, pricearea AS value FROM PT WHERE pricearea IS NOT NULL""")
def pick_list(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11 + SRT-02 + SET-02: ``Total`` then the sorted areas."""
    return L.pick_list(V.production_text(spark, d), "pricearea", "Total")


@register("group_pick_list", _with("PT") + """SELECT DISTINCT 1 AS ord, productiongroup AS value
FROM PT WHERE productiongroup IS NOT NULL""")
def group_pick_list(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11 + SRT-02: the sorted groups, no sentinel."""
    return L.pick_list(V.production_text(spark, d), "productiongroup", None)


@register("first_five", _with("P") + f"SELECT {_ROW_COLS} FROM P ORDER BY starttime, event_id LIMIT 5")
def first_five(spark: SparkSession, d: str) -> DataFrame:
    """SRT-03: the first five rows in (time, id) order; planned as a top-k."""
    return _rows_double(L.first_rows(V.production(spark, d), 5, ["starttime", "event_id"]))


@register("month_windows", _with("P", extra="""K AS (SELECT DISTINCT pricearea FROM P),
M AS (SELECT CAST(range AS DATE) AS window_start
      FROM range(DATE '2021-01-01', DATE '2022-01-01', INTERVAL 1 MONTH)),
X AS (SELECT pricearea, window_start,
      least(CAST(window_start + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE), DATE '2021-12-31') AS window_end
      FROM K, M)""") + """SELECT pricearea, CAST(window_start AS TIMESTAMP) AS window_start,
  CAST(window_end AS TIMESTAMP) AS window_end,
  strftime(window_start, '%Y-%m-%d') || 'T00:00:00+01:00' AS start_param,
  strftime(window_end + INTERVAL 1 DAY, '%Y-%m-%d') || 'T00:00:00+01:00' AS end_param,
  url_encode(strftime(window_start, '%Y-%m-%d') || 'T00:00:00+01:00') AS start_encoded,
  url_encode(strftime(window_end + INTERVAL 1 DAY, '%Y-%m-%d') || 'T00:00:00+01:00') AS end_encoded
FROM X""")
def month_windows_2021(spark: SparkSession, d: str) -> DataFrame:
    """GEN-01 + JN-01 + FN-12..FN-14: monthly request windows of 2021 for every area present."""
    w = month_windows(V.production(spark, d), "pricearea", "2021-01-01", "2021-12-31")
    return _dates_as_midnight(w, "window_start", "window_end")


# ------------------------------------------------------------- ingest path
_FLAT_SQL = _with("R") + """SELECT "priceArea", "productionGroup", "startTime", "endTime",
  "lastUpdatedTime", "quantityKwh" FROM R"""


@register("flatten_nested", _FLAT_SQL)
def flatten_nested(spark: SparkSession, d: str) -> DataFrame:
    """SRC-03 + FN-16 + PRJ-04 + PRJ-05: parse API records from JSON text and flatten them."""
    n = V.nested(spark, d)
    recs = n.select(F.from_json("payload", PAYLOAD_RECORD, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return I.flatten_hourly(recs)


@register("typed_records", _FLAT_SQL)
def typed_records(spark: SparkSession, d: str) -> DataFrame:
    """SRC-04: the declared production schema applied to every record (NULLs fail)."""
    return SRC.apply_schema(V.production_records(spark, d), PRODUCTION)


@register("curated_columns", _with("R") + """SELECT "priceArea" AS pricearea,
  "productionGroup" AS productiongroup, "startTime" AS starttime, "quantityKwh" AS quantitykwh FROM R""")
def curated_columns(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-02 + PRJ-01: lower-case every name, keep the four curated columns."""
    low = I.lower_case_columns(V.production_records(spark, d).drop("event_id"))
    return R.keep_columns(low, CURATED_COLUMNS)


@register("row_id_unique", """SELECT count(*) AS n_rows, count(*) AS n_keys, true AS "unique"
FROM events""")
def row_id_unique(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-03 + FN-15 + SNK-05 key check: the 64-bit ids are unique."""
    return S.key_is_unique(I.with_row_id(V.production(spark, d)), "ind")


@register("row_id_across_loads", """SELECT 2 * count(*) AS n_rows, 2 * count(*) AS n_keys, true AS "unique"
FROM events""")
def row_id_across_loads(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-03 + SNK-05: two appends to one table; the key check runs on what is stored."""
    base = scratch_path(spark, "loads")
    S.create_namespace(spark, "wattline_store", f"{base}/db")
    name = "wattline_store.loads_" + base.rsplit("-", 1)[-1]
    S.recreate_table(spark, name, STORED_TABLE_DDL, f"{base}/loads")
    recs = I.lower_case_columns(V.production_records(spark, d).drop("event_id"))
    for _ in range(2):
        S.append_table(I.with_row_id(recs, above=I.largest_id(read_table(spark, name))), name)
    return S.key_is_unique(read_table(spark, name), "ind")


def _load_table(spark: SparkSession, ddl: str) -> tuple[str, str]:
    base = scratch_path(spark, "published")
    S.create_namespace(spark, "wattline_store", f"{base}/db")
    name = "wattline_store.published_" + base.rsplit("-", 1)[-1]
    LD.create_load_table(spark, name, ddl, base, ["pricearea", "productiongroup"], "quantitykwh")
    return name, base


@register("published_loads", """SELECT CASE event_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS "load", count(*) AS n_rows,
  count(*) AS n_ids, CASE event_id % 2 WHEN 0 THEN 0 ELSE (SELECT count(*) FROM events) END AS low,
  CASE event_id % 2 WHEN 0 THEN 0 ELSE (SELECT count(*) FROM events) END + count(*) - 1 AS high FROM events GROUP BY event_id % 2""")
def published_loads(spark: SparkSession, d: str) -> DataFrame:
    """SNK-02/05/06 + PRJ-03: two loads and, between them, one whose ids clash.

    The clashing load is refused before anything of it can be seen, and the
    range reserved for it stays unused.
    """
    recs = I.lower_case_columns(V.production_records(spark, d))
    name, base = _load_table(spark, STORED_TABLE_DDL)

    def publish(load: str, df: DataFrame) -> None:
        LD.publish_load(spark, df.drop("event_id"), name, load, base, ["pricearea", "productiongroup"], "quantitykwh")
    odd = recs.filter("event_id % 2 = 1")
    publish("even", recs.filter("event_id % 2 = 0"))
    with contextlib.suppress(LD.LoadError):
        publish("odd", odd.withColumn("ind", F.col("event_id").cast("long")))
    publish("odd", odd)
    return read_table(spark, name).groupBy("load").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ind").alias("n_ids"), F.min("ind").alias("low"), F.max("ind").alias("high"))


@register("summary_by_loads", ORACLE["area_group_with_total"])
def summary_by_loads(spark: SparkSession, d: str) -> DataFrame:
    """CCH-01 + AGG-01/02: the summary from stored sums of three loads, one of them applied twice; no fact is read again."""
    facts = V.production_text(spark, d)
    name, base = _load_table(spark, "ind BIGINT, pricearea STRING, productiongroup STRING, starttime STRING, quantitykwh DECIMAL(18,2)")
    for k in (0, 1, 2, 1):
        LD.publish_load(spark, facts.filter(F.col("event_id") % 3 == k).drop("event_id"), name, f"part {k}", base,
                        ["pricearea", "productiongroup"], "quantitykwh")
    return A.area_group_with_total(LD.load_sums(spark, name))


@register("landed_list", _FLAT_SQL)
def landed_list(spark: SparkSession, d: str) -> DataFrame:
    """SRC-03: bare lists of records, one list per landed line, flattened like envelopes."""
    land = scratch_path(spark, "landed-list")
    recs = V.nested_records(spark, d).select(F.array(F.struct("priceArea", "attributes")).alias("list"))
    recs.select(F.to_json("list").alias("value")).write.text(land)
    files = SRC.read_landed_payloads(spark, land, multi_line=False)
    return I.flatten_hourly(files)


@register("landed_dump", _FLAT_SQL)
def landed_dump(spark: SparkSession, d: str) -> DataFrame:
    """SRC-03: indented dumps, up to 5,000 records a file, split between records and flattened like envelopes."""
    land = scratch_path(spark, "landed-dump")
    recs = V.nested_records(spark, d).groupBy(F.floor(F.col("batch") / 5000)).agg(
        F.collect_list(F.struct("priceArea", "attributes")).alias("list"))
    recs.select(F.to_json("list", {"pretty": "true"}).alias("value")).write.option("maxRecordsPerFile", 1).text(land)
    return I.flatten_hourly(SRC.read_landed_dump(spark, land))


@register("batch_union", _with("R") + """SELECT CASE WHEN event_id % 89 = 0 THEN NULL ELSE "priceArea" END AS "priceArea",
  "productionGroup", "startTime", "endTime", "lastUpdatedTime", "quantityKwh" FROM R""")
def batch_union(spark: SparkSession, d: str) -> DataFrame:
    """SNK-01 + SET-01 + PRJ-05: land per-area batches, read them back in one scan with the key stamped.

    Batches are found by listing the landing folder, so every landed batch
    is read (once) whatever its key, the NULL key's too.
    """
    path = scratch_path(spark, "batches")
    area = F.when(F.col("event_id") % 89 != 0, F.col("priceArea"))
    recs = V.production_records(spark, d).withColumn("priceArea", area).drop("event_id")
    S.land_json(recs, path, partition_by=["priceArea"])
    return SRC.read_batches(spark, path, "priceArea", recs.drop("priceArea").schema)


@register("streamed_ingest", _FLAT_SQL)
def streamed_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Streaming ingest: landed response files -> flatten -> Parquet, exactly once.

    The API records are landed as JSON lines, one response envelope per
    line, then a file stream with ``availableNow`` flattens and appends
    them; its checkpoint makes a rerun skip files already loaded.
    """
    land = scratch_path(spark, "landing")
    recs = V.nested_records(spark, d).select(F.struct("priceArea", "attributes").alias("rec"))
    S.land_json(recs.select(F.array("rec").alias("data")), land)
    out = scratch_path(spark, "flat")
    load_available(spark, land, out, scratch_path(spark, "stream-checkpoint"))
    return spark.read.parquet(out)


@register("streamed_latest", _with("R", extra="""B AS (
  SELECT "priceArea", "productionGroup", "startTime", "endTime", "lastUpdatedTime", "quantityKwh" FROM R UNION ALL
  SELECT "priceArea", "productionGroup", "startTime", "endTime", "lastUpdatedTime" || ' corrected', "quantityKwh" + 1 FROM R WHERE event_id % 3 = 0)""")
  + """SELECT *, substr("startTime", 1, 10) AS "day" FROM B
QUALIFY row_number() OVER (PARTITION BY "priceArea", "productionGroup", "startTime" ORDER BY "lastUpdatedTime" DESC, "quantityKwh" DESC) = 1""")
def streamed_latest(spark: SparkSession, d: str) -> DataFrame:
    """SET-01/S18: a load, then, by the restarted stream, corrections of a third of its rows; the latest row of a key stays."""
    land, base = scratch_path(spark, "landing"), scratch_path(spark, "latest")
    S.create_namespace(spark, "wattline_store", f"{base}/db")
    name = "wattline_store.latest_" + base.rsplit("-", 1)[-1]
    create_latest_table(spark, name, "priceArea STRING, productionGroup STRING, startTime STRING, endTime STRING, "
                        "lastUpdatedTime STRING, quantityKwh DOUBLE", f"{base}/table")
    recs = V.production_records(spark, d)
    corrected = recs.filter("event_id % 3 = 0").withColumns({
        "lastUpdatedTime": F.concat("lastUpdatedTime", F.lit(" corrected")), "quantityKwh": F.col("quantityKwh") + 1})
    for rows in (recs, corrected):
        entry = F.struct(*[c for c in recs.columns if c != "event_id"])
        record = F.struct("priceArea", F.struct(F.array(entry).alias("productionPerGroupMbaHour")).alias("attributes"))
        rows.select(F.array(record).alias("data")).write.mode("append").json(land)
        load_latest(spark, land, name, f"{base}/merges", f"{base}/checkpoint")
    return read_table(spark, name)


def _curate(spark: SparkSession, d: str) -> str:
    """Land N as response files, run the ingest chain, return the curated folder."""
    land, base = scratch_path(spark, "landing"), scratch_path(spark, "curate")
    recs = V.nested_records(spark, d).select(F.struct("priceArea", "attributes").alias("rec"))
    S.land_json(recs.select(F.array("rec").alias("data")), land)
    name = "wattline_store.stored_" + base.rsplit("-", 1)[-1]
    check = load_and_curate(spark, land, name, f"{base}/table", f"{base}/curated", multi_line=False,
                            namespace_location=f"{base}/db").first()
    if not (check["match"] and check["schema_match"]):
        raise RuntimeError(f"curated write check failed: {check}")
    return f"{base}/curated"


@register("sorted_selection", _with("PT") + f"""SELECT {_ROW_COLS} FROM PT WHERE pricearea = '{ONE_AREA}' AND productiongroup IN ('view', 'click')""")
def sorted_selection(spark: SparkSession, d: str) -> DataFrame:
    """FLT-03 + FLT-04 on a table whose files are sorted by area and group, so row groups and pages are skipped."""
    path, pt = scratch_path(spark, "sorted"), V.production_text(spark, d)
    S.overwrite_partitioned(with_text_month(pt), path, ["year", "month"], sort_by=["pricearea", "productiongroup"])
    stored = spark.read.schema(pt.schema).parquet(path).select(pt.columns)
    return _rows_double(FL.in_groups(FL.in_area(stored, ONE_AREA), SOME_GROUPS))


_CURATED_SQL = _with("R") + """SELECT "priceArea" AS pricearea, "productionGroup" AS productiongroup,
  "startTime" AS starttime, "quantityKwh" AS quantitykwh,
  CAST(substring("startTime", 1, 4) AS INTEGER) AS "year", CAST(substring("startTime", 6, 2) AS INTEGER) AS "month"
FROM R"""


@register("curate_from_landing", _CURATED_SQL)
def curate_from_landing(spark: SparkSession, d: str) -> DataFrame:
    """SURVEY 3.1: landed JSON -> flatten -> table append -> curated partitioned write, read back."""
    return spark.read.parquet(_curate(spark, d))


@register("curated_january", _CURATED_SQL + """ WHERE substring("startTime", 1, 4) = '2024'
  AND substring("startTime", 6, 2) = '01'""")
def curated_january(spark: SparkSession, d: str) -> DataFrame:
    """FLT-06 served by partition pruning on the curated collection."""
    return curated_month(spark, _curate(spark, d), YEAR, MONTH)


# ------------------------------------------------------------ sink path


@register("json_round_trip", _with("PT") + """SELECT pricearea, productiongroup, starttime,
  CAST(quantitykwh AS DOUBLE) AS quantitykwh FROM PT""")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """SNK-01 + SRC-06: write the curated collection as JSON, read it back under its schema."""
    path = scratch_path(spark, "collection")
    cur = _rows_double(V.production_text(spark, d).drop("event_id"))
    S.land_json(cur, path)
    return SRC.read_documents(spark, path, schema=cur.schema)


@register("table_append_read", _with("R") + """SELECT "priceArea" AS pricearea,
  "productionGroup" AS productiongroup, "startTime" AS starttime, "endTime" AS endtime,
  "quantityKwh" AS quantitykwh, "lastUpdatedTime" AS lastupdatedtime FROM R""")
def table_append_read(spark: SparkSession, d: str) -> DataFrame:
    """SNK-04 + SNK-05 + SNK-02 + SRC-05: namespace, typed table, append by name, scan back."""
    base = scratch_path(spark, "warehouse")
    S.create_namespace(spark, "wattline_store", f"{base}/db")
    name = "wattline_store.production_" + base.rsplit("-", 1)[-1]
    S.recreate_table(spark, name, STORED_TABLE_DDL, f"{base}/production")
    recs = I.with_row_id(I.lower_case_columns(V.production_records(spark, d).drop("event_id")))
    S.append_table(recs, name)
    return read_table(spark, name).drop("ind")


@register("csv_round_trip", _with("W") + "SELECT * FROM W")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """SRC-01 + SRC-02: the wide series as CSV with a header, read back under its schema."""
    path = scratch_path(spark, "series-csv")
    w = V.weather(spark, d)
    w.write.mode("overwrite").option("header", True).csv(path)
    with utc_zone(spark):
        return SRC.read_series_csv(spark, path, schema=w.schema)


@register("csv_with_gaps", _with("W", extra="""G AS (SELECT "time", CASE WHEN l_linenumber IN (1, 2, 3) THEN NULL
  ELSE l_tax END AS l_tax FROM (SELECT l_shipdate AS "time", l_linenumber, l_tax FROM lineitem))""") + """SELECT
  1 AS position, 'time' AS "column", 'timestamp_ntz' AS data_type, count("time") AS non_null, count(*) AS n_rows FROM G
UNION ALL SELECT 2, 'l_tax', 'double', count(l_tax), count(*) FROM G""")
def csv_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """S9 + SRC-02 + AGG-13: empty, ``NA`` and NaN fields of a CSV are missing, types inferred."""
    path = scratch_path(spark, "gaps-csv")
    line = F.col("l_linenumber")
    V.table(spark, d, "lineitem").select(
        F.col("l_shipdate").alias("time"), F.when(line == 1, "NaN").when(line == 2, "NA").when(line == 3, None)
        .otherwise(F.col("l_tax").cast("string")).alias("l_tax")).write.option("header", True).csv(path)
    with utc_zone(spark):
        return profile(SRC.read_series_csv(spark, path))


@register("group_totals_with_nan", _with("P") + """SELECT productiongroup,
  CAST(COALESCE(SUM(quantitykwh) FILTER (WHERE event_id % 7 <> 0), 0) AS DOUBLE) AS quantitykwh FROM P GROUP BY 1""")
def group_totals_with_nan(spark: SparkSession, d: str) -> DataFrame:
    """S9 + AGG-04: NaN quantities of landed documents are missing, so sums skip them."""
    path = scratch_path(spark, "nan-documents")
    p = V.production(spark, d)
    S.land_json(p.select("productiongroup", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan")))
                         .otherwise(F.col("quantitykwh").cast("double")).alias("quantitykwh")), path)
    back = SRC.read_documents(spark, path, schema="productiongroup STRING, quantitykwh DOUBLE")
    return A.group_totals(back.withColumn("quantitykwh", F.col("quantitykwh").cast("decimal(18,2)")))


@register("partitioned_overwrite", _with("W") + """SELECT CAST(year("time") AS INTEGER) AS "year",
  CAST(month("time") AS INTEGER) AS "month", count(*) AS n_rows FROM W GROUP BY 1, 2""")
def partitioned_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """SNK-03: overwrite a (year, month)-partitioned table; rows per partition read back."""
    path = scratch_path(spark, "series-parquet")
    w = V.weather(spark, d)
    S.overwrite_partitioned(w.withColumn("year", F.year("time")).withColumn("month", F.month("time")),
                            path, ["year", "month"])
    back = spark.read.parquet(path)
    return back.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n_rows"))


def _weather_by_month(spark: SparkSession, d: str) -> str:
    """W written with the SNK-03 layout (year/month partitions); returns its folder."""
    path = scratch_path(spark, "weather-by-month")
    w = V.weather(spark, d)
    S.overwrite_partitioned(w.withColumn("year", F.year("time")).withColumn("month", F.month("time")),
                            path, ["year", "month"])
    return path


@register("month_range_pruned", _with("W") + f"""SELECT *, CAST(year("time") AS INTEGER) AS "year",
  CAST(month("time") AS INTEGER) AS "month" FROM W
WHERE month("time") BETWEEN {MONTH_RANGE[0]} AND {MONTH_RANGE[1]}""")
def month_range_pruned(spark: SparkSession, d: str) -> DataFrame:
    """FLT-02 on the month-partitioned series: only the chosen months' folders are read."""
    back = spark.read.parquet(_weather_by_month(spark, d))
    return FL.in_month_range(back, "time", *MONTH_RANGE, partition_month="month")


@register("read_back_check", """SELECT count(*) AS written, count(*) AS read_back, true AS "match",
  true AS schema_match FROM lineitem""")
def read_back_check(spark: SparkSession, d: str) -> DataFrame:
    """SNK-06: rows written (observed during the write) against rows read back, as one row."""
    path = scratch_path(spark, "checked")
    w = V.weather(spark, d).withColumn("year", F.year("time"))
    written = S.overwrite_partitioned_counted(w, path, ["year"])
    return S.read_back_check(written, spark.read.parquet(path), w.schema)


# ------------------------------------------------------------ weather path


@register("month_equals", _with("W") + """SELECT * FROM W WHERE month("time") = 1""")
def month_equals(spark: SparkSession, d: str) -> DataFrame:
    """FLT-01 + FN-03: rows of January, any year."""
    return FL.in_month(V.weather(spark, d), "time", 1)


@register("month_range", _with("W") + f"""SELECT * FROM W
WHERE month("time") BETWEEN {MONTH_RANGE[0]} AND {MONTH_RANGE[1]}""")
def month_range(spark: SparkSession, d: str) -> DataFrame:
    """FLT-02: rows in a closed month range, any year."""
    return FL.in_month_range(V.weather(spark, d), "time", *MONTH_RANGE)


@register("month_bounds", _with("W") + """SELECT CAST(min(month("time")) AS INTEGER) AS first_month,
  CAST(max(month("time")) AS INTEGER) AS last_month,
  strftime(make_date(2000, CAST(min(month("time")) AS INTEGER), 1), '%B') AS first_month_name,
  strftime(make_date(2000, CAST(max(month("time")) AS INTEGER), 1), '%B') AS last_month_name FROM W""")
def month_bounds(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10 + FN-06: first and last month present."""
    b = V.weather(spark, d).agg(F.min(F.month("time")).alias("first_month"),
                                F.max(F.month("time")).alias("last_month"))
    return b.select("first_month", "last_month", month_name(F.col("first_month")).alias("first_month_name"),
                    month_name(F.col("last_month")).alias("last_month_name"))


@register("months_present", _with("W", extra="""B AS (SELECT CAST(min(month("time")) AS INTEGER) AS lo,
  CAST(max(month("time")) AS INTEGER) AS hi FROM W)""") + """SELECT CAST(m.range AS INTEGER) AS "month",
  strftime(make_date(2000, CAST(m.range AS INTEGER), 1), '%B') AS month_name
FROM B, range(B.lo, B.hi + 1) AS m""")
def months_present(spark: SparkSession, d: str) -> DataFrame:
    """SRT-05: month names from the first to the last month present, in calendar order."""
    b = month_bounds(spark, d)
    m = b.select(F.explode(F.sequence("first_month", "last_month")).alias("month"))
    return m.select("month", month_name(F.col("month")).alias("month_name")).orderBy("month")


def _minmax_sql(view: str, cols: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS metric, min({c}) AS min_value, max({c}) AS max_value FROM {view}" for c in cols)


@register("metric_min_max", _with("W") + _minmax_sql("W", V.METRICS))
def metric_min_max(spark: SparkSession, d: str) -> DataFrame:
    """AGG-09 + PRJ-06: min and max of every metric from one scan."""
    w = V.weather(spark, d)
    return NZ.column_min_max(w, NZ.metric_columns(w))


def _scaled_sql(view: str, cols: list[str], const: str) -> str:
    stats = ", ".join(f"min({c}) AS mn{i}, max({c}) AS mx{i}" for i, c in enumerate(cols))
    body = ", ".join(
        f"CASE WHEN mx{i} = mn{i} THEN {const.format(c=c, i=i)} ELSE ({c} - mn{i}) / (mx{i} - mn{i}) END AS {c}"
        for i, c in enumerate(cols))
    return stats, body


_NL_STATS, _NL_BODY = _scaled_sql("FW", V.METRICS, "{c} - mn{i}")


@register("normalized_long", _with("W", extra=f"""FW AS (SELECT * FROM W
  WHERE month("time") BETWEEN {MONTH_RANGE[0]} AND {MONTH_RANGE[1]}),
ST AS (SELECT {_NL_STATS} FROM FW),
NW AS (SELECT "time", {_NL_BODY} FROM FW, ST)""") + """SELECT "time", "Metric", "Normalized Value"
FROM NW UNPIVOT INCLUDE NULLS ("Normalized Value" FOR "Metric" IN (""" + ", ".join(V.METRICS) + "))")
def normalized_long(spark: SparkSession, d: str) -> DataFrame:
    """FLT-02 + AGG-09 + JN-02 + FN-07 + PRJ-08: scale the shown months, then wide to long."""
    w = FL.in_month_range(V.weather(spark, d), "time", *MONTH_RANGE)
    cols = NZ.metric_columns(w)
    return R.to_long(NZ.scale_min_max(w, cols, mode="keep_nulls"), ["time"], cols)


_GAP_COLS = V.METRICS + ["l_flat"]
_ZF_STATS, _ZF_BODY = _scaled_sql("WG", _GAP_COLS, "CAST(0.0 AS DOUBLE)")
_KN_STATS, _KN_BODY = _scaled_sql("WG", _GAP_COLS, "{c} - mn{i}")


@register("normalized_all_rows", _with("WG", extra=f"ST AS (SELECT {_ZF_STATS} FROM WG)") +
          f'SELECT "time", {_ZF_BODY} FROM WG, ST')
def normalized_all_rows(spark: SparkSession, d: str) -> DataFrame:
    """FN-08: notebook scaling over all rows; the constant column becomes 0 everywhere."""
    w = V.weather_with_gaps(spark, d)
    return NZ.scale_min_max(w, NZ.metric_columns(w), mode="zero_fill")


@register("normalized_keep_nulls", _with("WG", extra=f"ST AS (SELECT {_KN_STATS} FROM WG)") +
          f'SELECT "time", {_KN_BODY} FROM WG, ST')
def normalized_keep_nulls(spark: SparkSession, d: str) -> DataFrame:
    """FN-07: app scaling; the constant column gives 0 and keeps its NULLs."""
    w = V.weather_with_gaps(spark, d)
    return NZ.scale_min_max(w, NZ.metric_columns(w), mode="keep_nulls")


@register("normalized_stored_stats", ORACLE["normalized_keep_nulls"])
def normalized_stored_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG-09 + FN-07: app scaling of a stored table with the statistics that its write left; the table is read once."""
    path, stats = scratch_path(spark, "scaled"), scratch_path(spark, "scaled-stats")
    w = V.weather_with_gaps(spark, d)
    cols = NZ.metric_columns(w)
    ST.write_with_stats(w.withColumn("year", F.year("time")), path, stats, ["year"], cols)
    stored = spark.read.schema(w.schema).parquet(path).select(w.columns)
    return NZ.scale_min_max(stored, cols, mode="keep_nulls", stored=ST.stored_stats(spark, stats, cols))


@register("single_metric", _with("W") + 'SELECT "time", l_extendedprice FROM W')
def single_metric(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-07: one metric against time."""
    return R.single_metric(V.weather(spark, d), "l_extendedprice")


@register("metric_arrays", _with("W", extra="""H AS (SELECT date_trunc('hour', "time") AS h, """ + ", ".join(
    f"max({c}) AS {c}" for c in V.METRICS) + """ FROM W WHERE month("time") = 1 GROUP BY 1)""") + f"""SELECT "Metric",
  CAST(year(h) AS INTEGER) AS "year", CAST(month(h) AS INTEGER) AS "month", list(v ORDER BY h) AS "Trend over Time"
FROM H UNPIVOT INCLUDE NULLS (v FOR "Metric" IN ({", ".join(V.METRICS)})) GROUP BY 1, 2, 3""")
def metric_arrays(spark: SparkSession, d: str) -> DataFrame:
    """FLT-01 + PRJ-09 on the wide series: January per metric and year, one value per hour."""
    jan = FL.in_month(V.weather(spark, d), "time", MONTH)
    return R.metric_series(jan, NZ.metric_columns(jan))


@register("metric_chunks", _with("W", extra=f"""N AS (SELECT *, CAST(year("time") AS INTEGER) AS "year", CAST(month("time") AS INTEGER) AS "month",
  row_number() OVER (PARTITION BY year("time"), month("time") ORDER BY "time", {", ".join(f"{c} NULLS FIRST" for c in V.METRICS)}) - 1 AS p FROM W)""")
  + f"""SELECT "Metric", "year", "month", p // 4096 AS chunk, list(v ORDER BY p) AS "Trend over Time"
FROM N UNPIVOT INCLUDE NULLS (v FOR "Metric" IN ({", ".join(V.METRICS)})) GROUP BY 1, 2, 3, 4""")
def metric_chunks(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-09 on the wide series: every value per metric and month, in arrays of at most 4,096."""
    w = V.weather(spark, d)
    return R.metric_chunks(w, NZ.metric_columns(w), scratch_path(spark, "chunks"))


_PANEL_CASE = " ".join(f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate(V.METRICS))


@register("metric_panels", _with("W") + f"""SELECT "time", "Metric", "Value",
  CASE "Metric" {_PANEL_CASE} END AS panel
FROM W UNPIVOT INCLUDE NULLS ("Value" FOR "Metric" IN ({", ".join(V.METRICS)}))""")
def metric_panels(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-13: raw values in long form with one panel per metric."""
    w = V.weather(spark, d)
    return R.metric_panels(w, NZ.metric_columns(w))


@register("axis_dates", _with("W") + """SELECT DISTINCT "time", strftime("time", '%b %Y') AS month_year,
  strftime("time", '%d') AS "day", strftime("time", '%d %b %Y') AS day_month_year FROM W""")
def axis_dates(spark: SparkSession, d: str) -> DataFrame:
    """FN-11: axis texts for every distinct time."""
    t = V.weather(spark, d).select("time").distinct()
    return t.select("time", month_year_label("time").alias("month_year"), day_label("time").alias("day"),
                    day_month_year_label("time").alias("day_month_year"))


@register("window_coverage", """WITH C AS (SELECT l_returnflag,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS window_start, count(*) AS n
  FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '2002-01-01' GROUP BY 1, 2),
K AS (SELECT DISTINCT l_returnflag FROM lineitem),
M AS (SELECT CAST(range AS DATE) AS window_start
      FROM range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 MONTH))
SELECT K.l_returnflag, CAST(M.window_start AS TIMESTAMP) AS window_start,
  CAST(least(CAST(M.window_start + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE), DATE '2001-12-31') AS TIMESTAMP)
    AS window_end,
  COALESCE(C.n, 0) AS n_rows
FROM K CROSS JOIN M LEFT JOIN C ON C.l_returnflag = K.l_returnflag AND C.window_start = M.window_start""")
def window_coverage_q(spark: SparkSession, d: str) -> DataFrame:
    """GEN-01 + AGG-12: rows per (flag, month window), 0 where a window got nothing."""
    li = V.table(spark, d, "lineitem")
    cov = window_coverage(li, li.select("l_returnflag"), "l_returnflag", "l_shipdate", "1995-01-01", "2001-12-31")
    return _dates_as_midnight(cov, "window_start", "window_end")


@register("windows_tried", """WITH C AS (SELECT l_returnflag, CAST(date_trunc('month', l_shipdate) AS DATE) AS window_start, count(*) AS n
  FROM lineitem GROUP BY 1, 2),
K AS (SELECT DISTINCT l_returnflag FROM lineitem),
T AS (SELECT l_returnflag, CAST(range AS DATE) AS window_start, month(range) AS m, (month(range) + ascii(l_returnflag)) % 3 <> 0 AS one
      FROM K CROSS JOIN range(DATE '1995-01-01', DATE '1997-01-01', INTERVAL 1 MONTH))
SELECT T.l_returnflag, CAST(T.window_start AS TIMESTAMP) AS window_start,
  CASE WHEN one OR m % 2 = 0 THEN 'landed' WHEN T.l_returnflag = 'R' THEN 'refused' ELSE 'failed' END AS state,
  CASE WHEN one THEN 1 ELSE 2 END AS tries, CASE WHEN one OR m % 2 = 0 THEN COALESCE(n, 0) ELSE 0 END AS "rows"
FROM T LEFT JOIN C ON C.l_returnflag = T.l_returnflag AND C.window_start = T.window_start""")
def windows_tried(spark: SparkSession, d: str) -> DataFrame:
    """GEN-01/S14: the ledger after two rounds of requests, the second for what the first left open.

    A window's row count comes from the facts; which windows answer is a rule on month and flag.
    """
    li = V.table(spark, d, "lineitem")
    path, key, span = scratch_path(spark, "ledger"), "l_returnflag", ("1995-01-01", "1996-12-31")
    counts = window_coverage(li, li.select(key), key, "l_shipdate", *span)
    WN.create_ledger(spark, path, key)
    WN.plan_windows(spark, path, month_windows(li, key, *span), key)
    month = F.month("window_start")
    rounds = (F.when((month + F.ascii(key)) % 3 != 0, "landed").otherwise("failed"),
              F.when(month % 2 == 0, "landed").when(F.col(key) == "R", "refused").otherwise("failed"))
    for answer in rounds:
        asked = WN.to_fetch(WN.read_ledger(spark, path, key)).select(key, "window_start")
        got = counts.join(asked, [key, "window_start"], "left_semi").withColumn("state", answer)
        WN.record_tries(spark, path, got.select(key, "window_start", "state", F.col("n_rows").alias("rows")), key)
    return _dates_as_midnight(WN.read_ledger(spark, path, key), "window_start")


@register("area_coverage", _with("P", extra="""K AS (SELECT DISTINCT pricearea FROM P),
M AS (SELECT CAST(range AS DATE) AS window_start FROM range(DATE '2024-02-01', DATE '2025-02-01', INTERVAL 1 MONTH)),
C AS (SELECT pricearea, CAST(date_trunc('month', starttime) AS DATE) AS window_start, count(*) AS n
  FROM P WHERE pricearea IN ('NO1', 'NO2') AND starttime >= DATE '2024-02-01' AND starttime < DATE '2025-02-01'
  GROUP BY 1, 2)""") + """SELECT K.pricearea, CAST(M.window_start AS TIMESTAMP) AS window_start,
  CAST(M.window_start + INTERVAL 1 MONTH - INTERVAL 1 DAY AS TIMESTAMP) AS window_end, COALESCE(C.n, 0) AS n_rows
FROM K CROSS JOIN M LEFT JOIN C ON C.pricearea = K.pricearea AND C.window_start = M.window_start""")
def area_coverage(spark: SparkSession, d: str) -> DataFrame:
    """GEN-01 over the planned areas: those of which nothing arrived (or not in the range) show 0 throughout."""
    p = V.production(spark, d)
    cov = window_coverage(FL.in_groups(p, ["NO1", "NO2"], col="pricearea"), p.select("pricearea"), "pricearea",
                          "starttime", "2024-02-01", "2025-01-31")
    return _dates_as_midnight(cov, "window_start", "window_end")


def _profile_sql() -> str:
    cols = [("time", "timestamp_ntz")] + [(c, "double") for c in V.METRICS]
    return _with("W") + "\nUNION ALL ".join(
        f"""SELECT {i + 1} AS position, '{c}' AS "column", '{t}' AS data_type,
  count("{c}") AS non_null, count(*) AS n_rows FROM W""" for i, (c, t) in enumerate(cols))


@register("profile", _profile_sql())
def profile_q(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13: columns, types and non-null counts of the wide series."""
    return profile(V.weather(spark, d))
