"""Month request windows and a coverage spine that shows empty windows (GEN-01, JN-01, FN-12..FN-14).

The reference plans one request per (area, month) in nested loops; here
the (key x month) product is a generator: each distinct key row explodes
the month sequence, so there is no cross join and the output is
``#keys x #months`` rows, computed where the keys live.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.text import url_quote
from wattline.functions.timeops import iso_midnight, month_window_end


def _date(d: str | dt.date | Column) -> Column:
    if isinstance(d, Column):
        return d.cast("date")
    return F.lit(str(d)).cast("date")


def _start(start: str | dt.date | Column) -> Column:
    """The range's first day as a date.

    S20: a month step from the 29th to 31st drifts; only days 1 to 28 are
    exact.  A literal is checked here, a column row by row.
    """
    message = "month windows need a range starting on day 1..28"
    if not isinstance(start, Column):
        if dt.date.fromisoformat(str(start)).day > 28:
            raise ValueError(message)
        return _date(start)
    d = _date(start)
    return F.when(F.dayofmonth(d) > 28, F.raise_error(F.lit(message)).cast("date")).otherwise(d)


def month_windows(keys: DataFrame, key: str, start, end) -> DataFrame:
    """GEN-01: one row per (key, month window) over ``[start, end]``.

    Columns: key, ``window_start``, ``window_end`` (clipped to ``end``),
    ``start_param`` / ``end_param`` (midnight, +01:00, end is the next
    midnight) and their percent-encoded forms.
    """
    s, e = _start(start), _date(end)
    months = F.when(s <= e, F.sequence(s, e, F.expr("INTERVAL 1 MONTH"))) \
        .otherwise(F.array().cast("array<date>"))
    w = (keys.select(key).distinct()
         .select(key, F.explode(months).alias("window_start"))
         .withColumn("window_end", month_window_end(F.col("window_start"), e)))
    return (w.withColumn("start_param", iso_midnight(F.col("window_start")))
             .withColumn("end_param", iso_midnight(F.date_add(F.col("window_end"), 1)))
             .withColumn("start_encoded", url_quote(F.col("start_param")))
             .withColumn("end_encoded", url_quote(F.col("end_param"))))


def window_of(t: Column, start) -> Column:
    """Start of the month window (anchored at ``start``'s day) that holds ``t``."""
    s = _date(start)
    d = t.cast("date")
    n = ((F.year(d) - F.year(s)) * 12 + F.month(d) - F.month(s)
         - F.when(F.dayofmonth(d) < F.dayofmonth(s), 1).otherwise(0))
    return F.add_months(s, n)


def window_coverage(facts: DataFrame, keys: DataFrame, key: str, time_col: str, start, end) -> DataFrame:
    """GEN-01 + AGG-12: rows per (key, month window) for every key of ``keys``, with 0 for empty windows.

    ``keys`` is given (the areas a load was planned for), so a key of which
    nothing arrived shows every window with 0; facts of other keys are left
    out.  A NULL key is a key.  No join and no per-key collection: the
    generated (key, window) rows carry 0, the facts in range 1, and one
    two-phase aggregate sums both.  The range test is on the bare time
    column, so it is pushed to the scan.
    """
    s, e = _start(start), _date(end)
    t = F.col(time_col)
    spine = month_windows(keys, key, start, end).select(
        key, "window_start", F.lit(0).cast("long").alias("n"), F.lit(1).alias("planned"))
    seen = facts.filter((t >= s.cast("timestamp_ntz")) & (t < F.date_add(e, 1).cast("timestamp_ntz"))) \
        .select(key, window_of(t, start).alias("window_start"), F.lit(1).cast("long").alias("n"), F.lit(0).alias("planned"))
    return (spine.unionByName(seen).groupBy(key, "window_start")
            .agg(F.sum("n").alias("n_rows"), F.max("planned").alias("planned")).filter("planned = 1")
            .select(key, "window_start", month_window_end(F.col("window_start"), e).alias("window_end"), "n_rows"))
