"""wattline: Spark-native toolkit for hourly energy-production and weather series.

Every operator is a plain ``DataFrame -> DataFrame`` function built on
``pyspark.sql.functions`` so Catalyst can push filters into the scan,
prune columns and plan two-phase aggregates.  Only the functions in
``wattline.sinks`` run Spark jobs.
"""

from wattline.session import build_session, scratch_path, use_utc, utc_zone

__all__ = ["build_session", "scratch_path", "use_utc", "utc_zone"]
