"""Session helpers: building a session and finding the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


# Settings for a large cluster reading ~100 TB of Parquet.  Most shuffles
# here carry per-task partial aggregates, so they are small; the settings
# matter for the row-level sorts, the nested-view build and the writes.
CLUSTER_CONF = {
    # ~256 MB scan splits: fewer, fuller tasks for a 100 TB scan (~400k tasks).
    "spark.sql.files.maxPartitionBytes": "256m",
    # Start wide and let AQE merge shuffle partitions up to ~256 MB each.
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    # A key holding a large share of the rows is split at run time.
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Retry a lost executor's tasks rather than failing the job.
    "spark.task.maxFailures": "8",
    "spark.stage.maxConsecutiveAttempts": "8",
}


def build_session(master: str = "local[*]", app: str = "wattline",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None, cluster: bool = False) -> SparkSession:
    """Session with AQE on, UTC session time and no UI.

    ``cluster=True`` applies ``CLUSTER_CONF``.  ``shuffle_partitions``
    should be sized so one shuffle partition holds roughly 128-256 MB at the
    target scale; AQE coalesces small ones.
    """
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true"))
    for k, v in (CLUSTER_CONF if cluster else {}).items():
        b = b.config(k, v)
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Offset text is parsed to an instant and shown as naive UTC (FN-02)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


_ZONE_LOCK = threading.RLock()


@contextmanager
def utc_zone(spark: SparkSession) -> Iterator[None]:
    """Build DataFrames under the UTC session zone, then restore the caller's zone.

    The zone is bound to each expression when the DataFrame is analysed
    (at creation, in classic PySpark), so a DataFrame built inside the
    block keeps UTC semantics after the block ends.
    """
    key = "spark.sql.session.timeZone"
    with _ZONE_LOCK:  # threads building queries on one session take turns
        before = spark.conf.get(key)
        spark.conf.set(key, "UTC")
        try:
            yield
        finally:
            spark.conf.set(key, before)


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written tables: the cluster's ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests) gets a fresh
    temporary folder; on a cluster a missing setting is an error, since a
    machine-local folder is not visible to other executors.
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not _is_local(spark):
        raise RuntimeError(f"{_CHECKPOINT_KEY} must name a shared folder on a cluster")
    root = tempfile.mkdtemp(prefix="wattline-")
    spark.conf.set(_CHECKPOINT_KEY, root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared scratch folder."""
    return f"{_own_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _own_root(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/wattline/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote under the scratch folder; results read from there end with it."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(_own_root(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)
