"""Plan inspection helpers: what reaches the scan, which shuffles run.

Used by tests to keep plans honest: filters pushed into Parquet, only the
needed columns read, no single-partition exchange over fact rows and no
Python evaluation in the hot path.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattline.plans.eventlog import input_records


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The ``explain`` text of ``df`` as a string (same modes as ``DataFrame.explain``)."""
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def summary(df: DataFrame) -> dict:
    """Counts of plan nodes of interest in the physical plan (before AQE re-planning)."""
    t = plan_text(df)
    tree = t.split("\n\n")[0]
    return {
        "scans": len(re.findall(r"Scan parquet", tree)),
        "exchanges": len(re.findall(r"\bExchange\b", tree)),
        "single_partition": t.count("SinglePartition"),
        "broadcast": t.count("BroadcastExchange"),
        "cartesian": t.count("CartesianProduct") + t.count("BroadcastNestedLoopJoin"),
        "python": t.count("BatchEvalPython") + t.count("ArrowEvalPython") + t.count("FlatMapGroupsInPandas"),
        "pushed_filters": re.findall(r"PushedFilters: \[(.*?)\]", t),
        "read_schema": re.findall(r"ReadSchema: (struct<.*?>)", t),
    }


_NODE = re.compile(r"^(?P<pad>[\s:|+-]*)(?P<name>\w+) \((?P<id>\d+)\)\s*$")


def _tree(text: str) -> list[tuple[int, str, int]]:
    """(depth, node name, node id) for every node line of the formatted plan trees."""
    out = []
    for line in text.splitlines():
        m = _NODE.match(line)
        if m:
            out.append((len(m.group("pad")), m.group("name"), int(m.group("id"))))
    return out


def _sections(text: str) -> dict[int, str]:
    parts = re.split(r"\n\((\d+)\) ", text)
    return {int(parts[i]): parts[i + 1] for i in range(1, len(parts) - 1, 2)}


def single_partition_inputs(df: DataFrame) -> list[str]:
    """What feeds each single-partition exchange: one entry per such exchange.

    ``partial`` means per-task partial aggregates (a handful of rows per
    task), which is the only acceptable feed; anything else would move
    fact rows into one task.
    """
    text = plan_text(df)
    nodes, secs = _tree(text), _sections(text)
    out = []
    for i, (depth, name, nid) in enumerate(nodes):
        if name != "Exchange" or "SinglePartition" not in secs.get(nid, ""):
            continue
        child = nodes[i + 1] if i + 1 < len(nodes) and nodes[i + 1][0] > depth else None
        if child and child[1] in ("HashAggregate", "ObjectHashAggregate", "SortAggregate") \
                and "partial_" in secs.get(child[2], ""):
            out.append("partial")
        else:
            out.append(child[1] if child else "?")
    return out


_STAGES = ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "TableCacheQueryStageExec", "ResultQueryStageExec")


def rows_read(spark: SparkSession, run: Callable[[], object]) -> int:
    """Rows that all tasks started by ``run`` read from files, by the tasks' own metrics.

    Counted from the session's event log, so subqueries, broadcasts and
    branches that adaptive execution later drops from the plan all count.
    The session must have been started with an uncompressed event log; other
    work must not run on it meanwhile.
    """
    bus = spark.sparkContext._jsc.sc().listenerBus()
    log = spark.conf.get("spark.eventLog.dir")

    def total() -> int:
        bus.waitUntilEmpty(30_000)
        return input_records(log, spark.sparkContext.applicationId)
    before = total()
    run()
    return total() - before


def shuffle_records_written(df: DataFrame) -> int:
    """Records written by all shuffles of an executed DataFrame (from the SQL metrics)."""
    def walk(node) -> int:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name in _STAGES:
            return walk(node.plan())
        n = 0
        if name == "ShuffleExchangeExec":
            m = node.metrics()
            if m.contains("shuffleRecordsWritten"):
                n += int(m.apply("shuffleRecordsWritten").value())
        ch = node.children()
        return n + sum(walk(ch.apply(i)) for i in range(ch.size()))
    return walk(df._jdf.queryExecution().executedPlan())
