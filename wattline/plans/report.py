"""Write a Markdown summary of every registered query's physical plan.

Usage: ``python -m wattline.plans.report [sf_dir] > PLANS.md``.  Queries
that write data run their writes (into the scratch folder) to build the
read-back plan.
"""

from __future__ import annotations

import sys
import tempfile

from wattline.plans.checks import plan_text, rows_read, single_partition_inputs, summary
from wattline.plans.queries import QUERIES
from wattline.session import build_session


def _operators(text: str) -> str:
    tree = text.split("\n\n")[0]
    names = []
    for line in tree.splitlines()[1:]:
        name = line.strip(" :|+-").split(" (")[0]
        if name and name not in ("AdaptiveSparkPlan",):
            names.append(name)
    return " ← ".join(names)


def main(argv: list[str]) -> int:
    """Print the Markdown plan table for every registered key."""
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    log = tempfile.mkdtemp(prefix="wattline-log-")
    spark = build_session("local[8]", shuffle_partitions=8, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.compress": "false", "spark.eventLog.dir": f"file:{log}"})
    spark.sparkContext.setLogLevel("ERROR")
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `python -m wattline.plans.report {sf_dir}`.")
    print("Columns: scans in the initial plan, rows that all tasks read from files (building and running the")
    print("query, by task metrics, subqueries and intermediate files included), shuffles (`Exchange`), what feeds each single-partition exchange (`partial` = per-task")
    print("partial aggregates), filters pushed into Parquet, operator chain of the initial plan.\n")
    print("| query | scans (plan) | rows read | exchanges | single-partition feeds | pushed filters | operators (top ← scan) |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in QUERIES.items():
        made: list = []
        read = rows_read(spark, lambda: made.append(fn(spark, sf_dir)))
        df = made[0]
        s = summary(df)
        pushed = "; ".join(sorted({p for p in s["pushed_filters"] if p})) or "—"
        feeds = ", ".join(single_partition_inputs(df)) or "—"
        ops = _operators(plan_text(df)).replace("|", "/")
        read += rows_read(spark, df.collect)
        print(f"| `{name}` | {s['scans']} | {read} | {s['exchanges']} | {feeds} | {pushed} | {ops} |")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
