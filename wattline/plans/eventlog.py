"""Summarise a Spark event log: per SQL execution, its jobs, stages and time.

Usage: ``python -m wattline.plans.eventlog <event-log-dir-or-file>``.  Reads
plain or zstd-compressed logs (``spark.eventLog.compress``), including the
rolling ``eventlog_v2_*`` folders.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path: str):
    files = sorted(glob.glob(os.path.join(path, "**", "events_*"), recursive=True)) if os.path.isdir(path) else [path]
    for f in files:
        with open(f, "rb") as fh:
            if f.endswith(".zstd"):
                import zstandard
                stream = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
            else:
                stream = io.TextIOWrapper(fh, encoding="utf-8")
            for line in stream:
                if line.strip():
                    yield json.loads(line)


def input_records(path: str, application: str) -> int:
    """Rows read from files by all finished tasks of an application, as logged so far under ``path``."""
    root = path.removeprefix("file:")
    files = [f for f in glob.glob(os.path.join(root, "**", f"*{application}*"), recursive=True) if os.path.isfile(f)]
    total = 0
    for f in files:
        with open(f, encoding="utf-8") as log:
            for line in log:
                if line.startswith('{"Event":"SparkListenerTaskEnd"') and line.endswith("\n"):
                    total += (json.loads(line).get("Task Metrics") or {}).get("Input Metrics", {}).get("Records Read", 0)
    return total


def summarise(path: str) -> list[dict]:
    """One dict per SQL execution: wall time, jobs, stages, tasks, slowest stage."""
    sql: dict[int, dict] = {}
    job_sql: dict[int, int] = {}
    stages: dict[int, dict] = {}
    for e in _lines(path):
        kind = e["Event"]
        if kind.endswith("SQLExecutionStart"):
            sql[e["executionId"]] = {"id": e["executionId"], "description": e.get("description", "")[:60],
                                     "start": e["time"], "jobs": 0, "stages": [], "tasks": 0}
        elif kind.endswith("SQLExecutionEnd") and e["executionId"] in sql:
            sql[e["executionId"]]["ms"] = e["time"] - sql[e["executionId"]]["start"]
        elif kind == "SparkListenerJobStart":
            eid = int((e.get("Properties") or {}).get("spark.sql.execution.id", -1))
            job_sql[e["Job ID"]] = eid
            if eid in sql:
                sql[eid]["jobs"] += 1
                sql[eid]["stages"] += e["Stage IDs"]
        elif kind == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = {"tasks": si["Number of Tasks"],
                                      "ms": si.get("Completion Time", 0) - si.get("Submission Time", 0)}
    out = []
    for s in sql.values():
        done = [stages[i] for i in s["stages"] if i in stages]
        out.append({"id": s["id"], "description": s["description"], "ms": s.get("ms"), "jobs": s["jobs"],
                    "stages": len(done), "tasks": sum(d["tasks"] for d in done),
                    "slowest_stage_ms": max((d["ms"] for d in done), default=0)})
    return out


def main(argv: list[str]) -> int:
    """Print the summary as one JSON line per SQL execution."""
    for row in summarise(argv[1]):
        print(json.dumps(row))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
