"""Development tools: event-log summary."""

import json

import zstandard

from wattline.plans.eventlog import summarise

EVENTS = [
    {"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", "executionId": 0,
     "time": 1000, "description": "save at x"},
    {"Event": "SparkListenerJobStart", "Job ID": 0, "Stage IDs": [0, 1],
     "Properties": {"spark.sql.execution.id": "0"}},
    {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 0, "Number of Tasks": 4,
                                                            "Submission Time": 1100, "Completion Time": 1400}},
    {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 1, "Number of Tasks": 2,
                                                            "Submission Time": 1400, "Completion Time": 1450}},
    {"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionEnd", "executionId": 0, "time": 1500},
]


def _check(rows):
    assert rows == [{"id": 0, "description": "save at x", "ms": 500, "jobs": 1, "stages": 2, "tasks": 6,
                     "slowest_stage_ms": 300}]


def test_summarise_plain_log(tmp_path):
    p = tmp_path / "events_1_app"
    p.write_text("\n".join(json.dumps(e) for e in EVENTS) + "\n")
    _check(summarise(str(p)))


def test_summarise_compressed_rolling_folder(tmp_path):
    d = tmp_path / "eventlog_v2_app"
    d.mkdir()
    raw = ("\n".join(json.dumps(e) for e in EVENTS) + "\n").encode()
    (d / "events_1_app.zstd").write_bytes(zstandard.ZstdCompressor().compress(raw))
    _check(summarise(str(tmp_path)))
