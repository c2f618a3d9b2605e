"""Scans that count what they skip, ties by place in the file, and exports that are read back."""

from __future__ import annotations

import glob
import json

import pytest
from pyspark.sql import functions as F

from meterlark.sources import logs, scan, sinks

GOOD = {"source": "a", "model": "m", "hour_start": "2026-04-20T12:00:00.000Z", "device_id": "d", "total_tokens": 5}


def test_scan_counts_and_odd_fields(spark, tmp_path):
    rows = [GOOD, GOOD | {"total_tokens": "7"}, GOOD | {"total_tokens": 2.5e3, "input_tokens": "x"}, GOOD | {"hour_start": 5, "source": {"a": 1}}, GOOD | {"total_tokens": None, "more": [1]}, {}]
    bad = ['{"source": "b", "total', "no json", '"text"', "\t  "]
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(r) for r in rows] + bad) + "\r\n")
    (tmp_path / "b.jsonl").write_text("")
    scanned = logs.scan_usage(spark, str(tmp_path))
    c = {r.file.rsplit("/", 1)[1]: (r.lines, r.malformed, r.first_malformed) for r in scan.counts(scanned).collect()}
    assert c == {"a.jsonl": (9, 3, bad[0])}
    got = [(r.source, r.total_tokens, r.input_tokens, r.hour_start is None) for r in logs.read_usage(spark, str(tmp_path)).collect()]
    assert got == [("a", 5, None, False), ("a", 7, None, False), ("a", 2500, None, False), ('{"a":1}', 5, None, True), ("a", None, None, False), (None, None, None, True)]
    assert logs.scan_usage(spark, str(tmp_path / "none")).count() == 0


def test_equal_snapshots_first_in_the_file_wins(spark, tmp_path):
    """Also where it has more messages, and where the file is split over tasks."""
    s = {"session_key": "k", "snapshot_at": "2026-04-20T12:00:00.000Z", "total_messages": 9}
    lines = [s | {"snapshot_at": "2026-04-20T11:00:00.000Z"}, s, s | {"total_messages": 1}, {"source": "no key"}, s | {"session_key": "old", "snapshot_at": None}]
    lines += [s | {"session_key": "many", "total_messages": i, "project_ref": "p" * 500} for i in range(3000)]
    (tmp_path / "s.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        read = logs.read_session_snapshots(spark, str(tmp_path / "s.jsonl"), position=True)
        assert read.rdd.getNumPartitions() > 3
        latest = logs.latest_sessions(read)
        assert {r.session_key: r.total_messages for r in latest.collect()} == {"k": 9, "old": 9, "many": 0}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    plan = latest._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "_position" not in latest.columns


def test_runs_by_file_and_by_line(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"run-{i}.json").write_text(json.dumps({"runId": f"r{i}", "status": "succeeded"}, indent=2) if i != 3 else "{broken")
    assert [r.name for r in logs.read_runs(spark, str(tmp_path), limit=2).collect()] == ["run-4.json", "run-2.json"]
    assert logs.read_runs(spark, str(tmp_path), since="run-1.json").count() == 3
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "all.jsonl").write_text('{"runId": "b"}\n{"runId": ""}\n{"runId": "a"}\n{\n')
    assert {r.name for r in logs.read_runs(spark, str(tmp_path / "lines"), lines=True).collect()} == {"a", "b"}


@pytest.mark.parametrize("kind", ["csv", "ndjson"])
def test_exports_come_back(spark, tmp_path, kind):
    rows = [("a,b", 'say "hi"', 1, 0.1), ("two\nlines", "\\", None, 1e-9), (None, " padded ", -5, 12345678.123456789), ("é", "x", 2**62, None)]
    df = spark.createDataFrame(rows, "source string, model string, n long, usd double")
    back = sinks.export(df, f"{tmp_path}/{kind}", kind)
    assert back.columns == df.columns and sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert sinks.export(df.where("false"), f"{tmp_path}/{kind}-none", kind).count() == 0


def test_files_are_bounded_and_parted(spark, tmp_path):
    df = spark.range(1000).select(F.concat(F.lit("s"), F.col("id") % 3).alias("source"), "id")
    back = sinks.export(df, f"{tmp_path}/p", "ndjson", by="source", most_rows=50)
    files = glob.glob(f"{tmp_path}/p/source=*/*.json")
    assert back.columns == ["source", "id"] and back.count() == 1000
    assert len(files) >= 20 and max(sum(1 for _ in open(f)) for f in files) <= 50


def test_damage_is_told(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "source string, n long")
    sinks.write(df, f"{tmp_path}/x", "csv")
    with pytest.raises(ValueError, match="format"):
        sinks.write(df, f"{tmp_path}/y", "xml")
    # Rows that were there before are rows that differ.
    with pytest.raises(ValueError, match="differ"):
        sinks.export(df, f"{tmp_path}/x", "csv", mode="append")
