"""Streams over files, run to their end."""

from __future__ import annotations

import json

from meterlark.streaming import logs as streams


def _write(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def _usage(hour, tokens):
    return {"source": "a", "model": "gpt-5.4", "hour_start": f"2026-04-20T{hour:02d}:00:00.000Z", "device_id": "d", "total_tokens": tokens}


def test_hours_close_behind_the_watermark(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _write(tmp_path / "in/1.json", [_usage(1, 5), _usage(1, 6), _usage(2, 1)])
    hourly = streams.usage_hourly(streams.stream_usage(spark, str(tmp_path / "in")))

    def run():
        q = hourly.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    _write(tmp_path / "in/2.json", [_usage(8, 3)])
    run()
    _write(tmp_path / "in/3.json", [_usage(1, 100), _usage(12, 1)])  # hour 1 is closed
    run()
    rows = {r.hour.hour: r.tokens for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows[1] == 11 and rows[2] == 1 and 12 not in rows


def test_latest_snapshot_wins(spark, tmp_path):
    (tmp_path / "in").mkdir()
    base = {"session_key": "k", "source": "a", "started_at": "2026-04-20T01:00:00.000Z", "last_message_at": "2026-04-20T01:00:00.000Z", "model": "m"}
    _write(tmp_path / "in/1.json", [base | {"snapshot_at": "2026-04-20T01:00:00.000Z", "total_messages": 1}, base | {"snapshot_at": "2026-04-20T03:00:00.000Z", "total_messages": 3}])
    kept = {}

    def read(s):
        return s.createDataFrame(kept["rows"], kept["schema"]) if kept else None

    def write(df):
        kept.update(rows=df.collect(), schema=df.schema)

    def run():
        streams.latest_sessions_sink(streams.stream_session_snapshots(spark, str(tmp_path / "in")), read, write, str(tmp_path / "cp"), availableNow=True).awaitTermination()

    run()
    _write(tmp_path / "in/2.json", [base | {"snapshot_at": "2026-04-20T02:00:00.000Z", "total_messages": 2}])
    run()
    assert [r.total_messages for r in kept["rows"]] == [3]


def test_alerts_after_each_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    days = [(d, 10 + d % 2) for d in range(1, 15)] + [(15, 500)]
    _write(tmp_path / "in/1.json", [_usage(1, t) | {"hour_start": f"2026-04-{d:02d}T01:00:00.000Z"} for d, t in days])
    from meterlark.sources.logs import read_usage

    seen = []
    q = streams.anomaly_alerts(streams.stream_usage(spark, str(tmp_path / "in")), lambda s: read_usage(s, str(tmp_path / "in")), lambda: 20558, lambda df: seen.extend(df.collect()), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination()
    assert "2026-04-15" in [r.day for r in seen if r.status == "high"]
