"""Sources, configuration and streaming."""

import io
import json
import zipfile

import pytest

from tidemark.operators import sessions
from tidemark.sources import config, documents, envelopes
from tidemark.streaming import stateful


def test_envelopes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"type": "batch", "source": "ext", "events": [{"type": "ui_text", "app": "Mail", "text": "hi"}, {"type": "form_fill", "profile_key": "email"}, {"type": "odd"}]}))
    rows = envelopes.read(spark, str(tmp_path))
    good, bad = envelopes.convert(rows, "browser")
    got = {r["event_type"]: (r["source_app"], r["metadata"]) for r in good.collect()}
    assert got["ui_tree_delta"] == ("Mail", {"ui_text": "hi"}) and got["form_fill"] == ("ext", {"field_id": "", "profile_key": "email", "required": "false", "value_filled": "true", "is_trap": "false"})
    assert [(r["position"], r["error"]) for r in bad.collect()] == [(2, "unknown event type: odd")]
    with pytest.raises(Exception, match="unknown event type"):
        envelopes.convert_strict(rows, "browser").collect()


def test_snapshots(spark):
    d = spark.createDataFrame([("1", 5, "android", "App", [(1, 0, "text", " Pay ", None, False, None), (2, 0, "edit", None, "x@y.z", True, "Email")])], f"event_id string, timestamp_ms long, platform string, source_app string, nodes {envelopes.NODES}")
    assert envelopes.snapshot_events(d).first()["metadata"]["ui_text"] == "Pay"
    assert envelopes.snapshot_form_fills(d).first()["metadata"] == {"profile_key": "email", "required": "false", "is_trap": "false", "value_filled": "true"}


def test_config(spark, tmp_path):
    p = tmp_path / "rules.yaml"
    p.write_text("rules:\n- {id: A, name: a, severity: low, action: alert, match_any_text: [x]}\n")
    assert config.rules_frame(spark, config.load_rules(str(p))).first()["match_any_text"] == ["x"]
    p.write_text("rules:\n- {id: A, name: a, severity: odd, action: alert}\n")
    with pytest.raises(ValueError, match="unknown severity"):
        config.load_rules(str(p))
    p.write_text("plans:\n- {task_profile: t, goal: g, allow: [a], order: [b]}\n")
    with pytest.raises(ValueError, match="aren't allowed"):
        config.load_plans(str(p))
    t = tmp_path / "trace.jsonl"
    t.write_text('{"ts": 1, "kind": "session_start"}\nnot json\n\n')
    lines, bad = config.read_trace(spark, str(t))
    assert lines.count() == 1 and [r["value"] for r in bad.collect()] == ["not json"]
    s = tmp_path / "b.json"
    s.write_text(json.dumps({"type": "bundle", "id": "bundle--1", "objects": [{"type": "tool", "id": "tool--1", "spec_version": "2.1"}, {"type": "relationship", "id": "relationship--1", "spec_version": "2.1", "source_ref": "tool--1", "target_ref": "tool--2"}]}))
    assert [tuple(r) for r in config.check_stix(config.read_stix(spark, str(s))).collect()] == [("relationship--1", "tool--2", "dangling")]


def test_office(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:t>Hello</w:t></w:p><w:p><w:t xml:space='preserve'> a &amp; b</w:t></w:p></w:document>")
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    got = {r["path"][-6:]: r["t"] for r in documents.read_files(spark, str(tmp_path)).select("path", documents.office_text("path", "content").alias("t")).collect()}
    assert got["a.docx"]["text"] == "Hello\n a & b" and got["b.docx"]["error"] == "BadZipFile"


def test_streaming_throttle_agrees_with_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, t) for k in "ab" for t in range(0, 100_000, 7_000)], "key string, timestamp_ms long")
    rows.repartition(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).json(str(tmp_path / "in"))
    stateful.run_once(stateful.throttle(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in sessions.throttle(rows, ["key"]).select("key", "timestamp_ms", "emit", "repeats").collect()}


def test_streaming_without_replays(spark, tmp_path):
    spark.sql("select 1 as k, timestamp'2024-01-01' as ts union all select 1, timestamp'2024-01-01 00:01' union all select 2, timestamp'2024-01-01'").repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / "in"))
    stateful.run_once(stateful.without_replays(stream, ["k"]), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
