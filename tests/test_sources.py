import hashlib
import json
import os
import sqlite3

import pytest

from ledgerspark.operators import records
from ledgerspark.operators.preview import command_preview, redact, verify
from ledgerspark.sources import inventory, jsonl, sqlite
from ledgerspark.streaming import worker


def line(kind, second=0, **payload):
    return json.dumps({"timestamp": f"2026-09-01T12:00:{second:02d}.000Z", "type": kind, "payload": payload}) + "\n"


def read(spark, path, **options):
    jsonl.register(spark)
    return sorted(spark.read.format("agent_jsonl").options(path=str(path), **options).load().collect(), key=lambda r: r.byte_start)


def test_frames_and_bad_records(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    good = line("turn_context", model="m")
    f.write_bytes(good.encode() + b"bad json\n" + b"null\n" + b'{"a":"' + b"x" * 400 + b'"}\n' + "é\n".encode()[:1] + b"\n" + good.encode()[:-1])
    got = read(spark, f, maxRecordBytes="256")
    assert [r.error for r in got] == [None, "malformed_record", "malformed_record", "oversized_record", "malformed_record"]
    assert got[0].digest == hashlib.sha256(good.encode()).hexdigest() and [r.ordinal for r in got] == [1, 2, 3, 4, 5]
    assert got[1].byte_start == len(good)
    assert len(read(spark, f, maxRecordBytes="256", finalizedPaths=str(f))) == 6


def test_change_ladder(tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text("a" * 9000 + "\n" + "b\n" + "open")
    mark = jsonl.advance(str(f), None, True)
    assert mark["offset"] == 9003 and mark["pending"] == 4 and mark["ordinal"] == 2
    assert jsonl.change(str(f), mark, True) is None
    body = f.read_text()
    f.write_text(body + "more\n")
    assert jsonl.advance(str(f), mark)["ordinal"] == 3
    f.write_text("X" + body[1:])
    assert jsonl.change(str(f), mark) == "prefix_rewrite"
    f.write_text(body[:8000] + "X" + body[8001:])
    assert jsonl.change(str(f), mark) == "checkpoint_rewrite"
    f.write_text(body[:4500] + "X" + body[4501:])
    assert jsonl.change(str(f), mark) is None and jsonl.change(str(f), mark, True) == "content_rewrite"
    f.write_text("a")
    assert jsonl.change(str(f), mark) == "truncation"
    (tmp_path / "b").write_text(body)
    os.replace(tmp_path / "b", f)
    assert jsonl.change(str(f), mark) == "replacement" and jsonl.advance(str(f), mark)["generation"] == 2


def test_normalize_families(spark, tmp_path):
    total = {"input_tokens": 5, "output_tokens": 1, "total_tokens": 6}
    (tmp_path / "a.jsonl").write_text(
        line("session_meta", 0, id="child", parent_thread_id="parent", subagent_history_start_ordinal=3, cwd="/w")
        + line("session_meta", 1, id="parent") + line("turn_context", 2, turn_id="t1", model="m1")
        + line("event_msg", 3, type="token_count", info={"total_token_usage": total})
        + line("event_msg", 4, type="task_started", turn_id="t2") + line("event_msg", 5, type="token_count", info={"total_token_usage": total, "last_token_usage": total})
        + line("token_usage_record", 6, response_id="r", usage={"input_tokens": True, "output_tokens": 1.0, "total_tokens": 6})
        + line("response_item", 7, type="function_call", call_id="c", name="exec_command", arguments='{"cmd":"secret command"}')
        + line("response_item", 8, type="function_call_output", call_id="c", output='{"exit_code": 2, "text": "private"}')
        + line("event_msg", 9, type="item_completed", item={"type": "CommandExecution", "id": "i", "command": "ls", "duration": {"secs": 1, "nanos": 5e8}})
        + line("response_item", 10, type="message") + line("odd", 11) + line("turn_context", 12, model=5)
    )
    jsonl.register(spark)
    raw = spark.read.format("agent_jsonl").option("path", str(tmp_path)).load().withColumnRenamed("path", "source_id")
    got = sorted(records.normalize(raw, "salt").collect(), key=lambda r: r.ordinal)
    assert [r.session_id for r in got[:6]] == ["child", "parent", "parent", "parent", "child", "child"]
    assert [r.error for r in got[10:]] == [None, "unknown_record_kind", "unsupported_identity_shape"]
    assert json.loads(got[5].data_json)["own_counter_origin"] is True and got[5].turn_id == "t2"
    used = json.loads(got[6].data_json)["usage"]
    assert (used["input_tokens"], used["output_tokens"], used["total_tokens"]) == (None, None, 6)
    assert json.loads(got[8].data_json)["exitCode"] == 2 and json.loads(got[9].data_json)["durationMs"] == 1500
    assert not any("secret" in (r.data_json or "") or "private" in (r.data_json or "") for r in got)


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "state_5.sqlite")
    c = sqlite3.connect(path)
    c.execute("CREATE TABLE threads (id TEXT, tokens_used INTEGER)")
    c.execute("CREATE TABLE thread_spawn_edges (odd TEXT)")
    c.execute("INSERT INTO threads VALUES ('a', 5), ('b', NULL)")
    c.commit()
    found, bad = sqlite.adapter(spark, path, sqlite.STATE)
    assert [(r.id, r.cwd, r.tokens_used) for r in found["threads"].orderBy("id").collect()] == [("a", None, 5), ("b", None, None)]
    assert bad == ["thread_spawn_edges"]
    with pytest.raises(sqlite3.OperationalError):
        sqlite.connect(path).execute("INSERT INTO threads VALUES ('c', 1)")


def test_discovery(tmp_path):
    home = tmp_path / "home"
    (home / "sessions" / "x").mkdir(parents=True)
    (home / "sessions" / "x" / "r.jsonl").write_text("{}\n")
    (home / "logs_1.sqlite").write_text("")
    c = sqlite3.connect(home / "state_1.sqlite")
    c.execute("CREATE TABLE threads (id TEXT, rollout_path TEXT)")
    c.execute("INSERT INTO threads VALUES ('a', ?), ('b', 'ssh://host/x')", (str(tmp_path / "gone.jsonl"),))
    c.commit()
    config = inventory.Config.resolve(str(home), str(tmp_path / "out"))
    by = {os.path.basename(r["original_path"]): r["disposition"] for r in inventory.discover(config)}
    assert by["r.jsonl"] == "eligible" and by["logs_1.sqlite"] == "diagnostic_only" and by["gone.jsonl"] == "unavailable" and by["archived_sessions"] == "unavailable"
    with pytest.raises(ValueError):
        inventory.Config.resolve(str(home), str(home / "sessions" / "out"))


def test_preview(tmp_path):
    raw = line("response_item", type="function_call", arguments=json.dumps({"cmd": "curl -H 'Authorization: Bearer abc.def' --token s3cret", "env": "x"})).encode()
    f = tmp_path / "a.jsonl"
    f.write_bytes(raw)
    rec = {"record_id": 1, "path": str(f), "byte_start": 0, "byte_end": len(raw), "digest": hashlib.sha256(raw).hexdigest()}
    shown = command_preview([rec])["text"]
    assert "abc.def" not in shown and "s3cret" not in shown and "env" not in shown and "curl" in shown
    f.write_bytes(raw.replace(b"curl", b"wget"))
    assert verify(str(f), 0, len(raw), rec["digest"])[0] == "source_changed" and command_preview([rec])["text"] is None
    assert redact("x" * 3000).endswith("[preview truncated]")


def test_stream_appends_rewrites_and_restarts(spark, tmp_path):
    f, seen = tmp_path / "a.jsonl", []
    f.write_text(line("session_meta", 0, id="s") + line("turn_context", 1, model="m") + '{"open')

    def rebuild(sessions, batch, number):
        seen.append(([r.session for r in sessions.collect()], [(r.generation, r.ordinal, r.kind, r.session_id, r.model) for r in batch.orderBy("generation", "ordinal").collect()]))

    def go():
        q = worker.start(str(f), spark, rebuild, str(tmp_path / "state"), available_now=True)
        q.awaitTermination()

    go()
    assert seen[-1] == (["s"], [(1, 1, "session_meta", "s", None), (1, 2, "turn_context", "s", "m")])
    with open(f, "a") as h:  # the open record is finished, one more follows; context is kept
        h.write('": 1}\n' + line("event_msg", 2, type="task_started", turn_id="t"))
    go()
    assert seen[-1][1][-1] == (1, 4, "task_started", "s", "m")
    n = len(seen)
    go()
    assert len(seen) == n
    f.write_text(line("session_meta", 0, id="z"))
    go()
    assert seen[-1][1] == [(2, 1, "session_meta", "z", None)]
