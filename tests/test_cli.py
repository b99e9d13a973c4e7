import json
import sqlite3

from ledgerspark import __main__ as cli


def test_import_reads_all_that_is_discovered(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    home, other = tmp_path / "home", tmp_path / "other"
    used = {"input_tokens": 100, "output_tokens": 20, "total_tokens": 120}

    def log(path, name):
        path.parent.mkdir(parents=True, exist_ok=True)
        rows = [("session_meta", {"id": name}), ("token_usage_record", {"response_id": f"r-{name}", "usage": used})]
        path.write_text("".join(json.dumps({"timestamp": "2026-09-01T12:00:00Z", "type": k, "payload": p}) + "\n" for k, p in rows))

    log(home / "sessions" / "x" / "a.jsonl", "a")
    log(home / "archived_sessions" / "b.jsonl", "b")
    log(other / "c.jsonl", "c")
    c = sqlite3.connect(home / "state_1.sqlite")
    c.execute("CREATE TABLE threads (id TEXT, rollout_path TEXT)")
    c.executemany("INSERT INTO threads VALUES (?, ?)", [("a", str(home / "sessions" / "x" / "a.jsonl")), ("c", str(other / "c.jsonl"))])
    c.commit()
    assert cli.main(["import", "--home", str(home), "--data", str(tmp_path / "out")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["usage_facts"] == 3
