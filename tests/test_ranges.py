"""Logs that many tasks read, number, hash and verify."""

import hashlib
import json
import random

from ledgerspark.operators.storage import materialize
from ledgerspark.sources import content, jsonl
from ledgerspark.streaming import worker

COLUMNS = ("generation", "byte_start", "byte_end", "ordinal", "digest", "raw", "error")


def text(seed, n):
    """Lines of all lengths: blank, broken, longer than several ranges, with and without a carriage return."""
    g = random.Random(seed)
    made = []
    for k in range(n):
        made.append(g.choice([b"", b"   ", b"bad", b'{"k":%d}' % k, b'{"k":"' + b"x" * g.randrange(300) + b'"}\r', "{\"k\":\"é\"}".encode()]))
    return b"\n".join(made) + b"\n"


def rows(df):
    return sorted(tuple(r[c] for c in ("path", *COLUMNS)) for r in df.collect())


def test_one_file_of_many_ranges(spark, tmp_path):
    """Any cut gives the same records with the same numbers, an open tail or a finalized one too."""
    for name, seed, end in (("a", 1, b'{"open":1}'), ("b", 2, b""), ("c", 3, b'{"not finished')):
        (tmp_path / f"{name}.jsonl").write_bytes(text(seed, 60) + end)
    (tmp_path / "empty.jsonl").write_bytes(b"")
    final = str(tmp_path / "a.jsonl")
    for more in ({}, {"finalizedPaths": final}):
        whole = rows(jsonl.load(spark, str(tmp_path), **more))
        for step in (1 << 10, 64, 7):
            cut = jsonl.load(spark, str(tmp_path), rangeBytes=str(step), **more)
            assert rows(cut) == whole
        assert any(r[1:][5] and r[6] == '{"open":1}' for r in whole) == bool(more)
    assert jsonl.load(spark, str(tmp_path), rangeBytes="64").rdd.getNumPartitions() > 1


def test_a_line_over_many_ranges_is_sought_once(tmp_path, monkeypatch):
    f = tmp_path / "x.jsonl"
    f.write_bytes(b'{"a":"' + b"x" * 5000 + b'"}\n{"b":1}\n')
    sought = []
    plain = jsonl.last_line_end
    monkeypatch.setattr(jsonl, "last_line_end", lambda path, begin, end: (sought.append(end - begin), plain(path, begin, end))[1])
    spans = list(jsonl.cut(jsonl.Span(str(f), 0, f.stat().st_size, 0, 1), 100))
    got = [r for s in spans for r in jsonl.read_span(s)]
    assert [(r[2], r[3]) for r in got] == [(0, 5009), (5009, 5017)] and len(spans) == 51
    assert sum(n > 100 for n in sought) == 1  # only the range in which the long line ends looks back


def test_leaves_and_roots(spark, tmp_path):
    f, g = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    f.write_bytes(text(4, 50))
    g.write_bytes(text(5, 50))
    files = spark.createDataFrame([(str(p), 1, 0, p.stat().st_size) for p in (f, g)], "path string, generation int, begin bigint, size bigint")
    kept = materialize(content.measured(content.ranges(files, 64)), "kept")
    raw = f.read_bytes()
    mine = {r.span: r for r in kept.where(kept.path == str(f)).collect()}
    assert {s: r.digest for s, r in mine.items()} == {s: hashlib.sha256(raw[s : s + 64]).hexdigest() for s in range(0, len(raw), 64)}
    assert sum(r.records for r in mine.values()) == sum(bool(x.strip()) for x in raw.split(b"\n"))
    root = {r.path: r.root for r in content.roots(kept).collect()}[str(f)]
    assert root == hashlib.sha256(",".join(mine[s].digest for s in sorted(mine)).encode()).hexdigest()
    assert content.verify(kept).count() == 0
    f.write_bytes(raw[:200] + b"~" + raw[201:])
    assert [(r.path, r.span) for r in content.verify(kept).collect()] == [(str(f), 192)]
    g.unlink()
    assert [(r.path, r.span) for r in content.verify(kept).collect()] == [(str(f), 192)]  # what is gone isn't changed
    assert content.measured(content.ranges(files.where("size < 0"), 64)).count() == 0


def test_tail_reads_nothing_on_the_driver_but_ends(tmp_path, monkeypatch):
    f = tmp_path / "a.jsonl"
    f.write_bytes(text(6, 2000))

    def never(*a):
        raise AssertionError("content is read")

    monkeypatch.setattr(jsonl, "chained", never)
    s = jsonl.JsonlStream({"path": str(f), "counted": "false", "rangeBytes": "4096", "verifySeconds": "0"})
    end = s.latestOffset()
    spans = s.partitions(s.initialOffset(), end)
    assert spans[0].begin == 0 and spans[-1].end == f.stat().st_size and len(spans) == -(-f.stat().st_size // 4096)
    assert all(a.end == b.begin for a, b in zip(spans, spans[1:]))
    jsonl.note_rewritten(str(tmp_path / "notes"), str(f), 1)
    s = jsonl.JsonlStream({"path": str(f), "counted": "false", "rewritten": str(tmp_path / "notes")})
    s.partitions(end, end)
    mark = json.loads(s.latestOffset()["files"])[str(f)]
    assert (mark["generation"], mark["why"]) == (2, "content_rewrite")
    assert json.loads(s.latestOffset()["files"])[str(f)] == mark  # once


def test_rewrite_inside_is_found_by_tasks(spark, tmp_path):
    """A byte changed in the middle, with size and ends as they were, is a new generation after the next verification."""
    f, seen = tmp_path / "a.jsonl", []
    head = json.dumps({"timestamp": "2026-09-01T12:00:00.000Z", "type": "session_meta", "payload": {"id": "s"}}) + "\n"
    turn = json.dumps({"timestamp": "2026-09-01T12:00:01.000Z", "type": "turn_context", "payload": {"model": "m1"}}) + "\n"
    f.write_text(head + turn * 200)

    def rebuild(sessions, batch, number):
        seen.extend((r.generation, r.ordinal) for r in batch.collect())

    def go():
        worker.start(str(f), spark, rebuild, str(tmp_path / "state"), available_now=True, rangeBytes="1000", verifySeconds="0.001").awaitTermination()

    go()
    assert sorted(seen) == [(1, k) for k in range(1, 202)]
    seen.clear()
    raw = f.read_text()
    at = len(raw) // 2
    f.write_text(raw[:at].rsplit("m1", 1)[0] + "m2" + raw[:at].rsplit("m1", 1)[1] + raw[at:])
    with open(f, "a") as h:
        h.write(turn)
    go()  # the new line is read, and the change is found
    assert seen[0] == (1, 202)
    seen.clear()
    go()
    assert sorted(seen) == [(2, k) for k in range(1, 203)]
