"""Imports with databases, exports with ids, audits, the store against a rebuild, what surrounds a run."""

import hashlib
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from ledgerspark import __main__ as cli
from ledgerspark import runs
from ledgerspark.engine import Engine, numbered
from ledgerspark.operators import enrich, graph, inspect_sources, ledger, merge, records
from ledgerspark.operators.filters import Filters
from ledgerspark.sources import inventory, jsonl, sqlite
from ledgerspark.streaming import worker
from ledgerspark.streaming.store import Store

VECTOR = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")


def used(n):
    return dict(zip(VECTOR, (n, 0, 0, n // 2, 0, n + n // 2), strict=True))


def line(kind, second, **payload):
    return json.dumps({"timestamp": f"2026-09-{1 + second // 60:02d}T12:00:{second % 60:02d}.000Z", "type": kind, "payload": payload}) + "\n"


def counter(second, n, last=None):
    return line("event_msg", second, type="token_count", info={"total_token_usage": used(n), "last_token_usage": used(last or n)})


def call(second, i, name="exec_command", code=0):
    return line("response_item", second, type="function_call", call_id=i, name=name, arguments='{"cmd":"ls"}') + line("response_item", second + 1, type="function_call_output", call_id=i, output=json.dumps({"exit_code": code}))


def head(second, i, **more):
    return line("session_meta", second, id=i, cwd=f"/work/{i}", cli_version="1", **more) + line("turn_context", second, turn_id=f"t-{i}", model="m") + line("event_msg", second, type="task_started", turn_id=f"t-{i}")


LOGS = {
    "a": head(0, "a") + counter(1, 10) + counter(2, 30, 20) + call(3, "c1") + counter(70, 30, 0),
    "b": head(0, "b", parent_thread_id="a") + counter(5, 100, 7) + call(6, "c2", code=1) + call(8, "c3"),
    "c": head(0, "c") + line("token_usage_record", 1, response_id="r1", usage=used(4)) + counter(2, 4) + line("token_usage_record", 4, response_id="r2", usage=used(6)),
    "d": head(0, "d") + counter(1, 50) + counter(2, 20) + line("compacted", 3) + counter(4, 25),
}


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    at = tmp_path_factory.mktemp("logs")
    for name, text in LOGS.items():
        (at / f"{name}.jsonl").write_text(text)
    return at


@pytest.fixture(scope="module")
def engine(spark, logs):
    e = Engine(spark)
    state = {
        "threads": spark.createDataFrame([("a", "/repo/x", "p1", 1_700_000_000, None, 0, 99, None), ("z", "/repo/z", None, None, None, 1, 5, None)], "id string, cwd string, project_id string, created_at bigint, updated_at bigint, archived bigint, tokens_used bigint, rollout_path string"),
        "project_roots": spark.createDataFrame([("p1", "/work/a", 0)], "project_id string, path string, position bigint"),
        "thread_spawn_edges": spark.createDataFrame([("b", "c", None)], "parent_thread_id string, child_thread_id string, status string"),
        "local_thread_catalog": spark.createDataFrame([("h", "z", None, "p9"), ("nowhere", "y", "/y", None)], "host_id string, thread_id string, cwd string, project_id string"),
        "local_thread_catalog_hosts": spark.createDataFrame([("h", "local")], "host_id string, host_kind string"),
        "thread_items": spark.createDataFrame([("a", "t-a", "i1", 5, 1_756_728_000_000, '{"type":"CommandExecution","id":"i1","command":"ls","exit_code":0}', None, 1), ("a", None, "i2", 6, None, "no json", None, 2)], sqlite_schema("thread_items")),
    }
    e.rebuild(e.import_logs(str(logs)), databases=state, labels=spark.createDataFrame([("a", "mine")], "session_id string, label string"))
    return e


def sqlite_schema(table):
    return ", ".join(f"{c} {k}" for c, k in sqlite.HISTORY[table][0].items())


def test_databases_reach_the_datasets(engine):
    got = {r.session_id: r for r in engine.dataset("sessions", limit=None).collect()}
    assert got["a"].label == "mine" and got["a"].cwd == "/repo/x" and got["z"].coverage == "unknown" and got["y"].coverage == "remote_metadata_only"
    assert got["b"].cwd == "/work/b" and got["z"].facts is None
    own = {r.id: r for r in engine.tables.sessions.collect()}
    assert own["z"].project_id == "p9" and own["a"].created_at.startswith("2023-11-14") and own["a"].reported_state_tokens == 99
    assert {r.project for r in engine.dataset("usage", {"session": "a"}).collect()} == {"p1"}
    assert engine.dataset("usage", {"project": "p1"}, None).count() == engine.dataset("usage", {"session": "a"}, None).count() > 0
    calls = {r.native_id: r.status for r in engine.dataset("tools", {"session": "a"}, None).collect()}
    assert calls == {"c1": "succeeded", "i1": "succeeded"}
    assert sorted(r.session_id for r in engine.session_scope("a", True).collect()) == ["a", "b", "c"]


def test_newer_generations_supersede(spark):
    kinds = "source_id string, generation int, byte_start bigint, byte_end bigint, ordinal bigint, digest string, kind string"
    rows = numbered(spark.createDataFrame([("f", 1, 0, 5, 1, "x", "k"), ("f", 2, 0, 5, 1, "y", "k"), ("f", 2, 5, 9, 2, "z", "k"), ("g", 1, 0, 5, 1, "x", "k")], kinds)).orderBy("record_id").collect()
    assert [(r.source_id, r.generation, r.ordinal, r.superseded) for r in rows] == [("f", 1, 1, 1), ("f", 2, 1, 0), ("f", 2, 2, 0), ("g", 1, 1, 0)]
    assert [r.record_id for r in rows] == [1, 2, 3, 4]


def test_plain_sessions_need_no_fold(engine):
    """Windows and the fold give the same facts and gaps, and sessions without responses take the windows."""
    used = engine.tables.records.where("kind in ('response_usage', 'cumulative_usage')")
    seen = used.selectExpr("record_id", "kind", "session_id", "turn_id", "timestamp", "model", "project", "native_id", "data_json", "generation as generation_id", "ordinal", "superseded", "source_id", "byte_start", "digest", "6 as parser_version")
    shown = lambda df: sorted(tuple(map(str, (r.kind, r.session_id, r.turn_id, r.timestamp, r.interval_start, r.interval_end, r.model, r.project, r.method, r.coverage, *(r[f] for f in VECTOR), r.refs, r.record_id, r.code))) for r in df.collect())
    assert shown(ledger.build(seen)) == shown(ledger.fold_ledger(seen))
    plain = ledger.plain_ledger(ledger.settled(seen.where("session_id in ('a', 'b', 'd')")))
    assert shown(plain) == shown(ledger.fold_ledger(seen.where("session_id in ('a', 'b', 'd')"))) and plain.count() > 4


def test_export_ids_follow_the_filters(engine, tmp_path):
    day = {"end": "2026-09-01"}
    facts = {(r.session_id, r.id) for r in engine.dataset("usage", day, None).collect()}
    for r in json.loads(engine.export("sessions", "json", day))["rows"]:
        assert r["usage_fact_ids"] == ",".join(sorted(i for s, i in facts if s == r["session_id"]))
    every = {(r.session_id, r.id) for r in engine.dataset("tools", {}, None).collect()}
    compared = json.loads(engine.export("comparisons", "json", {"session": "a"}))["rows"]
    ids = {r["scope"]: set(filter(None, r["tool_fact_ids"].split(","))) for r in compared}
    assert ids["own_thread"] == {i for s, i in every if s == "a"} and ids["unique_descendants"] == {i for _, i in every} > ids["own_thread"]
    for r in json.loads(engine.export("patterns", "json"))["rows"]:
        assert len(r["tool_fact_ids"].split(",")) == r["occurrences"] > 1
    assert {r["name"]: len(r["tool_fact_ids"].split(",")) for r in json.loads(engine.export("rankings", "json", {"session": "b"}))["rows"]} == {"exec_command": 2}
    engine.export("rankings", "csv", path=str(tmp_path / "out"))
    spark = engine.spark
    assert spark.read.option("header", True).csv(str(tmp_path / "out-tool_fact_ids")).count() == len(every)


def test_audit_rules(engine):
    found = engine.audit_sources(engine.tables.records)
    got = {r.session_id: (r.disposition, r.reason) for r in found["sources"].where("session_id is not null").collect()}
    assert got == {"a": ("exact", None), "b": ("outside_simple_oracle", "unproven_first_boundary"), "c": ("exact", None), "d": ("outside_simple_oracle", "counter_decrease")}
    tags = {r.value: r.n for r in inspect_sources.histogram(found["sources"], "tags").collect()}
    assert tags == {"branch": 1, "compaction": 1, "responses": 1}
    assert {r.native_id: r.verdict for r in found["responses"].collect()} == {"r1": "exact", "r2": "exact"}
    wrong = engine.tables.usage_facts.withColumn("total_tokens", F.col("total_tokens") + 1)
    assert inspect_sources.audit_sources(engine.tables.records, wrong).where("disposition = 'exact'").count() == 0


def test_profile(engine, logs):
    got = inspect_sources.profile(engine.read_logs(str(logs)).withColumnRenamed("path", "source_id"))
    files = {r.first_session: r for r in got["files"].collect()}
    assert (files["a"].records, files["a"].usage_records, files["a"].repeats, files["d"].decreases) == (8, 3, 1, 1)
    assert files["a"].first_timestamp == "2026-09-01T12:00:00.000Z" and {r.version: r.headers for r in got["versions"].collect()} == {"1": 4}
    assert [(r.evidence, r.classification) for r in got["decreases"].collect()] == [("unexplained", "unresolved_decrease")]
    assert got["duplicate_first_ids"].count() == 0
    items = engine.spark.createDataFrame([('{"type":"Sleep"}',), ("x",), ("[1]",)], "item_json string")
    assert {r.type: r["items"] for r in inspect_sources.projection_types(items).collect()} == {"Sleep": 1, "malformed": 2}


def test_store_equals_rebuild(spark, tmp_path):
    """Batches that append to sessions, and one that rewrites a file, leave what a rebuild of all events gives."""
    at, store = tmp_path / "in", Store(spark, str(tmp_path / "store"), buckets=4)
    at.mkdir()

    def go():
        worker.start(str(at), spark, store.rebuild, str(tmp_path / "state"), available_now=True).awaitTermination()

    for half in (0, 1):
        for name, text in LOGS.items():
            rows = text.splitlines(True)
            (at / f"{name}.jsonl").open("a").write("".join(rows[: len(rows) // 2] if half == 0 else rows[len(rows) // 2 :]))
        go()
    t = store.tables()
    whole = Engine(spark)
    whole.rebuild(whole.import_logs(str(at)))
    facts = lambda t: sorted((r.session_id, r.method, str(r.timestamp), r.total_tokens) for r in t.usage_facts.collect())
    calls = lambda t: sorted((r.session_id, r.native_id, r.status) for r in t.tool_calls.collect())
    assert facts(t) == facts(whole.tables) and calls(t) == calls(whole.tables)
    assert sorted((r.session_id, r.code) for r in t.gaps.collect()) == sorted((r.session_id, r.code) for r in whole.tables.gaps.collect())
    (at / "d.jsonl").write_text(head(0, "e") + counter(1, 9))
    go()
    assert ("e", 9 + 4) in {(r.session_id, r.total_tokens) for r in store.read("facts").collect()}


def events_of(spark, rows):
    kinds = dict(c.split() for c in records.EVENTS.split(", "))
    base = {"source_id": "f", "generation": 1, "byte_start": 0, "byte_end": 1, "digest": "d", "timestamp": "2026-09-01T12:00:00Z"}
    return spark.createDataFrame([tuple((base | r).get(c) for c in kinds) for r in rows], records.EVENTS)


def usage_event(session, n, value, **more):
    data = {"usage": {"input_tokens": value, "output_tokens": 0, "total_tokens": value}}
    return {"ordinal": n, "byte_start": n, "kind": "response_usage", "session_id": session, "native_id": f"{session}-{n}", "data_json": json.dumps(data)} | more


def take(spark, store, number, rows):
    events = events_of(spark, rows)
    store.rebuild(events.selectExpr("session_id as session").distinct(), events, number)


def held(store):
    return sorted((r.session_id, r.total_tokens) for r in store.read("facts").collect())


def test_store_commits_at_once(spark, tmp_path, monkeypatch):
    """A batch that dies between two tables leaves the snapshot before it; done again it counts once."""
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    take(spark, store, 0, [usage_event("a", 1, 5), usage_event("b", 2, 7)])
    opened = store.read("facts")
    write = Store._write

    def dies(self, draft, number, name, *rest):
        if name == "calls":
            raise RuntimeError("killed")
        write(self, draft, number, name, *rest)

    monkeypatch.setattr(Store, "_write", dies)
    with pytest.raises(RuntimeError):
        take(spark, store, 1, [usage_event("a", 3, 11)])
    assert held(store) == [("a", 5), ("b", 7)] and store.snapshot()["version"] == 0 and store.events().count() == 2
    monkeypatch.setattr(Store, "_write", write)
    for _ in range(2):  # the second time it was committed
        take(spark, store, 1, [usage_event("a", 3, 11)])
        assert held(store) == [("a", 5), ("a", 11), ("b", 7)]
    assert sorted((r.session_id, r.total_tokens) for r in opened.collect()) == [("a", 5), ("b", 7)]  # a reader of the old snapshot reads on
    take(spark, store, 2, [usage_event("b", 4, 1)])
    assert held(store) == [("a", 5), ("a", 11), ("b", 1), ("b", 7)]


def test_store_of_a_file_that_tells_of_others(spark, tmp_path):
    """A file that begins anew and names other sessions supersedes what it said of the old ones."""
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    count = lambda session, n, total, gen: {"ordinal": n, "byte_start": n, "generation": gen, "kind": "cumulative_usage", "session_id": session, "data_json": json.dumps({"total_token_usage": {"input_tokens": total, "output_tokens": 0, "total_tokens": total}})}
    other = {"source_id": "g", "generation": 1}
    take(spark, store, 0, [count("a", 1, 5, 1), count("a", 2, 9, 1), count("a", 1, 5, 1) | other])
    take(spark, store, 1, [count("z", 1, 3, 2)])
    rows = {(r.session_id, r.superseded) for r in Store._latest(store.events().drop("superseded"), store.read("files")).select("session_id", "superseded").collect()}
    assert rows == {("a", 1), ("a", 0), ("z", 0)}
    assert {s for s, _ in held(store)} == {"a", "z"} and ("a", 5) in held(store)


def test_labels_follow_edges(spark):
    """Components that grow by batches of edges are those of all edges; only joined ones change."""
    import random

    g, names = random.Random(3), [f"n{k:02d}" for k in range(40)]
    kind = "parent_id string, child_id string"
    labels, every = spark.createDataFrame([], "session string, component string"), []
    for _ in range(4):
        batch = [(g.choice(names), g.choice(names)) for _ in range(9)]
        every += batch
        changed = graph.merge_components(labels, spark.createDataFrame(batch, kind))
        moved = {r.session: r.component for r in changed.collect()}
        old = {r.session: r.component for r in labels.collect()}
        assert all(old.get(s) != c for s, c in moved.items())
        labels = spark.createDataFrame(list((old | moved).items()), "session string, component string")
    edges = spark.createDataFrame(every, kind)
    want = {r.session: r.component for r in graph.components(edges).collect()}
    assert {r.session: r.component for r in labels.collect()} == want == {r.session: r.component for r in graph.components(edges, 0).collect()}
    seeds = spark.createDataFrame([("n00",), ("lonely",)], "session string")
    assert {r.session for r in graph.related(edges, seeds).collect()} == {s for s, c in want.items() if c == want.get("n00")} | {"n00", "lonely"}


def test_context_over_batches_equals_one_batch(spark, tmp_path):
    """A file that replays its parent, cut after every record."""
    text = head(0, "child", parent_thread_id="parent", subagent_history_start_ordinal=6) + head(1, "parent") + counter(2, 5) + line("turn_context", 3, model="late", turn_id="t9") + counter(4, 8, 3) + call(5, "c")
    f = tmp_path / "x.jsonl"
    f.write_text(text)
    jsonl.register(spark)
    raw = spark.read.format("agent_jsonl").option("path", str(f)).load().withColumnRenamed("path", "source_id").cache()
    one = sorted(map(tuple, records.normalize(raw).collect()), key=lambda r: r[4])
    assert [r[7] for r in one][:7] == ["child"] * 3 + ["parent"] * 4 and one[7][7] == "child"
    context, got = worker.Context(spark, str(tmp_path / "context")), []
    for k, (a, b) in enumerate([(0, 2), (2, 5), (5, 7), (7, 99)]):
        got += map(tuple, context.events(raw.where(f"ordinal > {a} and ordinal <= {b}"), k).collect())
    assert sorted(got, key=lambda r: r[4]) == one


def test_tail_marks(tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text("one\ntwo\nthree\n")
    quick = jsonl.advance(str(f), None)
    f.write_text("one\ntwo\nthree\nfour\n")
    more = jsonl.advance(str(f), quick)
    assert more["ordinal"] == 4 and jsonl.change(str(f), more, True) is None  # a quick mark can be verified in full
    assert jsonl.advance(str(f), more) is more  # an untouched file isn't opened
    first = jsonl.advance(str(f), None, False, 5)
    assert (first["offset"], first["more"]) == (4, True) and jsonl.advance(str(f), first)["content"] == more["content"]
    s = jsonl.JsonlStream({"path": str(tmp_path), "maxBytesPerTrigger": "5"})
    sizes = [json.loads(s.latestOffset()["files"])[str(f)]["offset"] for _ in range(5)]
    assert sizes == [4, 8, 14, 19, 19]
    (tmp_path / "b.jsonl").write_text("x\ny\n")
    (tmp_path / "c.jsonl").write_text("x\ny\n")
    every = json.loads(jsonl.JsonlStream({"path": str(tmp_path)}).latestOffset()["files"])
    assert [m["offset"] for _, m in sorted(every.items())] == [19, 4, 4]
    f.unlink()
    assert json.loads(s.latestOffset()["files"])[str(f)]["offset"] == 19  # a file that is gone stops nothing


def test_finalized_tail_needs_an_unchanged_file(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"a":1}\n{"b":2}')
    e, s = Engine(spark), f.stat()
    assert e.read_logs(str(f), (str(f),), {str(f): [s.st_size, s.st_mtime_ns]}).count() == 2
    assert e.read_logs(str(f), (str(f),), {str(f): [s.st_size - 1, s.st_mtime_ns]}).count() == 1
    assert e.read_logs(str(f), (str(f),), {}).count() == 1


def test_session_index(spark, tmp_path):
    f = tmp_path / "session_index.jsonl"
    f.write_text('{"id":"s","updated_at":"2026-09-01T00:00:00Z"}\n{"id":5}\nbad\n')
    got = [(r.kind, r.session_id, r.error) for r in Engine(spark).import_index(str(f)).orderBy("ordinal").collect()]
    assert got == [("session_index", "s", None), (None, None, "unsupported_index_record"), (None, None, "malformed_record")]


def test_current_view_keeps_database_rows(spark):
    rows = spark.createDataFrame([(1, 1, None, 0), (2, 1, None, 0), (3, 1, "threads", 0), (4, 1, "threads", 1)], "record_id int, source_id int, table_name string, superseded int")
    got = merge.current_view(rows, spark.createDataFrame([(2,)], "record_id int"), spark.createDataFrame([(1, 0)], "source_id int, g int"))
    assert sorted(r.record_id for r in got.collect()) == [2, 3]


def test_tokenizers(spark, tmp_path):
    """Only a verified local file counts, and only its own model's texts are counted with it."""
    ranks = tmp_path / "a.tiktoken"
    import base64

    ranks.write_text("".join(f"{base64.b64encode(bytes([k])).decode()} {k}\n" for k in range(256)) + f"{base64.b64encode(b'ab').decode()} 256\n")
    spec = {"bpe_path": str(ranks), "sha256": hashlib.sha256(ranks.read_bytes()).hexdigest(), "pattern": r"\S+|\s+", "encoding": "tiny"}
    (tmp_path / "tokenizers.json").write_text(json.dumps({"models": {"m": spec, "wrong": spec | {"sha256": "0"}, "relative": spec | {"bpe_path": "a"}}}))
    specs = runs.tokenizer_map(tmp_path)
    assert set(specs) == {"m"} and runs.tokenizer_map(tmp_path / "none") == {}
    (tmp_path / "x.jsonl").write_text(head(0, "s") + line("turn_context", 1, model="m") + line("response_item", 1, type="function_call", call_id="c", name="n", arguments="abab") + line("response_item", 1, type="function_call", call_id="e", name="n", arguments="abab") + line("turn_context", 2, model="other") + line("response_item", 3, type="function_call", call_id="d", name="n", arguments="abab"))
    (tmp_path / "logs").mkdir()
    (tmp_path / "x.jsonl").rename(tmp_path / "logs/x.jsonl")
    counter = runs.counter(specs, str(tmp_path / "counts"))
    for k in range(2):  # the second import finds every text counted
        events = Engine(spark).import_logs(str(tmp_path / "logs"), counter=counter).where("kind = 'tool_call'").orderBy("ordinal").collect()
        sizes = [json.loads(r.data_json)["argument_size"] for r in events]
        assert [(s["tokens"], s["method"]) for s in sizes] == [(2, "local_tokenizer_estimate"), (2, "local_tokenizer_estimate"), (None, "no_verified_local_tokenizer")]
        assert counter.encoded == 1
    assert {k: sizes[0][k] for k in ("encoding", "mapping", "mapping_sha256")} == {"encoding": "tiny", "mapping": "explicit_local_model_map", "mapping_sha256": spec["sha256"]} and sizes[0]["package_version"]
    assert set(sizes[2]) == {"bytes", "characters", "tokens", "method", "scope", "completeness", "flags"}  # unknown tokens are named, a tokenizer that isn't there isn't


def test_measure_media(spark):
    from ledgerspark.functions.exprs import measure_value

    rows = [('[{"type":"text","text":"a\\"b"},{"type":"input_image","url":"xx"},{"type":"text","text":"é"}]', True), ('say "type":"image"', False), (None, False), ("Truncated", False)]
    got = [r.m for r in spark.createDataFrame(rows, "t string, j boolean").select(measure_value(F.col("t"), F.col("j")).alias("m")).collect()]
    assert (got[0].characters, got[0].scope, got[0].flags) == (5, "extracted_text_only", ["unsupported_media"])
    assert (got[1].characters, got[1].scope) == (18, "retained_text") and got[2].method == "unavailable" and got[3].completeness == "partial"


def test_surroundings(spark, tmp_path):
    with runs.writer_lock(tmp_path), pytest.raises(RuntimeError), runs.writer_lock(tmp_path):
        pass
    runs.heartbeat(tmp_path, {"status": "running"})
    assert runs.status(tmp_path)["status"] == "stale"
    for label in ("one", "two"):
        runs.put_label(tmp_path, "s", label)
    runs.put_label(tmp_path, "t", None)
    assert [tuple(r) for r in runs.labels(spark, tmp_path).collect()] == [("s", "two")]
    df = spark.createDataFrame([(1234, 1.5, "unknown", None)], "n bigint, x double, s string, result_tokens bigint")
    assert tuple(runs.shown(df).first()) == ("1,234", "1.50", "Not recorded", "No model-tokenizer estimate")
    assert runs.local_time("2026-07-01T12:00:00Z", "Europe/London") == "2026-07-01 13:00:00 BST" and runs.local_time(None, "UTC") == "unknown" and runs.local_time("x", "UTC") == "x"
    assert str(inventory.local_path("\\\\?\\/tmp")) == "/tmp"


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    home, out = tmp_path / "home", tmp_path / "out"
    (home / "sessions").mkdir(parents=True)
    (home / "archived_sessions").mkdir()
    (home / "session_index.jsonl").write_text('{"id":"a"}\n')
    (home / "sessions" / "a.jsonl").write_text(LOGS["a"])
    c = sqlite3.connect(home / "state_1.sqlite")
    c.execute("CREATE TABLE threads (id TEXT, cwd TEXT, rollout_path TEXT)")
    c.execute("INSERT INTO threads VALUES ('a', '/repo', NULL)")
    c.commit()
    base = ["--home", str(home), "--data", str(out)]
    said = lambda: json.loads(capsys.readouterr().out.splitlines()[-1])
    assert cli.main(["reconcile", *base]) == 0
    got = said()
    assert got["usage_facts"] == 2 and got["events"]["session_index"] == 1 and got["statuses"] == {"succeeded": 1} and (out / "runs.jsonl").is_file()
    assert cli.main(["audit", *base]) == 0 and said()["counts"] == {"exact": 1}
    assert cli.main(["discover", *base, "--inspect", "--output", str(tmp_path / "report.json")]) == 0
    assert json.loads((tmp_path / "report.json").read_text())["inspection"]["versions"] == [{"version": "1", "headers": 1}]
    with pytest.raises(SystemExit):
        cli.main(["discover", *base, "--output", str(home / "sessions" / "r.json")])
    assert cli.main(["run", *base, "--available-now"]) == 0 and cli.main(["status", *base]) == 0
    assert Store(spark, str(out / "store")).tables().usage_facts.count() == 2


def test_enrichment_query(spark, sf):
    """Sessions of the catalogue's query are merged by kind of source."""
    rows = enrich.sessions(spark.createDataFrame([("a", "/log"), ("b", None)], "id string, cwd string"), {})
    assert sorted((r.id, r.cwd, r.coverage) for r in rows.collect()) == [("a", "/log", "unknown"), ("b", None, "unknown")]
    assert Filters().any is False
