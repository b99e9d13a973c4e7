import json

from pyspark.sql import functions as F

from ledgerspark.functions.exprs import measure_value, measured_text
from ledgerspark.operators import records, tools

DDL = "record_id bigint, kind string, native_id string, session_id string, turn_id string, timestamp string, data_json string, model string, project string, source_id string, byte_start bigint, digest string, parser_version int"
NO_EDGES = "parent_id string, child_id string"


def event(n, kind, data, native="c", session="s", source=None, **more):
    r = dict(record_id=n, kind=kind, native_id=native, session_id=session, turn_id="t", timestamp=f"2026-09-01T12:00:{n:02d}.000Z", data_json=json.dumps(data), model="m", project="p", source_id=source, byte_start=n if source else None, digest=f"d{n}" if source else None, parser_version=6)
    return r | more


def run(spark, rows, edges=()):
    df = spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in DDL.split(", ")) for r in rows], DDL)
    return tools.correlate(tools.tool_rows(df), spark.createDataFrame(list(edges), NO_EDGES)).collect()


def test_call_output_and_item_are_one(spark):
    rows = [
        event(1, "tool_call", {"name": "exec_command", "argument_size": {"bytes": 5}, "pattern_hash": "h", "pattern_kind": "exact_command"}),
        event(2, "tool_output", {"result_size": {"bytes": 7, "characters": 7}, "exitCode": 0}),
        event(3, "item_completed", {"type": "commandExecution", "durationMs": 12.5, "exitCode": 1, "result_size": {"bytes": 9, "characters": 9}}),
    ]
    (t,) = run(spark, rows)
    assert (t.name, t.status, t.duration_ms, t.wall_ms, t.argument_bytes, t.result_bytes, t.output_chunks, t.pattern_hash, t.refs) == ("exec_command", "failed", 12.5, 2000, 5, 9, 1, "h", [1, 2, 3])


def test_statuses(spark):
    status = lambda rows: run(spark, rows)[0].status
    call = event(1, "tool_call", {"name": "x"})
    assert status([call]) == "pending"
    assert status([call, event(2, "tool_output", {})]) == "unknown_outcome"
    assert status([event(2, "item_completed", {"type": "webSearch"})]) == "unknown"
    assert status([call, event(2, "tool_output", {"success": False}), event(3, "tool_output", {"success": True})]) == "succeeded"
    assert status([call, event(2, "tool_output", {"success": True, "explicit_error": True})]) == "failed"


def test_chunks_of_the_fullest_source(spark):
    rows = [event(1, "tool_call", {"name": "x"}, source="a")]
    rows += [event(k, "tool_output", {"result_size": {"bytes": 10, "completeness": "retained_content"}}, source="a" if k < 4 else "b") for k in (2, 3, 4)]
    (t,) = run(spark, rows)
    assert (t.result_bytes, t.output_chunks) == (20, 2)
    rows.append(event(5, "tool_output", {"result_size": {"bytes": None}}, source="a"))
    assert run(spark, rows)[0].result_bytes is None


def test_copies_meet_at_the_topmost_owner(spark):
    rows = [event(1, "tool_call", {"name": "x"}, session="root"), event(2, "tool_call", {"name": "x"}, session="kid"), event(3, "tool_output", {"success": True}, session="kid")]
    (t,) = run(spark, rows, [("root", "mid"), ("mid", "kid")])
    assert (t.session_id, t.status) == ("root", "succeeded")
    assert len(run(spark, rows)) == 2


def test_unknown_identity_and_levels(spark):
    (t,) = run(spark, [event(4, "tool_call", {"name": "exec", "namespace": "functions"}, native=None)])
    assert (t.native_id, t.coverage, t.level) == ("unknown-record:4", "nested_unobserved", "outer_opaque")
    (t,) = run(spark, [event(4, "tool_call", {"name": "a", "parent_call_id": "p"})])
    assert t.level == "child" and t.parent_id
    assert run(spark, [event(4, "item_completed", {"type": "userMessage"})]) == []


def test_retries(spark):
    rows = [("a", "s", "h", "failed", 0), ("b", "s", "h", "failed", 100), ("c", "s", "h", "succeeded", 5000), ("d", "s", None, "failed", 1), ("e", "z", "h", "failed", 2)]
    df = spark.createDataFrame(rows, "id string, session_id string, pattern_hash string, status string, at int").selectExpr("*", "'exact_arguments' as pattern_kind", "timestamp_seconds(at) as timestamp")
    got = {r.tool_id: (r.likely_retry, r.previous_tool_id) for r in tools.retries(df, 600).collect()}
    assert got == {"a": (0, None), "b": (1, "a"), "c": (0, "b"), "e": (0, None)}


def test_patterns(spark):
    def pattern(name, given, salt):
        df = spark.createDataFrame([(name, None if given is None else json.dumps(given))], "name string, raw string")
        columns = records.pattern_columns(F.col("name"), records.serialized(F.try_parse_json("raw")), salt)
        return {k: v for k, v in df.select(*[c.alias(k) for k, c in columns.items()]).first().asDict().items() if v is not None}

    same = pattern("exec_command", {"cmd": "ls"}, "x")
    assert same == pattern("exec_command", '{"cmd":"ls"}', "x") and same["pattern_kind"] == "exact_command"
    assert same != pattern("exec_command", {"cmd": "ls"}, "y")
    assert pattern("fs.read_file", {"path": "a", "limit": 1}, "x")["pattern_kind"] == "exact_read_and_range"
    assert pattern("x", None, "x") == {}


def test_sizes(spark):
    def size(value, count=None):
        v = F.try_parse_json("raw")
        is_json = F.coalesce(F.schema_of_variant(v) != "STRING", F.lit(False))
        return spark.createDataFrame([(None if value is None else json.dumps(value),)], "raw string").select(measure_value(records.serialized(v), is_json, count and count(measured_text(records.serialized(v), is_json))).alias("m")).first().m

    assert size("héllo")["bytes"] == 6 and size("héllo")["characters"] == 5
    media = size([{"type": "input_image", "url": "xxx"}, {"type": "text", "text": "hi"}, {"type": "text", "text": "you"}])
    assert media["characters"] == 6 and media["completeness"] == "partial" and media["scope"] == "extracted_text_only"
    assert size("Output TRUNCATED")["flags"] == ["truncated"] and size(None)["bytes"] is None
    assert size("abc", lambda t: F.char_length(t).cast("long"))["tokens"] == 3
