"""Queries over logs of their own read every observation."""

import collections
import json

from ledgerspark.plans import sources_demo
from ledgerspark.plans.fixtures import load


def test_every_observation_is_in_the_logs(spark, sf):
    seen = load(spark, sf, "fx_observations").select("session_id", "input_tokens").collect()
    lines = len(seen) + len({r.session_id for r in seen})
    assert sources_demo.jsonl_tail_batch(spark, sf).where("error is null").count() == lines
    rows = sources_demo.normalize_records(spark, sf).collect()
    counters = [r for r in rows if r.kind == "cumulative_usage"]
    assert len(rows) == lines and not any(r.error for r in rows)
    known = lambda pairs: collections.Counter(p for p in pairs if p[1] is not None)
    assert known((r.session_id, (json.loads(r.data_json)["total_token_usage"] or {}).get("input_tokens")) for r in counters) == known((r.session_id, r.input_tokens) for r in seen)
    assert sources_demo.stream_append(spark, sf).count() == lines
    again = {r.again: r["count"] for r in sources_demo.stream_rewrite(spark, sf).groupBy("again").count().collect()}
    assert sum(again.values()) == lines and again[True] >= again[False] > 0
