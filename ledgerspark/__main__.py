"""Command line: discover, import, reconcile, audit, export, run, status, label."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from ledgerspark import runs
from ledgerspark.engine import DATASETS, Engine
from ledgerspark.operators import inspect_sources
from ledgerspark.sources.inventory import Config, discover, eligible, rollouts
from ledgerspark.streaming import worker
from ledgerspark.streaming.store import Store

FILTERS = ("timezone", "session", "scope", "project", "model", "start", "end", "sort")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("ledgerspark")
    p.add_argument("command", choices=["discover", "import", "reconcile", "audit", "export", "run", "status", "label"])
    p.add_argument("--home")
    p.add_argument("--data")
    p.add_argument("--logs", help="folder or pattern of logs; default: those that are discovered")
    p.add_argument("--source-root", action="append", default=[], help="a further folder of logs")
    p.add_argument("--finalized-source", action="append", default=[], help="a closed log whose last record may lack its line feed")
    p.add_argument("--output", help="a file (for exports: a folder, written by executors) outside all sources")
    p.add_argument("--inspect", action="store_true", help="with discover: shapes and counters of the records")
    p.add_argument("--dataset", choices=sorted(DATASETS), default="usage")
    p.add_argument("--format", choices=["json", "csv"], default="json")
    p.add_argument("--label")
    p.add_argument("--retry-window", type=float, default=600)
    p.add_argument("--poll-interval", type=float, default=2)
    p.add_argument("--discovery-interval", type=float, default=30)
    p.add_argument("--reconcile-interval", type=float, default=300)
    p.add_argument("--salt", default="")
    p.add_argument("--available-now", action="store_true", help="with run: stop when all that is there is read")
    for f in FILTERS:
        p.add_argument(f"--{f}")
    return p


def rows(df) -> list[dict]:
    return [r.asDict(True) for r in df.toLocalIterator()]


def marks(data, logs: str) -> dict:
    """Sizes and times of logs as the last import left them; kept anew."""
    at = data / "marks.json"
    try:
        before = json.loads(at.read_text())
    except (OSError, ValueError):
        before = {}
    seen = {}
    for path in rollouts(logs) if logs.startswith("discover:") else []:
        s = os.stat(path)
        seen[path] = [s.st_size, s.st_mtime_ns]
    data.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps(seen))
    return before


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.inspect and a.command != "discover":
        p.error("--inspect goes with discover")
    if min(a.retry_window, a.poll_interval, a.discovery_interval, a.reconcile_interval) <= 0:
        p.error("windows and intervals must be positive")
    config = Config.resolve(a.home, a.data, tuple(a.source_root))
    try:
        output = config.writable(a.output) if a.output else None
    except ValueError as e:
        p.error(str(e))
    if a.command == "status":
        return _say(runs.status(config.data), output)
    if a.command == "label":
        runs.put_label(config.data, a.session or p.error("--session is needed"), a.label)
        return 0
    found = discover(config) if not a.logs or a.command == "discover" else []
    failed = any(s["disposition"] == "failed" for s in found)
    if a.command == "discover" and not a.inspect:
        return _say({"sources": found}, output) or int(failed)
    spark = SparkSession.builder.appName("ledgerspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine, logs = Engine(spark), a.logs or eligible(config)
    if a.command == "discover":
        seen = inspect_sources.profile(engine.read_logs(logs).withColumnRenamed("path", "source_id"))
        return _say({"sources": found, "inspection": {k: rows(df) for k, df in seen.items()}}, output) or int(failed)
    with runs.writer_lock(config.data):
        if a.command == "run":
            return _run(a, spark, config, logs)
        databases, unsupported = engine.read_databases(found)
        store = Store(spark, str(config.data / "store"), a.retry_window)
        if a.command == "export" and not a.logs and store.snapshot()["version"] >= 0:
            # what `run` keeps is there already; databases and labels are read as they are now
            engine.tables = store.tables(databases, runs.labels(spark, config.data))
            return _export(a, engine, output)
        events = engine.import_logs(logs, a.salt, tuple(a.finalized_source), runs.counter(runs.tokenizer_map(config.data), str(config.data / "token_counts")), marks(config.data, logs) if a.finalized_source else None)
        for s in found:
            if s["kind"] == "session_index" and s["disposition"] == "eligible":
                events = events.unionByName(engine.import_index(s["canonical_path"]))
        tables = engine.rebuild(events, retry_seconds=a.retry_window, databases=databases, labels=runs.labels(spark, config.data), salt=a.salt)
        if a.command == "export":
            return _export(a, engine, output)
        if a.command == "audit":
            made = engine.audit_sources(tables.records)
            sources = made["sources"].cache()
            result = {"counts": _counts(sources, "disposition"), "exclusions": _counts(sources, "reason"), "tags": _counts(sources.where("disposition = 'exact'"), "tags"), "responses": _counts(made["responses"], "verdict")}
            return _say(result, output) or int(bool(result["counts"].get("mismatch") or result["responses"].get("mismatch")))
        result = {"usage_facts": tables.usage_facts.count(), "tool_calls": tables.tool_calls.count(), "gaps": _counts(tables.gaps, "code"), "events": _counts(tables.records, "kind"), "errors": _counts(events, "error"), "sources": len(found), "failed": len(unsupported), "diagnostics": unsupported}
        if a.command == "reconcile":
            result |= {"methods": _counts(tables.usage_facts, "method"), "statuses": _counts(tables.tool_calls, "status"), "retries": tables.patterns.where("likely_retry = 1").count()}
        runs.log_run(config.data, result)
        return _say(result, output) or int(bool(unsupported))


def _export(a, engine: Engine, output) -> int:
    filters = {f: getattr(a, f) for f in FILTERS if getattr(a, f)}
    said = engine.export(a.dataset, a.format, filters, str(output) if output else None)
    sys.stdout.write(said or json.dumps({"output": str(output)}) + "\n")
    return 0


def _run(a, spark: SparkSession, config: Config, logs: str) -> int:
    store = Store(spark, str(config.data / "store"), a.retry_window)

    def rebuild(sessions, events, number: int) -> None:
        store.rebuild(sessions, events, number)
        runs.heartbeat(config.data, {"status": "running", "batch": number})

    runs.heartbeat(config.data, {"status": "running"})
    counter = runs.counter(runs.tokenizer_map(config.data), str(config.data / "token_counts"))
    options = {"discoverySeconds": str(a.discovery_interval), "verifySeconds": str(a.reconcile_interval)} | ({} if a.available_now else {"maxBytesPerTrigger": str(256 << 20)})
    worker.start(logs, spark, rebuild, str(config.data / "state"), a.salt, a.poll_interval, None, a.available_now, counter, **options).awaitTermination()
    runs.heartbeat(config.data, {"status": "stopped"})
    return 0


def _counts(df, column: str) -> dict:
    return {r["value"]: r["n"] for r in inspect_sources.histogram(df, column).collect()}


def _say(result: dict, output) -> int:
    text = json.dumps(result, indent=1, default=str)
    if output:
        output.parent.mkdir(parents=True, exist_ok=True)
        output.write_text(text)
        text = json.dumps({"output": str(output)})
    print(text if output or "sources" in result and isinstance(result["sources"], list) else json.dumps(result, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
