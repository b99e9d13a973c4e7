"""The engine's Python interface over canonical tables."""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.operators import datasets, enrich, export, graph, inspect_sources, ledger, merge, pages, preview, provenance, records, tools
from ledgerspark.operators.datasets import Tables
from ledgerspark.operators.filters import Filters, project_keys
from ledgerspark.operators.scan import hot
from ledgerspark.operators.storage import materialize
from ledgerspark.operators.token_counts import TokenCounter
from ledgerspark.schema import PARSER_VERSION
from ledgerspark.sources import inventory, jsonl, sqlite

DATASETS = {"usage": datasets.usage, "tools": datasets.tools, "results": datasets.results, "rankings": datasets.rankings, "patterns": datasets.patterns, "sessions": datasets.sessions, "timeline": datasets.timeline, "comparisons": datasets.comparisons}
WHEN = "try_cast(timestamp as timestamp_ntz) as timestamp"


def numbered(events: DataFrame, batch: int = 0) -> DataFrame:
    """Events with a ``record_id`` that grows with batch, file, generation and ordinal, and ``superseded``.

    Only one row for each file is ordered over all files.
    """
    per = events.groupBy("source_id", "generation").agg(F.min("ordinal").alias("_low"), F.max("ordinal").alias("_high"))
    before = Window.orderBy("source_id", "generation").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max("generation").over(Window.partitionBy("source_id"))
    per = per.withColumn("_base", F.lit(batch << 40) + F.coalesce(F.sum(F.col("_high") - F.col("_low") + 1).over(before), F.lit(0)) - F.col("_low") + 1).withColumn("superseded", (F.col("generation") < latest).cast("int"))
    per = per.select(F.col("source_id").alias("_s"), F.col("generation").alias("_g"), "_base", "superseded")
    rows = events.join(per, F.col("source_id").eqNullSafe(F.col("_s")) & F.col("generation").eqNullSafe(F.col("_g")))
    return rows.withColumn("record_id", F.col("_base") + F.col("ordinal")).drop("_s", "_g", "_base")


def timed(df: DataFrame) -> DataFrame:
    return df.selectExpr(*[WHEN if c == "timestamp" else c for c in df.columns])


class Engine:
    """Datasets, exports and rebuilds for one Spark session."""

    def __init__(self, spark: SparkSession, tables: Tables | None = None):
        self.spark, self.tables = spark, tables or Tables()

    # sources and rebuilds

    def discover(self, config: inventory.Config) -> DataFrame:
        return inventory.as_table(self.spark, inventory.discover(config))

    def read_logs(self, path: str, finalized: tuple[str, ...] = (), marks: dict | None = None) -> DataFrame:
        options = {"finalizedPaths": os.pathsep.join(finalized)} | ({"finalizedMarks": json.dumps(marks)} if marks is not None else {})
        return jsonl.load(self.spark, path, **options)

    def read_database(self, path: str, kind: str) -> tuple[dict[str, DataFrame], list[str]]:
        return sqlite.adapter(self.spark, path, {"state": sqlite.STATE, "catalog": sqlite.CATALOG, "history": sqlite.HISTORY}[kind])

    def read_databases(self, sources: list[dict]) -> tuple[dict[str, DataFrame], list[dict]]:
        """The known tables of all databases that were discovered, and what of them isn't supported."""
        found: dict[str, list[DataFrame]] = {}
        bad = []
        for s in sources:
            if s["kind"] not in sqlite.KINDS_OF or s["disposition"] != "eligible":
                continue
            try:
                own, lacking = sqlite.adapter(self.spark, s["canonical_path"], sqlite.KINDS_OF[s["kind"]])
            except Exception as e:  # an unreadable database is reported and stops no other
                own, lacking = {}, [str(e)]
            bad += [{"path": s["canonical_path"], "code": "unsupported_schema", "location": x} for x in lacking]
            for name, df in own.items():
                found.setdefault(name, []).append(df)
        return {name: reduce(DataFrame.unionByName, dfs) for name, dfs in found.items()}, bad

    def import_logs(self, path: str, salt: str = "", finalized: tuple[str, ...] = (), counter: TokenCounter | None = None, marks: dict | None = None) -> DataFrame:
        """Typed events of all logs below a path."""
        return records.normalize(self.read_logs(path, finalized, marks).withColumnRenamed("path", "source_id"), salt, counter)

    def import_index(self, path: str) -> DataFrame:
        """Events of a session index."""
        return enrich.index_events(self.read_logs(path).withColumnRenamed("path", "source_id"))

    def build_ledger(self, observations: DataFrame) -> DataFrame:
        return ledger.build(observations)

    def build_tools(self, events: DataFrame, edges: DataFrame) -> DataFrame:
        return tools.correlate(tools.tool_rows(events), edges)

    def derive(self, numbered_events: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Facts, gaps and calls of the sessions whose numbered events these are."""
        used = numbered_events.where("kind in ('response_usage', 'cumulative_usage')")
        seen = used.select("record_id", "kind", "session_id", "turn_id", "timestamp", "model", "project", "native_id", "data_json", F.col("generation").alias("generation_id"), "ordinal", "superseded", "source_id", "byte_start", "digest", F.lit(PARSER_VERSION).alias("parser_version"))
        seen = seen.withColumn("generation_id", F.concat_ws("#", "source_id", F.col("generation_id").cast("string")))
        rows = materialize(self.build_ledger(seen), "ledger")
        calls = timed(self.build_tools(numbered_events.withColumn("parser_version", F.lit(PARSER_VERSION)), edges))
        facts = timed(rows.where("kind = 'fact'").drop("kind", "code", "detail_json", "record_id"))
        return facts, rows.where("kind = 'gap'").select("session_id", "record_id", "code", "detail_json"), calls

    def rebuild(self, events: DataFrame, edges: DataFrame | None = None, retry_seconds: float = 600, databases: dict[str, DataFrame] | None = None, labels: DataFrame | None = None, salt: str = "", sources: DataFrame | None = None) -> Tables:
        """Canonical tables from events, what databases say and labels: facts, gaps, calls, patterns, sessions and edges."""
        held = databases or {}
        seen = numbered(events.where("kind is not null"))
        own = enrich.items(held, salt)
        if own is not None:
            own = own.where("kind is not null").withColumns({"ordinal": F.monotonically_increasing_id() + 1, "byte_start": F.monotonically_increasing_id(), "byte_end": F.monotonically_increasing_id()}).drop("table_name")
            seen = seen.unionByName(numbered(materialize(own, "items"), 1 << 20))
        seen = materialize(seen, "numbered")
        parents = merge.edges_of(seen.where("kind = 'session_meta'"))
        edges = enrich.edges(parents if edges is None else edges.select("parent_id", "child_id").unionByName(parents).distinct(), held)
        facts, gaps, calls = self.derive(seen, edges)
        facts, calls = materialize(facts, "facts"), materialize(calls, "calls")
        projects = enrich.projects(self.spark, held)
        # a session's folder is the one that its first record names
        logs = seen.where("session_id is not null").groupBy(F.col("session_id").alias("id")).agg(F.min_by(F.col("project"), F.when(F.col("project").isNotNull(), F.col("record_id"))).alias("cwd"))
        paths = facts.select("project").unionByName(calls.select("project")).select(F.col("project").alias("path"))
        self.tables = Tables(
            usage_facts=facts, tool_calls=calls, gaps=gaps, edges=edges, patterns=materialize(tools.retries(calls, retry_seconds, hot(calls, ("session_id",))), "patterns"),
            events=timed(seen).withColumn("id", F.col("record_id")), records=seen, sessions=materialize(enrich.sessions(logs, held), "sessions"), projects=projects, project_keys=materialize(project_keys(projects, paths), "keys"),
            labels=self.spark.createDataFrame([], "session_id string, label string") if labels is None else labels, sources=sources,
            fact_sources=facts.selectExpr("id as fact_id", "explode(refs) as record_id"), tool_sources=calls.selectExpr("id as tool_id", "explode(refs) as record_id"), extra={"turns": enrich.turns(held)})
        return self.tables

    # queries

    def dataset(self, name: str, filters: Filters | dict | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
        if name not in DATASETS:
            raise ValueError(f"unknown dataset: {name}")
        chosen = filters if isinstance(filters, Filters) else Filters.parse(filters or {})
        return DATASETS[name](self.tables, chosen, limit, offset)

    def overview(self, filters: Filters | dict | None = None) -> dict[str, DataFrame]:
        f, t = filters if isinstance(filters, Filters) else Filters.parse(filters or {}), self.tables
        out = {"totals": datasets.overview_totals(t, f), "days": datasets.overview_days(t, f), "attribution": datasets.overview_attribution(t, f), "gaps": datasets.overview_gaps(t), "unknown_sessions": datasets.unknown_sessions(t)}
        return out | ({"sources": datasets.overview_sources(t)} if t.sources is not None else {}) | ({"coverage": datasets.overview_bounds(t)} if t.records is not None else {})

    def usage_summary(self, session: str, descendants: bool = False) -> DataFrame:
        return datasets.usage_summary(self.tables, session, descendants)

    def session_scope(self, session: str, descendants: bool = False) -> DataFrame:
        """``session_id`` of the session, and of all below it if asked for."""
        root = self.spark.createDataFrame([(session,)], "root string")
        return graph.reach(self.tables.edges, root).select(F.col("node").alias("session_id")) if descendants else root.withColumnRenamed("root", "session_id")

    def export(self, name: str, kind: str, filters: Filters | dict | None = None, path: str | None = None) -> str | None:
        """All rows of a dataset, with the ids of the facts behind aggregate rows.

        With ``path``, executors write files below it, and the ids as rows to folders beside it.  Without, the
        result is one text, for datasets that a reader looks at.
        """
        f = filters if isinstance(filters, Filters) else Filters.parse(filters or {})
        rows = self.dataset(name, f, None)
        ids = datasets.drill_down(self.tables, name, f) if name in datasets.AGGREGATES else {}
        if path:
            return export.write(rows, path, kind, f.timezone, ids)
        for column, facts in ids.items():
            rows = export.with_ids(rows, facts, list(datasets.AGGREGATES[name]), column, "fact_id")
        return export.to_json(rows, {"dataset": name, "timezone": f.timezone, "units": export.UNITS, "note": export.NOTE}) if kind == "json" else export.to_csv(rows, f.timezone)

    def audit(self, observations: DataFrame) -> DataFrame:
        return inspect_sources.audit(observations, self.tables.usage_facts)

    def audit_sources(self, events: DataFrame) -> dict[str, DataFrame]:
        """The ledger against an independent reading of the same events: by source, and by response id."""
        return {"sources": inspect_sources.audit_sources(events, self.tables.usage_facts), "responses": inspect_sources.audit_responses(events, self.tables.usage_facts, self.tables.fact_sources, self.tables.records)}

    def verify(self, records: DataFrame | None = None) -> DataFrame:
        """Where records stand (all, or those of ``record_id`` rows), and whether their bytes are still those that were read."""
        rows = self.tables.records
        return provenance.verify(rows if records is None else rows.join(records.select("record_id"), "record_id", "left_semi"))

    def provenance(self, record_id: int) -> list[dict]:
        """The same for one record."""
        return [r.asDict() for r in provenance.verify(self.tables.records.where(F.col("record_id") == record_id)).collect()]

    def pages(self, name: str, by: list[pages.By], filters: Filters | dict | None = None) -> pages.Pages:
        """A dataset in an order that is kept, for readers that go from page to page."""
        return pages.Pages(self.dataset(name, filters, None), by)

    def command_preview(self, found: list[dict]) -> dict:
        return preview.command_preview(found)
