"""The datasets of the engine as DataFrames.

``Tables`` bundles the canonical tables.  Filters are applied once, before any aggregation; totals
per session or scope are aggregated before they are joined, so nothing is counted twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.exprs import flag_sum, local_day, model_key, noncached, rough_tokens
from ledgerspark.schema import CONTEXT_KINDS, ROUGH_METHOD, TOKEN_FIELDS

from .filters import Filters, scope_of, where
from .graph import reach

NONE = Filters()


@dataclass
class Tables:
    """Canonical tables; those that a dataset doesn't use may be missing."""

    usage_facts: DataFrame | None = None
    tool_calls: DataFrame | None = None
    sessions: DataFrame | None = None
    edges: DataFrame | None = None
    projects: DataFrame | None = None
    labels: DataFrame | None = None
    gaps: DataFrame | None = None
    patterns: DataFrame | None = None
    events: DataFrame | None = None
    sources: DataFrame | None = None
    records: DataFrame | None = None
    fact_sources: DataFrame | None = None
    tool_sources: DataFrame | None = None
    project_keys: DataFrame | None = None
    extra: dict = field(default_factory=dict)


def _has(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def _facts(t: Tables, f: Filters, keyed: bool = False) -> DataFrame:
    return where(t.usage_facts, f, t.edges, t.projects, keyed, t.project_keys)


def _tools(t: Tables, f: Filters, keyed: bool = False) -> DataFrame:
    return where(t.tool_calls, f, t.edges, t.projects, keyed, t.project_keys)


def page(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """At most 500 rows from ``offset`` on; None: all."""
    return df if limit is None else df.offset(max(int(offset), 0)).limit(min(max(int(limit), 1), 500))


def _ids(df: DataFrame, bridge: DataFrame | None, own: str) -> DataFrame:
    """``provenance_ids``: record ids in ascending order, joined by commas."""
    if bridge is None:
        return df.withColumn("provenance_ids", F.col("record_id").cast("string"))
    ids = bridge.groupBy(own).agg(F.array_join(F.transform(F.array_sort(F.collect_list("record_id")), lambda r: r.cast("string")), ",").alias("provenance_ids"))
    return df.join(ids, df.id == ids[own], "left").drop(ids[own])


def response_metrics() -> list[Column]:
    reported = F.col("method") == "reported_response"
    return [
        flag_sum(reported).alias("recorded_responses"), flag_sum(~reported).alias("other_usage_intervals"), F.sum("cached_input_tokens").alias("cached_input_tokens"),
        F.sum(noncached()).alias("noncached_input_tokens"), F.count(noncached()).alias("noncached_known_facts")]


def usage(t: Tables, f: Filters = NONE, limit: int | None = 100, offset: int = 0) -> DataFrame:
    rows = _ids(_facts(t, f, True), t.fact_sources, "fact_id")
    rows = rows.select("id", "session_id", _has(rows, "turn_id"), "timestamp", _has(rows, "interval_start", "timestamp_ntz"), _has(rows, "interval_end", "timestamp_ntz"),
        model_key().alias("model"), F.col("project_key").alias("project"), *TOKEN_FIELDS, "method", _has(rows, "coverage"), noncached().alias("noncached_input_tokens"), "provenance_ids")
    return page(rows.orderBy(F.desc_nulls_last("timestamp"), "id"), limit, offset)


def tools(t: Tables, f: Filters = NONE, limit: int | None = 100, offset: int = 0, largest: bool = False) -> DataFrame:
    rows = _ids(_tools(t, f, True), t.tool_sources, "tool_id")
    big = ("argument_bytes", "result_bytes", "argument_tokens", "result_tokens")
    rough = lambda name: (rough_tokens(f"{name}_characters") if f"{name}_characters" in rows.columns else F.lit(None).cast("bigint")).alias(f"rough_{name}_tokens")
    rows = rows.select("id", "session_id", _has(rows, "native_id"), "name", "timestamp", _has(rows, "completed_at", "timestamp_ntz"), "status", "duration_ms", _has(rows, "wall_ms", "double"),
        *[_has(rows, b, "bigint") for b in big], _has(rows, "estimate_method"), _has(rows, "completeness"), _has(rows, "level"), _has(rows, "coverage"),
        rough("argument"), rough("result"), F.lit(ROUGH_METHOD).alias("rough_estimate_method"), model_key().alias("model"), F.col("project_key").alias("project"), "provenance_ids")
    order = [F.desc_nulls_last("result_bytes"), "id"] if largest else [F.desc_nulls_last("timestamp"), "id"]
    return page(rows.orderBy(*order), limit, offset)


def results(t: Tables, f: Filters = NONE, limit: int | None = 100, offset: int = 0) -> DataFrame:
    return tools(t, f, limit, offset, largest=True)


def rankings(t: Tables, f: Filters = NONE, limit: int | None = 100, offset: int = 0) -> DataFrame:
    rough = rough_tokens("result_characters")
    rows = _tools(t, f).groupBy("name").agg(
        F.count("*").alias("calls"), flag_sum(F.col("status") == "failed").alias("failures"), flag_sum(F.col("status").isin("unknown", "unknown_outcome", "pending")).alias("unknown_outcomes"),
        F.sum("duration_ms").alias("duration_ms"), F.count("duration_ms").alias("durations_known"), F.sum("result_bytes").alias("result_bytes"),
        F.sum("result_tokens").alias("estimated_result_tokens"), F.count("result_tokens").alias("result_estimates_known"),
        F.sum(rough).alias("rough_result_tokens"), F.count(rough).alias("rough_results_known"))
    return page(rows.withColumn("rough_estimate_method", F.lit(ROUGH_METHOD)).orderBy(F.desc_nulls_last(f.sort), "name"), limit, offset)


def patterns(t: Tables, f: Filters = NONE, limit: int | None = 100, offset: int = 0) -> DataFrame:
    calls = _tools(t, f).select(F.col("id").alias("tool_id"), "session_id", "timestamp")
    rows = t.patterns.select("pattern_hash", "kind", "tool_id", "likely_retry").join(calls, "tool_id").groupBy("pattern_hash", "kind").agg(
        F.count("*").alias("occurrences"), F.count_distinct("session_id").alias("sessions"), F.sum("likely_retry").alias("likely_retries"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    return page(rows.where("occurrences > 1").orderBy(F.desc("occurrences"), "pattern_hash"), limit, offset)


def pattern_occurrences(t: Tables, pattern_hash: str, limit: int = 500) -> DataFrame:
    """Calls of one pattern, newest first."""
    own = t.patterns.where(F.col("pattern_hash") == pattern_hash).select(F.col("tool_id").alias("id"), "kind", "likely_retry", "previous_tool_id")
    calls = t.tool_calls.join(own, "id").withColumn("provenance_ids", F.col("record_id").cast("string"))
    return calls.select("id", "session_id", "name", "timestamp", "status", "kind", "likely_retry", "previous_tool_id", "provenance_ids").orderBy(F.desc_nulls_last("timestamp"), "id").limit(limit)


def sessions(t: Tables, f: Filters = NONE, limit: int | None = 100, offset: int = 0) -> DataFrame:
    u = _facts(t, f).groupBy(F.col("session_id").alias("u_session")).agg(
        F.count("*").alias("facts"), F.sum("total_tokens").alias("reported_total_tokens"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        *response_metrics(), flag_sum(F.col("method") == "unallocated_historical").alias("unallocated_facts"))
    calls = _tools(t, f).groupBy(F.col("session_id").alias("t_session")).agg(
        F.count("*").alias("tool_calls"), flag_sum(F.col("status") == "failed").alias("failures"), F.sum("duration_ms").alias("duration_ms"), F.sum("result_bytes").alias("result_bytes"))
    gaps = t.gaps.groupBy(F.col("session_id").alias("g_session")).agg(F.count("*").alias("gap_count"))
    s = t.sessions.select(F.col("id").alias("session_id"), "cwd", "coverage")
    labels = t.labels.select(F.col("session_id").alias("l_session"), "label")
    rows = s.join(u, s.session_id == u.u_session, "left").join(calls, s.session_id == calls.t_session, "left").join(labels, s.session_id == labels.l_session, "left").join(gaps, s.session_id == gaps.g_session, "left")
    if f.any:
        keep = F.col("u_session").isNotNull() | F.col("t_session").isNotNull()
        if f.session and not (f.project or f.model or f.start or f.end):
            inside = scope_of(t.edges, f).select(F.col("session_id").alias("in_scope"))
            rows = rows.join(inside, rows.session_id == inside.in_scope, "left")
            keep = keep | F.col("in_scope").isNotNull()
        rows = rows.where(keep)
    rows = rows.select("session_id", "label", "cwd", "coverage", "facts", "reported_total_tokens", "input_tokens", "output_tokens", "recorded_responses", "other_usage_intervals", "cached_input_tokens",
        "noncached_input_tokens", "noncached_known_facts", "unallocated_facts", "tool_calls", "failures", "duration_ms", "result_bytes", F.coalesce("gap_count", F.lit(0)).alias("accounting_gaps"))
    return page(rows.orderBy(F.desc_nulls_last("reported_total_tokens"), "session_id"), limit, offset)


def timeline(t: Tables, f: Filters = NONE, limit: int | None = 100, offset: int = 0) -> DataFrame:
    part = lambda df, kind, what, tokens: df.select("timestamp", "session_id", F.lit(kind).alias("kind"), F.col(what).alias("description"), tokens.cast("bigint").alias("reported_tokens"), F.col("id").cast("string").alias("fact_id"), "provenance_ids")
    none = F.lit(None)
    rows = part(_ids(_facts(t, f), t.fact_sources, "fact_id"), "usage", "method", F.col("total_tokens"))
    rows = rows.unionByName(part(_ids(_tools(t, f), t.tool_sources, "tool_id"), "tool", "name", none))
    if t.events is not None:
        seen = where(t.events.where(F.col("kind").isin(*CONTEXT_KINDS)), f, t.edges, t.projects, keys=t.project_keys).withColumn("provenance_ids", F.col("record_id").cast("string"))
        rows = rows.unionByName(part(seen, "context", "kind", none))
    return page(rows.orderBy(F.desc_nulls_last("timestamp"), "fact_id"), limit, offset)


def comparison_scopes(t: Tables, f: Filters = NONE) -> tuple[DataFrame, DataFrame]:
    """``position, root`` of the sessions compared, and ``root, scope, session_id`` of what each comprises."""
    spark = t.usage_facts.sparkSession
    picked = [s.strip() for s in f.session.split(",") if s.strip()][:20]
    if not picked:
        top = t.usage_facts.groupBy("session_id").agg(F.sum("total_tokens").alias("n")).orderBy(F.desc_nulls_last("n"), "session_id").limit(5)
        picked = [r.session_id for r in top.collect()]
    chosen = spark.createDataFrame([(k, s) for k, s in enumerate(picked)], "position int, root string")
    own = chosen.select("root").distinct().select("root", F.lit("own_thread").alias("scope"), F.col("root").alias("session_id"))
    below = reach(t.edges, chosen.select("root").distinct())
    return chosen, own.unionByName(below.select("root", F.lit("unique_descendants").alias("scope"), F.col("node").alias("session_id")))


def comparisons(t: Tables, f: Filters = NONE, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """The given sessions (comma-separated, 20 at most), or the five with most tokens, each by itself
    and with all below it.  One join with a (root, scope, session) map serves all of them."""
    chosen, scopes = comparison_scopes(t, f)
    rest = everyone(f)
    facts = scopes.join(_facts(t, rest), "session_id").groupBy("root", "scope").agg(
        *response_metrics(), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("total_tokens").alias("reported_total_tokens"),
        F.count("*").alias("reported_facts"), F.count("total_tokens").alias("facts_with_known_total"))
    calls = scopes.join(_tools(t, rest), "session_id").groupBy("root", "scope").agg(F.count("*").alias("calls"), flag_sum(F.col("status") == "failed").alias("failures"), F.sum("duration_ms").alias("duration_ms"), F.sum("result_bytes").alias("result_bytes"))
    gaps = scopes.join(t.gaps, "session_id").groupBy("root", "scope").agg(F.count("*").alias("gap_count"))
    sized = scopes.groupBy("root", "scope").agg(F.count_distinct("session_id").alias("sessions_in_scope"))
    zero = F.lit(0)
    rows = chosen.join(sized, "root").join(facts, ["root", "scope"], "left").join(calls, ["root", "scope"], "left").join(gaps, ["root", "scope"], "left").join(t.labels.select(F.col("session_id").alias("root"), "label"), "root", "left")
    rows = rows.select("position", F.col("root").alias("session_id"), "label", "scope", "sessions_in_scope", "recorded_responses", "other_usage_intervals", "cached_input_tokens", "noncached_input_tokens",
        F.coalesce("noncached_known_facts", zero).alias("noncached_known_facts"), "input_tokens", "output_tokens", "reported_total_tokens", F.coalesce("reported_facts", zero).alias("reported_facts"),
        F.coalesce("facts_with_known_total", zero).alias("facts_with_known_total"), F.coalesce("calls", zero).alias("calls"), "failures", "duration_ms", "result_bytes",
        F.coalesce("gap_count", zero).alias("accounting_gaps_all_dates"), F.when(F.coalesce("reported_facts", zero) > 0, "known subtotal; inspect accounting gaps").otherwise("unknown usage").alias("coverage"))
    return page(rows.orderBy("position", "scope").drop("position"), limit, offset)


def everyone(f: Filters) -> Filters:
    """The same filters over all sessions."""
    return Filters(**{**f.__dict__, "session": "", "scope": "own"})


#: Datasets whose rows are aggregates, and the columns that name a row.
AGGREGATES = {"rankings": ("name",), "patterns": ("pattern_hash", "kind"), "sessions": ("session_id",), "comparisons": ("session_id", "scope")}


def drill_down(t: Tables, name: str, f: Filters = NONE) -> dict[str, DataFrame]:
    """The facts behind the rows of an aggregate dataset: rows of its key columns and ``fact_id``, by column name.

    Filters count as they do for the aggregates: facts of other days, models or projects aren't named, and a row
    for descendants names the facts of its whole scope.
    """
    by = lambda df, *keys: df.select(*keys, F.col("id").alias("fact_id"))
    if name == "rankings":
        return {"tool_fact_ids": by(_tools(t, f), "name")}
    if name == "patterns":
        own = t.patterns.select("pattern_hash", "kind", F.col("tool_id").alias("id")).distinct()
        return {"tool_fact_ids": by(own.join(_tools(t, f).select("id"), "id", "left_semi"), "pattern_hash", "kind")}
    facts, calls = _facts(t, everyone(f)), _tools(t, everyone(f))
    if name == "sessions":
        return {"usage_fact_ids": by(facts, "session_id"), "tool_fact_ids": by(calls, "session_id")}
    scopes = comparison_scopes(t, f)[1]
    wide = lambda df: scopes.join(df.select("session_id", "id"), "session_id").select(F.col("root").alias("session_id"), "scope", F.col("id").alias("fact_id"))
    return {"usage_fact_ids": wide(facts), "tool_fact_ids": wide(calls)}


def overview_totals(t: Tables, f: Filters = NONE) -> DataFrame:
    known = [c for k in TOKEN_FIELDS for c in (F.sum(k).alias(k), F.count(k).alias(f"{k}_known"))]
    metrics = [m for m in response_metrics()]
    cached = metrics.pop(2)
    del cached  # the category's own sum has the same name and value
    return _facts(t, f).agg(F.count("*").alias("facts"), *known, *metrics)


def overview_days(t: Tables, f: Filters = NONE) -> DataFrame:
    """Tokens of each local day (unknown times first) and bar heights relative to the largest day."""
    return _bars(_days(t, f)).orderBy("day")


def daily_bars(t: Tables, f: Filters = NONE) -> DataFrame:
    """Bar heights of known days, relative to the largest of them; unknown times have no bar and no say."""
    return _bars(_days(t, f).where("day is not null")).select("day", "height").orderBy("day")


def _days(t: Tables, f: Filters) -> DataFrame:
    return _facts(t, f).groupBy(local_day(F.col("timestamp"), f.timezone).alias("day")).agg(F.sum("total_tokens").alias("total_tokens"))


def _bars(days: DataFrame) -> DataFrame:
    tokens = F.coalesce("total_tokens", F.lit(0))
    largest = F.greatest(F.max(tokens).over(Window.partitionBy(F.lit(0))), F.lit(1))
    return days.withColumn("height", 140 * tokens / largest)


def overview_sources(t: Tables) -> DataFrame:
    return t.sources.groupBy("disposition").agg(F.count("*").alias("sources"))


def overview_gaps(t: Tables) -> DataFrame:
    return t.gaps.groupBy("code").agg(F.count("*").alias("intervals"))


def overview_bounds(t: Tables) -> DataFrame:
    return t.records.agg(F.min("timestamp").alias("first_record"), F.max("timestamp").alias("last_record"))


def overview_attribution(t: Tables, f: Filters = NONE) -> DataFrame:
    """By model and method; a model that is called unknown stays apart from unknown models."""
    rows = _facts(t, f).groupBy(F.col("model").alias("raw"), "method").agg(F.count("*").alias("facts"), F.sum("total_tokens").alias("total_tokens"))
    return rows.select(F.coalesce("raw", F.lit("unknown")).alias("model"), "method", "facts", "total_tokens").orderBy(F.desc_nulls_last("total_tokens"), "model", "method")


def unknown_sessions(t: Tables) -> DataFrame:
    local = t.sessions.where(F.coalesce("host_kind", F.lit("local")) == "local")
    facts = t.usage_facts.select(F.col("session_id").alias("_s"))
    return local.join(facts, local.id == facts._s, "left_anti").agg(F.count("*").alias("unknown_sessions"))


def usage_summary(t: Tables, root: str, descendants: bool = False) -> DataFrame:
    """Totals of a session's scope, each with the number of facts that know it."""
    scope = scope_of(t.edges, Filters(session=root, scope="descendants" if descendants else "own"))
    facts = t.usage_facts.join(scope, "session_id", "left_semi")
    known = [c for k in TOKEN_FIELDS for c in (F.sum(k).alias(k), F.count(k).alias(f"{k}_known_facts"))]
    total = facts.agg(F.count("*").alias("facts"), F.count_distinct("session_id").alias("sessions_with_reported_usage"), *known, F.coalesce(flag_sum(F.col("method") == "unallocated_historical"), F.lit(0)).alias("unallocated_facts"))
    gaps = t.gaps.join(scope, "session_id", "left_semi").agg(F.count("*").alias("accounting_gaps"))
    sized = scope.agg(F.count("*").alias("sessions_in_scope"))
    return total.crossJoin(gaps).crossJoin(sized).withColumn("scope", F.lit("unique_descendants" if descendants else "own_thread"))


def filter_domains(t: Tables) -> DataFrame:
    """The models and projects that filters can name."""
    one = lambda kind, c: t.usage_facts.select(F.lit(kind).alias("kind"), c.alias("value")).unionByName(t.tool_calls.select(F.lit(kind).alias("kind"), c.alias("value"))).where("value is not null")
    return one("model", F.col("model")).unionByName(one("project", F.col("project"))).distinct().orderBy("kind", "value")
