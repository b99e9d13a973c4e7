"""Registered queries over the fixture tables, and the same in SQL for an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import exprs
from ledgerspark.operators import datasets as ds
from ledgerspark.operators import enrich, export, graph, inspect_sources, ledger, merge, pages, records, tools
from ledgerspark.operators.filters import Filters, project_keys
from ledgerspark.schema import ROUGH_METHOD, TOKEN_FIELDS

from . import fixtures
from .fixtures import load, oracle, prepared

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

RETRY_SECONDS = 3 * 86400
COUNTERS = {"input_tokens": "input_tokens", "output_tokens": "output_tokens"}
LONDON = Filters(timezone="Europe/London", start="2026-03-29", end="2026-03-29")
SALT = "salt"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = oracle(sql)
        return f

    return add


def tables(spark: SparkSession, sf_dir: str) -> ds.Tables:
    """The fixture tables; DataFrames are lazy, so unused ones cost nothing."""
    get = lambda n: load(spark, sf_dir, n)
    kept = lambda n, make: prepared(spark, sf_dir, n) if prepared(spark, sf_dir, n) is not None else make()
    calls = get("fx_tool_calls")
    observed = get("fx_observations")
    return ds.Tables(
        usage_facts=get("fx_usage_facts"), tool_calls=calls, sessions=get("fx_sessions"), edges=get("fx_edges"), projects=get("fx_projects"), labels=get("fx_labels"),
        gaps=kept("gaps", lambda: ledger.window_gaps(ledger.window_ledger(observed, COUNTERS))), patterns=kept("patterns", lambda: tools.retries(calls.withColumn("pattern_kind", F.lit("exact_arguments")), RETRY_SECONDS)),
        project_keys=prepared(spark, sf_dir, "project_keys"), records=observed, events=None)


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Write the canonical tables that an import leaves: facts, calls, gaps, patterns, project keys."""
    fixtures.prepare(spark, sf_dir)
    t = tables(spark, sf_dir)
    fixtures.keep(spark, sf_dir, "gaps", t.gaps)
    fixtures.keep(spark, sf_dir, "patterns", t.patterns)
    paths = t.usage_facts.select("project").unionByName(t.tool_calls.select("project")).select(F.col("project").alias("path"))
    fixtures.keep(spark, sf_dir, "project_keys", project_keys(t.projects, paths))


# --- SQL pieces -----------------------------------------------------------------------------------

PROJECT = "coalesce((select arg_max(p.id, length(p.root)) from fx_projects p where {t}.project = p.root or starts_with({t}.project, p.root || '/')), {t}.project, 'unknown')"
ROUGH = "(result_characters + 3) // 4"
NONCACHED = "case when input_tokens >= cached_input_tokens then input_tokens - cached_input_tokens end"
METRICS = f"""sum(cast(method = 'reported_response' as int))::bigint recorded_responses, sum(cast(method <> 'reported_response' as int))::bigint other_usage_intervals,
 sum(cached_input_tokens)::bigint cached_input_tokens, sum({NONCACHED})::bigint noncached_input_tokens, count({NONCACHED}) noncached_known_facts"""
LEDGER = """
v as (select *, (input_tokens is not null or output_tokens is not null) and coalesce(input_tokens >= 0, true) and coalesce(output_tokens >= 0, true) ok from fx_observations),
l as (select *, lag(record_id) over w pr, lag(timestamp) over w pt, lag(model) over w pm, lag(input_tokens) over w pi, lag(output_tokens) over w po, row_number() over w n
  from v window w as (partition by session_id, ok order by ordinal)),
d as (select *, case when pr is null then input_tokens else input_tokens - pi end di, case when pr is null then output_tokens else output_tokens - po end do_, false zero from l),
u as (select *, max(case when coalesce(di < 0, false) or coalesce(do_ < 0, false) then n end) over w lastdrop, max(case when zero then n end) over w lastzero
  from d window w as (partition by session_id, ok order by n rows unbounded preceding)),
o as (select *, ok and (coalesce(di < 0, false) or coalesce(do_ < 0, false)) also_decrease, case when not ok then 'null_or_invalid_cumulative' when inherited then 'inherited_cumulative_unallocated'
  when coalesce(lastdrop, 0) > coalesce(lastzero, 0) then 'unresolved_epoch_interval' when not (coalesce(di <> 0, false) or coalesce(do_ <> 0, false) or pr is null) then null
  when di < 0 or do_ < 0 then 'invalid_usage_categories' when di is null and do_ is null then 'unknown_usage_categories' when pr is null then 'unallocated_historical' else 'reported_cumulative_delta' end outcome from u),
gaps as (select session_id, record_id, outcome code from o where outcome is not null and outcome not in ('unallocated_historical', 'reported_cumulative_delta')
  union all select session_id, record_id, 'unresolved_counter_decrease' from o where also_decrease)"""
RETRIES = f"""r as (select pattern_hash, id tool_id, 'exact_arguments' kind, session_id, lag(id) over w previous_tool_id,
  cast(coalesce(lag(status) over w = 'failed' and epoch_us(timestamp) - epoch_us(lag(timestamp) over w) between 0 and {RETRY_SECONDS * 1_000_000}, false) as int) likely_retry
  from fx_tool_calls window w as (partition by session_id, pattern_hash order by coalesce(cast(timestamp as varchar), ''), id))"""
BELOW = "below(root, node) as (select parent_id, parent_id from fx_edges union select child_id, child_id from fx_edges union select b.root, e.child_id from below b join fx_edges e on e.parent_id = b.node)"


# --- rankings, usage, tools, results --------------------------------------------------------------


def _rankings(sort: str) -> None:
    sql = f"""select name, count(*) calls, sum(cast(status = 'failed' as int))::bigint failures, sum(cast(status in ('unknown', 'unknown_outcome', 'pending') as int))::bigint unknown_outcomes,
      sum(duration_ms)::bigint duration_ms, count(duration_ms) durations_known, sum(result_bytes)::bigint result_bytes, sum(result_tokens)::bigint estimated_result_tokens, count(result_tokens) result_estimates_known,
      sum({ROUGH})::bigint rough_result_tokens, count({ROUGH}) rough_results_known, '{ROUGH_METHOD}' rough_estimate_method from fx_tool_calls group by name order by {sort} desc nulls last, name limit 100"""
    query(f"rankings_{sort}", sql)(lambda spark, d: ds.rankings(tables(spark, d), Filters(sort=sort)))


for _sort in ("calls", "failures", "duration_ms", "result_bytes", "rough_result_tokens"):
    _rankings(_sort)


def _usage_sql(cond: str) -> str:
    return f"""select * from (select id, session_id, cast(null as varchar) turn_id, timestamp, cast(null as timestamp) interval_start, cast(null as timestamp) interval_end, coalesce(f.model, 'unknown') model,
      {PROJECT.format(t="f")} project, {", ".join(TOKEN_FIELDS)}, method, cast(null as varchar) coverage, {NONCACHED} noncached_input_tokens, cast(record_id as varchar) provenance_ids from fx_usage_facts f) where {cond}
      order by timestamp desc nulls last, id"""


@query("usage_rows_dst_day", _usage_sql("timestamp >= '2026-03-29 00:00:00' and timestamp < '2026-03-29 23:00:00'"))
def _(spark, d):
    return ds.usage(tables(spark, d), LONDON, None)


@query("usage_rows_model_unknown", _usage_sql("model = 'unknown'"))
def _(spark, d):
    return ds.usage(tables(spark, d), Filters(model="unknown"), None)


@query("usage_rows_project", _usage_sql("project = 'nested'"))
def _(spark, d):
    return ds.usage(tables(spark, d), Filters(project="nested"), None)


def _tools_sql(order: str, tail: str) -> str:
    null = lambda n, t="varchar": f"cast(null as {t}) {n}"
    return f"""select id, session_id, {null("native_id")}, name, timestamp, {null("completed_at", "timestamp")}, status, duration_ms, {null("wall_ms", "double")}, {null("argument_bytes", "bigint")}, result_bytes,
      {null("argument_tokens", "bigint")}, result_tokens, {null("estimate_method")}, {null("completeness")}, {null("level")}, {null("coverage")}, {null("rough_argument_tokens", "bigint")}, {ROUGH} rough_result_tokens,
      '{ROUGH_METHOD}' rough_estimate_method, coalesce(model, 'unknown') model, {PROJECT.format(t="t")} project, cast(record_id as varchar) provenance_ids from fx_tool_calls t order by {order} {tail}"""


@query("tools_rows", _tools_sql("timestamp desc nulls last, id", "limit 100"))
def _(spark, d):
    return ds.tools(tables(spark, d))


@query("results_topk", _tools_sql("result_bytes desc nulls last, id", "limit 25"))
def _(spark, d):
    return ds.results(tables(spark, d), limit=25)


@query("results_page2", _tools_sql("result_bytes desc nulls last, id", "limit 25 offset 25"))
def _(spark, d):
    return ds.results(tables(spark, d), limit=25, offset=25)


# --- patterns -------------------------------------------------------------------------------------

PATTERNS = f"""with {RETRIES}, q as (select r.pattern_hash, r.kind, count(*) occurrences, count(distinct t.session_id) sessions, sum(r.likely_retry)::bigint likely_retries, min(t.timestamp) first_seen, max(t.timestamp) last_seen
  from r join fx_tool_calls t on t.id = r.tool_id group by 1, 2 having count(*) > 1)"""


@query("patterns_repeated", PATTERNS + " select * from q")
def _(spark, d):
    return ds.patterns(tables(spark, d), limit=None)


@query("patterns_order", PATTERNS + " select row_number() over (order by occurrences desc, pattern_hash) as place, pattern_hash, occurrences from q order by place limit 10")
def _(spark, d):
    top = ds.patterns(tables(spark, d), limit=10)
    return top.select("pattern_hash", "occurrences").withColumn("place", F.row_number().over(ds.Window.orderBy(F.desc("occurrences"), "pattern_hash")).cast("bigint")).select("place", "pattern_hash", "occurrences")


@query("pattern_drilldown", f"""with {RETRIES} select t.id, t.session_id, t.name, t.timestamp, t.status, r.kind, r.likely_retry, r.previous_tool_id, cast(t.record_id as varchar) provenance_ids from r join fx_tool_calls t on t.id = r.tool_id
  where r.pattern_hash = sha256('click:1') order by t.timestamp desc, t.id limit 500""")
def _(spark, d):
    import hashlib

    return ds.pattern_occurrences(tables(spark, d), hashlib.sha256(b"click:1").hexdigest())


@query("likely_retries", f"with {RETRIES} select * from r")
def _(spark, d):
    return tables(spark, d).patterns


# --- sessions, timeline, comparisons, overview ----------------------------------------------------


def _sessions_sql(cond: str, keep: str) -> str:
    return f"""with {LEDGER}, f as (select *, {PROJECT.format(t="x")} pk from fx_usage_facts x), t as (select *, {PROJECT.format(t="y")} pk from fx_tool_calls y),
    us as (select session_id, count(*) facts, sum(total_tokens)::bigint reported_total_tokens, sum(input_tokens)::bigint input_tokens, sum(output_tokens)::bigint output_tokens, {METRICS}, sum(cast(method = 'unallocated_historical' as int))::bigint unallocated_facts from f where {cond} group by 1),
    tl as (select session_id, count(*) tool_calls, sum(cast(status = 'failed' as int))::bigint failures, sum(duration_ms)::bigint duration_ms, sum(result_bytes)::bigint result_bytes from t where {cond} group by 1)
    select s.id session_id, label, cwd, coverage, facts, reported_total_tokens, input_tokens, output_tokens, recorded_responses, other_usage_intervals, cached_input_tokens, noncached_input_tokens, noncached_known_facts, unallocated_facts,
      tool_calls, failures, duration_ms, result_bytes, (select count(*) from gaps g where g.session_id = s.id) accounting_gaps
    from fx_sessions s left join us on us.session_id = s.id left join tl on tl.session_id = s.id left join fx_labels b on b.session_id = s.id where {keep}"""


@query("sessions_overview", _sessions_sql("true", "true"))
def _(spark, d):
    return ds.sessions(tables(spark, d), limit=None)


@query("sessions_filtered", _sessions_sql("coalesce(model, 'unknown') = 'beta' and pk = 'proj1'", "us.session_id is not null or tl.session_id is not null"))
def _(spark, d):
    return ds.sessions(tables(spark, d), Filters(model="beta", project="proj1"), None)


@query("sessions_metadata_only", _sessions_sql("session_id = 'm4'", "s.id = 'm4'"))
def _(spark, d):
    return ds.sessions(tables(spark, d), Filters(session="m4"), None)


@query("sessions_order", f"with z as (select s.id, (select sum(total_tokens)::bigint from fx_usage_facts f where f.session_id = s.id) n from fx_sessions s) select row_number() over (order by n desc nulls last, id) as place, id session_id, n reported_total_tokens from z order by place limit 20")
def _(spark, d):
    top = ds.sessions(tables(spark, d), limit=20).select("session_id", "reported_total_tokens")
    return top.withColumn("place", F.row_number().over(ds.Window.orderBy(F.desc_nulls_last("reported_total_tokens"), "session_id")).cast("bigint")).select("place", "session_id", "reported_total_tokens")


@query("timeline_all", """with c as (select record_id id, 'task_started' kind, session_id, timestamp, record_id from fx_observations)
 select timestamp, session_id, 'usage' kind, method description, total_tokens reported_tokens, id fact_id, cast(record_id as varchar) provenance_ids from fx_usage_facts
 union all select timestamp, session_id, 'tool', name, null, id, cast(record_id as varchar) from fx_tool_calls
 union all select timestamp, session_id, 'context', kind, null, cast(id as varchar), cast(record_id as varchar) from c""")
def _(spark, d):
    t = tables(spark, d)
    seen = t.records.select(F.col("record_id").alias("id"), F.lit("task_started").alias("kind"), "session_id", "timestamp", "model", F.lit(None).cast("string").alias("project"), "record_id")
    t.events = seen
    return ds.timeline(t, limit=None)


def _comparisons_sql(roots: str) -> str:
    return f"""with recursive {BELOW}, {LEDGER}, chosen as ({roots}),
    sc as (select root, 'own_thread' as scope, root session_id from chosen union all select c.root, 'unique_descendants', b.node from chosen c join (select * from below union select root, root from chosen) b on b.root = c.root),
    f as (select root, scope, {METRICS}, sum(input_tokens)::bigint input_tokens, sum(output_tokens)::bigint output_tokens, sum(total_tokens)::bigint reported_total_tokens, count(*) reported_facts, count(total_tokens) facts_with_known_total from sc join fx_usage_facts using (session_id) group by 1, 2),
    t as (select root, scope, count(*) calls, sum(cast(status = 'failed' as int))::bigint failures, sum(duration_ms)::bigint duration_ms, sum(result_bytes)::bigint result_bytes from sc join fx_tool_calls using (session_id) group by 1, 2),
    g as (select root, scope, count(*) n from sc join gaps using (session_id) group by 1, 2), z as (select root, scope, count(distinct session_id) sessions_in_scope from sc group by 1, 2)
    select z.root session_id, label, z.scope, sessions_in_scope, recorded_responses, other_usage_intervals, cached_input_tokens, noncached_input_tokens, coalesce(noncached_known_facts, 0) noncached_known_facts, input_tokens, output_tokens,
      reported_total_tokens, coalesce(reported_facts, 0) reported_facts, coalesce(facts_with_known_total, 0) facts_with_known_total, coalesce(calls, 0) calls, failures, duration_ms, result_bytes, coalesce(g.n, 0) accounting_gaps_all_dates,
      case when coalesce(reported_facts, 0) > 0 then 'known subtotal; inspect accounting gaps' else 'unknown usage' end coverage
    from z left join f using (root, scope) left join t using (root, scope) left join g using (root, scope) left join fx_labels b on b.session_id = z.root"""


@query("comparisons_top5", _comparisons_sql("select session_id root from fx_usage_facts group by 1 order by sum(total_tokens) desc nulls last, 1 limit 5"))
def _(spark, d):
    return ds.comparisons(tables(spark, d), limit=None)


@query("comparisons_selected", _comparisons_sql("select unnest(['s0', 's5', 'm1']) root"))
def _(spark, d):
    return ds.comparisons(tables(spark, d), Filters(session="s0, s5, m1"), None)


KNOWN = ", ".join(f"sum({k})::bigint {k}, count({k}) {k}_known" for k in TOKEN_FIELDS)


@query("overview_totals", f"select count(*) facts, {KNOWN}, sum(cast(method = 'reported_response' as int))::bigint recorded_responses, sum(cast(method <> 'reported_response' as int))::bigint other_usage_intervals, sum({NONCACHED})::bigint noncached_input_tokens, count({NONCACHED}) noncached_known_facts from fx_usage_facts where timestamp >= '2026-03-29 00:00:00' and timestamp < '2026-03-29 23:00:00'")
def _(spark, d):
    return ds.overview_totals(tables(spark, d), LONDON)


DAYS = "with q as (select cast((timestamp at time zone 'UTC') at time zone 'Europe/London' as date) as day, sum(total_tokens)::bigint total_tokens from fx_usage_facts group by 1)"


@query("overview_days", DAYS + " select day, total_tokens, 140 * coalesce(total_tokens, 0) / greatest(max(coalesce(total_tokens, 0)) over (), 1) height from q")
def _(spark, d):
    return ds.overview_days(tables(spark, d), Filters(timezone="Europe/London"))


@query("daily_bars", DAYS + " select day, 140 * coalesce(total_tokens, 0) / greatest(max(coalesce(total_tokens, 0)) over (), 1) height from q where day is not null")
def _(spark, d):
    return ds.daily_bars(tables(spark, d), Filters(timezone="Europe/London"))


@query("overview_attribution", "select coalesce(model, 'unknown') model, method, count(*) facts, sum(total_tokens)::bigint total_tokens from fx_usage_facts group by fx_usage_facts.model, method")
def _(spark, d):
    return ds.overview_attribution(tables(spark, d))


@query("overview_gaps", f"with {LEDGER} select code, count(*) intervals from gaps group by code")
def _(spark, d):
    return ds.overview_gaps(tables(spark, d))


@query("overview_sources", "select case when doc_id % 7 = 0 then 'failed' when doc_id % 11 = 0 then 'unavailable' else 'imported' end disposition, count(*) sources from documents group by 1")
def _(spark, d):
    t = tables(spark, d)
    t.sources = load(spark, d, "documents").select(F.when(F.col("doc_id") % 7 == 0, "failed").when(F.col("doc_id") % 11 == 0, "unavailable").otherwise("imported").alias("disposition"))
    return ds.overview_sources(t)


@query("overview_bounds", "select min(timestamp) first_record, max(timestamp) last_record from fx_observations")
def _(spark, d):
    return ds.overview_bounds(tables(spark, d))


@query("overview_unknown_sessions", "select count(*) unknown_sessions from fx_sessions s where coalesce(host_kind, 'local') = 'local' and not exists (select 1 from fx_usage_facts f where f.session_id = s.id)")
def _(spark, d):
    return ds.unknown_sessions(tables(spark, d))


def _summary_sql(scope: str, name: str) -> str:
    known = ", ".join(f"sum({k})::bigint {k}, count({k}) {k}_known_facts" for k in TOKEN_FIELDS)
    return f"""with recursive {BELOW}, {LEDGER}, sc as ({scope}) select count(*) facts, count(distinct session_id) sessions_with_reported_usage, {known}, coalesce(sum(cast(method = 'unallocated_historical' as int)), 0)::bigint unallocated_facts,
      (select count(*) from gaps where session_id in (select node from sc)) accounting_gaps, (select count(*) from sc) sessions_in_scope, '{name}' as scope from fx_usage_facts where session_id in (select node from sc)"""


@query("usage_summary_own", _summary_sql("select 's3' node", "own_thread"))
def _(spark, d):
    return ds.usage_summary(tables(spark, d), "s3")


@query("usage_summary_descendants", _summary_sql("select distinct node from below where root = 's3'", "unique_descendants"))
def _(spark, d):
    return ds.usage_summary(tables(spark, d), "s3", True)


@query("filter_domains", "select distinct kind, value from (select 'model' kind, model as value from fx_usage_facts union all select 'model', model from fx_tool_calls union all select 'project', project from fx_usage_facts union all select 'project', project from fx_tool_calls) where value is not null")
def _(spark, d):
    return ds.filter_domains(tables(spark, d))


# --- graph ----------------------------------------------------------------------------------------


@query("session_scope", f"with recursive {BELOW} select root, node from below where root in ('s0', 's1', 's9', 's27')")
def _(spark, d):
    roots = spark.createDataFrame([("s0",), ("s1",), ("s9",), ("s27",)], "root string")
    return graph.reach(load(spark, d, "fx_edges"), roots)


@query("session_ancestors", f"with recursive {BELOW} select node session, root ancestor from below where node <> root and node in (select child_id from fx_edges)")
def _(spark, d):
    edges = load(spark, d, "fx_edges")
    return graph.ancestors(edges, edges.select(F.col("child_id").alias("session")))


SYMMETRIC = "both_(a, b) as (select parent_id, child_id from fx_edges union select child_id, parent_id from fx_edges)"


@query("related_sessions", f"with recursive {SYMMETRIC}, rel(session) as (select 's28' union select b from both_ join rel on a = session) select session from rel")
def _(spark, d):
    return graph.related(load(spark, d, "fx_edges"), spark.createDataFrame([("s28",)], "session string"))


@query("dirty_closure", f"with recursive {SYMMETRIC}, rel(session) as (select distinct session_id from fx_usage_facts where total_tokens % 97 = 0 union select b from both_ join rel on a = session) select session from rel")
def _(spark, d):
    dirty = load(spark, d, "fx_usage_facts").where("total_tokens % 97 = 0").select(F.col("session_id").alias("session")).distinct()
    return graph.related(load(spark, d, "fx_edges"), dirty)


@query("components", f"with recursive {SYMMETRIC}, rel(n, m) as (select a, a from both_ union select n, b from rel join both_ on a = m) select n session, min(m) component from rel group by n")
def _(spark, d):
    return graph.components(load(spark, d, "fx_edges"))


# --- ledger ---------------------------------------------------------------------------------------


def _ledger(spark, d) -> DataFrame:
    return ledger.window_ledger(load(spark, d, "fx_observations"), COUNTERS)


FACTS = "outcome in ('unallocated_historical', 'reported_cumulative_delta')"
OWN = "case when outcome <> 'unallocated_historical' then {} end"
MODEL = OWN.format("case when pr is null or pm = model then model end")


@query("ledger_facts", f"with {LEDGER} select session_id, record_id, {OWN.format('timestamp')} as timestamp, pt interval_start, timestamp interval_end, {MODEL} model, outcome as method, di input_tokens, do_ output_tokens from o where {FACTS}")
def _(spark, d):
    return ledger.window_facts(_ledger(spark, d), COUNTERS)


@query("ledger_gaps", f"with {LEDGER} select * from gaps")
def _(spark, d):
    return ledger.window_gaps(_ledger(spark, d))


@query("ledger_gap_counts", f"with {LEDGER} select session_id, code, count(*) gaps from gaps group by 1, 2")
def _(spark, d):
    return ledger.window_gaps(_ledger(spark, d)).groupBy("session_id", "code").agg(F.count("*").alias("gaps"))


@query("ledger_subtotals", f"with {LEDGER} select session_id, outcome as method, count(*) facts, sum(di)::bigint input_tokens, count(di) input_known, sum(do_)::bigint output_tokens, count(do_) output_known from o where {FACTS} group by 1, 2")
def _(spark, d):
    rows = ledger.window_facts(_ledger(spark, d), COUNTERS)
    return rows.groupBy("session_id", "method").agg(F.count("*").alias("facts"), F.sum("input_tokens").alias("input_tokens"), F.count("input_tokens").alias("input_known"), F.sum("output_tokens").alias("output_tokens"), F.count("output_tokens").alias("output_known"))


RESPONSES = "select native_id, arg_max(session_id, record_id) session_id, arg_max(total_tokens, record_id) total_tokens, arg_max(generation_id, record_id) generation_id, max(record_id) record_id, case when count(distinct model) <= 1 then arg_max(model, case when model is not null or true then record_id end) end model, count(distinct (session_id || ':' || total_tokens)) > 1 conflict, count(*) copies from fx_responses group by 1"


@query("response_facts", f"with q as ({RESPONSES}), b as (select native_id, model bm, row_number() over (partition by native_id order by record_id desc) n from fx_responses), m as (select native_id, count(distinct model) k from fx_responses group by 1) select q.native_id, session_id, total_tokens, record_id, case when k <= 1 then bm end model, copies from q join b on b.native_id = q.native_id and n = 1 join m on m.native_id = q.native_id where not conflict")
def _(spark, d):
    return ledger.responses(load(spark, d, "fx_responses")).where("not conflict").select("native_id", "session_id", "total_tokens", "record_id", "model", "copies")


@query("response_conflicts", f"with q as ({RESPONSES}) select r.native_id, r.record_id, 'conflicting_response_usage' code from fx_responses r join q using (native_id) where conflict")
def _(spark, d):
    found = ledger.responses(load(spark, d, "fx_responses")).where("conflict")
    return found.select("native_id", F.explode("refs").alias("record_id"), F.lit("conflicting_response_usage").alias("code"))


# Counters say what responses said, so they add no fact where responses count; where copies of responses
# contradict each other, none counts, and the counters' steps are the facts.
LAGGING = """with c as (select native_id from fx_responses group by 1 having count(distinct total_tokens) > 1),
 a as (select native_id, session_id, max(total_tokens) n from fx_responses where native_id not in (select native_id from c) group by 1, 2),
 s as (select session_id, total_tokens n, row_number() over (partition by session_id order by record_id) k from fx_responses where generation_id = 1 and native_id in (select native_id from c)),
 f as (select session_id, 'reported_response' as method, n from a union all select session_id, case k when 1 then 'unallocated_historical' else 'reported_cumulative_delta' end, n from s where n > 0)
 select 'fact' as kind, session_id, method, cast(null as varchar) code, cast(null as bigint) record_id, n input_tokens, cast(null as bigint) cached_input_tokens, cast(null as bigint) cache_write_input_tokens, cast(0 as bigint) output_tokens, cast(null as bigint) reasoning_output_tokens, n total_tokens from f
 union all select 'gap', session_id, null, 'conflicting_response_usage', record_id, null, null, null, null, null, null from fx_responses where native_id in (select native_id from c)"""


@query("ledger_with_responses", LAGGING)
def _(spark, d):
    """Counters that lag behind responses."""
    text = lambda *pairs: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in pairs])
    n = F.col("total_tokens").cast("string")
    own = text('{"usage":{"input_tokens":', n, ',"output_tokens":0,"total_tokens":', n, "}}")
    base = load(spark, d, "fx_responses")
    seen = base.select("record_id", F.lit("response_usage").alias("kind"), "session_id", "native_id", "model", own.alias("data_json"), F.col("record_id").alias("ordinal"), "generation_id")
    run = F.sum("total_tokens").over(ds.Window.partitionBy("session_id").orderBy("record_id")).cast("string")
    counter = base.where("generation_id = 1").withColumn("run", run)
    total = text('{"total_token_usage":{"input_tokens":', F.col("run"), ',"output_tokens":0,"total_tokens":', F.col("run"), "}}")
    later = counter.select((F.col("record_id") + 5_000_000).alias("record_id"), F.lit("cumulative_usage").alias("kind"), "session_id", F.lit(None).cast("string").alias("native_id"), "model", total.alias("data_json"), F.col("record_id").alias("ordinal"), "generation_id")
    rows = seen.unionByName(later)
    rows = rows.select("*", F.lit(None).cast("string").alias("turn_id"), F.date_format(F.timestamp_seconds(F.lit(1_780_000_000) + F.col("ordinal") % 1_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit(None).cast("string").alias("project"), F.lit(0).alias("superseded"),
        F.lit(None).cast("bigint").alias("source_id"), F.lit(None).cast("bigint").alias("byte_start"), F.lit(None).cast("string").alias("digest"), F.lit(6).alias("parser_version"))
    return ledger.build(rows).select("kind", "session_id", "method", "code", "record_id", *TOKEN_FIELDS)


def _observed(rows: DataFrame) -> DataFrame:
    """Columns of observations that a fixture doesn't set."""
    rest = {"turn_id": "string", "project": "string", "native_id": "string", "source_id": "bigint", "byte_start": "bigint", "digest": "string", "superseded": "int", "parser_version": "int"}
    return rows.withColumns({c: F.lit(0 if c in ("superseded", "parser_version") else None).cast(t) for c, t in rest.items() if c not in rows.columns})


def _at(seconds: F.Column) -> F.Column:
    return F.date_format(F.timestamp_seconds(F.lit(1_780_000_000) + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


OFFSET = 1_000_000_000
OFFSETS = f"""select session_id, 'unallocated_historical' as method, cast(null as varchar) code, {OFFSET} total_tokens, 1 tokens_of from (select distinct session_id from fx_responses where generation_id = 1)
 union all select session_id, 'reported_response', null, total_tokens, 1 from fx_responses where generation_id = 1"""


@query("ledger_offset", OFFSETS)
def _(spark, d):
    """Counters that began before responses did: the second counter shows by how much, and from then on each
    counter comes after the response that follows the one it tells of.  No step is counted twice, none is a gap."""
    base = load(spark, d, "fx_responses").where("generation_id = 1")
    w = ds.Window.partitionBy("session_id").orderBy("record_id")
    base = base.withColumn("k", F.row_number().over(w)).withColumn("run", F.sum("total_tokens").over(w))
    vector = lambda n: F.struct(n.cast("bigint").alias("input_tokens"), F.lit(0).cast("bigint").alias("output_tokens"), n.cast("bigint").alias("total_tokens"))
    said = base.select("record_id", F.lit("response_usage").alias("kind"), "session_id", "native_id", "model", F.to_json(F.struct(vector(F.col("total_tokens")).alias("usage"), vector(F.col("run")).alias("thread_token_usage"))).alias("data_json"), F.col("k").cast("bigint").alias("ordinal"), F.concat(F.lit("r"), F.col("k").cast("string")).alias("turn_id"), _at(10 * F.col("k")).alias("timestamp"))
    late = F.when(F.col("k") == 1, 15).otherwise(10 * (F.col("k") + 1) + 5)
    shown = lambda rows, n, k, at, time: rows.select((F.col("record_id") + at).alias("record_id"), F.lit("cumulative_usage").alias("kind"), "session_id", "model", F.to_json(F.struct(vector(F.lit(OFFSET) + n).alias("total_token_usage"))).alias("data_json"), k.cast("bigint").alias("ordinal"), F.lit("c").alias("turn_id"), _at(time).alias("timestamp"))
    counters = shown(base, F.col("run"), F.col("k"), 5_000_000, late)
    begin = shown(base.where("k = 1"), F.lit(0), F.lit(0), 9_000_000, F.lit(0))
    rows = _observed(said.unionByName(counters.unionByName(begin), allowMissingColumns=True).withColumn("generation_id", F.lit(1).cast("bigint")))
    return ledger.build(rows).select("session_id", "method", "code", "total_tokens", F.lit(1).alias("tokens_of"))


TWO_STREAMS = f"""with {LEDGER}, p as (select *, case when row_number() over (partition by session_id order by ordinal) = 1 then record_id else record_id + 10000000 end rid from o)
 select 'fact' as kind, session_id, outcome as method, cast(null as varchar) code, cast(null as bigint) record_id, di input_tokens, do_ output_tokens from p where outcome in ('unallocated_historical', 'reported_cumulative_delta')
 union all select 'gap', session_id, null, outcome, rid, null, null from p where outcome is not null and outcome not in ('unallocated_historical', 'reported_cumulative_delta')
 union all select 'gap', session_id, null, 'unresolved_counter_decrease', rid, null, null from p where also_decrease"""


@query("ledger_two_streams", TWO_STREAMS)
def _(spark, d):
    """Two copies of every counter, of which one lacks the first row and the other the last: laid over each other
    they are the whole history, once."""
    w = ds.Window.partitionBy("session_id")
    base = load(spark, d, "fx_observations").withColumn("k", F.row_number().over(w.orderBy("ordinal"))).withColumn("n", F.count("*").over(w))
    vector = F.struct("input_tokens", "output_tokens")
    data = F.struct(F.when(F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull(), vector).alias("total_token_usage"), F.when(F.col("inherited"), F.lit("p")).alias("parent"))
    base = base.select("k", "n", "record_id", "session_id", "ordinal", "model", F.lit("t").alias("turn_id"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.to_json(data).alias("data_json"), F.lit("cumulative_usage").alias("kind"))
    # both copies in one pass
    copies = base.withColumn("generation_id", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))).where("generation_id = 1 and (k < n or n = 1) or generation_id = 2 and k > 1")
    copies = copies.withColumn("record_id", F.col("record_id") + F.when(F.col("generation_id") == 2, 10_000_000).otherwise(0))
    found = ledger.build(_observed(copies.drop("k", "n")))
    return found.select("kind", "session_id", "method", "code", "record_id", "input_tokens", "output_tokens")


@query("physical_merge", "select source_id, byte_start, digest, arg_max(record_id, parser_version * 100000000 + record_id) record_id, max(parser_version) parser_version, arg_max(owner, parser_version * 100000000 + record_id) as owner, count(*) copies from fx_record_copies group by 1, 2, 3")
def _(spark, d):
    rows = ledger.physical_merge(load(spark, d, "fx_record_copies"), ["source_id", "byte_start", "digest"])
    return rows.withColumn("copies", F.size("refs").cast("bigint")).drop("refs")


@query("current_interpretations", "select source_id, byte_start, digest, max(record_id) record_id from fx_record_copies group by 1, 2, 3")
def _(spark, d):
    return ledger.latest(load(spark, d, "fx_record_copies"), ["source_id", "byte_start", "digest"])


@query("primary_stream_choice", """with g as (select session_id, ordinal % 2 as generation, count(*) n, min(record_id) first_record from fx_observations group by 1, 2)
 select session_id, generation, n, first_record from (select *, row_number() over (partition by session_id order by cast(generation = 0 as int) desc, n desc, first_record desc) place from g) where place = 1""")
def _(spark, d):
    rows = load(spark, d, "fx_observations").withColumn("generation", F.col("ordinal") % 2).withColumn("superseded", (F.col("generation") != 0).cast("int"))
    return merge.primary_stream(rows, "generation").select("session_id", "generation", "n", "first_record")


# --- tools ----------------------------------------------------------------------------------------


def _tool_events(spark, d) -> DataFrame:
    rows = load(spark, d, "fx_tool_events")
    null = lambda kind: F.lit(None).cast(kind)
    size = F.struct(F.col("result_bytes").alias("bytes"), null("bigint").alias("characters"), null("bigint").alias("tokens"), null("string").alias("method"), null("string").alias("completeness"))
    data = F.struct("name", null("string").alias("tool"), null("string").alias("server"), null("string").alias("namespace"), F.lit("commandExecution").alias("type"), null("string").alias("status"), null("boolean").alias("success"), F.col("exit_code").alias("exitCode"), null("boolean").alias("explicit_error"),
        F.col("duration_ms").alias("durationMs"), null("string").alias("parent"), null("string").alias("parent_call_id"), null("string").alias("parentCallId"), null("string").alias("pattern_hash"), null("string").alias("pattern_kind"),
        null("struct<bytes:bigint,characters:bigint,tokens:bigint>").alias("argument_size"), size.alias("result_size"), null("array<struct<pattern_hash:string,pattern_kind:string>>").alias("read_patterns"))
    return rows.select("record_id", "native_id", "session_id", "timestamp", "kind", "source_id", null("string").alias("turn_id"), null("string").alias("model"), null("string").alias("project"), data.alias("d"))


NO_EDGES = "parent_id string, child_id string"
CALLS = """e as (select *, cast(kind = 'item_completed' as int) late from fx_tool_events),
 g as (select session_id, native_id, count(*) filter (kind = 'tool_call') calls, count(*) filter (kind = 'tool_output') outputs,
  arg_max(case when exit_code <> 0 then 'failed' else 'succeeded' end, late * 1000000000 + record_id) filter (kind <> 'tool_call' and exit_code is not null) verdict,
  arg_max(duration_ms, late * 1000000000 + record_id) filter (kind <> 'tool_call' and duration_ms >= 0) duration_ms,
  arg_max(result_bytes, record_id) filter (kind = 'item_completed' and result_bytes is not null) item_bytes, min(timestamp) filter (kind = 'tool_call') call_at,
  max(timestamp) filter (kind <> 'tool_call') completed_at from e group by 1, 2),
 h as (select session_id, native_id, source_id, count(*) n, max(record_id) top, case when count(result_bytes) = count(*) then sum(result_bytes)::bigint end bytes from e where kind = 'tool_output' group by 1, 2, 3),
 k as (select session_id, native_id, arg_max(coalesce(bytes, -1), n * 1000000000 + top) bytes, arg_max(n, n * 1000000000 + top) n from h group by 1, 2)"""


@query("tool_correlation", f"""with {CALLS} select native_id, session_id, coalesce(verdict, case when outputs > 0 then 'unknown_outcome' when calls > 0 then 'pending' else 'unknown' end) status, duration_ms,
  case when calls > 0 and completed_at >= call_at then (epoch_us(completed_at) - epoch_us(call_at)) / 1000 end wall_ms, completed_at from g""")
def _(spark, d):
    found = tools.correlate(_tool_events(spark, d), spark.createDataFrame([], NO_EDGES))
    return found.select("native_id", "session_id", "status", "duration_ms", "wall_ms", "completed_at")


@query("tool_chunks", f"with {CALLS} select g.native_id, g.session_id, coalesce(item_bytes, nullif(k.bytes, -1)) result_bytes, case when item_bytes is not null then 1 else coalesce(k.n, 0) end output_chunks from g left join k on k.session_id = g.session_id and k.native_id = g.native_id")
def _(spark, d):
    return tools.correlate(_tool_events(spark, d), spark.createDataFrame([], NO_EDGES)).select("native_id", "session_id", "result_bytes", "output_chunks")


@query("tool_owner_resolution", f"""with recursive {BELOW}, t as (select distinct native_id, session_id from (select concat('n', event_id % 40) native_id, concat('s', user_id % 30) session_id from events)),
 c as (select t.native_id, t.session_id, b.root candidate from t join below b on b.node = t.session_id and b.root <> t.session_id join t o on o.native_id = t.native_id and o.session_id = b.root),
 top as (select * from c where not exists (select 1 from c x join below b on b.root = x.candidate and b.node = c.candidate and b.root <> b.node where x.native_id = c.native_id and x.session_id = c.session_id)),
 one as (select native_id, session_id, min(candidate) as owner from top group by 1, 2 having count(*) = 1)
 select t.native_id, t.session_id, coalesce(one.owner, t.session_id) as owner from t left join one on one.native_id = t.native_id and one.session_id = t.session_id""")
def _(spark, d):
    rows = load(spark, d, "events").select(F.concat(F.lit("n"), F.col("event_id") % 40).alias("native_id"), F.concat(F.lit("s"), F.col("user_id") % 30).alias("session_id"))
    return tools.owners(rows, load(spark, d, "fx_edges"))


@query("fingerprints", "select event_id, 'exact_arguments' pattern_kind, sha256('salt' || chr(0) || 'exact_arguments' || chr(0) || event_type || chr(0) || props) pattern_hash from events")
def _(spark, d):
    kind, value = exprs.fingerprint(F.col("event_type"), F.col("props"), SALT)
    return load(spark, d, "events").select("event_id", kind.alias("pattern_kind"), value.alias("pattern_hash"))


SHOWN_NAMES = """with q as (select *, cast(json_extract_string(props, '$.k') as bigint) k from events),
 c as (select event_id, case when k % 8 = 0 then 'srv.' || event_type when k % 4 = 0 then event_type end as name, case when k % 3 = 0 then 'tool' || k end tool,
  case k % 5 when 0 then 'exec_command' when 1 then 'apply_patch' when 2 then 'webSearch' end typed, case k % 6 when 0 then 'srv' when 1 then '' when 2 then 'functions' end ns from q),
 p as (select event_id, ns, coalesce(name, tool, typed, 'unknown_tool') plain from c)
 select event_id, case when ns <> '' and not starts_with(plain, ns || '.') then ns || '.' || plain else plain end as name from p"""


@query("tool_display_name", SHOWN_NAMES)
def _(spark, d):
    """Names of calls of which only some have a name, a tool, a type or a namespace."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = load(spark, d, "events").withColumn("k", k).withColumns({
        "name": F.expr("case when k % 8 = 0 then concat('srv.', event_type) when k % 4 = 0 then event_type end"), "tool": F.expr("case when k % 3 = 0 then concat('tool', k) end"),
        "type": F.expr("case k % 5 when 0 then 'commandExecution' when 1 then 'fileChange' when 2 then 'webSearch' end"), "ns": F.expr("case k % 6 when 0 then 'srv' when 1 then '' when 2 then 'functions' end")})
    return rows.select("event_id", exprs.display_name(F.col("name"), F.col("tool"), F.col("type"), F.col("ns")).alias("name"))


# --- scalar functions -----------------------------------------------------------------------------


@query("measure_text", "select doc_id, cast(strlen(text) as bigint) bytes, cast(length(text) as bigint) characters, 'no_verified_local_tokenizer' as method, case when contains(lower(text), 'truncated') then 'partial' else 'retained_content' end completeness from documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", exprs.measure(F.col("text")).alias("m")).select("doc_id", "m.*")


REDACT = "text"
for _p, _r in exprs.REDACTIONS:
    REDACT = f"regexp_replace({REDACT}, '{_p.replace(chr(39), chr(39) * 2)}', '{_r.replace('$', chr(92))}', 'g')"


@query("redact_preview", f"with q as (select doc_id, concat('Bearer abc.def sk-', doc_id, ' --token \"x y\" password=', doc_id, '; ', text) as text from documents), r as (select doc_id, {REDACT} as text from q) select doc_id, case when length(text) > 2000 then left(text, 2000) || chr(10) || '[preview truncated]' else text end preview from r")
def _(spark, d):
    said = F.concat(F.lit("Bearer abc.def sk-"), "doc_id", F.lit(' --token "x y" password='), "doc_id", F.lit("; "), "text")
    return load(spark, d, "documents").select("doc_id", exprs.redact(said).alias("preview"))


@query("project_key_longest_prefix", "with roots as (select 'r' || r_regionkey id, 'https:/site' || r_regionkey || '.example' root from region union all select 'any', 'https:'), q as (select distinct regexp_extract(url, '^(.*)/', 1) path from pages where url is not null) select path, coalesce((select arg_max(id, length(root)) from roots where path = root or starts_with(path, root || '/')), path) project_key from (select distinct regexp_replace(path, '/+', '/', 'g') path from q where path <> '') where path <> ''")
def _(spark, d):
    roots = load(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.concat(F.lit("https:/site"), "r_regionkey", F.lit(".example")).alias("root")).unionByName(spark.createDataFrame([("any", "https:")], "id string, root string"))
    paths = load(spark, d, "pages").select(F.regexp_replace(F.regexp_extract("url", "^(.*)/", 1), "/+", "/").alias("path"))
    return project_keys(roots, paths)


@query("local_day_dst", "select id, cast((timestamp at time zone 'UTC') at time zone 'Europe/London' as date) as day from fx_usage_facts")
def _(spark, d):
    return load(spark, d, "fx_usage_facts").select("id", exprs.local_day(F.col("timestamp"), "Europe/London").alias("day"))


@query("wall_elapsed", "select a.id, case when b.timestamp >= a.timestamp then (epoch_us(b.timestamp) - epoch_us(a.timestamp)) / 1000 end wall_ms from fx_tool_calls a left join fx_tool_calls b on b.record_id = a.record_id + case when a.record_id % 3 = 0 then -1 else 1 end")
def _(spark, d):
    a = load(spark, d, "fx_tool_calls").select("id", "timestamp", (F.col("record_id") + F.when(F.col("record_id") % 3 == 0, -1).otherwise(1)).alias("other"))
    b = load(spark, d, "fx_tool_calls").select(F.col("record_id").alias("other"), F.col("timestamp").alias("ended"))
    return a.join(b, "other", "left").select("id", exprs.elapsed_ms(F.col("timestamp"), F.col("ended")).alias("wall_ms"))


@query("epoch_to_utc", "select event_id, strftime(make_timestamp((1780000000 + event_id) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') as from_seconds, strftime(make_timestamp((1780000000000 + event_id) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as from_millis from events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", exprs.epoch_to_utc(F.lit(1780000000) + F.col("event_id")).alias("from_seconds"), exprs.epoch_to_utc(F.lit(1780000000000) + F.col("event_id"), True).alias("from_millis"))


@query("deterministic_ids", "select id, sha256('=' || session_id || chr(0) || coalesce('=' || model, '-')) made from fx_tool_calls")
def _(spark, d):
    return load(spark, d, "fx_tool_calls").select("id", exprs.key(F.col("session_id"), F.col("model")).alias("made"))


PATHS = r"""with q as (select page_id, regexp_replace(url, '^[a-z]+:/', '') p from pages)
 select page_id, case page_id % 4 when 0 then rtrim('c:' || lower(replace(p, '/', '\')), '\') when 1 then rtrim('c:' || lower(replace(p, '/', '\')), '\')
  when 2 then rtrim('\' || lower(replace(p, '/', '\')), '\') else rtrim(regexp_replace('/' || p || '/', '/+', '/', 'g'), '/') end as path from q"""


@query("canonical_paths", PATHS)
def _(spark, d):
    """Paths of pages as Windows writes them (with a long-path prefix, slashes, or a share) and as others do."""
    p = F.regexp_replace("url", "^[a-z]+:/", "")
    back = F.replace(p, F.lit("/"), F.lit("\\"))
    kind = F.col("page_id") % 4
    made = F.when(kind == 0, F.concat(F.lit("\\\\?\\C:"), back)).when(kind == 1, F.concat(F.lit("C:"), p, F.lit("/"))).when(kind == 2, F.concat(F.lit("\\\\?\\UNC"), back)).otherwise(F.concat(F.lit("/"), p, F.lit("/")))
    return load(spark, d, "pages").select("page_id", exprs.canonical_path(made).alias("path"))


@query("strict_int_projection", "with q as (select event_id, props from events union all select * from (values (-1, '{\"k\": 1.0}'), (-2, '{\"k\": true}'), (-3, '{\"k\": \"7\"}'), (-4, '{\"k\": 7}'), (-5, 'no json')) t(event_id, props)) select event_id, case when event_id = -4 or event_id >= 0 then cast(json_extract_string(props, '$.k') as bigint) end k from q")
def _(spark, d):
    more = spark.createDataFrame([(-1, '{"k": 1.0}'), (-2, '{"k": true}'), (-3, '{"k": "7"}'), (-4, '{"k": 7}'), (-5, "no json")], "event_id bigint, props string")
    rows = load(spark, d, "events").select("event_id", "props").unionByName(more)
    return rows.select("event_id", exprs.strict_int(F.try_parse_json("props"), "$.k").alias("k"))


@query("scalar_allowlist", "select event_id, json_extract_string(props, '$.k') k from events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("k"))


@query("all_or_nothing_sum", "select session_id, case when count(cached_input_tokens) = count(*) then coalesce(sum(cached_input_tokens), 0)::bigint end cached, case when count(input_tokens) = count(*) then coalesce(sum(input_tokens), 0)::bigint end given from fx_usage_facts group by 1")
def _(spark, d):
    return load(spark, d, "fx_usage_facts").groupBy("session_id").agg(exprs.sum_or_unknown(F.col("cached_input_tokens")).alias("cached"), exprs.sum_or_unknown(F.col("input_tokens")).alias("given"))


@query("status_summary", "select name, status, count(*) calls from fx_tool_calls group by 1, 2")
def _(spark, d):
    return load(spark, d, "fx_tool_calls").groupBy("name", "status").agg(F.count("*").alias("calls"))


@query("method_summary", "select method, count(*) facts, sum(total_tokens)::bigint total_tokens, count(total_tokens) total_known from fx_usage_facts group by 1")
def _(spark, d):
    return load(spark, d, "fx_usage_facts").groupBy("method").agg(F.count("*").alias("facts"), F.sum("total_tokens").alias("total_tokens"), F.count("total_tokens").alias("total_known"))


# --- merges and lookups ---------------------------------------------------------------------------

OLD = "select doc_id row_key, md5(text) digest from documents where doc_id % 5 <> 0"
NEW = "select doc_id row_key, case when doc_id % 3 = 0 then md5(text || '!') else md5(text) end digest from documents where doc_id % 7 <> 0"


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = load(spark, d, "documents")
    old = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("row_key"), F.md5("text").alias("digest"))
    new = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("row_key"), F.when(F.col("doc_id") % 3 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("digest"))
    return old, new


@query("scd2_rows", f"with o as ({OLD}), n as ({NEW}) select n.row_key, n.digest, 'insert' as action from n left join o using (row_key) where o.row_key is null union all select n.row_key, n.digest, 'supersede' from n join o using (row_key) where n.digest <> o.digest union all select n.row_key, n.digest, 'keep' from n join o using (row_key) where n.digest = o.digest")
def _(spark, d):
    return merge.row_versions(*_snapshots(spark, d), ["row_key"])


@query("source_registry_upsert", f"with o as ({OLD}), n as ({NEW}) select coalesce(n.row_key, o.row_key) row_key, coalesce(n.digest, o.digest) digest from o full join n on o.row_key = n.row_key")
def _(spark, d):
    return merge.upsert(*_snapshots(spark, d), ["row_key"])


@query("changed_sources", f"with o as ({OLD}), n as ({NEW}) select n.* from n where not exists (select 1 from o where o.row_key = n.row_key and o.digest = n.digest)")
def _(spark, d):
    old, new = _snapshots(spark, d)
    return merge.changed(old, new, ["row_key", "digest"])


@query("unavailable_sources", f"with o as ({OLD}), n as ({NEW}) select row_key from o where row_key not in (select row_key from n)")
def _(spark, d):
    old, new = _snapshots(spark, d)
    return merge.missing(old, new, ["row_key"]).select("row_key")


@query("db_only_threads", "select distinct id from fx_sessions where id not in (select session_id from fx_usage_facts)")
def _(spark, d):
    return merge.missing(load(spark, d, "fx_sessions"), load(spark, d, "fx_usage_facts").select(F.col("session_id").alias("id")), ["id"]).select("id").distinct()


@query("catalog_hosts", "select s.id, coalesce(h.kind, 'unknown') host_kind, case when coalesce(h.kind, 'unknown') = 'local' then 'unknown' else 'remote_metadata_only' end coverage from fx_sessions s left join (select 'local' host_kind, 'local' kind) h on h.host_kind = s.host_kind")
def _(spark, d):
    hosts = spark.createDataFrame([("local", "local")], "host_id string, host_kind string")
    return merge.catalog(load(spark, d, "fx_sessions").select("id", F.col("host_kind").alias("host_id")), hosts).select("id", "host_kind", "coverage")


@query("first_record_per_session", "select owner session_id, min(record_id) record_id from fx_record_copies group by 1")
def _(spark, d):
    return load(spark, d, "fx_record_copies").groupBy(F.col("owner").alias("session_id")).agg(F.min("record_id").alias("record_id"))


@query("observation_view", """with i as (select source_id, byte_start, digest, max(record_id) record_id from fx_record_copies group by 1, 2, 3)
 select c.record_id, c.owner, c.source_id, g.superseded from fx_record_copies c join i on i.record_id = c.record_id join (select distinct source_id, cast(source_id % 2 as int) superseded from fx_record_copies) g on g.source_id = c.source_id""")
def _(spark, d):
    copies = load(spark, d, "fx_record_copies")
    current = ledger.latest(copies, ["source_id", "byte_start", "digest"])
    generations = copies.select("source_id", (F.col("source_id") % 2).cast("int").alias("superseded")).distinct()
    return merge.current_view(copies, current, generations).select("record_id", "owner", "source_id", "superseded")


@query("source_health", "select sum(cast(source_id % 9 = 0 as int))::bigint failed_sources, coalesce(sum(case when source_id % 4 = 0 then byte_start % 7 end), 0)::bigint pending_bytes, count(*) sources from (select source_id, max(byte_start) byte_start from fx_record_copies group by 1)")
def _(spark, d):
    rows = load(spark, d, "fx_record_copies").groupBy("source_id").agg(F.max("byte_start").alias("byte_start"))
    return merge.health(rows.select((F.col("source_id") % 9 == 0).alias("failed"), F.when(F.col("source_id") % 4 == 0, F.col("byte_start") % 7).alias("pending_bytes")))


@query("import_counters", "select parser_version, count(*) records, count(distinct source_id) sources, count(distinct owner) owners from fx_record_copies group by 1")
def _(spark, d):
    return load(spark, d, "fx_record_copies").groupBy("parser_version").agg(F.count("*").alias("records"), F.count_distinct("source_id").alias("sources"), F.count_distinct("owner").alias("owners"))


@query("provenance_lookup", "select c.record_id, c.byte_start, c.digest, t.id tool_id from fx_record_copies c join fx_tool_calls t on t.record_id = c.record_id where t.name = 'error'")
def _(spark, d):
    calls = load(spark, d, "fx_tool_calls").where("name = 'error'").select("record_id", F.col("id").alias("tool_id"))
    return load(spark, d, "fx_record_copies").join(calls, "record_id").select("record_id", "byte_start", "digest", "tool_id")


@query("preview_candidates", "select * from (select source_id, record_id, row_number() over (partition by source_id order by record_id desc) place from fx_record_copies where digest in ('purchase', 'error')) where place <= 8")
def _(spark, d):
    return merge.newest(load(spark, d, "fx_record_copies").where(F.col("digest").isin("purchase", "error")), ["source_id"], 8).select("source_id", "record_id", F.col("place").cast("bigint").alias("place"))


@query("tool_detail", f"select id, name, status, result_characters, {ROUGH} rough_result_tokens, cast(record_id as varchar) provenance_ids from fx_tool_calls where id = 't77'")
def _(spark, d):
    rows = load(spark, d, "fx_tool_calls").where("id = 't77'")
    return rows.select("id", "name", "status", "result_characters", exprs.rough_tokens("result_characters").alias("rough_result_tokens"), F.col("record_id").cast("string").alias("provenance_ids"))


@query("enrichment_sessions", """with c as (select concat('s', c_custkey % 60) id, min(c_name) cwd, concat('proj', min(c_nationkey)) project_id, min(c_custkey) n from customer group by 1),
 k as (select 'm' || r_regionkey id, case when r_regionkey % 2 = 0 then 'local' else 'remote' end host_kind from region)
 select coalesce(c.id, s.id) id, coalesce(c.cwd, s.cwd) cwd, c.project_id, strftime(make_timestamp((1780000000 + c.n) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') created_at, c.n reported_state_tokens, coalesce(k.host_kind, 'local') host_kind,
  case when k.host_kind = 'remote' then 'remote_metadata_only' else 'unknown' end coverage
 from fx_sessions s full join c on c.id = s.id left join k on k.id = s.id""")
def _(spark, d):
    """Sessions that logs name, with what a state database and a catalogue with its hosts say."""
    state = load(spark, d, "customer").groupBy(F.concat(F.lit("s"), F.col("c_custkey") % 60).alias("id")).agg(F.min("c_name").alias("cwd"), F.concat(F.lit("proj"), F.min("c_nationkey")).alias("project_id"), F.min("c_custkey").alias("n"))
    state = state.select("id", "cwd", "project_id", (F.lit(1_780_000_000) + F.col("n")).alias("created_at"), F.lit(None).cast("bigint").alias("updated_at"), F.lit(0).alias("archived"), F.col("n").alias("tokens_used"))
    region = load(spark, d, "region")
    threads = region.select(F.concat(F.lit("h"), "r_regionkey").alias("host_id"), F.concat(F.lit("m"), "r_regionkey").alias("thread_id"), F.lit(None).cast("string").alias("cwd"), F.lit(None).cast("string").alias("project_id"))
    hosts = region.select(F.concat(F.lit("h"), "r_regionkey").alias("host_id"), F.when(F.col("r_regionkey") % 2 == 0, "local").otherwise("remote").alias("host_kind"))
    found = enrich.sessions(load(spark, d, "fx_sessions").select("id", "cwd"), {"threads": state, "local_thread_catalog": threads, "local_thread_catalog_hosts": hosts})
    return found.select("id", "cwd", "project_id", "created_at", "reported_state_tokens", "host_kind", "coverage")


# --- export, audit, inspection, normalization ------------------------------------------------------


@query("export_csv_safe", "with q as (select event_id, case event_id % 6 when 0 then '=' || event_type when 1 then '  @' || event_type when 2 then chr(9) || event_type when 3 then '-1' else event_type end name from events) select event_id, case when regexp_matches(ltrim(name), '^[=+\\-@]') or regexp_matches(name, '^[\\t\\r]') then '''' || name else name end name from q")
def _(spark, d):
    kind = F.col("event_id") % 6
    name = F.when(kind == 0, F.concat(F.lit("="), "event_type")).when(kind == 1, F.concat(F.lit("  @"), "event_type")).when(kind == 2, F.concat(F.lit("\t"), "event_type")).when(kind == 3, F.lit("-1")).otherwise(F.col("event_type"))
    return load(spark, d, "events").select("event_id", exprs.csv_safe(name).alias("name"))


@query("export_drilldown_ids", "select name, string_agg(id, ',' order by id) tool_fact_ids from fx_tool_calls group by 1")
def _(spark, d):
    return export.with_ids(load(spark, d, "fx_tool_calls").select("name").distinct(), load(spark, d, "fx_tool_calls"), "name", "tool_fact_ids")


def _export_ids(spark, d, name: str, f: Filters = Filters(), column: str = "tool_fact_ids") -> DataFrame:
    keys, t = list(ds.AGGREGATES[name]), tables(spark, d)
    rows = ds_rows(t, name, f).select(*keys)
    return export.with_ids(rows, ds.drill_down(t, name, f)[column], keys, column, "fact_id")


def ds_rows(t: ds.Tables, name: str, f: Filters) -> DataFrame:
    return {"rankings": ds.rankings, "patterns": ds.patterns, "sessions": ds.sessions, "comparisons": ds.comparisons}[name](t, f, None)


MARCH = Filters(start="2026-03-28", end="2026-03-29", model="beta")


@query("export_ids_filtered", "select session_id, string_agg(id, ',' order by id) usage_fact_ids from fx_usage_facts where timestamp >= '2026-03-28 00:00:00' and timestamp < '2026-03-30 00:00:00' and coalesce(model, 'unknown') = 'beta' group by 1")
def _(spark, d):
    return _export_ids(spark, d, "sessions", MARCH, "usage_fact_ids").where("usage_fact_ids <> ''")


@query("export_ids_descendants", f"""with recursive {BELOW}, chosen as (select unnest(['s0', 's5', 'm1']) root),
 sc as (select root, 'own_thread' as scope, root session_id from chosen union all select c.root, 'unique_descendants', b.node from chosen c join (select * from below union select root, root from chosen) b on b.root = c.root)
 select root session_id, scope, coalesce(string_agg(id, ',' order by id), '') usage_fact_ids from sc left join fx_usage_facts using (session_id) group by 1, 2""")
def _(spark, d):
    return _export_ids(spark, d, "comparisons", Filters(session="s0, s5, m1"), "usage_fact_ids")


@query("export_ids_patterns", f"""with {RETRIES}, q as (select r.pattern_hash, r.kind, t.id from r join fx_tool_calls t on t.id = r.tool_id where coalesce(t.model, 'unknown') = 'beta')
 select pattern_hash, kind, string_agg(id, ',' order by id) tool_fact_ids from q group by 1, 2 having count(*) > 1""")
def _(spark, d):
    return _export_ids(spark, d, "patterns", Filters(model="beta"))


@query("export_semi_join", f"with {RETRIES} select id, name from fx_tool_calls t where exists (select 1 from r where r.tool_id = t.id and r.likely_retry = 1)")
def _(spark, d):
    t = tables(spark, d)
    again = t.patterns.where("likely_retry = 1").select(F.col("tool_id").alias("id"))
    return t.tool_calls.join(again, "id", "left_semi").select("id", "name")


@query("audit_join", f"with {LEDGER} select o.session_id, count(*) facts, sum(coalesce(di, 0))::bigint input_tokens, count(distinct t.model) models from o join fx_observations t on t.record_id = o.record_id where {FACTS} group by 1")
def _(spark, d):
    facts = ledger.window_facts(_ledger(spark, d), COUNTERS).select("session_id", "record_id", "input_tokens")
    seen = load(spark, d, "fx_observations").select("record_id", "model")
    return facts.join(seen, "record_id").groupBy("session_id").agg(F.count("*").alias("facts"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.count_distinct("model").alias("models"))


@query("audit_full_outer", """with raw as (select native_id, max(total_tokens) n from fx_responses where generation_id = 1 and record_id % 13 <> 0 group by 1), led as (select native_id, max(total_tokens) + case when max(record_id) % 11 = 0 then 1 else 0 end n from fx_responses where generation_id = 1 and record_id % 17 <> 0 group by 1)
 select coalesce(raw.native_id, led.native_id) native_id, raw.n raw_tokens, led.n ledger_tokens, case when raw.n is null then 'only_in_ledger' when led.n is null then 'only_in_source' when raw.n = led.n then 'exact' else 'mismatch' end verdict from raw full join led on raw.native_id = led.native_id""")
def _(spark, d):
    base = load(spark, d, "fx_responses").where("generation_id = 1")
    raw = base.where("record_id % 13 <> 0").groupBy("native_id").agg(F.max("total_tokens").alias("tokens"))
    led = base.where("record_id % 17 <> 0").groupBy("native_id").agg((F.max("total_tokens") + F.when(F.max("record_id") % 11 == 0, 1).otherwise(0)).alias("tokens"))
    return inspect_sources.compare(raw, led, "native_id", "tokens").withColumnsRenamed({"source_tokens": "raw_tokens"})


@query("inspection_families", "select event_type || '/k' family, count(*) records from events group by 1")
def _(spark, d):
    return inspect_sources.families(load(spark, d, "events"), F.col("event_type"), F.col("props"))


@query("inspection_decreases", """with l as (select *, lag(input_tokens) over w pi, lag(output_tokens) over w po, lag(record_id) over w pr from fx_observations where input_tokens is not null window w as (partition by session_id order by ordinal))
 select session_id, count(*) records, sum(cast(pr is not null and pi = input_tokens and po is not distinct from output_tokens as int))::bigint repeats, sum(cast(coalesce(input_tokens < pi, false) or coalesce(output_tokens < po, false) as int))::bigint decreases from l group by 1""")
def _(spark, d):
    return inspect_sources.counters(load(spark, d, "fx_observations").where("input_tokens is not null"), list(COUNTERS))


@query("inspection_duplicates", "select text, count(*) copies, min(doc_id) first_id from documents group by 1 having count(*) > 1")
def _(spark, d):
    return load(spark, d, "documents").groupBy("text").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("json_extract_edges", "with m as (select json_object('id', child_id, 'parent', parent_id)::varchar j from fx_edges) select distinct json_extract_string(j, '$.parent') parent_id, json_extract_string(j, '$.id') child_id from m where json_extract_string(j, '$.parent') <> json_extract_string(j, '$.id')")
def _(spark, d):
    meta = load(spark, d, "fx_edges").select(F.col("child_id").alias("session_id"), F.to_json(F.struct(F.col("child_id").alias("id"), F.col("parent_id").alias("parent"))).alias("data_json"))
    return merge.edges_of(meta)


@query("normalize_context_ffill", "select session_id, record_id, last_value(case when ordinal % 4 = 0 then model end ignore nulls) over (partition by session_id order by ordinal rows between unbounded preceding and current row) model, count(*) filter (ordinal % 9 = 0) over (partition by session_id order by ordinal rows between unbounded preceding and current row) epoch from fx_observations")
def _(spark, d):
    rows = load(spark, d, "fx_observations").withColumn("said", F.when(F.col("ordinal") % 4 == 0, F.col("model"))).withColumn("header", F.col("ordinal") % 9 == 0)
    return records.forward_context(rows, ["said"], "header").select("session_id", "record_id", F.col("said").alias("model"), "epoch")


ITEMS = """with q as (select *, cast(json_extract_string(props, '$.k') as bigint) k from events)
 select event_id, case event_id % 4 when 0 then 'commandExecution' when 1 then 'mcpToolCall' when 2 then 'webSearch' else 'userMessage' end as type,
  cast(case event_id % 4 when 0 then k * 1000 + 500 when 2 then k end as decimal(12, 1)) duration_ms, case when event_id % 4 < 2 then cast(strlen(event_type) as bigint) end result_bytes from q"""


@query("item_adapter", ITEMS)
def _(spark, d):
    """Items in either spelling, with durations as structs and numbers, and results under several names."""
    k, name = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_type")
    json_of = lambda *pairs: F.to_json(F.struct(*[v.alias(n) for n, v in pairs]))
    kind = F.col("event_id") % 4
    item = (
        F.when(kind == 0, json_of(("type", F.lit("CommandExecution")), ("duration", F.struct(k.alias("secs"), F.lit(500_000_000).alias("nanos"))), ("aggregated_output", name)))
        .when(kind == 1, json_of(("type", F.lit("mcpToolCall")), ("result", name))).when(kind == 2, json_of(("type", F.lit("WebSearch")), ("duration_ms", k), ("result", name))).otherwise(json_of(("type", F.lit("UserMessage")), ("result", name))))
    rows = records.item_metrics(load(spark, d, "events").select("event_id", item.alias("item_json")))
    return rows.select("event_id", "type", F.col("duration_ms").cast("decimal(12,1)").alias("duration_ms"), "result_bytes")


@query("results_keyset_page3", _tools_sql("result_bytes desc nulls last, id", "limit 25 offset 50"))
def _(spark, d):
    """The third page by two cursors over an order that is kept."""
    kept = pages.Pages(ds.results(tables(spark, d), limit=None), [pages.By("result_bytes", True), pages.By("id")])
    _, cursor = kept.after(None, 25)
    _, cursor = kept.after(cursor, 25)
    return kept.frame(cursor, 25)


from . import sources_demo  # noqa: E402

for _name, _f in sources_demo.QUERIES.items():
    query(_name, sources_demo.ORACLE[_name])(_f)
