"""Canonical tables derived from the driver's star schema, in Spark and in DuckDB.

One text serves both engines; the few words that differ are macros.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.operators.storage import materialize

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "fx_tool_calls": """
select concat('t', event_id) id, concat('s', user_id % 100) session_id, event_type as name, ts as timestamp,
  case k % 7 when 0 then 'failed' when 1 then 'pending' when 2 then 'unknown_outcome' else 'succeeded' end status,
  case when k % 11 = 0 then null else cast(floor(value * 100) as bigint) end duration_ms,
  case when k % 13 = 0 then null else k * 17 end result_characters,
  case when k % 13 = 0 then null else k * 18 end result_bytes,
  cast(null as bigint) result_tokens,
  case k % 3 when 0 then null when 1 then 'alpha' else 'beta' end model,
  concat('/p', user_id % 5, '/x') project, <SHA:concat(event_type, ':', k % 8)> pattern_hash, event_id record_id
from (select *, <K> k from [events])""",
    "fx_usage_facts": """
select concat('f', conv_id, '-', turn) id, concat('s', conv_id) session_id,
  case role when 'assistant' then 'reported_response' when 'user' then 'reported_interval_residual' else 'unallocated_historical' end as method,
  case when role = 'system' then null else <MIN:conv_id * 37 + turn * 11> end as timestamp,
  case when role = 'system' or conv_id % 9 = 0 then null when conv_id % 2 = 0 then 'alpha' else 'beta' end model,
  case when role = 'system' then null else concat('/p', conv_id % 5, '/x') end project,
  i input_tokens,
  case turn % 4 when 0 then null when 1 then cast(floor(i / 2) as bigint) when 2 then i else i + 1 end cached_input_tokens,
  cast(0 as bigint) cache_write_input_tokens, o output_tokens,
  case when turn % 5 = 4 then null else cast(floor(o / 2) as bigint) end reasoning_output_tokens, i + o total_tokens,
  conv_id * 100 + turn record_id
from (select *, cast(floor(i / 3) as bigint) o from (select *, cast(floor((char_length(text) + 3) / 4) as bigint) i from [conversations]))""",
    "fx_sessions": """
select concat('s', conv_id) id, concat('/p', conv_id % 5) cwd, 'unknown' coverage, 'local' host_kind from (select distinct conv_id from [conversations])
union all select concat('m', r_regionkey), null, case when r_regionkey = 4 then 'remote_metadata_only' else 'unknown' end,
  case when r_regionkey = 4 then 'remote' else 'local' end from [region]""",
    "fx_edges": """
select distinct concat('s', cast(floor(conv_id / 3) as bigint)) parent_id, concat('s', conv_id) child_id from [conversations] where conv_id > 0
union all select 's27', 's0'""",
    "fx_labels": "select concat('s', doc_id) session_id, concat('q', quality, 't', toxic) label from [labels] where doc_id < 100",
    "fx_projects": "select concat('proj', r_regionkey) id, concat('/p', r_regionkey) root from [region] union all select 'nested', '/p0/x'",
    "fx_observations": """
select concat('s', user_id % 100) session_id, event_id record_id, event_id as ordinal, ts as timestamp,
  case k % 3 when 0 then 'alpha' else 'beta' end model, user_id % 10 = 0 inherited,
  case when k % 29 = 0 then null when event_type = 'signup' then 0 when event_type = 'error' then cast(floor(ci / 2) as bigint) else ci end input_tokens,
  case when k % 29 = 0 then null when event_type = 'signup' then 0 when event_type = 'error' then cast(floor(co / 2) as bigint) else co end output_tokens
from (select *, cast(sum(cast(floor(value) as bigint)) over (partition by user_id % 100, ep order by event_id) as bigint) ci,
             cast(sum(k) over (partition by user_id % 100, ep order by event_id) as bigint) co
      from (select *, <K> k, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id % 100 order by event_id) ep from [events]))""",
    "fx_responses": """
select conv_id * 100 + turn record_id, concat('r', conv_id, '-', turn) native_id, concat('s', conv_id) session_id,
  cast(char_length(text) as bigint) total_tokens, case when conv_id % 2 = 0 then 'alpha' else 'beta' end model, 1 generation_id from [conversations] where role = 'assistant'
union all select 1000000 + conv_id * 100 + turn, concat('r', conv_id, '-', turn), concat('s', conv_id),
  cast(char_length(text) as bigint) + case when conv_id % 10 = 1 then 1 else 0 end, case when conv_id % 10 = 0 then 'gamma' else null end, 2
  from [conversations] where role = 'assistant' and conv_id % 10 in (0, 1, 2)""",
    "fx_record_copies": """
select cast(event_id as bigint) record_id, user_id source_id, event_id byte_start, event_type digest, 5 parser_version, concat('old', user_id) owner from [events]
union all select 1000000 + event_id, user_id, event_id, event_type, 6, concat('new', user_id) from [events] where event_id % 2 = 0""",
    "fx_tool_events": """
select event_id record_id, concat('c', cast(floor(event_id / 3) as bigint)) native_id, concat('s', user_id % 100) session_id, ts as timestamp,
  case event_id % 3 when 0 then 'tool_call' when 1 then 'tool_output' else 'item_completed' end kind, event_type as name, user_id % 3 source_id,
  case when k % 5 = 0 then null else k % 2 end exit_code, case when k % 7 = 0 then null else k * 18 end result_bytes, case when k % 4 = 0 then null else k * 1.5 end duration_ms
from (select *, <K> k from [events])""",
}


def _macros(text: str, spark: bool) -> str:
    text = text.replace("<K>", "cast(get_json_object(props, '$.k') as bigint)" if spark else "cast(json_extract_string(props, '$.k') as bigint)")
    start = "timestamp_ntz'2026-03-28 00:00:00'" if spark else "timestamp '2026-03-28 00:00:00'"
    text = re.sub(r"<MIN:(.*?)>", rf"timestampadd(MINUTE, \1, {start})" if spark else rf"({start} + to_minutes((\1)::bigint))", text)
    return re.sub(r"<SHA:(.*?)> ", r"sha2(\1, 256) " if spark else r"sha256(\1) ", text)


#: Tables that ``prepare`` wrote, by (application, folder, name).
_prepared: dict[tuple[str, str, str], DataFrame] = {}


def keep(spark: SparkSession, sf_dir: str, name: str, df: DataFrame) -> DataFrame:
    """From now on ``df``, written as a table, is what ``load`` gives for the name."""
    _prepared[spark.sparkContext.applicationId, sf_dir, name] = table = materialize(df, name)
    return table


def prepared(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    return _prepared.get((spark.sparkContext.applicationId, sf_dir, name))


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Write the canonical tables once, as an import does; queries then read them."""
    for name in VIEWS:
        keep(spark, sf_dir, name, load(spark, sf_dir, name))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver, or a fixture view."""
    if (kept := prepared(spark, sf_dir, name)) is not None:
        return kept
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _macros(VIEWS[name], True)
    used = set(re.findall(r"\[(\w+)\]", text))
    return spark.sql(re.sub(r"\[(\w+)\]", r"{\1}", text), **{t: load(spark, sf_dir, t) for t in used})


def oracle(sql: str) -> str:
    """DuckDB SQL with the fixture views that it names put in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    views = [f"{v} as ({re.sub(r'\[(\w+)\]', r'\1', _macros(VIEWS[v], False))})" for v in used]
    body = sql.strip()
    if not views:
        return body
    if m := re.match(r"with( recursive)? ", body):
        return f"with recursive {', '.join(views)}, {body[m.end():]}"
    return f"with recursive {', '.join(views)} {body}"
