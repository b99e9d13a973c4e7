"""Fixed names and versions of the data model."""

#: Token categories, in output order.
TOKEN_FIELDS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
PARSER_VERSION = 6
ACCOUNTING_VERSION = 1
PATTERN_VERSION = 1
#: Events that a timeline shows as context.
CONTEXT_KINDS = ("compacted", "turn_context", "session_meta", "thread_settings_applied", "task_started", "task_complete", "turn_aborted")
#: Columns that rankings can be sorted by.
RANKING_SORTS = ("calls", "failures", "duration_ms", "result_bytes", "estimated_result_tokens", "rough_result_tokens")
ROUGH_METHOD = "characters_divided_by_4; rough text-size heuristic, not model-tokenizer or billed usage"
