"""Record schemas.  Readers always pass one: inference would type all-null columns as strings."""

from __future__ import annotations

CALL = (
    "exp_id string, arm string, task_id string, tier string, model string, fresh_input_tokens bigint, cache_creation_tokens bigint, "
    "cache_read_tokens bigint, output_tokens bigint, input_tokens_logical bigint, cost_usd double, duration_ms bigint, tokens_used bigint, tokens_only boolean"
)
JUDGE = (
    "exp_id string, arm string, task_id string, tier string, seeded boolean, adherence_labels struct<checklist:boolean,disconfirm:boolean,verify:boolean>, "
    "truth_path string, truth_defect_ids array<string>, normalized_block string, parse_ok boolean, defects array<struct<defect_id:string,found:boolean>>, "
    "false_findings bigint, neutral_matched bigint, verdict_flagged boolean, item_pass boolean, judge_error boolean, judge_tokens bigint, judge_cost_usd double"
)
INCIDENT = (
    "corpus string, detector string, bucket string, path string, session string, line_no bigint, ts string, model string, cwd string, sidechain boolean, snippet string"
)
EVIDENCE = "key string, source string, class string, ts string, session string, line bigint, row string, first_seen date"
CATALOG = "detector string, bucket string, priority int, pattern string, role string"
MESSAGE = (
    "path string, line_no bigint, role string, ts string, model string, cwd string, uuid string, sidechain boolean, meta boolean, text string, tools array<struct<name:string,input:string>>"
)
