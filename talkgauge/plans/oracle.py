"""Equivalent SQL of every registered query that SQL can express (DuckDB dialect).

The common table expressions below rebuild the derived inputs from the base tables
independently of the Spark code.
"""

from __future__ import annotations

from talkgauge import constants as c

_ISO = r"regexp_replace(strftime({}, '%Y-%m-%dT%H:%M:%S.%f'), '\.000000$', '')"


def _iso(column: str) -> str:
    return _ISO.format(column)


def _round(value: str, digits: int) -> str:
    scale = float(10**digits)
    return f"round_even(({value}) * {scale}::DOUBLE, 0) / {scale}::DOUBLE"


def _std(column: str) -> str:
    total = f"CAST(SUM({column}) AS DOUBLE)"
    squares = f"CAST(SUM({column} * {column}) AS DOUBLE)"
    return (
        f"CASE WHEN COUNT({column}) = 0 THEN 0.0 WHEN COUNT({column}) > 1 THEN"
        f" sqrt(greatest(({squares} - {total} * {total} / COUNT({column}))"
        f" / (COUNT({column}) - 1), 0.0)) END"
    )


_PRICES = ", ".join(
    f"('{m}', CAST({a} AS DECIMAL(12,8)), CAST({b} AS DECIMAL(12,8)))" for m, a, b in c.PRICES_PER_1K
)

_WITH = f"""
WITH msgs AS (
  SELECT conv_id, 'conv-' || CAST(conv_id AS VARCHAR) AS session_id, turn AS msg_index,
         CASE role WHEN 'assistant' THEN 'agent' WHEN 'user' THEN 'client' ELSE 'system' END AS speaker,
         text AS content,
         TIMESTAMP '2024-01-01 00:00:00'
           + to_seconds(conv_id * 37 + turn * 20 + conv_id * turn % 13) AS ts,
         CAST(SUM(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
           OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_number
  FROM conversations),
per_conv AS (
  SELECT conv_id, session_id, SUM(CASE WHEN speaker = 'agent' THEN 1 ELSE 0 END) AS agent_msgs,
         CAST(SUM(length(content)) AS BIGINT) AS n_chars FROM msgs GROUP BY conv_id, session_id),
results AS (
  SELECT p.session_id, p.conv_id AS scenario_index,
         'batch-' || CAST(p.conv_id % 4 AS VARCHAR) AS batch_id,
         CASE WHEN p.conv_id % 19 = 18 THEN NULL
              ELSE 'scenario_' || CAST(p.conv_id % 7 AS VARCHAR) END AS scenario,
         CASE WHEN p.conv_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS prompt_version,
         CAST(p.conv_id % 3 AS INTEGER) AS seed,
         CASE WHEN p.conv_id % 11 = 5 THEN 'failed' WHEN p.conv_id % 23 = 22 THEN 'running'
              ELSE 'completed' END AS status,
         CASE WHEN p.conv_id % 11 = 5 OR p.conv_id % 13 = 4 THEN 1
              ELSE CAST(1 + p.n_chars % 3 AS INTEGER) END AS score,
         CASE p.conv_id % 6 WHEN 0 THEN 'say "hi", ok' WHEN 1 THEN 'two' || chr(10) || 'lines'
              WHEN 3 THEN 'back\\slash' WHEN 4 THEN 'Привет, мир'
              WHEN 5 THEN 'cr' || chr(13) || chr(10) || 'lf' END AS comment,
         CASE WHEN p.conv_id % 11 = 5 THEN NULL WHEN p.conv_id % 13 = 4 THEN 'failed'
              ELSE 'success' END AS evaluation_status,
         CASE WHEN p.conv_id % 17 = 3 THEN NULL ELSE CAST(p.agent_msgs AS INTEGER) END AS total_turns,
         CASE WHEN p.conv_id % 11 = 5 THEN NULL ELSE CAST(p.n_chars AS DOUBLE) / 8 END
           AS duration_seconds,
         e.ts AS start_time,
         CASE WHEN p.conv_id % 11 <> 5
              THEN e.ts + to_microseconds(p.n_chars * 125000) END AS end_time
  FROM per_conv p LEFT JOIN events e ON e.event_id = p.conv_id),
token_log AS (
  SELECT session_id, conv_id, msg_index, ts AS "timestamp",
         CASE conv_id % 5 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4' WHEN 2 THEN 'gpt-3.5-turbo'
              WHEN 3 THEN 'gpt-4o-mini' ELSE 'unlisted' END AS model,
         CAST(floor(coalesce(SUM(length(content)) OVER (PARTITION BY conv_id ORDER BY msg_index
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4.0) AS BIGINT) AS prompt_tokens,
         CAST(floor(length(content) / 4.0) AS BIGINT) AS completion_tokens
  FROM msgs WHERE speaker <> 'system'),
prices AS (SELECT * FROM (VALUES {_PRICES}) AS t(model, input_per_1k, output_per_1k)),
usage AS (
  SELECT t.*, prompt_tokens + completion_tokens AS total_tokens,
         CAST(coalesce((prompt_tokens * input_per_1k + completion_tokens * output_per_1k)
              * CAST(0.001 AS DECIMAL(4,3)), 0) AS DECIMAL(18,10)) AS cost_estimate
  FROM token_log t LEFT JOIN prices p ON t.model = p.model),
replies AS (
  SELECT conv_id, session_id,
         CASE conv_id % 10 WHEN 0 THEN '{{"score":3,"comment":"ok"}}'
              WHEN 1 THEN '{{"score":2,"comment":"fine"}}' WHEN 2 THEN '{{"score":1,"comment":"bad"}}'
              WHEN 3 THEN '{{"score":2.0,"comment":"float"}}' WHEN 4 THEN '{{"score":"3","comment":"text"}}'
              WHEN 5 THEN '{{"score":5,"comment":"range"}}' WHEN 6 THEN '{{"error":"e","score":3}}'
              WHEN 7 THEN 'not json' WHEN 8 THEN '[1,2]' ELSE '{{"score":3,"comment":"  "}}' END AS raw
  FROM per_conv),
parsed AS (
  SELECT *, CASE WHEN doc IS NULL THEN 'INVALID' ELSE json_type(doc) END AS kind,
         json_type(doc, '$.score') AS score_type,
         json_extract_string(doc, '$.score') AS score_text,
         json_extract_string(doc, '$.comment') AS comment_text,
         coalesce(json_exists(doc, '$.error'), FALSE) AS has_error
  FROM (SELECT *, CASE WHEN json_valid(raw) THEN raw END AS doc FROM replies)),
scored AS (
  SELECT *, kind = 'OBJECT' AND NOT has_error AND coalesce(score_type IN ('UBIGINT', 'BIGINT')
            AND score_text IN ('1', '2', '3'), FALSE) AS score_valid
  FROM parsed),
evaluations AS (
  SELECT conv_id, session_id,
         CASE WHEN score_valid THEN CAST(score_text AS INTEGER) ELSE 1 END AS score,
         CASE WHEN kind = 'ARRAY' THEN '{c.COMMENT_EVALUATION_FAILED_PREFIX}' || '{c.ERROR_REPLY_LIST.replace("'", "''")}'
              WHEN kind = 'INVALID' OR has_error THEN '{c.COMMENT_INVALID_REPLY}'
              WHEN NOT score_valid THEN '{c.COMMENT_BAD_SCORE_PREFIX}' || coalesce(comment_text, '')
              WHEN trim(coalesce(comment_text, '')) = '' THEN '{c.COMMENT_BLANK}'
              ELSE comment_text END AS comment,
         CASE WHEN kind = 'ARRAY' THEN 'failed' ELSE 'success' END AS evaluation_status,
         CASE WHEN kind = 'ARRAY' THEN '{c.ERROR_REPLY_LIST.replace("'", "''")}' END AS error
  FROM scored),
jobs0 AS (
  SELECT *, CASE event_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' WHEN 2 THEN 'failed'
                 WHEN 3 THEN 'cancelled' ELSE 'pending' END AS status,
         event_id % 9 + 1 AS total_scenarios
  FROM events),
jobs AS (
  SELECT 'batch-' || CAST(event_id AS VARCHAR) AS batch_id, status, ts AS created_at,
         CASE WHEN status <> 'pending' THEN ts + INTERVAL 5 SECOND END AS started_at,
         CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN ts + INTERVAL 65 SECOND END
           AS completed_at,
         total_scenarios,
         CASE WHEN status IN ('completed', 'failed') THEN total_scenarios
              ELSE total_scenarios % 3 END AS completed_scenarios,
         CAST(CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS BIGINT) AS failed_scenarios,
         CASE WHEN status = 'failed' THEN 'stopped' END AS error_message
  FROM jobs0),
scenarios AS (
  SELECT batch_id, scenario_index,
         CASE WHEN scenario_index % 5 <> 0
              THEN 'named_' || CAST(scenario_index % 7 AS VARCHAR) END AS name
  FROM results),
outcomes AS (
  SELECT r.batch_id, r.scenario_index, r.scenario, r.session_id,
         CASE WHEN r.status = 'completed' THEN 'completed' ELSE 'failed' END AS status,
         CASE WHEN r.status = 'failed' AND r.scenario_index % 2 = 0
              THEN 'lost ' || CAST(r.scenario_index AS VARCHAR) END AS error,
         CASE WHEN r.status = 'completed' THEN r.total_turns ELSE coalesce(r.total_turns, 0) END
           AS total_turns,
         CASE WHEN r.status = 'completed' THEN r.duration_seconds END AS duration_seconds,
         CASE WHEN r.status = 'completed' THEN e.score ELSE 1 END AS score,
         CASE WHEN r.status = 'completed' THEN e.comment
              ELSE '{c.COMMENT_NOT_FINISHED_PREFIX}' ||
                   CASE WHEN r.status = 'failed' AND r.scenario_index % 2 = 0
                        THEN 'lost ' || CAST(r.scenario_index AS VARCHAR)
                        ELSE '{c.UNKNOWN_ERROR}' END END AS comment,
         CASE WHEN r.status = 'completed' THEN e.evaluation_status END AS evaluation_status,
         CASE WHEN r.status = 'completed' THEN r.start_time END AS start_time,
         CASE WHEN r.status = 'completed' THEN r.end_time END AS end_time
  FROM results r LEFT JOIN evaluations e ON r.session_id = e.session_id
  WHERE r.scenario_index % 9 <> 8
  UNION ALL
  SELECT r.batch_id, r.scenario_index,
         coalesce(s.name, 'scenario_' || CAST(r.scenario_index AS VARCHAR)), NULL, 'failed',
         'boom ' || CAST(r.scenario_index AS VARCHAR), NULL, NULL, 1,
         '{c.COMMENT_PROCESSING_FAILED_PREFIX}' || 'boom ' || CAST(r.scenario_index AS VARCHAR),
         NULL, NULL, NULL
  FROM results r LEFT JOIN scenarios s
    ON r.batch_id = s.batch_id AND r.scenario_index = s.scenario_index
  WHERE r.scenario_index % 9 = 8),
flagged AS (
  SELECT *, CASE speaker WHEN 'agent' THEN contains(lower(content), 'end')
                         WHEN 'client' THEN contains(lower(content), 'und') ELSE FALSE END AS ends,
         lag(ts) OVER (PARTITION BY conv_id ORDER BY msg_index) AS previous_ts,
         first_value(ts) OVER (PARTITION BY conv_id ORDER BY msg_index) AS first_ts
  FROM msgs),
cuts AS (
  SELECT session_id, MAX(msg_index) AS last_index,
         MIN(msg_index) FILTER (ends) AS end_index,
         MIN(msg_index) FILTER (speaker = 'agent' AND turn_number >= 2) AS max_turns_index,
         MIN(msg_index) FILTER (speaker = 'client'
           AND date_diff('microsecond', first_ts, previous_ts) > 90000000) AS timeout_index
  FROM flagged GROUP BY session_id),
usage_by_batch AS (
  SELECT r.batch_id, SUM(u.cost_estimate) AS cost, CAST(SUM(u.total_tokens) AS BIGINT) AS tokens,
         COUNT(*) AS requests
  FROM usage u JOIN results r ON u.session_id = r.session_id GROUP BY r.batch_id)
"""

_RESULT_COLUMNS = (
    "session_id, scenario, status, total_turns, duration_seconds, score,"
    f" evaluation_status, {_iso('start_time')} AS start_time"
)

_ONE_LINE = "replace(replace({}, chr(10), ' '), chr(13), ' ')"


def _csv(version: str, text_output: bool) -> str:
    """The CSV row; as written to a file every value is text and '' reads as NULL."""
    columns = {
        "session_id": "session_id",
        "scenario": "coalesce(scenario, '')",
        "prompt_version": f"'{version}'",
        "score": "score",
        "comment": _ONE_LINE.format("coalesce(comment, '')"),
        "turns": "coalesce(total_turns, 0)",
        "start_ts": _iso("start_time"),
        "status": "status",
        "duration_seconds": "coalesce(duration_seconds, 0.0::DOUBLE)",
        "evaluation_status": "coalesce(evaluation_status, 'unknown')",
    }
    if text_output:
        columns = {k: f"nullif(CAST({v} AS VARCHAR), '')" for k, v in columns.items()}
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + " FROM results"


_SCORES = "COUNT(*) FILTER (score = 1) AS score_1, COUNT(*) FILTER (score = 2) AS score_2, COUNT(*) FILTER (score = 3) AS score_3"
_COUNTS = (
    "COUNT(*) AS total_scenarios, COUNT(*) FILTER (status = 'completed') AS successful_scenarios,"
    " COUNT(*) FILTER (status = 'failed') AS failed_scenarios"
)
_SCORE_STATS = (
    f"coalesce(AVG(score), 0.0) AS score_mean, {_std('score')} AS score_std,"
    " coalesce(MIN(score), 0) AS score_min, coalesce(MAX(score), 0) AS score_max,"
    " coalesce(MEDIAN(CAST(score AS DOUBLE)), 0.0) AS score_median"
)
_TURN_STATS = (
    "coalesce(AVG(total_turns), 0.0) AS turns_mean, coalesce(MIN(total_turns), 0) AS turns_min,"
    " coalesce(MAX(total_turns), 0) AS turns_max,"
    " coalesce(MEDIAN(CAST(total_turns AS DOUBLE)), 0.0) AS turns_median"
)
_DURATION_STATS = (
    "coalesce(AVG(duration_seconds), 0.0) AS duration_mean,"
    " coalesce(MIN(duration_seconds), 0.0) AS duration_min,"
    " coalesce(MAX(duration_seconds), 0.0) AS duration_max,"
    " coalesce(SUM(duration_seconds), 0.0) AS duration_total,"
    " coalesce(MEDIAN(duration_seconds), 0.0) AS duration_median"
)


def _transcript(source: str) -> str:
    return (
        f"SELECT p.session_id, CAST(0 AS BIGINT) AS part, '{c.TRANSCRIPT_HEADER}' || coalesce(t.body, '')"
        f" || '{c.TRANSCRIPT_FOOTER}' AS transcript FROM per_conv p LEFT JOIN ("
        f"SELECT session_id, string_agg('{c.TURN_WORD} ' || CAST(turn_number AS VARCHAR) || ' - ' ||"
        f" CASE speaker WHEN 'agent' THEN '{c.AGENT_LABEL}' ELSE '{c.CLIENT_LABEL}' END || ': ' ||"
        f" content || chr(10) || chr(10), '' ORDER BY msg_index) AS body"
        f" FROM {source} WHERE speaker <> 'system' GROUP BY session_id) t"
        " ON p.session_id = t.session_id"
    ).replace("\n", "' || chr(10) || '")


_CONTEXT = """
SELECT session_id, CAST(-2 AS BIGINT) AS msg_index, 'system' AS role,
       'You talk in ' || session_id AS content FROM per_conv
{kickoff}
UNION ALL SELECT session_id, msg_index, CASE speaker WHEN 'agent' THEN 'assistant' ELSE 'user' END,
       content FROM msgs WHERE speaker <> 'system'"""
_AGENT_CONTEXT = _CONTEXT.format(
    kickoff=f"UNION ALL SELECT session_id, -1, 'user', '{c.KICKOFF_MESSAGE}' FROM per_conv"
)

_SEARCHES = """
searches AS (
  SELECT DISTINCT query, category, query || '/' || category AS search_id FROM (
    SELECT upper(substr(p_name, 1, 4)) AS query, substr(p_type, 1, 3) AS category FROM part
    UNION ALL SELECT substr(p_name, 2, 2), '' FROM part
    UNION ALL SELECT '', p_type FROM part
    UNION ALL SELECT 'nothing like it', '' FROM part)),
found AS (
  SELECT s.search_id, p.p_partkey AS position, p.p_name AS name, p.p_type AS category,
         p.p_retailprice AS price
  FROM searches s JOIN part p ON contains(lower(p.p_name), lower(s.query))
    AND contains(lower(p.p_type), lower(s.category)))
"""

_PERCENTS = ", ".join(
    f"{_round(f'100 * (CASE WHEN COUNT(score) > 0 THEN COUNT(*) FILTER (score = {s}) / COUNT(score) ELSE 0.0 END)', 1)}"
    f" AS score_{s}_pct"
    for s in c.VALID_SCORES
)

# Each request with the requests of the second before it, itself included.
_PEAKS = """COUNT(*) AS requests, MAX(rate) AS peak,
  COUNT(*) FILTER (rate > 1) AS busy_requests, MAX(rate) > 1 AS over_limit
FROM (SELECT date_trunc('second', a.ts) AS second, a.event_id, COUNT(*) AS rate
      FROM events a JOIN events b ON b.ts <= a.ts AND b.ts > a.ts - INTERVAL 1 SECOND GROUP BY 1, 2)
GROUP BY second"""

_SELECTS: dict[str, str] = {
    "read_scenarios": """
SELECT CAST(c_custkey // 10000 AS BIGINT) AS chunk,
       row_number() OVER (PARTITION BY c_custkey // 10000 ORDER BY c_custkey) - 1 AS scenario_index,
       c_name AS name, c_mktsegment AS personality, CAST(c_nationkey AS VARCHAR) AS amb_level
FROM customer""",
    "read_results_ndjson": f"""
SELECT batch_id, comment, {_RESULT_COLUMNS}, {_iso('end_time')} AS end_time,
       '2024-02-01 12:00:00' AS export_timestamp FROM results""",
    "read_results_csv": f"""
SELECT nullif(session_id, '') AS session_id, scenario, status,
       coalesce(total_turns, 0) AS total_turns,
       coalesce(duration_seconds, 0.0::DOUBLE) AS duration_seconds, score,
       {_ONE_LINE.format('comment')} AS comment,
       coalesce(evaluation_status, 'unknown') AS evaluation_status,
       {_iso('start_time')} AS start_time, 'v7' AS prompt_version FROM results""",
    "load_results": """
SELECT session_id, CAST(2 * COUNT(*) AS BIGINT) AS copies, COUNT(batch_id) AS with_batch,
       CAST(2 * SUM(score) AS BIGINT) AS score_sum,
       CAST(2 * SUM(coalesce(total_turns, 0)) AS BIGINT) AS turns_sum
FROM results GROUP BY session_id""",
    "read_token_log": f"""
SELECT session_id, model, prompt_tokens, completion_tokens, total_tokens,
       CAST(cost_estimate AS DOUBLE) AS cost_estimate, {_iso('"timestamp"')} AS "timestamp"
FROM usage""",
    "read_conversation_log": f"""
SELECT r.session_id, r.total_turns, r.score AS final_score, r.comment AS evaluator_comment, r.status,
       {_iso('r.start_time')} AS "timestamp", m.turn_records, m.last_turn, m.n_chars,
       {_iso('m.last_timestamp')} AS last_timestamp
FROM results r LEFT JOIN (
  SELECT session_id, COUNT(*) AS turn_records, CAST(MAX(turn_number) AS INTEGER) AS last_turn,
         CAST(SUM(length(content)) AS BIGINT) AS n_chars, MAX(ts) AS last_timestamp
  FROM msgs WHERE speaker <> 'system' GROUP BY session_id) m ON r.session_id = m.session_id""",
    "read_service_log": f"""
SELECT CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, COUNT(*) AS n,
       COUNT(*) FILTER (event_type = 'error') AS retries,
       CAST(SUM(CASE WHEN event_type = 'error' THEN event_id % 3 + 1 END) AS BIGINT) AS attempt_sum,
       COUNT(*) FILTER (event_type = 'error') AS with_extra,
       {_iso("MAX(date_trunc('second', ts) + INTERVAL 250 MILLISECOND)")} AS last_ts
FROM events GROUP BY 1""",
    "list_result_files": """
SELECT DISTINCT 'batch_id=' || batch_id || '/export_ts=' || export_ts AS folder, TRUE AS has_content
FROM results, (VALUES ('20240201_120000'), ('20240202_120000')) AS t(export_ts)
WHERE contains(batch_id, 'batch-1')""",
    "latest_export": """
SELECT DISTINCT batch_id, format, '20240202_120000' AS export_ts
FROM results, (VALUES ('ndjson'), ('csv')) AS t(format)""",
    "logs_for_batch": """
SELECT u.session_id, COUNT(*) AS requests, CAST(SUM(u.total_tokens) AS BIGINT) AS tokens
FROM usage u JOIN results r ON u.session_id = r.session_id
WHERE r.batch_id = 'batch-1' GROUP BY u.session_id""",
    "write_results_ndjson": """
SELECT batch_id, session_id, '2024-02-01 12:00:00' AS export_timestamp, comment,
       scenario IS NOT NULL AS has_scenario, duration_seconds IS NOT NULL AS has_duration,
       strftime(start_time, '%Y-%m-%dT%H:%M:%S.%f') AS start_time FROM results""",
    "write_results_csv": _csv(c.DEFAULT_PROMPT_VERSION, True),
    "write_summary_json": """
SELECT batch_id, 2 + COUNT(DISTINCT scenario) AS lines,
       greatest(COUNT(DISTINCT scenario) - 1, 0) AS separators, COUNT(*) AS total_scenarios,
       AVG(score) AS score_mean, MEDIAN(duration_seconds) AS duration_median,
       '},"generated_at":"2024-02-01T12:00:00"}' AS footer
FROM results GROUP BY batch_id""",
    "write_summary_csv": """
SELECT session_id, scenario, score, total_turns, duration_seconds, status FROM results""",
    "append_logs": """
SELECT session_id, strftime("timestamp", '%Y-%m-%d') AS log_date, COUNT(*) AS requests,
       CAST(SUM(total_tokens) AS BIGINT) AS tokens FROM usage GROUP BY 1, 2""",
    "results_envelope": """
SELECT batch_id, 0 AS section, NULL AS position,
       '{"batch_id":"' || batch_id || '","results":[' AS line FROM results GROUP BY batch_id
UNION ALL
SELECT batch_id, 2, NULL, '],"total_results":' || CAST(COUNT(*) AS VARCHAR) || '}'
FROM results GROUP BY batch_id
UNION ALL
SELECT batch_id, 1, scenario_index,
       CASE WHEN row_number() OVER (PARTITION BY batch_id ORDER BY scenario_index) > 1
            THEN ',' ELSE '' END
       || '{"batch_id":"' || batch_id || '","scenario_index":' || CAST(scenario_index AS VARCHAR)
       || ',"session_id":"' || session_id || '","status":"' || status || '","score":'
       || CAST(score AS VARCHAR) || '}' FROM results""",
    "validate_scenarios": """
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'No scenarios provided'
       WHEN 1 THEN 'Scenarios must be a list' WHEN 2 THEN 'Scenario 1 must be an object'
       WHEN 3 THEN 'Scenario 1 missing ''variables'' field'
       WHEN 4 THEN 'Scenario 0 missing ''name'' field' END AS error FROM customer""",
    "scenario_by_index": """
SELECT r.scenario_index AS request_id, r.scenario_index * 2 AS scenario_index,
       CASE WHEN s.scenario_index IS NOT NULL THEN coalesce(s.name,
            'scenario_' || CAST(r.scenario_index * 2 AS VARCHAR)) END AS name,
       CASE WHEN s.scenario_index IS NULL
            THEN 'Scenario index ' || CAST(r.scenario_index * 2 AS VARCHAR) || ' not found' END AS error
FROM scenarios r LEFT JOIN scenarios s ON s.scenario_index = r.scenario_index * 2""",
    "completed_batches": """
SELECT batch_id, session_id, score FROM results
WHERE batch_id IN (SELECT batch_id FROM jobs WHERE status = 'completed')""",
    "unserved_batches": """
SELECT DISTINCT r.batch_id, coalesce(j.status, 'not found') AS current_status
FROM results r LEFT JOIN jobs j ON r.batch_id = j.batch_id
WHERE coalesce(j.status, 'not found') <> 'completed'""",
    "status_counts": """
SELECT batch_id, COUNT(*) FILTER (status = 'completed') AS successful_scenarios,
       COUNT(*) FILTER (status = 'failed') AS failed_scenarios FROM results GROUP BY batch_id""",
    "non_null_scores": "SELECT session_id, score FROM results WHERE score IS NOT NULL AND score <> 0",
    "evaluable_conversations": "SELECT session_id, status FROM results WHERE status = 'completed'",
    "expired_batches": f"""
SELECT batch_id, status, {_iso('completed_at')} AS completed_at FROM jobs
WHERE status IN ('completed', 'failed', 'cancelled')
  AND date_diff('microsecond', completed_at, TIMESTAMP '2024-01-16 00:00:00') > 24 * 3600000000""",
    "kept_batches": """
SELECT batch_id, status FROM jobs WHERE NOT coalesce(status IN ('completed', 'failed', 'cancelled')
  AND date_diff('microsecond', completed_at, TIMESTAMP '2024-01-16 00:00:00') > 24 * 3600000000, FALSE)""",
    "removed_batch_count": """
SELECT COUNT(*) AS removed FROM jobs WHERE status IN ('completed', 'failed', 'cancelled')
  AND date_diff('microsecond', completed_at, TIMESTAMP '2024-01-16 00:00:00') > 24 * 3600000000""",
    "order_total_of_array": """
SELECT l_orderkey AS order_id, CAST(SUM(CASE WHEN l_linenumber % 5 <> 0
         THEN CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_quantity AS DECIMAL(12,2)) ELSE 0 END) AS DOUBLE) AS total_amount
FROM lineitem GROUP BY l_orderkey""",
    "render_prompts": """
SELECT c_name AS session_id,
       CASE WHEN c_custkey % 5 = 0
            THEN 'Session {session_id} {{raw}}: {PERSONALITY} wants {ORDER_GOAL}, patience {PATIENCE}.'
            ELSE 'Session ' || c_name || ' {raw}: ' || c_mktsegment
                 || ' wants [{"name":"{session_id}", "qty":' || CAST(c_nationkey AS VARCHAR)
                 || '}], patience ' || CASE WHEN c_custkey % 3 = 0 THEN 'None'
                                            ELSE CAST(c_custkey % 4 AS VARCHAR) END || '.' END AS prompt,
       CASE WHEN c_custkey % 5 = 0 THEN 'missing_variable' ELSE 'rendered' END AS render_status
FROM customer""",
    "csv_rows": _csv("v7", False),
    "summary_columns": "SELECT session_id, scenario, score, total_turns, status FROM results",
    "stamp_export": """
SELECT session_id, CASE WHEN scenario_index % 2 = 0 THEN batch_id ELSE 'batch-x' END AS batch_id,
       '2024-02-01 12:00:00' AS export_timestamp FROM results""",
    "stamp_prompt_version": "SELECT session_id, score, 'default' AS prompt_version FROM results",
    "assign_session_id": """
SELECT batch_id, scenario_index, CASE WHEN scenario_index % 3 = 0 THEN session_id
       ELSE sha256(batch_id || '/' || CAST(scenario_index AS VARCHAR)) END AS session_id
FROM results""",
    "job_status_view": f"""
SELECT batch_id, status, 100 * completed_scenarios / total_scenarios AS progress, total_scenarios,
       completed_scenarios, failed_scenarios, {_iso('created_at')} AS created_at,
       {_iso('started_at')} AS started_at, {_iso('completed_at')} AS completed_at, error_message
FROM jobs""",
    "evaluator_request": f"""
SELECT session_id, 'system' AS role, 'Grade the conversation.' AS content
FROM ({_transcript('kept')})
UNION ALL SELECT session_id, 'user', transcript FROM ({_transcript('kept')})""",
    "read_prompt_templates": """
SELECT c_name, c_mktsegment AS template_name, 'rendered' AS render_status,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'You are a MACHINERY.'
            ELSE 'You speak for ' || c_mktsegment || '.' || chr(10) || 'Greet ' || c_name || '!' END AS prompt
FROM customer""",
    "request_cost": """
SELECT session_id, msg_index, model, total_tokens, CAST(cost_estimate AS DOUBLE) AS cost_estimate
FROM usage""",
    "result_rows": f"""
SELECT batch_id, scenario_index, scenario, session_id, status, error, total_turns,
       duration_seconds, score, comment, evaluation_status, {_iso('start_time')} AS start_time,
       {_iso('end_time')} AS end_time FROM outcomes""",
    "conversation_history": f"""
SELECT session_id, CAST(0 AS BIGINT) AS part,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY msg_index) - 1 AS INTEGER) AS pos,
       turn_number AS turn, speaker, content, {_iso('ts')} AS "timestamp" FROM msgs""",
    "transcript_text": _transcript("msgs"),
    "end_detection": "SELECT session_id, msg_index, speaker, ends FROM flagged",
    "cut_at_end": """
SELECT m.session_id, m.msg_index, m.speaker, m.content FROM msgs m JOIN cuts c
  ON m.session_id = c.session_id
WHERE m.msg_index <= coalesce(least(c.end_index, c.max_turns_index), c.last_index)""",
    "cut_at_timeout": """
SELECT m.session_id, m.msg_index, m.speaker FROM msgs m JOIN cuts c ON m.session_id = c.session_id
WHERE c.timeout_index IS NULL OR m.msg_index < c.timeout_index""",
    "end_reason": """
SELECT session_id, reason AS end_reason,
       CASE reason WHEN 'timeout' THEN timeout_index - 1 WHEN 'failed' THEN last_index
                   ELSE stop END AS last_msg_index
FROM (SELECT c.*, CASE
        WHEN timeout_index IS NOT NULL AND (stop IS NULL OR timeout_index <= stop) THEN 'timeout'
        WHEN stop IS NULL THEN 'failed' WHEN end_index = stop THEN f.speaker || '_end'
        ELSE 'max_turns' END AS reason
      FROM (SELECT *, least(end_index, max_turns_index) AS stop FROM cuts) c
      LEFT JOIN flagged f ON c.session_id = f.session_id AND c.end_index = f.msg_index)""",
    "total_turns": """
SELECT session_id, COUNT(*) FILTER (speaker = 'agent') AS total_turns,
       COUNT(*) FILTER (speaker <> 'system') AS n_messages FROM msgs GROUP BY session_id""",
    "agent_context": _AGENT_CONTEXT,
    "client_context": _CONTEXT.format(kickoff=""),
    "context_at": f"""
SELECT c.session_id, l.last_index AS msg_index,
       CAST(row_number() OVER (PARTITION BY c.session_id ORDER BY c.msg_index) - 1 AS INTEGER) AS pos,
       c.role, c.content
FROM ({_AGENT_CONTEXT}) c JOIN (SELECT session_id, MAX(msg_index) AS last_index FROM msgs
  WHERE speaker = 'agent' GROUP BY session_id) l ON c.session_id = l.session_id
WHERE c.msg_index < l.last_index""",
    "conversation_result": f"""
SELECT r.session_id, coalesce(r.scenario, 'unknown') AS scenario, r.status,
       CASE WHEN r.status = 'failed' THEN 'lost ' || r.session_id END AS error,
       m.total_turns, {_iso('m.start_time')} AS start_time, {_iso('m.end_time')} AS end_time,
       date_diff('microsecond', m.start_time, m.end_time) / 1000000.0::DOUBLE AS duration_seconds
FROM results r JOIN (SELECT session_id, MIN(ts) AS start_time, MAX(ts) AS end_time,
       CAST(COUNT(*) FILTER (speaker = 'agent') AS INTEGER) AS total_turns
     FROM msgs GROUP BY session_id) m ON r.session_id = m.session_id""",
    "number_turns": "SELECT session_id, msg_index, speaker, turn_number FROM msgs",
    "parse_evaluation": """
SELECT session_id, raw, kind AS reply_kind,
       CASE WHEN kind = 'INVALID' THEN 'invalid_json' END AS error FROM parsed""",
    "validate_score": """
SELECT session_id, CASE WHEN score_valid THEN CAST(score_text AS INTEGER) ELSE 1 END AS score,
       score_valid FROM scored""",
    "normalize_comment": """
SELECT session_id, CASE WHEN evaluation_status = 'success' THEN comment END AS comment
FROM evaluations""",
    "evaluation_fallback": """
SELECT session_id, score, comment, evaluation_status, error FROM evaluations""",
    "evaluate_batch": f"""
SELECT r.scenario_index AS conversation_index,
       CASE WHEN r.scenario_index % 10 <> 9 THEN r.session_id
            ELSE 'unknown_' || CAST(r.scenario_index AS VARCHAR) END AS session_id,
       coalesce(r.scenario, 'unknown') AS scenario,
       CASE WHEN n % 11 <> 0 AND n % 4 < 3 THEN CAST(1 + n % 4 AS INTEGER) ELSE 1 END AS score,
       CASE WHEN n % 11 = 0 THEN '{c.COMMENT_EVALUATION_FAILED_PREFIX}no answer'
            WHEN n % 4 = 3 THEN '{c.COMMENT_BAD_SCORE_PREFIX}' || CAST(n AS VARCHAR) || ' characters'
            ELSE CAST(n AS VARCHAR) || ' characters' END AS comment,
       CASE WHEN n % 11 = 0 THEN 'failed' ELSE 'success' END AS evaluation_status
FROM results r JOIN (SELECT session_id, length(transcript) AS n FROM ({_transcript('kept')})) t
  ON r.session_id = t.session_id""",
    "evaluation_summary": f"""
SELECT COUNT(*) AS total_evaluations,
       COUNT(*) FILTER (evaluation_status = 'success') AS successful_evaluations,
       AVG(score) AS average_score, {_SCORES},
       COUNT(*) FILTER (evaluation_status = 'success') / COUNT(*) AS success_rate
FROM evaluations""",
    "price_lookup": """
SELECT t.session_id, t.msg_index, t.model, CAST(p.input_per_1k AS DOUBLE) AS input_per_1k,
       CAST(p.output_per_1k AS DOUBLE) AS output_per_1k
FROM token_log t LEFT JOIN prices p ON t.model = p.model""",
    "join_evaluation": """
SELECT r.session_id, r.scenario, r.status, e.score, e.comment, e.evaluation_status
FROM results r LEFT JOIN evaluations e ON r.session_id = e.session_id""",
    "usage_by_batch": """
SELECT batch_id, CAST(cost AS DOUBLE) AS cost, tokens, requests FROM usage_by_batch""",
    "failed_scenario_name": """
SELECT r.batch_id, r.scenario_index, 'boom ' || CAST(r.scenario_index AS VARCHAR) AS error,
       coalesce(s.name, 'scenario_' || CAST(r.scenario_index AS VARCHAR)) AS scenario
FROM results r LEFT JOIN scenarios s
  ON r.batch_id = s.batch_id AND r.scenario_index = s.scenario_index
WHERE r.scenario_index % 9 = 8""",
    "catalog_search": "SELECT * FROM found",
    "catalog_search_totals": """
SELECT s.search_id, COUNT(f.position) AS total_found FROM searches s
LEFT JOIN found f ON s.search_id = f.search_id GROUP BY s.search_id""",
    "customer_history": f"""
SELECT c.c_custkey AS customer_id,
       CASE WHEN o.n IS NULL THEN 'not_found' ELSE 'found' END AS status,
       coalesce(o.n, 0) AS previous_orders, f1.p_name AS favorite_item_1, f2.p_name AS favorite_item_2,
       {_iso('o.last_date')} AS last_order_date
FROM customer c
LEFT JOIN (SELECT o_custkey, COUNT(*) AS n, MAX(o_orderdate) AS last_date FROM orders
           GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey
LEFT JOIN (SELECT b.o_custkey, p.p_name FROM bought b JOIN part p ON b.l_partkey = p.p_partkey
           WHERE b.place = 1) f1 ON c.c_custkey = f1.o_custkey
LEFT JOIN (SELECT b.o_custkey, p.p_name FROM bought b JOIN part p ON b.l_partkey = p.p_partkey
           WHERE b.place = 2) f2 ON c.c_custkey = f2.o_custkey""",
    "batch_counts": f"""
SELECT batch_id, {_COUNTS}, COUNT(*) FILTER (status = 'completed') / COUNT(*) AS success_rate
FROM results GROUP BY batch_id""",
    "score_stats": f"SELECT batch_id, {_SCORE_STATS}, COUNT(score) AS score_count FROM results GROUP BY batch_id",
    "score_distribution": f"SELECT batch_id, {_SCORES}, {_PERCENTS} FROM results GROUP BY batch_id",
    "turn_stats": f"SELECT batch_id, {_TURN_STATS} FROM results GROUP BY batch_id",
    "duration_stats": f"SELECT batch_id, {_DURATION_STATS} FROM results GROUP BY batch_id",
    "scenario_performance": f"""
SELECT scenario, COUNT(score) AS score_count, {_round('AVG(score)', 2)} AS score_mean,
       {_round('AVG(duration_seconds)', 2)} AS duration_seconds_mean,
       {_round('AVG(total_turns)', 2)} AS total_turns_mean
FROM results WHERE scenario IS NOT NULL GROUP BY scenario ORDER BY scenario""",
    "summary_report": f"""
SELECT b.batch_id, coalesce(s.total_scenarios, 0) AS total_scenarios,
       coalesce(s.successful_scenarios, 0) AS successful_scenarios,
       coalesce(s.failed_scenarios, 0) AS failed_scenarios,
       coalesce(s.success_rate, 0.0::DOUBLE) AS success_rate,
       s.* EXCLUDE (batch_id, total_scenarios, successful_scenarios, failed_scenarios, success_rate)
FROM (SELECT DISTINCT batch_id FROM jobs) b LEFT JOIN (
  SELECT batch_id, {_COUNTS}, COUNT(*) FILTER (status = 'completed') / COUNT(*) AS success_rate,
         {_SCORE_STATS}, {_SCORES}, {_TURN_STATS}, {_DURATION_STATS}
  FROM results GROUP BY batch_id) s ON b.batch_id = s.batch_id""",
    "summary_report_scenarios": f"""
SELECT batch_id, scenario, COUNT(score) AS score_count, {_round('AVG(score)', 2)} AS score_mean,
       {_round('AVG(duration_seconds)', 2)} AS duration_seconds_mean,
       {_round('AVG(total_turns)', 2)} AS total_turns_mean
FROM results WHERE scenario IS NOT NULL GROUP BY batch_id, scenario""",
    "console_summary": f"""
SELECT batch_id, {_COUNTS},
       {_round("100 * (COUNT(*) FILTER (status = 'completed') / COUNT(*))", 1)} AS successful_pct,
       {_round("100 * (COUNT(*) FILTER (status = 'failed') / COUNT(*))", 1)} AS failed_pct
FROM results GROUP BY batch_id""",
    "quick_summary": f"""
SELECT batch_id, AVG(coalesce(score, 1)) AS average_score, {_SCORES} FROM results GROUP BY batch_id""",
    "run_outcome": """
SELECT batch_id, COUNT(*) AS total_scenarios,
       COUNT(*) FILTER (NOT (status = 'failed' AND session_id IS NULL)) AS successful_scenarios,
       COUNT(*) FILTER (status = 'failed' AND session_id IS NULL) AS failed_scenarios
FROM outcomes GROUP BY batch_id""",
    "batch_progress": """
SELECT j.batch_id, j.total_scenarios * 30 AS total_scenarios, coalesce(r.n, 0) AS completed_scenarios,
       100 * (coalesce(r.n, 0) / (j.total_scenarios * 30)) AS progress_percentage
FROM jobs j LEFT JOIN (SELECT batch_id, COUNT(*) FILTER (status IN ('completed', 'failed')) AS n
  FROM results GROUP BY batch_id) r ON j.batch_id = r.batch_id""",
    "score_histogram": """
SELECT score AS bin, score - 0.5::DOUBLE AS from_score, score + 0.5::DOUBLE AS to_score, COUNT(*) AS n
FROM results WHERE score IN (1, 2, 3) GROUP BY score""",
    "cost_report": f"""
SELECT b.batch_id, CAST(round(coalesce(u.cost, 0), 4) AS DOUBLE) AS total_cost_usd,
       coalesce(u.tokens, 0) AS total_tokens, coalesce(u.requests, 0) AS total_requests,
       {_round('CASE WHEN u.requests > 0 THEN CAST(u.cost AS DOUBLE) / u.requests ELSE 0.0 END', 4)}
         AS average_cost_per_request
FROM (SELECT DISTINCT batch_id FROM jobs) b LEFT JOIN usage_by_batch u ON b.batch_id = u.batch_id""",
    "cost_by_model": f"""
SELECT model, CAST(round(SUM(cost_estimate), 4) AS DOUBLE) AS total_cost_usd,
       CAST(SUM(total_tokens) AS BIGINT) AS total_tokens, COUNT(*) AS total_requests,
       {_round('CAST(SUM(cost_estimate) AS DOUBLE) / COUNT(*)', 4)} AS average_cost_per_request
FROM usage GROUP BY model""",
    "prompt_version_comparison": """
SELECT scenario, AVG(score) FILTER (prompt_version = 'v1') AS base_mean,
       COUNT(score) FILTER (prompt_version = 'v1') AS base_count,
       AVG(score) FILTER (prompt_version = 'v2') AS other_mean,
       COUNT(score) FILTER (prompt_version = 'v2') AS other_count,
       AVG(score) FILTER (prompt_version = 'v2') - AVG(score) FILTER (prompt_version = 'v1')
         AS mean_delta
FROM results WHERE scenario IS NOT NULL GROUP BY scenario""",
    "determinism_check": """
SELECT scenario, seed, prompt_version, COUNT(*) AS runs, MIN(score) AS min_score,
       MAX(score) AS max_score
FROM results GROUP BY scenario, seed, prompt_version HAVING MIN(score) <> MAX(score)""",
    "throughput_report": """
SELECT r.batch_id, r.conversations,
       r.conversations / (date_diff('microsecond', r.a, r.b) / 1000000.0::DOUBLE / 60)
         AS conversations_per_minute,
       r.mean_duration_seconds, u.tokens / r.conversations AS tokens_per_conversation,
       CAST(u.cost AS DOUBLE) / r.conversations AS cost_per_conversation
FROM (SELECT batch_id, COUNT(*) AS conversations, AVG(duration_seconds) AS mean_duration_seconds,
             MIN(start_time) AS a, MAX(end_time) AS b FROM results GROUP BY batch_id) r
LEFT JOIN usage_by_batch u ON r.batch_id = u.batch_id""",
    "peak_concurrency": """
SELECT batch_id, CAST(MAX(level) AS BIGINT) AS peak, CAST(SUM(change) AS BIGINT) AS open_conversations,
       MAX(level) > 1 AS over_limit
FROM (SELECT batch_id, change, SUM(change) OVER (PARTITION BY batch_id ORDER BY moment, change) AS level
      FROM (SELECT batch_id, start_time AS moment, 1 AS change FROM results WHERE start_time IS NOT NULL
            UNION ALL SELECT batch_id, end_time, -1 FROM results WHERE end_time IS NOT NULL))
GROUP BY batch_id""",
    "order_total": """
SELECT o.o_orderkey AS order_id, CAST(coalesce(t.total, 0) AS DOUBLE) AS total_amount
FROM orders o LEFT JOIN (
  SELECT l_orderkey, SUM(CAST(coalesce(p_retailprice, 0) AS DECIMAL(12,2))
                         * CAST(l_quantity AS DECIMAL(12,2))) AS total
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) t
  ON o.o_orderkey = t.l_orderkey""",
    "score_order": "SELECT score, COUNT(*) AS n FROM results WHERE score IS NOT NULL GROUP BY score ORDER BY score",
    "union_outcomes": """
SELECT batch_id, scenario_index, scenario, status, score, comment FROM outcomes
ORDER BY batch_id, scenario_index""",
    "stream_token_usage": f"""
SELECT {_iso('w')} AS window_start, model, requests, tokens, CAST(cost AS DOUBLE) AS cost FROM (
  SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS w, event_type AS model, COUNT(*) AS requests,
         CAST(SUM(tokens) AS BIGINT) AS tokens, SUM(tokens * CAST(0.0001 AS DECIMAL(5,4))) AS cost
  FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS tokens FROM events) GROUP BY 1, 2)
WHERE w + INTERVAL 1 MINUTE <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE""",
    "request_rate": f"""
SELECT {_iso("date_trunc('second', ts)")} AS second, COUNT(*) AS requests, COUNT(*) > 1 AS over_limit
FROM events GROUP BY date_trunc('second', ts)""",
    "stream_batch_progress": """
SELECT 'batch-' || CAST(user_id % 10 AS VARCHAR) AS batch_id, COUNT(*) AS total_scenarios,
       COUNT(*) FILTER (event_type NOT IN ('error', 'signup')) AS completed_scenarios,
       COUNT(*) FILTER (event_type = 'error') AS failed_scenarios
FROM events GROUP BY 1""",
    "stream_conversation_timeout": f"""
SELECT s.session_id, {_iso('s.ts')} AS started_at, {_iso('s.ts + INTERVAL 90 SECOND')} AS deadline
FROM flagged s
WHERE s.msg_index = 0
  AND NOT EXISTS (SELECT 1 FROM flagged e WHERE e.session_id = s.session_id AND e.ends
                  AND e.ts BETWEEN s.ts AND s.ts + INTERVAL 90 SECOND)
  AND s.ts + INTERVAL 90 SECOND < least((SELECT MAX(ts) FROM flagged WHERE msg_index = 0),
                     (SELECT MAX(ts) FROM flagged WHERE ends)) - INTERVAL 10 MINUTE""",
    "stream_exchange_timeout": f"""
SELECT session_id, MIN(msg_index) AS cut_index, {_iso('MIN(started)')} AS started_at,
       MIN(epoch_us(previous) - epoch_us(started)) / 1000000 AS elapsed_seconds
FROM (SELECT *, first_value(ts) OVER w AS started, lag(ts) OVER w AS previous FROM flagged
      WINDOW w AS (PARTITION BY session_id ORDER BY msg_index))
WHERE speaker = 'client' AND previous > started + INTERVAL 90 SECOND
  AND ts <= (SELECT MAX(ts) FROM flagged) - INTERVAL 10 MINUTE
GROUP BY session_id""",
    "stream_request_rate": f"""
SELECT {_iso('second')} AS second, requests, requests > 1 AS over_limit
FROM (SELECT date_trunc('second', ts) AS second, COUNT(*) AS requests FROM events GROUP BY 1)
WHERE second + INTERVAL 1 SECOND <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE""",
    "request_peaks": f"SELECT {_iso('second')} AS second, {_PEAKS}",
    "stream_request_peaks": f"""SELECT {_iso('second')} AS second, {_PEAKS}
HAVING second <= (SELECT date_trunc('second', MAX(ts)) FROM events) + INTERVAL 1 SECOND - INTERVAL 10 MINUTE""",
    "stream_append_logs": """
SELECT event_type AS model, strftime(ts, '%Y-%m-%d') AS log_date, COUNT(*) AS requests,
       CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2""",
}
_SELECTS["summary_states"] = f"""
SELECT * EXCLUDE (duration_median), CASE WHEN duration_total > 0 THEN TRUE END AS median_in_bound
FROM ({_SELECTS["summary_report"]})"""
_SELECTS["summary_states_scenarios"] = _SELECTS["summary_report_scenarios"]
_SELECTS["write_summary_json_scenarios"] = _SELECTS["summary_report_scenarios"]
_SELECTS["catalog_search_indexed"] = _SELECTS["catalog_search"]
_SELECTS["validate_scenarios_strict"] = """
SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN 'Scenario 1 ''variables'' must be an object' END AS error
FROM customer"""
_SELECTS["report_from_logs"] = f"""
SELECT {_COUNTS}, COUNT(*) FILTER (status = 'completed') / COUNT(*) AS success_rate,
       {_SCORE_STATS}, {_SCORES}, {_TURN_STATS}, {_DURATION_STATS}
FROM (SELECT r.status, r.score, s.total_turns, s.duration_seconds
      FROM results r FULL JOIN logged s ON r.session_id = s.session_id)"""
_SELECTS["evaluate_stored"] = _SELECTS["evaluate_batch"]
_SELECTS["document_parts"] = f"""
SELECT batch_id, CAST(SUM(strlen(line) + 1) AS BIGINT) AS bytes, 0 AS damaged
FROM ({_SELECTS["results_envelope"]}) GROUP BY batch_id"""
_SELECTS["list_batches"] = _SELECTS["job_status_view"]

# Extra common table expressions that only some queries need.
_EXTRA_WITH = {
    "catalog_search": _SEARCHES,
    "catalog_search_indexed": _SEARCHES,
    "catalog_search_totals": _SEARCHES,
    "customer_history": """
bought AS MATERIALIZED (
  SELECT o_custkey, l_partkey,
         row_number() OVER (PARTITION BY o_custkey ORDER BY SUM(l_quantity) DESC, l_partkey) AS place
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey)""",
    "report_from_logs": """
spoken AS (
  SELECT session_id, speaker, content, ts, COUNT(*) FILTER (speaker = 'agent')
         OVER (PARTITION BY session_id ORDER BY msg_index) AS turn
  FROM msgs WHERE speaker <> 'system'),
placed AS (
  SELECT *, 2 * turn - CASE speaker WHEN 'agent' THEN 2 ELSE 1 END AS place FROM spoken WHERE turn > 0
  QUALIFY row_number() OVER (PARTITION BY session_id, turn, speaker ORDER BY ts, content) = 1),
stops AS (
  SELECT session_id, least(
           MIN(place) FILTER (speaker = 'agent' AND contains(lower(content), 'end')
                              OR speaker = 'client' AND contains(lower(content), 'und')),
           MIN(place) FILTER (speaker = 'agent' AND turn >= 2)) AS stop
  FROM placed GROUP BY session_id),
logged AS (
  SELECT p.session_id, CAST(COUNT(*) FILTER (speaker = 'agent') AS INTEGER) AS total_turns,
         date_diff('microsecond', MIN(ts), MAX(ts)) / 1000000 AS duration_seconds
  FROM placed p JOIN stops s ON p.session_id = s.session_id
  WHERE s.stop IS NULL OR p.place <= s.stop GROUP BY p.session_id)""",
    "evaluate_batch": """
kept AS (
  SELECT m.* FROM msgs m JOIN (
    SELECT session_id, least(MIN(msg_index) FILTER (ends),
           MIN(msg_index) FILTER (speaker = 'agent' AND turn_number >= 30)) AS stop
    FROM flagged GROUP BY session_id) c ON m.session_id = c.session_id
  WHERE c.stop IS NULL OR m.msg_index <= c.stop)""",
}


_EXTRA_WITH["evaluate_stored"] = _EXTRA_WITH["evaluate_batch"]
_EXTRA_WITH["evaluator_request"] = _EXTRA_WITH["evaluate_batch"]
# Queries over base tables alone, without the derived inputs above.
_BASE_ONLY = {"customer_history"}


def oracle_queries() -> dict[str, str]:
    statements = {}
    for name, select in _SELECTS.items():
        extra = _EXTRA_WITH.get(name)
        head = f"{_WITH.rstrip()},\n{extra.strip()}" if extra else _WITH
        if name in _BASE_ONLY:
            head = f"WITH {extra.strip()}"
        statements[name] = f"{head.strip()}\n{select.strip()}"
    return statements
