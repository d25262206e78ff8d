"""Explicit schemas (DDL) of every record type, so that no read ever infers one."""

RESULT = (
    "batch_id STRING, export_timestamp STRING, scenario_index BIGINT, scenario STRING,"
    " session_id STRING, prompt_version STRING, status STRING, error STRING,"
    " total_turns INT, duration_seconds DOUBLE, score INT, comment STRING,"
    " evaluation_status STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ"
)

RESULT_CSV = (
    "session_id STRING, scenario STRING, prompt_version STRING, score INT, comment STRING,"
    " total_turns INT, start_time TIMESTAMP_NTZ, status STRING, duration_seconds DOUBLE,"
    " evaluation_status STRING"
)

CONVERSATION_LOG = (
    "session_id STRING, turn_number INT, role STRING, content STRING, tool_calls STRING,"
    " tool_results STRING, total_turns INT, final_score INT, evaluator_comment STRING,"
    " status STRING, timestamp TIMESTAMP_NTZ, event_type STRING, _broken STRING"
)
