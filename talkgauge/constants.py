"""Fixed values.

Texts, word lists, defaults and prices that have to equal the agreed ones for
results to be right.  They are data, not logic; operators take them as default
arguments so that callers can pass their own.
"""

# --- fixed values: conversation end rules -------------------------------------
AGENT_END_MARKERS = ("end_call",)
CLIENT_END_MARKERS = ("до свидания", "спасибо", "всё", "хватит", "конец")
MAX_TURNS = 30
TIMEOUT_SECONDS = 90
CONCURRENCY_LIMIT = 4
REQUESTS_PER_SECOND_LIMIT = 200
JOB_MAX_AGE_HOURS = 24

# --- fixed values: transcript and prompt texts --------------------------------
TRANSCRIPT_HEADER = "=== РАЗГОВОР ДЛЯ ОЦЕНКИ ===\n\n"
TRANSCRIPT_FOOTER = "=== КОНЕЦ РАЗГОВОРА ==="
TURN_WORD = "Ход"
AGENT_LABEL = "АГЕНТ"
CLIENT_LABEL = "КЛИЕНТ"
KICKOFF_MESSAGE = "Начните разговор с клиентом."
EVALUATOR_TEMPLATE_NAME = "evaluator_system"
EVALUATOR_FALLBACK_TEMPLATE = (
    "You are an expert evaluator of customer service conversations. \n"
    "            Evaluate the conversation and respond with JSON: "
    '{"score": [1,2,3], "comment": "explanation"}'
)

# --- fixed values: evaluation comments ----------------------------------------
VALID_SCORES = (1, 2, 3)
FALLBACK_SCORE = 1
COMMENT_INVALID_REPLY = "invalid evaluator output"
COMMENT_BAD_SCORE_PREFIX = "Некорректная оценка от системы оценки. Оригинальный ответ: "
COMMENT_ABSENT = "Комментарий отсутствует"
COMMENT_BLANK = "Комментарий не предоставлен"
COMMENT_EVALUATION_FAILED_PREFIX = "Ошибка оценки: "
COMMENT_NOT_FINISHED_PREFIX = "Разговор не завершен: "
COMMENT_PROCESSING_FAILED_PREFIX = "Ошибка обработки: "
UNKNOWN_ERROR = "неизвестная ошибка"

# --- fixed values: error texts for replies that are JSON but not an object ----
ERROR_REPLY_LIST = "'list' object has no attribute 'get'"
ERROR_REPLY_STRING = "'str' object has no attribute 'get'"
ERROR_REPLY_SCALAR = "argument of type '{}' is not iterable"
ERROR_REPLY_MISSING = "the JSON object must be str, bytes or bytearray, not NoneType"

# --- fixed values: scenario validation messages -------------------------------
MESSAGE_NO_SCENARIOS = "No scenarios provided"
MESSAGE_NOT_A_LIST = "Scenarios must be a list"
MESSAGE_NOT_AN_OBJECT = "Scenario {} must be an object"
MESSAGE_MISSING_NAME = "Scenario {} missing 'name' field"
MESSAGE_VARIABLES_NOT_AN_OBJECT = "Scenario {} 'variables' must be an object"
MESSAGE_MISSING_VARIABLES = "Scenario {} missing 'variables' field"
MESSAGE_FILE_NOT_AN_ARRAY = "Scenarios file must contain a JSON array"

# --- fixed values: price per 1,000 tokens, US dollars -------------------------
PRICES_PER_1K = (
    ("gpt-4o-mini", "0.00015", "0.0006"),
    ("gpt-4o", "0.005", "0.015"),
    ("gpt-4", "0.03", "0.06"),
    ("gpt-3.5-turbo", "0.0015", "0.002"),
)

# --- fixed values: result file layout -----------------------------------------
CSV_COLUMNS = (
    "session_id",
    "scenario",
    "prompt_version",
    "score",
    "comment",
    "turns",
    "start_ts",
    "status",
    "duration_seconds",
    "evaluation_status",
)
SUMMARY_COLUMNS = (
    "session_id",
    "scenario",
    "score",
    "total_turns",
    "duration_seconds",
    "status",
)
DEFAULT_PROMPT_VERSION = "default"
TERMINAL_STATUSES = ("completed", "failed", "cancelled")
