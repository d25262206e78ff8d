"""The query registry: one entry per operator, over the tables of a folder.

Entries only wire inputs to library functions and pick flat output columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge import constants as c
from talkgauge.functions import templates, text
from talkgauge.operators import catalog, conversations, costs, evaluation, results as rows
from talkgauge.plans import reports, states
from talkgauge.plans.inputs import FIRST_SPEAKER, MARKERS, Inputs
from talkgauge.session import scratch_path
from talkgauge.sources import documents, logs, results as files, scenarios, sinks
from talkgauge.streaming import appends, rates, timeouts
from talkgauge.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}

MAX_TURNS = 2
TIMEOUT_SECONDS = 90
EXPORTED_AT = "2024-02-01 12:00:00"
NOW = "2024-01-16 00:00:00"
PROMPT_TEMPLATE = (
    "Session {session_id} {{raw}}: {PERSONALITY} wants {ORDER_GOAL}, patience {PATIENCE}."
)
EVALUATOR_PROMPT = "Grade the conversation."
SCENARIOS_PER_FILE = 10_000


def _query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    _REGISTRY[build.__name__] = lambda spark, folder: build(Inputs(spark, folder))
    return build


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def _iso(df: DataFrame, *names: str) -> DataFrame:
    """Timestamps as ISO text."""
    return df.withColumns({name: text.iso_timestamp(F.col(name)) for name in names})


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    """Exact money as doubles, for output."""
    return df.withColumns({name: F.col(name).cast("double") for name in names})


def _exported_at() -> Column:
    return F.lit(EXPORTED_AT)


# --- sources ------------------------------------------------------------------


@_query
def read_scenarios(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "scenarios")
    entry = F.struct(
        F.col("c_custkey"),
        F.col("c_name").alias("name"),
        F.struct(
            F.col("c_mktsegment").alias("PERSONALITY"), F.col("c_nationkey").alias("AMB_LEVEL")
        ).alias("variables"),
    )
    chunk = F.floor(F.col("c_custkey") / SCENARIOS_PER_FILE).cast("bigint")
    (
        i.table("customer")
        .groupBy(chunk.alias("chunk"))
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select("chunk", F.to_json("entries").alias("value"))
        .write.partitionBy("chunk")
        .text(path)
    )
    chunk_of_file = F.regexp_extract("source_file", r"/chunk=(\d+)/", 1).cast("bigint")
    return scenarios.read_scenarios(i.spark, path).select(
        chunk_of_file.alias("chunk"),
        F.col("scenario_index").cast("bigint").alias("scenario_index"),
        "name",
        F.col("variables")["PERSONALITY"].alias("personality"),
        F.col("variables")["AMB_LEVEL"].alias("amb_level"),
    )


_RESULT_OUTPUT = [
    "batch_id",
    "session_id",
    "scenario",
    "status",
    "total_turns",
    "duration_seconds",
    "score",
    "comment",
    "evaluation_status",
    "start_time",
]


@_query
def read_results_ndjson(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "results") + ".ndjson"
    sinks.write_results_ndjson(i.results(), path, _exported_at())
    loaded = files.read_results_ndjson(i.spark, path)
    return _iso(loaded.select(*_RESULT_OUTPUT, "end_time", "export_timestamp"), "start_time", "end_time")


@_query
def read_results_csv(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "results") + ".csv"
    sinks.write_results_csv(i.results(), path, "v7")
    loaded = files.read_results_csv(i.spark, path)
    return _iso(loaded.select(*_RESULT_OUTPUT[1:], "prompt_version"), "start_time")


@_query
def load_results(i: Inputs) -> DataFrame:
    base = scratch_path(i.spark, "results")
    sinks.write_results_ndjson(i.results(), base + ".ndjson", _exported_at())
    sinks.write_results_csv(i.results(), base + ".csv")
    loaded = files.load_results(i.spark, base + ".ndjson", base + ".csv")
    return loaded.groupBy("session_id").agg(
        F.count("*").alias("copies"),
        F.count("batch_id").alias("with_batch"),
        F.sum("score").alias("score_sum"),
        F.sum(F.coalesce("total_turns", F.lit(0))).alias("turns_sum"),
    )


def _token_lines(i: Inputs) -> DataFrame:
    """Token log lines, with a line that does not parse after every seventh session's."""
    record = F.to_json(
        F.struct(
            "session_id",
            "model",
            "prompt_tokens",
            "completion_tokens",
            "total_tokens",
            "cost_estimate",
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        )
    )
    stamp = F.concat(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(",000"))
    line = F.concat(stamp, F.lit(" - "), record)
    broken = F.concat(stamp, F.lit(" - {not a record - "), F.col("session_id"))
    lines = F.when(F.col("conv_id") % 7 == 0, F.array(line, broken)).otherwise(F.array(line))
    return i.usage().select("session_id", F.explode(lines).alias("value"))


@_query
def read_token_log(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "logs")
    _token_lines(i).select("value").write.text(f"{path}/tokens_20240201_120000")
    loaded = logs.read_token_log(i.spark, path)
    return _iso(_doubles(loaded, "cost_estimate"), "timestamp")


@_query
def read_conversation_log(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "conversations")
    numbered = i.numbered().filter(F.col("speaker") != "system")
    turns = numbered.select(
        "session_id",
        F.col("turn_number").cast("int").alias("turn_number"),
        F.col("speaker").alias("role"),
        "content",
        F.col("ts").alias("timestamp"),
    )
    done = i.results().select(
        "session_id",
        "total_turns",
        F.col("score").alias("final_score"),
        F.col("comment").alias("evaluator_comment"),
        "status",
        F.col("start_time").alias("timestamp"),
        F.lit("conversation_complete").alias("event_type"),
    )
    sinks.append_logs(turns, path)
    sinks.append_logs(done, path)
    turn_rows, completions = logs.read_conversation_log(i.spark, path)
    per_session = turn_rows.groupBy("session_id").agg(
        F.count("*").alias("turn_records"),
        F.max("turn_number").alias("last_turn"),
        F.sum(F.length("content")).alias("n_chars"),
        F.max("timestamp").alias("last_timestamp"),
    )
    joined = completions.join(per_session, "session_id", "left")
    return _iso(joined, "timestamp", "last_timestamp")


@_query
def report_from_logs(i: Inputs) -> DataFrame:
    """From both kinds of conversation records, as files, to cut conversations and their report."""
    path = scratch_path(i.spark, "conversations")
    spoken = conversations.number_turns(i.messages().filter(F.col("speaker") != "system"), "agent")
    turns = spoken.filter(F.col("turn_number") > 0).select(
        "session_id", F.col("turn_number").cast("int").alias("turn_number"), F.col("speaker").alias("role"), "content", F.col("ts").alias("timestamp")
    )
    done = i.results().select(
        "session_id", F.col("score").alias("final_score"), F.col("comment").alias("evaluator_comment"), "status",
        F.col("start_time").alias("timestamp"), F.lit("conversation_complete").alias("event_type"),
    )
    sinks.append_logs(turns, path)
    sinks.append_logs(done, path)
    report = reports.report_from_logs(*logs.read_conversation_log(i.spark, path), MAX_TURNS, **MARKERS)
    return _flat(report).drop("batch_id")


@_query
def read_service_log(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "service")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",250"))
    number = F.col("event_id").cast("string")
    attempt = F.concat(
        F.lit("request failed (attempt "),
        (F.col("event_id") % 3 + 1).cast("string"),
        F.lit("/3) - "),
        F.to_json(F.struct("user_id")),
    )
    error = F.array(
        F.concat(stamp, F.lit(" - app_error - ERROR - "), attempt),
        F.lit("Traceback (most recent call last):"),
        F.concat(F.lit("ValueError: "), number),
    )
    info = F.array(F.concat(stamp, F.lit(" - app - INFO - saw "), F.col("event_type")))
    lines = F.when(F.col("event_type") == "error", error).otherwise(info)
    i.table("events").select(F.explode(lines).alias("value")).write.text(f"{path}/app_1")
    log = logs.read_service_log(i.spark, f"{path}/app_*")
    levels = logs.count_levels(log)
    details = log.groupBy("level").agg(
        F.sum("attempt").alias("attempt_sum"),
        F.count("extra").alias("with_extra"),
        F.max("ts").alias("last_ts"),
    )
    return _iso(levels.join(details, "level"), "last_ts")


def _exports(i: Inputs) -> str:
    """Two dated exports of both formats."""
    base = scratch_path(i.spark, "exports")
    for export_ts in ("20240201_120000", "20240202_120000"):
        for file_format in ("ndjson", "csv"):
            sinks.write_export(
                i.results(), f"{base}/results.{file_format}", file_format, export_ts, _exported_at()
            )
    return base


@_query
def list_result_files(i: Inputs) -> DataFrame:
    listed = files.list_result_files(i.spark, _exports(i), "batch-1")
    return listed.select(
        F.regexp_extract("filepath", r"/(batch_id=[^/]+/export_ts=[^/]+)/", 1).alias("folder"),
        (F.col("size_bytes") > 0).alias("has_content"),
    ).distinct()


@_query
def latest_export(i: Inputs) -> DataFrame:
    return files.latest_export(files.list_result_files(i.spark, _exports(i)))


@_query
def logs_for_batch(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "logs")
    batches = i.results().select("session_id", "batch_id")
    lines = _token_lines(i).join(batches, "session_id").select("batch_id", "value")
    lines.write.partitionBy("batch_id").text(path)
    found = logs.parse_token_lines(files.logs_for_batch(i.spark, path, "batch-1"))
    return found.groupBy("session_id").agg(
        F.count("*").alias("requests"), F.sum("total_tokens").alias("tokens")
    )


# --- sinks --------------------------------------------------------------------


@_query
def write_results_ndjson(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "results")
    sinks.write_results_ndjson(i.results(), path, _exported_at())
    line = F.col("value")
    return i.spark.read.option("recursiveFileLookup", True).text(path).select(
        F.get_json_object(line, "$.batch_id").alias("batch_id"),
        F.get_json_object(line, "$.session_id").alias("session_id"),
        F.get_json_object(line, "$.export_timestamp").alias("export_timestamp"),
        F.get_json_object(line, "$.comment").alias("comment"),
        line.contains('"scenario":').alias("has_scenario"),
        line.contains('"duration_seconds":').alias("has_duration"),
        F.get_json_object(line, "$.start_time").alias("start_time"),
    )


@_query
def write_results_csv(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "results")
    sinks.write_results_csv(i.results(), path)
    plain = ", ".join(f"{name} STRING" for name in c.CSV_COLUMNS)
    return i.spark.read.schema(plain).option("header", True).option("escape", '"').csv(path)


@_query
def write_summary_json(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "summary")
    at = F.lit(EXPORTED_AT).cast("timestamp_ntz")
    sinks.write_document(reports.summary_document(i.results(), at), path)
    lines = i.spark.read.text(path)
    head = F.concat("value", F.lit("}}"))
    is_head = F.col("value").startswith('{"batch_id"')

    def of_head(json_path: str) -> Column:
        return F.max(F.when(is_head, F.get_json_object(head, json_path)))

    return lines.groupBy("batch_id").agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("value").startswith(",")).alias("separators"),
        of_head("$.total_scenarios").cast("bigint").alias("total_scenarios"),
        of_head("$.score_statistics.mean").cast("double").alias("score_mean"),
        of_head("$.duration_statistics.median").cast("double").alias("duration_median"),
        F.max(F.when(F.col("value").startswith("}"), F.col("value"))).alias("footer"),
    )


@_query
def write_summary_json_scenarios(i: Inputs) -> DataFrame:
    """The body lines of the written summary documents, read back as JSON."""
    path = scratch_path(i.spark, "summary")
    at = F.lit(EXPORTED_AT).cast("timestamp_ntz")
    sinks.write_document(reports.summary_document(i.results(), at), path)
    body = i.spark.read.text(path).filter(F.col("value").rlike('^,?"'))
    figures = "struct<score_count:bigint,score_mean:double,duration_seconds_mean:double,total_turns_mean:double>"
    member = F.from_json(
        F.concat(F.lit("{"), F.regexp_replace("value", "^,", ""), F.lit("}")), f"map<string,{figures}>"
    )
    found = body.select("batch_id", F.explode(member).alias("scenario", "f"))
    return found.select("batch_id", "scenario", "f.*")


@_query
def document_parts(i: Inputs) -> DataFrame:
    """Bytes of the written result envelopes by their manifest, and how many parts are not as it says."""
    path = scratch_path(i.spark, "envelopes")
    columns = ["batch_id", "scenario_index", "session_id", "status", "score"]
    sinks.write_document(reports.results_envelope(i.results().select(*columns)), path)
    listed = documents.document_parts(i.spark, path).groupBy("batch_id").agg(F.sum("bytes").alias("bytes"))
    damaged = documents.damaged_parts(i.spark, path).groupBy("batch_id").agg(F.count("*").alias("_n"))
    return listed.join(damaged, "batch_id", "left").select("batch_id", "bytes", F.coalesce("_n", F.lit(0)).alias("damaged"))


@_query
def write_summary_csv(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "summary")
    sinks.write_summary_csv(i.results(), path)
    types = {"score": "INT", "total_turns": "INT", "duration_seconds": "DOUBLE"}
    schema = ", ".join(f"{name} {types.get(name, 'STRING')}" for name in c.SUMMARY_COLUMNS)
    return i.spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


@_query
def append_logs(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "tokens")
    usage = i.usage()
    for half in (0, 1):
        sinks.append_logs(usage.filter(F.col("conv_id") % 2 == half), path)
    return (
        i.spark.read.schema("log_date DATE, session_id STRING, total_tokens BIGINT")
        .json(path)
        .groupBy("session_id", F.col("log_date").cast("string").alias("log_date"))
        .agg(F.count("*").alias("requests"), F.sum("total_tokens").alias("tokens"))
    )


@_query
def results_envelope(i: Inputs) -> DataFrame:
    lines = reports.results_envelope(
        i.results().select("batch_id", "scenario_index", "session_id", "status", "score")
    )
    return lines.select("batch_id", "section", "position", "line")


# --- filters and validation ---------------------------------------------------


@_query
def validate_scenarios(i: Inputs) -> DataFrame:
    name = F.concat(F.lit('{"name":"'), F.col("c_name"), F.lit('"'))
    good = F.concat(name, F.lit(',"variables":{}}'))
    shapes = F.array(
        F.lit("[]"),
        F.lit('{"a":1}'),
        F.concat(F.lit("["), good, F.lit(",7]")),
        F.concat(F.lit("["), good, F.lit(","), name, F.lit("}]")),
        F.lit('[{"variables":{}}]'),
        F.concat(F.lit("["), good, F.lit("]")),
        F.lit('[{"name":null,"variables":null}]'),
    )
    request = F.element_at(shapes, (F.col("c_custkey") % 7 + 1).cast("int"))
    requests = i.table("customer").select("c_custkey", request.alias("scenarios"))
    return scenarios.validate_scenarios(requests).select("c_custkey", "error")


@_query
def validate_scenarios_strict(i: Inputs) -> DataFrame:
    """Variables of four kinds; only objects pass."""
    kinds = F.array(*[F.lit(v) for v in ("{}", "[1]", '"text"', "null")])
    value = F.element_at(kinds, (F.col("c_custkey") % 4 + 1).cast("int"))
    request = F.concat(
        F.lit('[{"name":"a","variables":{}},{"name":"b","variables":'), value, F.lit("}]")
    )
    requests = i.table("customer").select("c_custkey", request.alias("scenarios"))
    return scenarios.validate_scenarios(requests, strict=True).select("c_custkey", "error")


@_query
def scenario_by_index(i: Inputs) -> DataFrame:
    listed = i.scenarios()
    requests = listed.select(
        F.col("scenario_index").alias("request_id"),
        (F.col("scenario_index") * 2).alias("scenario_index"),
    )
    return rows.scenario_by_index(listed, requests)


@_query
def completed_batches(i: Inputs) -> DataFrame:
    return rows.completed_batches(i.results(), i.jobs()).select("batch_id", "session_id", "score")


@_query
def unserved_batches(i: Inputs) -> DataFrame:
    return rows.unserved_batches(i.results(), i.jobs())


@_query
def status_counts(i: Inputs) -> DataFrame:
    return reports.status_counts(i.results())


@_query
def non_null_scores(i: Inputs) -> DataFrame:
    return rows.non_null_scores(i.results()).select("session_id", "score")


@_query
def evaluable_conversations(i: Inputs) -> DataFrame:
    return rows.evaluable_conversations(i.results()).select("session_id", "status")


@_query
def expired_batches(i: Inputs) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz")
    return _iso(
        rows.expired_batches(i.jobs(), now).select("batch_id", "status", "completed_at"),
        "completed_at",
    )


@_query
def kept_batches(i: Inputs) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz")
    return rows.kept_batches(i.jobs(), now).select("batch_id", "status")


@_query
def removed_batch_count(i: Inputs) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz")
    return rows.expired_batches(i.jobs(), now).agg(F.count("*").alias("removed"))


# --- projections --------------------------------------------------------------


@_query
def read_prompt_templates(i: Inputs) -> DataFrame:
    """Each customer's prompt from the template of their segment; one segment has no file."""
    path = scratch_path(i.spark, "templates")
    customers = i.table("customer").select("c_name", "c_mktsegment")
    segments = customers.select("c_mktsegment").distinct()
    text_of = F.concat(F.lit("You speak for "), "c_mktsegment", F.lit(".\nGreet {session_id}!"))
    segments.filter(F.col("c_mktsegment") != "MACHINERY").select(
        F.col("c_mktsegment").alias("template_name"), text_of.alias("value")
    ).write.partitionBy("template_name").text(path)
    names = segments.withColumnRenamed("c_mktsegment", "template_name")
    read = scenarios.read_prompt_templates(i.spark, path, names)
    joined = customers.join(read, customers["c_mktsegment"] == read["template_name"])
    empty = F.create_map().cast("map<string,string>")
    prompt, status = templates.render(F.col("template"), empty, F.col("c_name"))
    return joined.select("c_name", "template_name", prompt.alias("prompt"), status.alias("render_status"))


@_query
def render_prompts(i: Inputs) -> DataFrame:
    goal = F.concat(F.lit('[{"name":"{session_id}", "qty":'), F.col("c_nationkey").cast("string"), F.lit("}]"))
    entries = F.filter(
        F.array(
            F.struct(F.lit("PERSONALITY").alias("k"), F.col("c_mktsegment").alias("v")),
            F.struct(F.lit("ORDER_GOAL").alias("k"), goal.alias("v")),
            F.struct(
                F.when(F.col("c_custkey") % 5 != 0, F.lit("PATIENCE")).alias("k"),
                F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 4).cast("string")).alias("v"),
            ),
        ),
        lambda e: e["k"].isNotNull(),
    )
    callers = i.table("customer").select(
        F.col("c_name").alias("session_id"), F.map_from_entries(entries).alias("variables")
    )
    prompt, status = templates.render(
        F.lit(PROMPT_TEMPLATE), F.col("variables"), F.col("session_id")
    )
    return callers.select("session_id", prompt.alias("prompt"), status.alias("render_status"))


@_query
def csv_rows(i: Inputs) -> DataFrame:
    return rows.csv_rows(i.results(), "v7")


@_query
def summary_columns(i: Inputs) -> DataFrame:
    return rows.summary_columns(i.results().drop("duration_seconds"))


@_query
def stamp_export(i: Inputs) -> DataFrame:
    own = F.when(F.col("scenario_index") % 2 == 0, F.col("batch_id"))
    plain = i.results().withColumn("batch_id", own).select("session_id", "batch_id")
    return rows.stamp_export(plain, "batch-x", _exported_at())


@_query
def stamp_prompt_version(i: Inputs) -> DataFrame:
    plain = i.results().select("session_id", "score")
    return rows.stamp_prompt_version(plain)


@_query
def assign_session_id(i: Inputs) -> DataFrame:
    given = (
        F.when(F.col("scenario_index") % 3 == 0, F.col("session_id"))
        .when(F.col("scenario_index") % 3 == 1, F.lit(""))
    )
    plain = i.results().select("batch_id", "scenario_index", given.alias("session_id"))
    return rows.assign_session_id(plain, "batch_id", "scenario_index")


@_query
def job_status_view(i: Inputs) -> DataFrame:
    return rows.job_status_view(i.jobs())


@_query
def evaluator_request(i: Inputs) -> DataFrame:
    kept = conversations.cut_at_end(i.messages(), FIRST_SPEAKER, **MARKERS)
    requests = evaluation.evaluator_request(
        conversations.transcript_text(kept, None, FIRST_SPEAKER), EVALUATOR_PROMPT
    )
    return requests.select("session_id", F.inline("messages"))


@_query
def request_cost(i: Inputs) -> DataFrame:
    costed = i.usage().select("session_id", "msg_index", "model", "total_tokens", "cost_estimate")
    return _doubles(costed, "cost_estimate")


def _result_rows(i: Inputs) -> DataFrame:
    ran, exceptions = i.attempts()
    evaluations = evaluation.evaluate_replies(i.replies())
    evaluated = evaluation.join_evaluation(
        ran.drop("score", "comment", "evaluation_status"), evaluations
    )
    named = rows.failed_scenario_name(exceptions, i.scenarios())
    return rows.result_rows(evaluated, named)


@_query
def result_rows(i: Inputs) -> DataFrame:
    return _iso(_result_rows(i), "start_time", "end_time")


# --- conversations ------------------------------------------------------------


@_query
def conversation_history(i: Inputs) -> DataFrame:
    history = conversations.conversation_history(i.messages(), FIRST_SPEAKER)
    entries = history.select("session_id", "part", F.posexplode("history").alias("pos", "e"))
    return _iso(
        entries.select(
            "session_id", "part", "pos", "e.turn", "e.speaker", "e.content", "e.timestamp"
        ),
        "timestamp",
    )


@_query
def transcript_text(i: Inputs) -> DataFrame:
    return conversations.transcript_text(i.messages(), i.results(), FIRST_SPEAKER)


@_query
def end_detection(i: Inputs) -> DataFrame:
    return conversations.end_detection(i.messages(), **MARKERS).select(
        "session_id", "msg_index", "speaker", "ends"
    )


@_query
def cut_at_end(i: Inputs) -> DataFrame:
    kept = conversations.cut_at_end(i.messages(), FIRST_SPEAKER, MAX_TURNS, **MARKERS)
    return kept.select("session_id", "msg_index", "speaker", "content")


@_query
def cut_at_timeout(i: Inputs) -> DataFrame:
    kept = conversations.cut_at_timeout(i.messages(), FIRST_SPEAKER, TIMEOUT_SECONDS)
    return kept.select("session_id", "msg_index", "speaker")


@_query
def end_reason(i: Inputs) -> DataFrame:
    cuts = conversations.cut_points(
        i.messages(), FIRST_SPEAKER, MAX_TURNS, TIMEOUT_SECONDS, **MARKERS
    )
    return conversations.end_reason(cuts)


@_query
def total_turns(i: Inputs) -> DataFrame:
    return conversations.total_turns(i.messages())


def _system_prompts(i: Inputs) -> DataFrame:
    prompt = F.concat(F.lit("You talk in "), F.col("session_id"))
    return i.sessions().select("session_id", prompt.alias("prompt"))


@_query
def agent_context(i: Inputs) -> DataFrame:
    return conversations.agent_context(i.messages(), _system_prompts(i))


@_query
def client_context(i: Inputs) -> DataFrame:
    return conversations.client_context(i.messages(), _system_prompts(i))


@_query
def context_at(i: Inputs) -> DataFrame:
    """The context of each session's last agent message, entry by entry."""
    last = (
        i.messages()
        .filter(F.col("speaker") == "agent")
        .groupBy("session_id")
        .agg(F.max("msg_index").alias("msg_index"))
    )
    context = conversations.agent_context(i.messages(), _system_prompts(i))
    arrays = conversations.context_at(context, last)
    entries = arrays.select("session_id", "msg_index", F.posexplode("messages").alias("pos", "m"))
    return entries.select("session_id", "msg_index", "pos", "m.role", "m.content")


@_query
def conversation_result(i: Inputs) -> DataFrame:
    sessions = i.results().select(
        "session_id", "scenario", "status", F.concat(F.lit("lost "), "session_id").alias("error")
    )
    return _iso(
        conversations.conversation_result(i.messages(), sessions), "start_time", "end_time"
    )


@_query
def number_turns(i: Inputs) -> DataFrame:
    return i.numbered().select("session_id", "msg_index", "speaker", "turn_number")


# --- evaluation ---------------------------------------------------------------


@_query
def parse_evaluation(i: Inputs) -> DataFrame:
    parsed = evaluation.parse_evaluation(i.replies())
    return parsed.select(
        "session_id",
        "raw",
        "reply_kind",
        F.when(F.col("reply_kind") == "INVALID", "invalid_json").alias("error"),
    )


@_query
def validate_score(i: Inputs) -> DataFrame:
    scored = evaluation.validate_score(evaluation.parse_evaluation(i.replies()))
    return scored.select("session_id", "score", "score_valid")


@_query
def normalize_comment(i: Inputs) -> DataFrame:
    scored = evaluation.validate_score(evaluation.parse_evaluation(i.replies()))
    return evaluation.normalize_comment(scored).select("session_id", "comment")


@_query
def evaluation_fallback(i: Inputs) -> DataFrame:
    return evaluation.evaluate_replies(i.replies()).select(
        "session_id", "score", "comment", "evaluation_status", "error"
    )


def _judge(transcript: str) -> str:
    size = len(transcript)
    if size % 11 == 0:
        raise ValueError("no answer")
    return '{"score":%d,"comment":"%d characters"}' % (1 + size % 4, size)


def _asked(i: Inputs) -> DataFrame:
    kept = conversations.cut_at_end(i.messages(), FIRST_SPEAKER, **MARKERS)
    transcripts = conversations.transcript_text(kept, None, FIRST_SPEAKER)
    return evaluation.whole_transcripts(transcripts).join(i.results(), "session_id").select(
        F.col("scenario_index").alias("conversation_index"),
        F.when(F.col("scenario_index") % 10 != 9, F.col("session_id")).alias("session_id"),
        "scenario",
        "transcript",
    )


_EVALUATED = ["conversation_index", "session_id", "scenario", "score", "comment", "evaluation_status"]


@_query
def evaluate_batch(i: Inputs) -> DataFrame:
    return evaluation.evaluate_batch(_asked(i), _judge).select(*_EVALUATED)


@_query
def evaluate_stored(i: Inputs) -> DataFrame:
    """The same replies, kept: a first run over some of the conversations, a second over all."""
    path = scratch_path(i.spark, "replies")
    asked = _asked(i)
    evaluation.evaluate_stored(asked.filter(F.col("conversation_index") % 3 == 0), _judge, path, EVALUATOR_PROMPT)
    return evaluation.evaluate_stored(asked, _judge, path, EVALUATOR_PROMPT).select(*_EVALUATED)


@_query
def evaluation_summary(i: Inputs) -> DataFrame:
    return evaluation.evaluation_summary(evaluation.evaluate_replies(i.replies()))


# --- joins --------------------------------------------------------------------


@_query
def price_lookup(i: Inputs) -> DataFrame:
    priced = costs.price_lookup(i.token_log(), costs.price_table(i.spark))
    return _doubles(
        priced.select("session_id", "msg_index", "model", "input_per_1k", "output_per_1k"),
        "input_per_1k",
        "output_per_1k",
    )


@_query
def join_evaluation(i: Inputs) -> DataFrame:
    conversations_only = i.results().select("session_id", "scenario", "status")
    return evaluation.join_evaluation(
        conversations_only, evaluation.evaluate_replies(i.replies())
    )


@_query
def usage_by_batch(i: Inputs) -> DataFrame:
    return _doubles(costs.usage_by_batch(i.usage(), i.results()), "cost")


@_query
def failed_scenario_name(i: Inputs) -> DataFrame:
    _, exceptions = i.attempts()
    return rows.failed_scenario_name(exceptions, i.scenarios())


def _searches(i: Inputs) -> DataFrame:
    """Searches a caller of this catalogue may make: starts of names, by category."""
    part = i.table("part")
    words = part.select(
        F.upper(F.substring("p_name", 1, 4)).alias("query"),
        F.substring("p_type", 1, 3).alias("category"),
    )
    short = part.select(F.substring("p_name", 2, 2).alias("query"), F.lit("").alias("category"))
    everything = part.select(F.lit("").alias("query"), F.col("p_type").alias("category"))
    unknown = part.select(F.lit("nothing like it").alias("query"), F.lit("").alias("category"))
    searches = words.union(short).union(everything).union(unknown).distinct()
    return searches.withColumn("search_id", F.concat("query", F.lit("/"), "category"))


def _catalog(i: Inputs) -> DataFrame:
    return i.table("part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
    )


@_query
def catalog_search(i: Inputs) -> DataFrame:
    return catalog.catalog_search(_catalog(i), _searches(i))


@_query
def catalog_search_indexed(i: Inputs) -> DataFrame:
    """The same searches against a stored index."""
    path = scratch_path(i.spark, "index")
    catalog.write_index(catalog.name_index(_catalog(i)), path)
    return catalog.catalog_search(_catalog(i), _searches(i), catalog.read_index(i.spark, path))


@_query
def catalog_search_totals(i: Inputs) -> DataFrame:
    searches = _searches(i)
    return catalog.catalog_search_totals(catalog.catalog_search(_catalog(i), searches), searches)


@_query
def customer_history(i: Inputs) -> DataFrame:
    customers = i.table("customer").select(F.col("c_custkey").alias("customer_id"))
    orders = i.table("orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
    )
    items = i.table("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_quantity").alias("quantity"),
    )
    history = catalog.customer_history(customers, orders, items, _catalog(i))
    return _iso(history, "last_order_date")


# --- aggregations -------------------------------------------------------------


@_query
def batch_counts(i: Inputs) -> DataFrame:
    return reports.batch_counts(i.results())


@_query
def score_stats(i: Inputs) -> DataFrame:
    return reports.score_stats(i.results())


@_query
def score_distribution(i: Inputs) -> DataFrame:
    return reports.score_distribution(i.results())


@_query
def turn_stats(i: Inputs) -> DataFrame:
    return reports.turn_stats(i.results())


@_query
def duration_stats(i: Inputs) -> DataFrame:
    return reports.duration_stats(i.results())


@_query
def scenario_performance(i: Inputs) -> DataFrame:
    return reports.scenario_performance(i.results())


def _flat(report: DataFrame) -> DataFrame:
    """A nested report without its scenarios."""
    nested = {
        "score": "score_statistics",
        "turns": "turn_statistics",
        "duration": "duration_statistics",
    }
    flat = [
        F.col(f"{group}.{field}").alias(f"{prefix}_{field}")
        for prefix, group in nested.items()
        for field in report.schema[group].dataType.names
    ]
    counts = ["total_scenarios", "successful_scenarios", "failed_scenarios", "success_rate"]
    return report.select("batch_id", *counts, *flat, "score_distribution.*")


@_query
def summary_report(i: Inputs) -> DataFrame:
    report = reports.summary_report(i.results(), i.jobs())
    return _flat(report)


@_query
def summary_report_scenarios(i: Inputs) -> DataFrame:
    report = reports.summary_report(i.results(), i.jobs())
    return report.select("batch_id", F.inline("scenario_performance"))


def _stored_states(i: Inputs) -> states.States:
    """States of all results, stored by the day of their start, the second half after the first."""
    path = scratch_path(i.spark, "states")
    results = i.results()
    day = F.coalesce(F.to_date("start_time"), F.lit("1970-01-01").cast("date"))
    for half in (0, 1):
        some = results.filter(F.dayofyear(day) % 2 == half)
        states.write_states(states.report_states(some, day), path)
    return states.read_states(i.spark, path)


@_query
def summary_states(i: Inputs) -> DataFrame:
    """The report from stored states, and whether the rank of its median of durations is within its bound."""
    report = _flat(states.report_from_states(_stored_states(i), i.jobs()))
    timed = i.results().select("batch_id", "duration_seconds").filter(F.col("duration_seconds").isNotNull())
    ranks = timed.join(report.select("batch_id", "duration_median"), "batch_id").groupBy("batch_id").agg(
        F.avg((F.col("duration_seconds") < F.col("duration_median")).cast("int")).alias("_below"),
        F.avg((F.col("duration_seconds") <= F.col("duration_median")).cast("int")).alias("_upto"),
    )
    bound = states.rank_error(states.SKETCH_SIZE)
    near = (F.col("_below") <= 0.5 + bound) & (F.col("_upto") >= 0.5 - bound)
    checked = report.join(ranks.select("batch_id", near.alias("median_in_bound")), "batch_id", "left")
    return checked.drop("duration_median")


@_query
def summary_states_scenarios(i: Inputs) -> DataFrame:
    report = states.report_from_states(states.merge_states(_stored_states(i)))
    return report.select("batch_id", F.inline("scenario_performance"))


@_query
def console_summary(i: Inputs) -> DataFrame:
    return reports.console_summary(i.results())


@_query
def quick_summary(i: Inputs) -> DataFrame:
    return reports.quick_summary(i.results())


@_query
def run_outcome(i: Inputs) -> DataFrame:
    return reports.run_outcome(_result_rows(i))


@_query
def batch_progress(i: Inputs) -> DataFrame:
    planned = i.jobs().select("batch_id", (F.col("total_scenarios") * 30).alias("total_scenarios"))
    return reports.batch_progress(i.results(), planned)


@_query
def score_histogram(i: Inputs) -> DataFrame:
    return reports.score_histogram(i.results())


@_query
def cost_report(i: Inputs) -> DataFrame:
    report = costs.cost_report(i.usage(), i.results(), i.jobs())
    return _doubles(report, "total_cost_usd")


@_query
def cost_by_model(i: Inputs) -> DataFrame:
    return _doubles(costs.cost_by_model(i.usage()), "total_cost_usd")


@_query
def prompt_version_comparison(i: Inputs) -> DataFrame:
    return reports.prompt_version_comparison(i.results(), "v1", "v2")


@_query
def determinism_check(i: Inputs) -> DataFrame:
    return reports.determinism_check(i.results())


@_query
def throughput_report(i: Inputs) -> DataFrame:
    return reports.throughput_report(i.results(), i.usage())


@_query
def peak_concurrency(i: Inputs) -> DataFrame:
    return reports.peak_concurrency(i.results(), limit=1)


@_query
def order_total(i: Inputs) -> DataFrame:
    orders = i.table("orders").select(F.col("o_orderkey").alias("order_id"))
    price = F.col("p_retailprice").cast("DECIMAL(12,2)")  # once per part, not once per line
    prices = i.table("part").select("p_partkey", price.alias("price"))
    lines = i.table("lineitem")
    items = lines.join(prices, lines["l_partkey"] == prices["p_partkey"], "left").select(
        F.col("l_orderkey").alias("order_id"), "price", F.col("l_quantity").alias("quantity")
    )
    return _doubles(catalog.order_totals(orders, items), "total_amount")


@_query
def order_total_of_array(i: Inputs) -> DataFrame:
    """The same totals from orders that carry their items as an array."""
    item = F.struct(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    given = F.when(F.col("l_linenumber") % 5 != 0, item)  # every fifth line has no price or quantity
    absent = F.struct(F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("quantity"))
    orders = i.table("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.collect_list(F.coalesce(given, absent)).alias("items")
    )
    totals = orders.select("order_id", catalog.order_total(F.col("items")).alias("total_amount"))
    return _doubles(totals, "total_amount")


# --- sorts and set operations -------------------------------------------------


@_query
def list_batches(i: Inputs) -> DataFrame:
    return rows.list_batches(i.jobs())


@_query
def score_order(i: Inputs) -> DataFrame:
    return reports.score_order(i.results())


@_query
def union_outcomes(i: Inputs) -> DataFrame:
    return rows.union_outcomes(_result_rows(i)).select(
        "batch_id", "scenario_index", "scenario", "status", "score", "comment"
    )


# --- streaming ----------------------------------------------------------------


@_query
def stream_token_usage(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "stream")
    events = i.event_stream().withColumn("ts", F.col("ts").cast("timestamp"))
    usage = streams.stream_token_usage(i.event_usage(events))
    out = streams.run_available(usage, f"{path}/out", f"{path}/checkpoint")
    return _iso(_doubles(out, "cost"), "window_start")


@_query
def request_rate(i: Inputs) -> DataFrame:
    return _iso(reports.request_rate(i.table("events"), limit=1), "second")


@_query
def stream_batch_progress(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "stream")
    status = (
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "signup", "running")
        .otherwise("completed")
    )
    batch = F.concat(F.lit("batch-"), (F.col("user_id") % 10).cast("string"))
    rows_in = i.event_stream().select(batch.alias("batch_id"), status.alias("status"))
    progress = streams.stream_batch_progress(rows_in)
    return streams.run_upserts(
        i.spark, progress, ["batch_id"], f"{path}/out", f"{path}/checkpoint"
    )


@_query
def stream_conversation_timeout(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "stream")
    starts = i.message_stream().filter(F.col("msg_index") == 0)
    ends = conversations.end_detection(i.message_stream(), **MARKERS).filter("ends")
    late = streams.stream_conversation_timeout(starts, ends)
    out = streams.run_available(late, f"{path}/out", f"{path}/checkpoint")
    return _iso(out, "started_at", "deadline")


@_query
def stream_exchange_timeout(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "stream")
    cuts = timeouts.stream_exchange_timeout(i.message_stream(), FIRST_SPEAKER, "10 minutes", TIMEOUT_SECONDS)
    timeouts.run_stateful(i.spark, cuts, f"{path}/out", f"{path}/checkpoint")
    return _iso(i.spark.read.schema(cuts.schema).parquet(f"{path}/out"), "started_at")


@_query
def stream_request_rate(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "stream")
    rated = rates.stream_request_rate(i.event_stream(), limit=1)
    return _iso(streams.run_available(rated, f"{path}/out", f"{path}/checkpoint"), "second")


@_query
def request_peaks(i: Inputs) -> DataFrame:
    return _iso(rates.request_peaks(i.table("events"), limit=1), "second")


@_query
def stream_request_peaks(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "stream")
    out = rates.run_request_peaks(i.spark, i.event_stream(), f"{path}/out", f"{path}/checkpoint", limit=1)
    return _iso(out, "second")


@_query
def stream_append_logs(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "stream")
    usage = i.event_usage(i.event_stream())
    appends.start_append_logs(usage, f"{path}/out", f"{path}/checkpoint", at="ts").awaitTermination()
    stored = appends.read_appended_logs(i.spark, f"{path}/out", usage.schema)
    return stored.groupBy("model", F.col("log_date").cast("string").alias("log_date")).agg(
        F.count("*").alias("requests"), F.sum("total_tokens").alias("tokens")
    )
