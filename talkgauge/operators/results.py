"""Result rows: assembly, filters and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgauge import constants as c
from talkgauge.functions import text


def failed_scenario_name(exceptions: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Add `scenario` to exceptions by (batch, index); `scenario_<i>` where none is known."""
    names = scenarios.select("batch_id", "scenario_index", F.col("name").alias("scenario"))
    default = F.concat(F.lit("scenario_"), F.col("scenario_index").cast("string"))
    return exceptions.join(names, ["batch_id", "scenario_index"], "left").withColumn(
        "scenario", F.coalesce("scenario", default)
    )


def evaluable_conversations(conversations: DataFrame) -> DataFrame:
    """Only completed conversations are sent to the evaluator."""
    return conversations.filter(F.col("status") == "completed")


def conversation_rows(evaluated: DataFrame) -> DataFrame:
    """Result rows of conversations that ran, completed or not."""
    done = F.col("status") == "completed"
    not_finished = F.concat(
        F.lit(c.COMMENT_NOT_FINISHED_PREFIX), F.coalesce("error", F.lit(c.UNKNOWN_ERROR))
    )
    return evaluated.select(
        "batch_id",
        "scenario_index",
        "scenario",
        "session_id",
        F.when(done, "completed").otherwise("failed").alias("status"),
        F.when(~done, F.col("error")).alias("error"),
        F.when(done, F.col("total_turns"))
        .otherwise(F.coalesce("total_turns", F.lit(0)))
        .alias("total_turns"),
        F.when(done, F.col("duration_seconds")).alias("duration_seconds"),
        F.when(done, F.col("score")).otherwise(F.lit(c.FALLBACK_SCORE)).alias("score"),
        F.when(done, F.col("comment")).otherwise(not_finished).alias("comment"),
        F.when(done, F.col("evaluation_status")).alias("evaluation_status"),
        F.when(done, F.col("start_time")).alias("start_time"),
        F.when(done, F.col("end_time")).alias("end_time"),
    )


def exception_rows(exceptions: DataFrame) -> DataFrame:
    """Result rows of scenarios that raised before any conversation existed."""
    return exceptions.select(
        "batch_id",
        "scenario_index",
        "scenario",
        F.lit(None).cast("string").alias("session_id"),
        F.lit("failed").alias("status"),
        "error",
        F.lit(c.FALLBACK_SCORE).alias("score"),
        F.concat(F.lit(c.COMMENT_PROCESSING_FAILED_PREFIX), F.col("error")).alias("comment"),
    )


def result_rows(evaluated: DataFrame, exceptions: DataFrame) -> DataFrame:
    """All outcomes of a batch in one unified row type."""
    return conversation_rows(evaluated).unionByName(
        exception_rows(exceptions), allowMissingColumns=True
    )


def union_outcomes(rows: DataFrame) -> DataFrame:
    """Outcomes in scenario order within each batch."""
    return rows.orderBy("batch_id", "scenario_index")


def _split_completed(results: DataFrame, jobs: DataFrame, how: str) -> DataFrame:
    completed = jobs.filter(F.col("status") == "completed").select("batch_id")
    return results.join(completed, "batch_id", how)


def completed_batches(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Result rows whose batch has completed; only these are served."""
    return _split_completed(results, jobs, "left_semi")


def unserved_batches(requested: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requested batches that cannot be served, with the status to report back."""
    known = jobs.select("batch_id", F.col("status").alias("current_status"))
    return (
        requested.select("batch_id")
        .distinct()
        .join(known, "batch_id", "left")
        .filter(F.col("current_status").isNull() | (F.col("current_status") != "completed"))
        .withColumn("current_status", F.coalesce("current_status", F.lit("not found")))
    )


def non_null_scores(results: DataFrame) -> DataFrame:
    """Scores that enter the histogram: neither NULL nor 0."""
    return results.filter(F.col("score").isNotNull() & (F.col("score") != 0))


def is_expired(now: Column, max_age_hours: int = c.JOB_MAX_AGE_HOURS) -> Column:
    age = text.seconds_between(F.col("completed_at"), now)
    expired = F.col("status").isin(*c.TERMINAL_STATUSES) & (age > max_age_hours * 3600)
    return F.coalesce(expired, F.lit(False))


def expired_batches(
    jobs: DataFrame, now: Column, max_age_hours: int = c.JOB_MAX_AGE_HOURS
) -> DataFrame:
    """Finished jobs older than the limit; count them to learn how many go."""
    return jobs.filter(is_expired(now, max_age_hours))


def kept_batches(
    jobs: DataFrame, now: Column, max_age_hours: int = c.JOB_MAX_AGE_HOURS
) -> DataFrame:
    """The jobs that stay after clean-up."""
    return jobs.filter(~is_expired(now, max_age_hours))


def scenario_by_index(scenarios: DataFrame, requests: DataFrame) -> DataFrame:
    """The scenario at each requested ordinal, with its default name.

    `requests(request_id, scenario_index)`; an ordinal out of range gets an `error`.
    """
    index = F.col("scenario_index").cast("string")
    found = scenarios.select("scenario_index", F.col("name"), F.lit(True).alias("_found"))
    return requests.join(found, "scenario_index", "left").select(
        "request_id",
        "scenario_index",
        F.when(F.col("_found"), F.coalesce("name", F.concat(F.lit("scenario_"), index))).alias("name"),
        F.when(
            F.col("_found").isNull(),
            F.concat(F.lit("Scenario index "), index, F.lit(" not found")),
        ).alias("error"),
    )


def csv_columns(
    results: DataFrame, prompt_version: str = c.DEFAULT_PROMPT_VERSION
) -> list[Column]:
    """The ten CSV columns with their defaults; comments become one line."""

    def default(column: str, value: object) -> Column:
        if column not in results.columns:
            return F.lit(value)
        return F.coalesce(F.col(column), F.lit(value))

    known = "start_time" in results.columns
    start = text.iso_timestamp(F.col("start_time")) if known else F.lit("")
    return [
        default("session_id", "").alias("session_id"),
        default("scenario", "").alias("scenario"),
        F.lit(prompt_version).alias("prompt_version"),
        default("score", c.FALLBACK_SCORE).alias("score"),
        text.single_line(default("comment", "")).alias("comment"),
        default("total_turns", 0).alias("turns"),
        F.coalesce(start, F.lit("")).alias("start_ts"),
        default("status", "unknown").alias("status"),
        default("duration_seconds", 0.0).alias("duration_seconds"),
        default("evaluation_status", "unknown").alias("evaluation_status"),
    ]


def csv_rows(results: DataFrame, prompt_version: str = c.DEFAULT_PROMPT_VERSION) -> DataFrame:
    return results.select(*csv_columns(results, prompt_version))


def summary_columns(results: DataFrame) -> DataFrame:
    """Whichever of the six summary columns exist, in their fixed order."""
    return results.select(*[name for name in c.SUMMARY_COLUMNS if name in results.columns])


def stamp_export(results: DataFrame, batch_id: str | None, exported_at: Column) -> DataFrame:
    """Add batch id and export time; values a row already has win."""
    stamps = {"batch_id": F.lit(batch_id), "export_timestamp": exported_at}
    stamped = results
    for name, value in stamps.items():
        value = F.coalesce(F.col(name), value) if name in results.columns else value
        stamped = stamped.withColumn(name, value)
    return stamped


def stamp_prompt_version(results: DataFrame, version: str = c.DEFAULT_PROMPT_VERSION) -> DataFrame:
    return results.withColumn("prompt_version", F.lit(version))


def assign_session_id(rows: DataFrame, *stable_keys: str) -> DataFrame:
    """Keep a non-empty session id, else make one.

    With `stable_keys` the new id is a digest of those columns, so a task that runs again
    produces the same id; without them it is a random UUID.
    """
    if stable_keys:
        made = F.sha2(F.concat_ws("/", *[F.col(k).cast("string") for k in stable_keys]), 256)
    else:
        made = F.uuid()
    return rows.withColumn("session_id", F.coalesce(F.nullif(F.col("session_id"), F.lit("")), made))


def job_status_view(jobs: DataFrame) -> DataFrame:
    """The ten status fields of a job, times as ISO text."""
    return jobs.select(
        "batch_id",
        "status",
        F.col("progress_percentage").alias("progress"),
        "total_scenarios",
        "completed_scenarios",
        "failed_scenarios",
        text.iso_timestamp(F.col("created_at")).alias("created_at"),
        text.iso_timestamp(F.col("started_at")).alias("started_at"),
        text.iso_timestamp(F.col("completed_at")).alias("completed_at"),
        "error_message",
    )


def list_batches(jobs: DataFrame) -> DataFrame:
    """All jobs, newest first."""
    return job_status_view(jobs).orderBy(F.desc("created_at"), "batch_id")
