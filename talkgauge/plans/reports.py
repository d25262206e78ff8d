"""Statistics and reports over result rows.

Unless said otherwise, reports are per batch (`batch_id`).  All statistics that share a
grouping are taken in one aggregation; only medians need passes of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, ShortType

from talkgauge import constants as c
from talkgauge.functions import numbers, text
from talkgauge.operators import conversations, costs
from talkgauge.operators.medians import grouped_medians
from talkgauge.operators.results import non_null_scores
from talkgauge.sources.logs import messages_from_log

BATCH = ("batch_id",)


def turns_column(results: DataFrame) -> str | None:
    """`total_turns`, or `turns` in files that use the CSV name, or None."""
    return next((name for name in ("total_turns", "turns") if name in results.columns), None)


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def _zero_float(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def _percent(part: Column, whole: Column) -> Column:
    return numbers.round_half_even(100 * numbers.ratio_or_zero(part, whole), 1)


def _count_columns() -> list[Column]:
    total = F.count("*")
    successful = F.count_if(F.col("status") == "completed")
    return [
        total.alias("total_scenarios"),
        successful.alias("successful_scenarios"),
        F.count_if(F.col("status") == "failed").alias("failed_scenarios"),
        numbers.ratio_or_zero(successful, total).alias("success_rate"),
    ]


def _score_columns() -> list[Column]:
    score = F.col("score")
    return [
        _zero_float(F.avg(score)).alias("score_mean"),
        numbers.sample_std_of_integers(score).alias("score_std"),
        _zero(F.min(score)).cast("int").alias("score_min"),
        _zero(F.max(score)).cast("int").alias("score_max"),
        F.count(score).alias("score_count"),
    ]


def _distribution_columns() -> list[Column]:
    return [F.count_if(F.col("score") == s).alias(f"score_{s}") for s in c.VALID_SCORES]


def _turn_columns(results: DataFrame) -> list[Column]:
    name = turns_column(results)
    turns = F.col(name) if name else F.lit(None).cast("int")
    return [
        _zero_float(F.avg(turns)).alias("turns_mean"),
        _zero(F.min(turns)).cast("int").alias("turns_min"),
        _zero(F.max(turns)).cast("int").alias("turns_max"),
    ]


def _duration_columns() -> list[Column]:
    duration = F.col("duration_seconds")
    return [
        _zero_float(F.avg(duration)).alias("duration_mean"),
        _zero_float(F.min(duration)).alias("duration_min"),
        _zero_float(F.max(duration)).alias("duration_max"),
        _zero_float(F.sum(duration)).alias("duration_total"),
    ]


def _std_or_zero(stats: DataFrame) -> DataFrame:
    """No score at all gives 0; a single score has no sample deviation and stays NULL."""
    return stats.withColumn(
        "score_std", F.when(F.col("score_count") == 0, F.lit(0.0)).otherwise(F.col("score_std"))
    )


def _counted(results: DataFrame, columns: dict[str, str]) -> dict[str, str]:
    """Those {result column: name} whose values are whole numbers of 32 bits at most."""
    whole = (ByteType, ShortType, IntegerType)
    return {c: name for c, name in columns.items() if isinstance(results.schema[c].dataType, whole)}


def _counted_medians(results: DataFrame, columns: dict[str, str]) -> list[Column]:
    """`<name>_median` of scores and turns, in the same aggregation as other figures.

    The exact percentile keeps a count per different value.  Scores have few; for k different numbers of turns
    there have to be k * k / 2 messages, so a million million messages give 1.4 million.
    """
    return [
        F.coalesce(F.percentile(column, 0.5), F.lit(0.0)).alias(f"{name}_median")
        for column, name in _counted(results, columns).items()
    ]


def _with_medians(
    stats: DataFrame, results: DataFrame, keys: Sequence[str], columns: dict[str, str]
) -> DataFrame:
    """Join `<name>_median` for each {result column: name} that was not counted; 0 where a group has no value."""
    columns = {c: name for c, name in columns.items() if c not in _counted(results, columns)}
    if not columns:
        return stats
    medians = grouped_medians(results, keys, list(columns))
    renamed = medians.select(
        *keys, *[F.col(f"{column}_median").alias(f"{name}_median") for column, name in columns.items()]
    )
    joined = stats.join(renamed, list(keys), "left")
    for name in columns.values():
        joined = joined.withColumn(f"{name}_median", F.coalesce(f"{name}_median", F.lit(0.0)))
    return joined


def _kept(results: DataFrame, completed_only: bool) -> DataFrame:
    return results.filter(F.col("status") == "completed") if completed_only else results


def batch_counts(results: DataFrame, keys: Sequence[str] = BATCH) -> DataFrame:
    return results.groupBy(*keys).agg(*_count_columns())


def status_counts(results: DataFrame, keys: Sequence[str] = BATCH) -> DataFrame:
    return batch_counts(results, keys).select(*keys, "successful_scenarios", "failed_scenarios")


def score_stats(
    results: DataFrame, keys: Sequence[str] = BATCH, completed_only: bool = False
) -> DataFrame:
    """Mean, median, sample deviation, minimum and maximum of the scores.

    Failed rows carry score 1 and count, unless `completed_only` is set.
    """
    rows = _kept(results, completed_only)
    medians = {"score": "score"}
    stats = rows.groupBy(*keys).agg(*_score_columns(), *_counted_medians(rows, medians))
    return _with_medians(_std_or_zero(stats), rows, keys, medians)


def score_distribution(results: DataFrame, keys: Sequence[str] = BATCH) -> DataFrame:
    """Counts of the scores 1, 2, 3 and their share of all non-null scores in percent."""
    counted = results.groupBy(*keys).agg(*_distribution_columns(), F.count("score").alias("_n"))
    for s in c.VALID_SCORES:
        counted = counted.withColumn(f"score_{s}_pct", _percent(F.col(f"score_{s}"), F.col("_n")))
    return counted.drop("_n")


def score_order(results: DataFrame) -> DataFrame:
    """How often each score occurs, by score."""
    scored = results.filter(F.col("score").isNotNull())
    return scored.groupBy("score").agg(F.count("*").alias("n")).orderBy("score")


def turn_stats(results: DataFrame, keys: Sequence[str] = BATCH) -> DataFrame:
    name = turns_column(results)
    medians = {name: "turns"} if name else {}
    stats = results.groupBy(*keys).agg(*_turn_columns(results), *_counted_medians(results, medians))
    if name is None:
        return stats.withColumn("turns_median", F.lit(0.0))
    return _with_medians(stats, results, keys, medians)


def duration_stats(results: DataFrame, keys: Sequence[str] = BATCH) -> DataFrame:
    stats = results.groupBy(*keys).agg(*_duration_columns())
    return _with_medians(stats, results, keys, {"duration_seconds": "duration"})


def _scenario_figures(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    turns = turns_column(results)
    means = {"score_mean": "score", "duration_seconds_mean": "duration_seconds"}
    if turns:
        means[f"{turns}_mean"] = turns
    return (
        results.filter(F.col("scenario").isNotNull())
        .groupBy(*keys, "scenario")
        .agg(
            F.count("score").alias("score_count"),
            *[numbers.round_half_even(F.avg(v), 2).alias(k) for k, v in means.items()],
        )
    )


def scenario_performance(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per scenario: mean score, scored rows, mean duration and mean turns, by name.

    Rows without a scenario are left out; means are rounded to two digits.
    """
    return _scenario_figures(results, keys).orderBy(*keys, "scenario")


def summary_report(
    results: DataFrame, batches: DataFrame | None = None, completed_only: bool = False
) -> DataFrame:
    """One nested record per batch, with the figures of its scenarios in order of their names.

    Batches listed in `batches` without results get zeros.  The scenarios of a batch are a
    short list; for batches with very many use `scenario_performance`, which has them as rows.
    """
    rows = _kept(results, completed_only)
    keys = list(BATCH)
    medians = {"score": "score", "duration_seconds": "duration"}
    turns = turns_column(rows)
    if turns:
        medians[turns] = "turns"
    stats = _std_or_zero(
        rows.groupBy(*keys).agg(
            *_count_columns(),
            *_score_columns(),
            *_distribution_columns(),
            *_turn_columns(rows),
            *_duration_columns(),
            *_counted_medians(rows, medians),
        )
    )
    stats = _with_medians(stats, rows, keys, medians)
    if not turns:
        stats = stats.withColumn("turns_median", F.lit(0.0))
    performance = _scenario_figures(rows, BATCH)
    figures = F.struct(*[name for name in performance.columns if name != "batch_id"])
    nested = performance.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(figures)).alias("scenario_performance")
    )
    return nested_report(stats, nested, batches)


def nested_report(
    stats: DataFrame, scenarios: DataFrame, batches: DataFrame | None = None
) -> DataFrame:
    """The nested record of each batch from flat figures and its scenarios' array."""
    if batches is not None:
        stats = batches.select("batch_id").distinct().join(stats, "batch_id", "left")
    stats = stats.join(scenarios, "batch_id", "left")

    def group(prefix: str, names: Sequence[str]) -> Column:
        return F.struct(*[F.col(f"{prefix}_{n}").alias(n) for n in names])

    return stats.select(
        "batch_id",
        _zero(F.col("total_scenarios")).alias("total_scenarios"),
        _zero(F.col("successful_scenarios")).alias("successful_scenarios"),
        _zero(F.col("failed_scenarios")).alias("failed_scenarios"),
        _zero_float(F.col("success_rate")).alias("success_rate"),
        F.when(
            F.col("total_scenarios").isNotNull(),
            group("score", ["mean", "median", "std", "min", "max"]),
        ).alias("score_statistics"),
        F.when(
            F.col("total_scenarios").isNotNull(),
            F.struct(*[F.col(f"score_{s}") for s in c.VALID_SCORES]),
        ).alias("score_distribution"),
        F.when(
            F.col("total_scenarios").isNotNull(), group("turns", ["mean", "median", "min", "max"])
        ).alias("turn_statistics"),
        F.when(
            F.col("total_scenarios").isNotNull(),
            group("duration", ["mean", "median", "min", "max", "total"]),
        ).alias("duration_statistics"),
        F.coalesce("scenario_performance", F.array().cast(scenarios.schema["scenario_performance"].dataType))
        .alias("scenario_performance"),
    )


def report_from_logs(
    turns: DataFrame,
    completions: DataFrame,
    max_turns: int | None = None,
    batches: DataFrame | None = None,
    **markers: Iterable[str],
) -> DataFrame:
    """`summary_report` of logged conversations, cut where their messages say they end.

    `turns` and `completions` are those of `read_conversation_log`; the scores are the logged ones, turns
    and durations those of the cut messages.  Turn records of one index, as a repeated run leaves them,
    count once, the earliest.  `batches(batch_id, session_id)` deals sessions to batches; without it all are one, `logs`.
    Sessions of the logs without a completion record have neither status nor score.
    """
    messages = messages_from_log(turns)
    first = F.min_by(F.struct("speaker", "content", "ts"), F.struct("ts", "content")).alias("_m")
    single = messages.groupBy("session_id", "msg_index").agg(first).select("session_id", "msg_index", "_m.*")
    kept = conversations.cut_at_end(single, "agent", max_turns, **markers)
    last = F.max_by(F.struct("final_score", "evaluator_comment", "status"), "timestamp").alias("_c")
    ended = completions.groupBy("session_id").agg(last).select(
        "session_id",
        F.col("_c.final_score").cast("int").alias("score"),
        F.col("_c.status").alias("status"),
    )
    spans = kept.groupBy("session_id").agg(
        F.count_if(F.col("speaker") == "agent").cast("int").alias("total_turns"),
        text.seconds_between(F.min("ts"), F.max("ts")).alias("duration_seconds"),
    )
    results = ended.join(spans, "session_id", "full").withColumn("scenario", F.lit(None).cast("string"))
    if batches is None:
        results = results.withColumn("batch_id", F.lit("logs"))
    else:
        results = results.join(batches.select("session_id", "batch_id"), "session_id", "left")
    return summary_report(results)


_SHARES = 16


def _json_lines(headers: DataFrame, members: DataFrame, footers: DataFrame) -> DataFrame:
    """Lines `(batch_id, section, position, line)` of one JSON text per batch.

    A batch of any size becomes one document without ever being one row: its header, one
    line per member and its footer, in (section, position) order.  `members` holds
    `(batch_id, position, line)` with positions that are unique in the batch; a comma goes
    before each member but the first.
    """
    share = F.pmod(F.xxhash64("position"), F.lit(_SHARES)).cast("int")
    every_share = F.explode(F.array(*[F.lit(k) for k in range(_SHARES)]))
    first = (
        members.groupBy("batch_id")
        .agg(F.min("position").alias("_first"))
        .withColumn("_share", every_share)
    )
    # a batch may hold most rows, so its members meet their first one in several parts
    separated = members.withColumn("_share", share).join(first, ["batch_id", "_share"]).select(
        "batch_id",
        F.lit(1).alias("section"),
        "position",
        F.when(F.col("position") == F.col("_first"), F.col("line"))
        .otherwise(F.concat(F.lit(","), F.col("line")))
        .alias("line"),
    )

    def edge(df: DataFrame, section: int, sample: DataFrame) -> DataFrame:
        empty = F.lit(None).cast(sample.schema["position"].dataType)
        return df.select("batch_id", F.lit(section).alias("section"), empty.alias("position"), "line")

    return edge(headers, 0, members).unionByName(separated).unionByName(edge(footers, 2, members))


def _open_object(*fields: str) -> Column:
    """JSON text of the named columns, left open for one more member."""
    return F.regexp_replace(F.to_json(F.struct(*fields)), r"\}$", ",")


def results_envelope(results: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """The `{batch_id, results: [...], total_results}` document of every batch, as lines.

    Batches listed in `batches` without results get an empty list.
    """
    totals = results.groupBy("batch_id").agg(F.count("*").alias("_n"))
    if batches is not None:
        listed = batches.select("batch_id").distinct().join(totals, "batch_id", "left")
        totals = listed.withColumn("_n", F.coalesce("_n", F.lit(0)))
    headers = totals.select(
        "batch_id", F.concat(_open_object("batch_id"), F.lit('"results":[')).alias("line")
    )
    footers = totals.select(
        "batch_id",
        F.concat(F.lit('],"total_results":'), F.col("_n").cast("string"), F.lit("}")).alias("line"),
    )
    members = results.select(
        "batch_id",
        F.col("scenario_index").alias("position"),
        F.to_json(F.struct(*results.columns)).alias("line"),
    )
    return _json_lines(headers, members, footers)


def summary_document(
    results: DataFrame, generated_at: Column, batches: DataFrame | None = None
) -> DataFrame:
    """The nested summary document of every batch, as lines.

    A batch without results has the minimal record: its id, a total of 0 and empty
    statistics.
    """
    summary = summary_report(results, batches).withColumn(
        "generated_at", text.iso_timestamp(generated_at)
    )
    filled = F.col("total_scenarios") > 0
    fields = [n for n in summary.columns if n not in ("generated_at", "scenario_performance")]
    stamp = F.concat(
        F.lit('"generated_at":"'), F.col("generated_at"), F.lit('"}')
    )
    headers = summary.select(
        "batch_id",
        F.when(filled, F.concat(_open_object(*fields), F.lit('"scenario_performance":{')))
        .otherwise(
            F.concat(_open_object("batch_id", "total_scenarios"), F.lit('"summary_stats":{'))
        )
        .alias("line"),
    )
    footers = summary.select("batch_id", F.concat(F.lit("},"), stamp).alias("line"))
    performance = _scenario_figures(results, BATCH)
    figures = [n for n in performance.columns if n not in ("batch_id", "scenario")]
    name = F.regexp_extract(
        F.to_json(F.struct(F.col("scenario").alias("k"))), r"^\{\"k\":(.*)\}$", 1
    )
    members = performance.select(
        "batch_id",
        F.col("scenario").alias("position"),
        F.concat(name, F.lit(":"), F.to_json(F.struct(*figures))).alias("line"),
    )
    return _json_lines(headers, members, footers)


def console_summary(results: DataFrame, keys: Sequence[str] = BATCH) -> DataFrame:
    """Counts with their percentages to one digit."""
    counts = batch_counts(results, keys)
    return counts.select(
        *keys,
        "total_scenarios",
        "successful_scenarios",
        _percent(F.col("successful_scenarios"), F.col("total_scenarios")).alias("successful_pct"),
        "failed_scenarios",
        _percent(F.col("failed_scenarios"), F.col("total_scenarios")).alias("failed_pct"),
    )


def quick_summary(results: DataFrame, keys: Sequence[str] = BATCH) -> DataFrame:
    """Mean score, a missing score counting as 1, and the distribution."""
    score = F.coalesce("score", F.lit(c.FALLBACK_SCORE))
    return results.groupBy(*keys).agg(
        F.avg(score).alias("average_score"),
        *[F.count_if(score == s).alias(f"score_{s}") for s in c.VALID_SCORES],
    )


def run_outcome(results: DataFrame) -> DataFrame:
    """Outcome of a run: only scenarios that raised count as failed here."""
    raised = F.count_if((F.col("status") == "failed") & F.col("session_id").isNull())
    return results.groupBy("batch_id").agg(
        F.count("*").alias("total_scenarios"),
        (F.count("*") - raised).alias("successful_scenarios"),
        raised.alias("failed_scenarios"),
    )


def batch_progress(results: DataFrame, planned: DataFrame) -> DataFrame:
    """Finished rows against `planned(batch_id, total_scenarios)`, in percent."""
    finished = results.groupBy("batch_id").agg(
        F.count_if(F.col("status").isin("completed", "failed")).alias("completed_scenarios")
    )
    completed = F.coalesce("completed_scenarios", F.lit(0))
    return planned.join(finished, "batch_id", "left").select(
        "batch_id",
        "total_scenarios",
        completed.alias("completed_scenarios"),
        (100 * numbers.ratio_or_zero(completed, F.col("total_scenarios"))).alias(
            "progress_percentage"
        ),
    )


def score_histogram(results: DataFrame) -> DataFrame:
    """Rows per histogram bin: edges 0.5, 1.5, 2.5, 3.5; scores outside fall in no bin."""
    bins = non_null_scores(results).withColumn(
        "bin", F.width_bucket("score", F.lit(0.5), F.lit(3.5), F.lit(3))
    )
    return (
        bins.filter(F.col("bin").between(1, 3))
        .groupBy(F.col("bin").cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
        .select(
            "bin",
            (F.col("bin") - 0.5).cast("double").alias("from_score"),
            (F.col("bin") + 0.5).cast("double").alias("to_score"),
            "n",
        )
    )


def prompt_version_comparison(results: DataFrame, base: str, other: str) -> DataFrame:
    """Mean score and rows of two prompt versions side by side, per scenario."""
    versions = results.filter(
        F.col("scenario").isNotNull() & F.col("prompt_version").isin(base, other)
    )

    def of(version: str, value: Column) -> Column:
        return F.when(F.col("prompt_version") == version, value)

    score = F.col("score")
    return versions.groupBy("scenario").agg(
        F.avg(of(base, score)).alias("base_mean"),
        F.count(of(base, score)).alias("base_count"),
        F.avg(of(other, score)).alias("other_mean"),
        F.count(of(other, score)).alias("other_count"),
        (F.avg(of(other, score)) - F.avg(of(base, score))).alias("mean_delta"),
    )


def determinism_check(results: DataFrame) -> DataFrame:
    """Groups of equal scenario, seed and prompt version whose scores differ."""
    return (
        results.groupBy("scenario", "seed", "prompt_version")
        .agg(
            F.count("*").alias("runs"),
            F.min("score").alias("min_score"),
            F.max("score").alias("max_score"),
        )
        .filter(F.col("min_score") != F.col("max_score"))
    )


def throughput_report(results: DataFrame, usage: DataFrame) -> DataFrame:
    """Per batch: conversations per minute, mean duration, tokens and cost per conversation."""
    timed = results.groupBy("batch_id").agg(
        F.count("*").alias("conversations"),
        F.avg("duration_seconds").alias("mean_duration_seconds"),
        F.min("start_time").alias("_from"),
        F.max("end_time").alias("_to"),
    )
    minutes = text.seconds_between(F.col("_from"), F.col("_to")) / 60
    used = costs.usage_by_batch(usage, results)
    tokens = F.coalesce("tokens", F.lit(0))
    cost = F.coalesce(F.col("cost").cast("double"), F.lit(0.0))
    return timed.join(used, "batch_id", "left").select(
        "batch_id",
        "conversations",
        F.when(minutes > 0, F.col("conversations") / minutes).alias("conversations_per_minute"),
        "mean_duration_seconds",
        (tokens / F.col("conversations")).alias("tokens_per_conversation"),
        (cost / F.col("conversations")).alias("cost_per_conversation"),
    )


def peak_concurrency(results: DataFrame, limit: int = c.CONCURRENCY_LIMIT) -> DataFrame:
    """Highest number of conversations of a batch that run at the same time.

    A conversation without an end counts from its start on; `open_conversations` tells how
    many there are.  One without a start counts nowhere.
    Starts and ends at one instant cancel out first.  Changes are then summed per second,
    and seconds per hour, so the running level of a batch is carried through three small
    orderings instead of one over all its events.
    """
    spans = results.filter(F.col("start_time").isNotNull())
    changes = spans.select(
        "batch_id",
        F.inline(
            F.array(
                F.struct(F.col("start_time").alias("at"), F.lit(1).alias("change")),
                F.struct(F.col("end_time").alias("at"), F.lit(-1).alias("change")),
            )
        ),
    ).filter(F.col("at").isNotNull())
    instants = (
        changes.groupBy("batch_id", "at")
        .agg(F.sum("change").alias("change"))
        .withColumn("second", F.date_trunc("second", "at"))
    )
    seconds = (
        instants.groupBy("batch_id", "second")
        .agg(F.sum("change").alias("change"))
        .withColumn("hour", F.date_trunc("hour", "second"))
    )
    hours = seconds.groupBy("batch_id", "hour").agg(F.sum("change").alias("change"))

    def before(group: Sequence[str], order: str) -> Column:
        earlier = (
            Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        )
        return F.coalesce(F.sum("change").over(earlier), F.lit(0))

    by_hour = hours.select(
        "batch_id", "hour", before(["batch_id"], "hour").alias("hour_level")
    )
    by_second = seconds.select(
        "batch_id", "hour", "second", before(["batch_id", "hour"], "second").alias("second_level")
    ).join(by_hour, ["batch_id", "hour"])
    inside = (
        Window.partitionBy("batch_id", "second")
        .orderBy("at")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    levels = instants.withColumn("_inside", F.sum("change").over(inside)).join(
        by_second, ["batch_id", "second"]
    )
    level = F.col("_inside") + F.col("second_level") + F.col("hour_level")
    return (
        levels.groupBy("batch_id")
        .agg(F.max(level).alias("peak"), F.sum("change").alias("open_conversations"))
        .withColumn("over_limit", F.col("peak") > limit)
    )


def request_rate(
    requests: DataFrame, at: str = "ts", limit: int = c.REQUESTS_PER_SECOND_LIMIT
) -> DataFrame:
    """Requests in each second that has any, and whether they exceed the limit."""
    return (
        requests.groupBy(F.date_trunc("second", at).alias("second"))
        .agg(F.count("*").alias("requests"))
        .withColumn("over_limit", F.col("requests") > limit)
    )
