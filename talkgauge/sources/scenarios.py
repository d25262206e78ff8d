"""Scenario files and prompt templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge import constants as c
from talkgauge.functions import strict_json

_SCENARIOS = "array<struct<name:string,variables:map<string,string>>>"


def parse_scenarios(files: DataFrame, text: str = "value") -> DataFrame:
    """Scenario rows from JSON array texts; other columns are kept.

    Numbers in `variables` become the text a template would print.  A text that is not a
    JSON array fails the query.
    """
    value = F.col(text)
    is_array = F.coalesce(
        strict_json.kind(strict_json.parse_strict(value)) == "ARRAY", F.lit(False)
    )
    checked = F.when(is_array, value).otherwise(
        F.raise_error(F.lit(c.MESSAGE_FILE_NOT_AN_ARRAY)).cast("string")
    )
    rows = F.posexplode(F.from_json(checked, _SCENARIOS))
    others = [name for name in files.columns if name != text]
    return files.select(*others, rows.alias("scenario_index", "_scenario")).select(
        *others, "scenario_index", "_scenario.name", "_scenario.variables"
    )


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenarios of one or many JSON array files, indexed by their place in the file."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_file"), "value"
    )
    return parse_scenarios(files)


def _scenario_problem(element: Column, index: Column, strict: bool) -> Column:
    """The first problem of one array element, or NULL."""
    prefix = F.format_string

    def message(template: str) -> Column:
        return prefix(template.replace("{}", "%d"), index)

    problem = (
        F.when(strict_json.kind(element) != "OBJECT", message(c.MESSAGE_NOT_AN_OBJECT))
        .when(~strict_json.has_field(element, "name"), message(c.MESSAGE_MISSING_NAME))
        .when(~strict_json.has_field(element, "variables"), message(c.MESSAGE_MISSING_VARIABLES))
    )
    if strict:
        variables = strict_json.kind(strict_json.field(element, "variables", "variant"))
        problem = problem.when(variables != "OBJECT", message(c.MESSAGE_VARIABLES_NOT_AN_OBJECT))
    return problem


def validate_scenarios(requests: DataFrame, text: str = "scenarios", strict: bool = False) -> DataFrame:
    """Add `error`: the first problem of a request's scenario list, NULL when it is valid.

    Only the presence of `name` and `variables` is checked; an explicit null is present.  With
    `strict`, `variables` has to be an object, too.
    """
    value = strict_json.parse_strict(F.col(text))
    kind = strict_json.kind(value)
    as_text = value.cast("string")
    number = as_text.try_cast("double")
    empty = F.coalesce(
        value.isNull()
        | (kind == "VOID")
        | as_text.isin("[]", "{}")
        | ((kind == "STRING") & (as_text == ""))
        | ((kind == "BOOLEAN") & (as_text == "false"))
        | (kind.isin("BIGINT", "DECIMAL", "DOUBLE") & (number == 0)),
        F.lit(True),
    )
    elements = F.try_variant_get(value, "$", "array<variant>")
    problems = F.filter(
        F.transform(elements, lambda element, i: _scenario_problem(element, i, strict)),
        lambda problem: problem.isNotNull(),
    )
    error = (
        F.when(empty, F.lit(c.MESSAGE_NO_SCENARIOS))
        .when(kind != "ARRAY", F.lit(c.MESSAGE_NOT_A_LIST))
        .otherwise(F.get(problems, F.lit(0)))
    )
    return requests.withColumn("error", error)


def read_prompt_templates(
    spark: SparkSession, path: str, names: Sequence[str] | DataFrame
) -> DataFrame:
    """`(template_name, template)` for the expected names, one `<name>.txt` file each.

    `names` is a list, or a table whose column `template_name` has as many as there are.

    A Spark job writes them as one-row folders `template_name=<name>` instead, whose closing
    line break is not part of the text.  A name without a file gets its fallback text.
    """
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/template_name=([^/]+)/[^/]*$", 1)
    file_name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1)
    written = folder != ""
    found = (
        spark.read.option("pathGlobFilter", "*.txt")
        .option("recursiveFileLookup", True)
        .text(path, wholetext=True)
        .select(
            F.when(written, folder).otherwise(file_name).alias("template_name"),
            F.when(written, F.regexp_replace("value", r"\n$", ""))
            .otherwise(F.col("value"))
            .alias("template"),
        )
    )
    if isinstance(names, DataFrame):
        expected = names.select("template_name").distinct()
    else:
        listed = F.array(*[F.lit(name) for name in names]).cast("array<string>")
        expected = spark.range(1).select(F.explode(listed).alias("template_name"))
    fallback = F.when(
        F.col("template_name") == c.EVALUATOR_TEMPLATE_NAME, F.lit(c.EVALUATOR_FALLBACK_TEMPLATE)
    ).otherwise(
        F.concat(
            F.lit("You are a "), F.translate("template_name", "_", " "), F.lit(".")
        )
    )
    return expected.join(found, "template_name", "left").select(
        "template_name", F.coalesce("template", fallback).alias("template")
    )
