"""Filling `{NAME}` placeholders in one pass over the template."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: escaped braces, a placeholder, plain text, a lone brace.
_TOKENS = r"(\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}])"
_NAMED = r"^\{[^{}.\[\]:!]*[^{}.\[\]:!0-9][^{}.\[\]:!]*\}$"


def _is_placeholder(token: Column) -> Column:
    return token.startswith("{") & token.endswith("}") & (F.length(token) > 1)


def _name(token: Column) -> Column:
    return F.substring(token, F.lit(2), F.length(token) - 2)


def render(template: Column, variables: Column, session_id: Column) -> tuple[Column, Column]:
    """Return (rendered text, render status).

    `session_id` overrides a variable of that name.  One missing variable returns the
    template unrendered (`missing_variable`); a lone brace or a placeholder that is
    not a plain name gives NULL (`bad_template`); whichever comes first decides.
    Values are inserted as they are and never scanned again.
    """
    names = F.coalesce(F.map_keys(variables), F.array().cast("array<string>"))
    tokens = F.regexp_extract_all(template, F.lit(_TOKENS), F.lit(1))

    def is_bad(token: Column) -> Column:
        lone = token.isin("{", "}")
        return lone | (_is_placeholder(token) & ~token.rlike(_NAMED))

    def is_missing(token: Column) -> Column:
        name = _name(token)
        known = (name == "session_id") | F.array_contains(names, name)
        return _is_placeholder(token) & token.rlike(_NAMED) & ~known

    def fill(token: Column) -> Column:
        name = _name(token)
        value = F.when(name == "session_id", session_id).otherwise(variables[name])
        return (
            F.when(token == "{{", F.lit("{"))
            .when(token == "}}", F.lit("}"))
            .when(_is_placeholder(token), F.coalesce(value, F.lit("None")))
            .otherwise(token)
        )

    first_problem = F.get(F.filter(tokens, lambda t: is_bad(t) | is_missing(t)), F.lit(0))
    status = (
        F.when(first_problem.isNull(), F.lit("rendered"))
        .when(is_bad(first_problem), F.lit("bad_template"))
        .otherwise(F.lit("missing_variable"))
    )
    text = (
        F.when(status == "rendered", F.array_join(F.transform(tokens, fill), ""))
        .when(status == "missing_variable", template)
    )
    return text, status
