"""Strict JSON parsing into VARIANT, and type tests on the result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text is parsed as the first of two array elements.  Anything that closes the
# array early or adds elements loses this closing element or changes the length.
_END_MARK = "end-of-text"


def parse_strict(text: Column) -> Column:
    """The JSON value of the whole text as VARIANT, or NULL when it is not valid JSON."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END_MARK}"]')))
    parts = F.try_variant_get(wrapped, "$", "array<variant>")
    closing = F.try_variant_get(wrapped, "$[1]", "string")
    return F.when((F.size(parts) == 2) & (closing == _END_MARK), F.get(parts, F.lit(0)))


def kind(value: Column) -> Column:
    """Name of the JSON type: OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def field(value: Column, name: str, type_name: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", type_name)


def has_field(value: Column, name: str) -> Column:
    """True when the key is present, also with an explicit null."""
    return field(value, name).isNotNull()
