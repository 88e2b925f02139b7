"""JSON functions over JSON text; objects keep their text and key order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _path(path: str) -> str:
    """Both selector styles, ``['k']`` and ``."k"``, as Spark writes them."""
    return re.sub(r'\."([^"]+)"', r"['\1']", path)


def json_type(text: Column) -> Column:
    """object, array, string, number, boolean or null."""
    first = F.substring(F.ltrim(text), 1, 1)
    return (
        F.when(text.isNull(), F.lit(None))
        .when(first == "{", "object")
        .when(first == "[", "array")
        .when(first == '"', "string")
        .when(first.isin("t", "f"), "boolean")
        .when(first == "n", "null")
        .otherwise("number")
    )


def _kind(text: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), _path(path), "variant"))


def json_value(text: Column, path: str = "$") -> Column:
    """A scalar as STRING; objects, arrays and JSON null give NULL."""
    found = F.get_json_object(text, _path(path))
    # only what looks like an object or array may be one, so other values are parsed once
    kind = _kind(text, path)
    nested = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
    return F.when(~F.substring(found, 1, 1).isin("{", "["), found).when(~nested, found)


def json_query(text: Column, path: str = "$") -> Column:
    """The JSON text at the path; strings keep their quotes, JSON null gives NULL."""
    found = F.get_json_object(text, _path(path))
    return F.when(_kind(text, path) == "STRING", F.to_json(F.array(found)).substr(F.lit(2), F.length(F.to_json(F.array(found))) - 2)).otherwise(found)


def json_value_array(text: Column, path: str = "$") -> Column:
    """An array of scalars as ARRAY<STRING>; anything else gives NULL."""
    kind = _kind(text, path)
    nested = kind.contains("OBJECT") | F.startswith(kind, F.lit("ARRAY<ARRAY"))
    return F.when(F.startswith(kind, F.lit("ARRAY")) & ~nested, F.from_json(F.get_json_object(text, _path(path)), "array<string>"))


def json_query_array(text: Column, path: str = "$") -> Column:
    """The elements of an array as JSON text."""
    elements = F.variant_get(F.parse_json(F.get_json_object(text, _path(path))), "$", "array<variant>")
    return F.when(F.startswith(_kind(text, path), F.lit("ARRAY")), F.transform(elements, lambda e: F.to_json(e)))


#: The older names of the same functions.
json_extract, json_extract_scalar, json_extract_array, json_extract_string_array = json_query, json_value, json_query_array, json_value_array


def to_json(value: Column) -> Column:
    """A value as JSON; structs keep their NULL fields."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def get_field(text: Column, name: str) -> Column:
    return json_query(text, f"$['{name}']")


def subscript(text: Column, key: int | str) -> Column:
    return json_query(text, f"$[{key}]" if isinstance(key, int) else f"$['{key}']")


def parse_json(text: Column) -> Column:
    """The text itself if it is valid JSON, else an error."""
    return F.when(F.try_parse_json(text).isNull() & text.isNotNull(), F.raise_error(F.lit("invalid JSON"))).otherwise(text)


def to_json_string(value: Column) -> Column:
    """Structs and arrays with their NULL fields."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def bool_(text: Column) -> Column:
    return text.cast("boolean")


def int64(text: Column) -> Column:
    return text.cast("bigint")


def float64(text: Column) -> Column:
    return text.cast("double")
