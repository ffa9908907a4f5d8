"""JSON at the border: lists, ids and small parameter objects held as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_list(text: Column) -> Column:
    """A JSON array of strings; anything else (bad JSON, null, other types) gives
    an empty array."""
    empty = F.array().cast("array<string>")
    doc = F.try_parse_json(text)
    only_strings = F.schema_of_variant(doc).isin("ARRAY<STRING>", "ARRAY<VOID>")
    items = F.from_json(text, "array<string>")
    clean = only_strings & ~F.exists(items, lambda x: x.isNull())
    return F.coalesce(F.when(clean, items), empty)


def id_list(text: Column) -> Column:
    """A JSON array as bigint ids, element by element."""
    return F.from_json(text, "array<bigint>")


def string_field(text: Column, name: str, default: str) -> Column:
    """A string member of a JSON object, else ``default`` (missing member, member
    of another type, bad JSON, null)."""
    doc = F.try_parse_json(text)
    member = F.try_variant_get(doc, f"$.{name}", "variant")
    value = F.try_variant_get(doc, f"$.{name}", "string")
    return F.coalesce(F.when(F.schema_of_variant(member) == "STRING", value), F.lit(default))


def object_of(**members: Column) -> Column:
    return F.to_json(F.struct(*[value.alias(name) for name, value in members.items()]))
