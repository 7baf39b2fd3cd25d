"""JSON text, enums and zones as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def salvaged(text: Column) -> Column:
    """The JSON object in a text, from its first brace to its last, whatever stands around it; null where that is no valid JSON."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def items(text: Column, kind: str) -> Column:
    """The elements of a JSON array as an array of the kind; empty where the text is no array of it."""
    return F.coalesce(F.from_json(F.when(F.trim(text).startswith("["), text), f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def sorted_json(entries: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def known(value: Column, names: tuple[str, ...]) -> Column:
    """The value if it is one of the names, else null."""
    return F.when(value.isin(*names), value)


def in_utc(local: Column, zone: Column | str) -> Column:
    """A time of day in a zone as the time in UTC."""
    return F.to_utc_timestamp(local, zone)
