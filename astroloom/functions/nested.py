"""Nested results: model output and per-target records as VARIANT values, read by path with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_block(text: Column) -> Column:
    """The JSON of a model's answer: what a fenced block holds, else from the first brace to the last; null if neither."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.nullif(F.trim(F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)\{.*\}", 0))), F.lit(""))


def parsed(text: Column) -> Column:
    """The answer's JSON as a VARIANT; null where there is none or it is broken."""
    return F.try_parse_json(json_block(text))


def at(value: Column, path: str, kind: str, default: object = None) -> Column:
    """What a VARIANT holds at a path, cast; the default where the path is absent, null or of another kind."""
    found = F.try_variant_get(value, path, kind)
    return found if default is None else F.coalesce(found, F.lit(default).cast(kind))


def flattened(value: Column, fields: dict[str, tuple[str, str, object]]) -> list[Column]:
    """A flat record of {name: (path, kind, default)}."""
    return [at(value, path, kind, default).alias(name) for name, (path, kind, default) in fields.items()]


def first_present(value: Column, surveys: tuple[str, ...], path: str, field: str, kind: str = "double") -> Column:
    """struct(value, source): ``field`` of the first of the surveys under ``path`` that has it; null if none has."""
    found = [F.when(at(value, f"{path}.{s}.{field}", kind).isNotNull(), F.struct(at(value, f"{path}.{s}.{field}", kind).alias("value"), F.lit(s).alias("source"))) for s in surveys]
    return F.coalesce(*found)


def band_map(bands: dict[str, Column]) -> Column:
    """Map of band to magnitude, without the bands that are null or not a number."""
    made = F.create_map(*[x for name, value in bands.items() for x in (F.lit(name), F.nanvl(value.cast("double"), F.lit(None).cast("double")))])
    return F.map_filter(made, lambda _, v: v.isNotNull())


def restored(text: Column, schema: str) -> Column:
    """The other way of ``to_json``: nested results from their text."""
    return F.from_json(text, schema)
