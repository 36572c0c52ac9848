"""Dotted JSON paths as columns: ``.a.b``, ``.tags[]``, ``id``, ``version``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_strings(document: Column, path: str, *, id_col: Column | None = None, version_col: Column | None = None) -> Column:
    """``array<string>`` of the string leaves at ``path`` of a JSON text column, in order.

    A step ``name[]`` spreads an array; over anything else it is a plain step. Numbers, booleans, objects,
    nulls and an array without ``[]`` yield nothing, as do missing steps and text that is no JSON. ``id`` and
    ``version`` name the record's own columns if given. Keys are taken literally.
    """
    steps = path.removeprefix(".")
    if steps == "id" and id_col is not None:
        return F.array(id_col)
    if steps == "version" and version_col is not None:
        return F.array_compact(F.array(version_col))
    values = F.array(F.try_parse_json(document))
    for step in [s for s in steps.split(".") if s]:
        spread, key = step.endswith("[]"), step.removesuffix("[]")
        name = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
        values = F.flatten(F.transform(values, _spread(name))) if spread else F.transform(values, _step(name))
        values = F.filter(values, lambda v: v.isNotNull())
    strings = F.filter(values, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(strings, lambda v: v.cast("string")), F.array().cast("array<string>"))


def _step(name: str):
    return lambda v: F.try_variant_get(v, name, "variant")


def _spread(name: str):
    return lambda v: F.coalesce(F.try_variant_get(v, name, "array<variant>"), F.array(F.try_variant_get(v, name, "variant")))
