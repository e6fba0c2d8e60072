"""The filter language of node reads: key, op and value."""

from __future__ import annotations

import json
from numbers import Number

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.text import variant_number, variant_text


def value_text(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), sort_keys=True)


def matches(spec: dict, compat: bool = False) -> Column:
    """F8: one test as a column.

    Keys status and label are columns and always there. eq and neq compare as numbers if
    both sides are numbers, else as text; a missing key fails eq and passes neq. gt, gte, lt
    and lte hold for numbers only; with ``compat`` a comparison that cannot be made passes
    lt and lte. An unknown op holds for nothing.
    """
    key, op, value = spec["key"], spec["op"], spec.get("value")
    if key in ("status", "label"):
        there, text, number = F.lit(True), F.col(key), F.lit(None).cast("double")
    else:
        v = F.try_element_at(F.col("meta"), F.lit(key))
        there, text, number = F.coalesce(F.map_contains_key("meta", key), F.lit(False)), variant_text(v), variant_number(v)
    is_number = isinstance(value, Number) and not isinstance(value, bool)
    same = text == F.lit(value_text(value))
    if is_number:
        same = F.when(number.isNotNull(), number == F.lit(float(value))).otherwise(same)
    if op == "exists":
        return there
    if op == "eq":
        return there & F.coalesce(same, F.lit(False))
    if op == "neq":
        return ~(there & F.coalesce(same, F.lit(False)))
    if op == "contains":
        return there & F.coalesce(F.contains(text, F.lit(value_text(value))), F.lit(False))
    if op not in ("gt", "gte", "lt", "lte"):
        return F.lit(False)
    other = F.lit(float(value) if is_number else None).cast("double")
    test = {"gt": number > other, "gte": number >= other, "lt": number < other, "lte": number <= other}[op]
    return F.coalesce(test, F.lit(compat and op in ("lt", "lte")))
