"""Text forms of numbers and variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(x: Column) -> Column:
    """A double without a needless fraction: 10.0 as 10, 2.5 as 2.5."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def variant_kind(v: Column) -> Column:
    """The type name of a variant, such as BIGINT, STRING or OBJECT<...>."""
    return F.schema_of_variant(v)


def variant_number(v: Column) -> Column:
    """The value of a numeric variant as a double; null for strings, booleans and the rest."""
    numeric = F.regexp_like(variant_kind(v), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|TINYINT|SMALLINT|INT)$"))
    return F.when(numeric, F.try_variant_get(v, "$", "double"))


def variant_text(v: Column) -> Column:
    """Default text form: numbers without a needless fraction, strings bare, the rest as JSON."""
    return F.coalesce(number_text(variant_number(v)), F.when(variant_kind(v) == "STRING", F.try_variant_get(v, "$", "string")), F.to_json(v))
