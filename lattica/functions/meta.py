"""Metadata maps: key-value functions, paging, projection and schema checks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import variant_kind

EMPTY = "CAST(map() AS map<string,variant>)"


def as_variant(value) -> Column:
    return F.parse_json(F.lit(json.dumps(value)))


def put(meta: Column, key: str, value) -> Column:
    """B1: sets a key. ``value`` is any JSON value or a variant column."""
    v = value if isinstance(value, Column) else as_variant(value)
    return F.map_concat(drop(meta, key), F.create_map(F.lit(key), v))


def drop(meta: Column, *keys: str) -> Column:
    """Without the keys."""
    return F.map_filter(F.coalesce(meta, F.expr(EMPTY)), lambda k, _: ~k.isin(*keys)) if keys else meta


def get(meta: Column, key: str) -> Column:
    """B2: the value, null if missing."""
    return F.try_element_at(meta, F.lit(key))


def has(meta: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(meta, key), F.lit(False))


def count(meta: Column) -> Column:
    """Entries, 0 for a missing map."""
    return F.greatest(F.coalesce(F.size(meta), F.lit(0)), F.lit(0))


def keys(meta: Column) -> Column:
    """Keys, ascending."""
    return F.array_sort(F.map_keys(F.coalesce(meta, F.expr(EMPTY))))


def page(meta: Column, offset: int, limit: int) -> Column:
    """struct(items, total, offset, limit, has_more); a negative offset is 0, a limit
    under 1 means all and is given back as it is."""
    offset, n = max(0, offset), count(meta)
    take = F.lit(limit) if limit > 0 else F.greatest(n, F.lit(1))
    chosen = F.slice(keys(meta), F.lit(offset + 1), take)
    items = F.transform(chosen, lambda k: F.struct(k.alias("key"), F.try_element_at(meta, k).alias("value")))
    return F.struct(items.alias("items"), n.alias("total"), F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), (offset + take < n).alias("has_more"))


def until(meta: Column, stop) -> Column:
    """Entries in key order up to and including the first for which ``stop(key, value)`` holds."""
    ks = keys(meta)
    ends = F.transform(ks, lambda k: stop(k, F.try_element_at(meta, k)))
    at = F.array_position(ends, F.lit(True)).cast("int")
    return F.transform(F.slice(ks, 1, F.when(at > 0, at).otherwise(F.greatest(F.size(ks), F.lit(1)))), lambda k: F.struct(k.alias("key"), F.try_element_at(meta, k).alias("value")))


def project(meta: Column, wanted: list[str] | None) -> Column:
    """The wanted keys, all if none are named; null instead of an empty map."""
    kept = F.map_filter(meta, lambda k, _: k.isin(*wanted)) if wanted else meta
    return F.when(count(kept) > 0, kept)


def fits(kind: Column, wanted: Column) -> Column:
    """whether a variant's type name is of the schema type ``wanted``."""
    tests = {"string": kind == "STRING", "int": kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "float": F.regexp_like(kind, F.lit("^(DOUBLE|FLOAT|DECIMAL.*)$")), "bool": kind == "BOOLEAN", "bytes": kind == "BINARY", "slice": kind.startswith("ARRAY<") | (kind == "BINARY"), "map": kind.startswith("OBJECT<"), "any": F.lit(True)}
    out = F.lit(False)
    for name, test in tests.items():
        out = F.when(wanted == name, test).otherwise(out)
    return out


def schema_errors(rows: DataFrame, owner: str = "id") -> DataFrame:
    """(owner, key, message) where metadata breaks its schema, by owner and key. Keys
    outside the schema are legal; without a schema all is."""
    fields = rows.filter("meta_schema IS NOT NULL").select(owner, "meta", F.explode("meta_schema").alias("key", "field"))
    value = F.try_element_at(F.col("meta"), F.col("key"))
    found, kind = F.coalesce(F.expr("map_contains_key(meta, key)"), F.lit(False)), F.coalesce(variant_kind(value), F.lit("VOID"))
    missing = F.format_string('missing required field "%s"', F.col("key"))
    wrong = F.format_string('field "%s": expected type %s, got %s', F.col("key"), F.col("field.type"), kind)
    message = F.when(~found & F.col("field.required"), missing).when(found & ~fits(kind, F.col("field.type")), wrong)
    return fields.select(owner, "key", message.alias("message")).filter("message IS NOT NULL").orderBy(owner, "key")
