"""Structured blocks read by their schemas: keys, types and required fields come from schema tables, not from code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "block_type string, type string, _status string, required array<string>, properties map<string, struct<type: string>>, keys_extracted array<struct<key: string, `from`: string>>"
#: What Spark calls the values that a schema's type allows.
KINDS = {"integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "string": ["STRING"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"], "null": ["VOID"]}
#: Blocks of schemas are projected in one expression; a catalogue of more keys than this is no schema table.
MOST_KEYS = 5000


def schemas(texts: DataFrame) -> DataFrame:
    """The parsed schemas of (text); one without a block type drops out, of several for a type the last text counts."""
    parsed = texts.select("text", F.from_json("text", SCHEMA).alias("s")).filter("s.block_type is not null")
    return parsed.groupBy("s.block_type").agg(F.max_by("s", "text").alias("s")).select("s.*")


def key_table(parsed: DataFrame) -> DataFrame:
    """(block_type, key, path, type) of all keys that schemas extract; the type is the path's first field's, null where none is stated or the path goes deeper."""
    keys = parsed.select("block_type", "properties", F.explode("keys_extracted").alias("k"))
    path = F.col("k.from")
    kind = F.when(~F.contains(path, F.lit(".")), F.try_element_at("properties", path)["type"])
    return keys.select("block_type", F.col("k.key").alias("key"), path.alias("path"), kind.alias("type"))


def _at(path: str) -> str:
    return "$" + "".join(f"['{p}']" for p in path.split("."))


def _kind_ok(value: Column, kind: str | None) -> Column:
    """Whether a variant is of a schema's type; true where the schema states none."""
    if kind not in KINDS:
        return F.lit(True)
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0).isin(KINDS[kind])


def _by_type(arrays: dict[str, list[Column]], none: str) -> Column:
    """The array of a block's type, in one CASE."""
    empty = F.array().cast(none)
    return reduce(lambda c, t: c.when(F.col("block_type") == t, F.array(*arrays[t]).cast(none)), arrays, F.when(F.lit(False), empty)).otherwise(empty)


def extract(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """(block_id, key, value, type_ok): a row for each key that a block (block_id, block_type, payload) has, with its value as text.

    A payload is parsed once, to a VARIANT, and all keys of its type are read from that in one pass. A key whose value is null has a
    null value; one that isn't there has no row, nor has a block that isn't JSON or has no schema.
    """
    rows = keys.limit(MOST_KEYS + 1).collect()
    if len(rows) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys")
    arrays: dict[str, list[Column]] = {}
    for r in sorted(rows):
        v = F.try_variant_get("v", _at(r.path), "variant")
        arrays.setdefault(r.block_type, []).append(F.when(v.isNotNull(), F.struct(F.lit(r.key).alias("key"), F.try_variant_get("v", _at(r.path), "string").alias("value"), _kind_ok(v, r.type).alias("type_ok"))))
    parsed = blocks.withColumn("v", F.try_parse_json("payload"))
    found = parsed.select("block_id", F.explode(F.array_compact(_by_type(arrays, "array<struct<key:string,value:string,type_ok:boolean>>"))).alias("x"))
    return found.select("block_id", "x.*")


def check(blocks: DataFrame, parsed: DataFrame) -> DataFrame:
    """(block_id, problem, field) by a soft check: 'type' where the schema asks for an object and the payload is a plain value, 'missing' for each required field that isn't there.

    Blocks without a schema, of one that is pending, or of an object schema that states neither fields nor required ones, aren't checked. A field that is null is there. A
    payload that isn't JSON, or is null, has none. An array counts as an object without fields.
    """
    rows = parsed.limit(MOST_KEYS + 1).collect()
    if len(rows) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} schemas")
    arrays: dict[str, list[Column]] = {}
    plain = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "STRING", "BOOLEAN")
    problem = lambda what, field: F.struct(F.lit(what).alias("problem"), F.lit(field).cast("string").alias("field"))
    for r in rows:
        if r["_status"] == "pending" or (r.type == "object" and not r.required and not r.properties):
            continue
        of = [F.when(plain, problem("type", None))] if r.type == "object" else []
        checks = of + [F.when(F.try_variant_get("v", _at(k), "variant").isNull() & ~(plain if of else F.lit(False)), problem("missing", k)) for k in r.required or []]
        if checks:
            arrays[r.block_type] = checks
    seen = blocks.withColumn("v", F.coalesce(F.try_parse_json("payload"), F.parse_json(F.lit("null"))))
    found = seen.select("block_id", F.explode(F.array_compact(_by_type(arrays, "array<struct<problem:string,field:string>>"))).alias("x"))
    return found.select("block_id", "x.*")
