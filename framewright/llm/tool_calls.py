"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Calls and results meet in a hash join on conversation and call id. A call may depend on others of its conversation;
its level is one more than the highest level of those, found for all conversations at once, one join a level, and
calls are ordered by level, then by their own order. Calls in a circle, or depending on such, never get a level and
are reported with status `cycle`. Arguments are parsed as variants and checked against the tool's schema. JSON is
canonical: fixed keys in alphabetic order, arguments as an object by sorted keys, no spaces; arguments that aren't JSON are
kept as text.

All of it is DataFrame expressions.

Edge cases: a call without a result has status `pending`, results without a call are returned by orphans(); of several
results of one call the one that sorts first counts, of several calls of one id the one with the least order;
dependencies on unknown calls are ignored and listed in `missing`; arguments that aren't a JSON object, or hold a key
twice, unknown tools, missing or unknown fields, wrong types and values out of bounds are named in `errors`; arguments
longer than a variant may be (128 MB) aren't a JSON object; repeated rows count once; rows with a null conversation or
call id are left out; other columns, whatever their names, are ignored; empty tables give empty results.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.llm._common import materialise

#: JSON schema types and the names that Spark gives variants of them; an integer may also be a number without a fraction.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",)}
#: What of JSON schema is checked; a schema with anything else is an error.
KEYWORDS = {"type", "enum", "minimum", "maximum", "minLength", "maxLength", "pattern", "items", "minItems", "maxItems", "required", "properties", "additionalProperties"}


def _none() -> Column:
    return F.array().cast("array<string>")


def _value_errors(name: str, rule: dict, value: Column) -> Column:
    """array<string>: what is wrong with a value (a variant, not a missing one); parts of it are named name.part and name[]."""
    if unknown := set(rule) - KEYWORDS:
        raise ValueError(f"not checked: {', '.join(sorted(unknown))}")
    kind = F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    is_number, is_text, is_list, is_object = (kind.isin(*TYPES[t]) for t in ("number", "string", "array", "object"))
    types = rule.get("type", [])
    types = [types] if isinstance(types, str) else types
    fits = kind.isin([k for t in types for k in TYPES[t]])
    if "integer" in types:
        fits |= is_number & (number == F.floor(number))
    checks = [F.when(~fits, f"{name}: type")] if types else []
    if "enum" in rule:
        checks.append(F.when(~F.to_json(value).isin([json.dumps(x, separators=(",", ":"), ensure_ascii=False, sort_keys=True) for x in rule["enum"]]), f"{name}: enum"))
    for word, when, wrong in (("minimum", is_number, lambda x: number < x), ("maximum", is_number, lambda x: number > x), ("minLength", is_text, lambda x: F.length(text) < x), ("maxLength", is_text, lambda x: F.length(text) > x), ("pattern", is_text, lambda x: ~text.rlike(x))):
        if word in rule:
            checks.append(F.when(when & wrong(rule[word]), f"{name}: {word}"))
    found = [F.array_compact(F.array(*checks))] if checks else []
    if {"items", "minItems", "maxItems"} & set(rule):
        parts = F.coalesce(F.when(is_list, F.try_variant_get(value, "$", "array<variant>")), F.array().cast("array<variant>"))
        size = F.when(is_list, F.size(parts))
        found += [F.array_compact(F.array(F.when(wrong(size, rule[w]), f"{name}: {w}"))) for w, wrong in (("minItems", lambda a, b: a < b), ("maxItems", lambda a, b: a > b)) if w in rule]
        if "items" in rule:
            found.append(F.array_distinct(F.flatten(F.transform(parts, lambda v: _value_errors(f"{name}[]", rule["items"], v)))))
    if {"properties", "required", "additionalProperties"} & set(rule):
        found.append(F.when(is_object, _object_errors(f"{name}.", rule, value)).otherwise(_none()))
    return F.concat(*found) if found else _none()


def _object_errors(prefix: str, schema: dict, value: Column) -> Column:
    if unknown := set(schema) - KEYWORDS:
        raise ValueError(f"not checked: {', '.join(sorted(unknown))}")
    props, keys = schema.get("properties", {}), F.coalesce(F.json_object_keys(F.to_json(value)), _none())
    required = [F.when(~F.array_contains(keys, f), f"{prefix}{f}: missing") for f in sorted(schema.get("required", []))]
    extra = F.transform(F.array_sort(F.array_except(keys, F.array(*[F.lit(p) for p in props]).cast("array<string>"))), lambda k: F.concat(F.lit(prefix), k, F.lit(": unknown")))
    return F.concat(
        F.array_compact(F.array(*required)) if required else _none(),
        _none() if schema.get("additionalProperties", True) else extra,
        *[F.when(F.array_contains(keys, p), _value_errors(prefix + p, rule, F.variant_get(value, f"$['{p}']", "variant"))).otherwise(_none()) for p, rule in sorted(props.items())],
    )


def schema_errors(tool: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """array<string>: what is wrong with the arguments (JSON text) of a call by the tools' JSON schemas (KEYWORDS)."""
    value = F.try_parse_json(arguments)
    out = F.array(F.lit("unknown tool"))
    for name, schema in sorted(schemas.items()):
        out = F.when(tool == name, _object_errors("", schema, value)).otherwise(out)
    is_object = F.coalesce(value.isNotNull() & F.startswith(F.ltrim(arguments), F.lit("{")), F.lit(False))
    again = value.isNull() & F.json_object_keys(arguments).isNotNull()
    return F.when(again, F.array(F.lit("repeated keys"))).when(~is_object, F.array(F.lit("not a JSON object"))).otherwise(out)


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level for calls (conv_id, call_id, depends_on) that aren't in or behind a circle.

    A call with one dependency points to it, and the pointers of all such calls double in each round, so that a chain
    takes as many rounds as its length has binary digits. A call with several is ready once all of them have levels. When
    no call got a level for as many rounds as the longest conversation could need, the rest is in or behind a circle."""
    key = ["conv_id", "call_id"]
    calls = materialise(calls.select(*key, F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")), "calls")
    edges = calls.select(*key, F.explode(F.array_distinct("depends_on")).alias("needs"))
    edges = materialise(edges.join(calls.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"]), "needs")
    fan = edges.groupBy(*key).agg(F.count("*").alias("k"), F.min("needs").alias("needs"))
    state = calls.select(*key).join(fan, key, "left").select(*key, F.when(F.col("k") == 1, F.col("needs")).alias("to"), F.when(F.col("k") == 1, F.lit(1).cast("bigint")).alias("far"), F.when(F.col("k").isNull(), 0).alias("level"))
    state = materialise(state, "levels")
    many = edges.join(fan.filter("k > 1").select(*key), key, "left_semi")
    any_many = bool(many.limit(1).count())
    longest = calls.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    idle, before, rounds = 0, None, 0
    while idle <= longest.bit_length():
        left = state.filter("level is null").count()
        idle = idle + 1 if left == before else 0
        before = left
        if not left:
            break
        other = state.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"), F.col("level").alias("level2"))
        moved = state.join(other, ["conv_id", "to"], "left")
        level = F.coalesce(F.col("level"), F.col("level2") + F.col("far"))
        # after as many rounds as the longest chain could need, pointers that still move go round in a circle: they stay
        doubling, rounds = rounds <= longest.bit_length(), rounds + 1
        to, far = (F.coalesce("to2", "to"), F.col("far") + F.coalesce("far2", F.lit(0).cast("bigint"))) if doubling else (F.col("to"), F.col("far"))
        state = moved.select(*key, to.alias("to"), far.alias("far"), level.cast("int").alias("level"))
        if any_many:
            ready = many.join(moved.filter("level is not null").select("conv_id", F.col("call_id").alias("needs"), F.col("level").alias("l")), ["conv_id", "needs"], "left").groupBy(*key).agg(F.max("l").alias("l"), F.min(F.col("l").isNotNull()).alias("all")).filter("all").select(*key, (F.col("l") + 1).alias("own"))
            state = state.join(ready, key, "left").select(*key, "to", "far", F.coalesce("level", "own").cast("int").alias("level"))
        state = materialise(state, "levels")
    return state.filter("level is not null").select(*key, "level")


def _positions(calls: DataFrame, level: DataFrame) -> DataFrame:
    """conv_id, call_id, level, position (from 1, by level, ord and call_id) of the calls with a level.

    All are sorted at once, so that a long conversation spans tasks: a place in it is one in its part plus the sizes of the
    parts before."""
    by = ["level", "ord", "call_id"]
    placed = level.join(calls.select("conv_id", "call_id", "ord"), ["conv_id", "call_id"]).repartitionByRange("conv_id", *by)
    placed = materialise(placed.withColumn("_part", F.spark_partition_id()), "sorted")
    sizes = placed.groupBy("conv_id", "_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("conv_id", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("conv_id", "_part").orderBy(*by))
    return placed.withColumn("_place", place).join(sizes, ["conv_id", "_part"]).select("conv_id", "call_id", "level", (F.col("_before") + F.col("_place")).cast("int").alias("position"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls: conv_id, call_id, ord, tool, arguments (JSON text), depends_on; results: conv_id, call_id, content.

    Returns conv_id, call_id, position (from 1; null in a circle), level, status (ok, invalid, pending, cycle),
    errors, missing, json."""
    one = W.partitionBy("conv_id", "call_id")
    calls = calls.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"), F.col("ord").cast("bigint").alias("ord"), "tool", "arguments", "depends_on").filter("conv_id is not null and call_id is not null")
    calls = materialise(calls.withColumn("_n", F.row_number().over(one.orderBy("ord", "tool", "arguments"))).filter("_n = 1").drop("_n"), "single")
    results = results.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"), "content").groupBy("conv_id", "call_id").agg(F.min("content").alias("content"), F.lit(True).alias("answered"))
    known = calls.select("conv_id", F.col("call_id").alias("d")).withColumn("there", F.lit(True))
    missing = calls.select("conv_id", "call_id", F.explode("depends_on").alias("d")).join(known, ["conv_id", "d"], "left_anti").groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("d")).alias("missing"))
    full = calls.join(_positions(calls, levels(calls)), ["conv_id", "call_id"], "left").join(results, ["conv_id", "call_id"], "left").join(missing, ["conv_id", "call_id"], "left")
    full = full.withColumn("errors", schema_errors(F.col("tool"), F.col("arguments"), schemas)).withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
    status = F.when(F.col("level").isNull(), "cycle").when(F.size("errors") > 0, "invalid").when(F.col("answered").isNull(), "pending").otherwise("ok")
    canonical = F.to_json(
        F.struct(F.coalesce(F.try_parse_json("arguments"), F.col("arguments").cast("variant")).alias("arguments"), F.array_sort(F.coalesce("depends_on", F.array().cast("array<string>"))).alias("depends_on"), F.col("call_id").alias("id"), F.col("tool").alias("name"), F.col("content").alias("result")),
        {"ignoreNullFields": "false"},
    )
    return full.select("conv_id", "call_id", "position", "level", status.alias("status"), "errors", "missing", canonical.alias("json"))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose call isn't there."""
    return results.join(calls.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
