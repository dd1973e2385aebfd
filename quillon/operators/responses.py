"""Strict parsing of JSON responses (FN12-14, SRC9, SRC11): shapes as data, bad rows routed apart with a reason.

A response is read once, in batches; a shape tells which keys an object has (no more, no fewer), which
labels a probability vector has and to what it must sum, and that an array answers a request's keys one by
one and in their order. Nothing raises on a bad row: it gets the reason of the first check that it fails. What
was one JSON value goes on as a VARIANT.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources import io

# Labels, in order.
INTENT_LABELS = ("current_state", "history", "unknown")
POLICY_LABELS = ("allowed", "disallowed", "unknown")
LIFECYCLE_LABELS = ("compatible", "incompatible", "unknown")
ADMISSIBILITY_LABELS = ("admissible", "inadmissible", "unknown")
NUMBERS = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


@dataclass(frozen=True)
class Vector:
    """Probabilities of exactly these labels, each in [0, 1], that sum to 1."""

    labels: tuple[str, ...]


@dataclass(frozen=True)
class Answers:
    """An array of objects of these fields, one for each requested key, which `key` repeats in the request's order."""

    key: str
    fields: dict[str, Vector]


#: A verifier's response: the intent, and three judgements of every candidate.
VERIFIER = {"query_intent": Vector(INTENT_LABELS), "candidates": Answers("candidate_key", {"policy": Vector(POLICY_LABELS), "lifecycle": Vector(LIFECYCLE_LABELS), "admissibility": Vector(ADMISSIBILITY_LABELS)})}


def json_schema(shape: dict[str, Vector | Answers], count: int) -> str:
    """FN13: the shape as JSON Schema for `count` requested keys."""

    def closed(properties: dict) -> dict:
        return {"type": "object", "additionalProperties": False, "properties": properties, "required": list(properties)}

    def of(x: Vector | Answers) -> dict:
        if isinstance(x, Vector):
            return closed({label: {"type": "number", "minimum": 0, "maximum": 1} for label in x.labels})
        item = closed({x.key: {"type": "string"}, **{k: of(v) for k, v in x.fields.items()}})
        return {"type": "array", "minItems": count, "maxItems": count, "items": item}

    return json.dumps(closed({k: of(v) for k, v in shape.items()}), sort_keys=True)


def strict_json(text: Column) -> Column:
    """The text as a VARIANT; NULL if it isn't one JSON value and nothing else, or repeats a key.

    Spark's parser stops behind the first value. Within brackets a text that goes on with `}` or another value
    fails or has several members, and within braces one that goes on with `]` fails.
    """
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(alone) == 1, F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))), "$.v", "variant"))


def entries(value: Column) -> Column:
    """A VARIANT object as a map, NULL if it isn't one."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def number(value: Column) -> Column:
    """The number in a VARIANT; NULL for what isn't one, strings and booleans too."""
    return F.when(F.schema_of_variant(value).rlike(NUMBERS), F.try_variant_get(value, "$", "double"))


def _refused(numbers: object, labels: tuple[str, ...], tolerance: float) -> str | None:
    """The reason against a vector, or None."""
    if type(numbers) is not dict or len(numbers) != len(labels):
        return "labels"
    total = 0.0
    for p in map(numbers.get, labels, repeat(_once)):
        if type(p) is float or type(p) is int:
            total += p if 0 <= p <= 1 else math.inf
        else:
            total = math.inf
    if -tolerance <= total - 1 <= tolerance:
        return None
    return "labels" if numbers.keys() != set(labels) else "probability" if total == math.inf else "sum"


def _answers_refused(items: object, shape: Answers, keys: list[str | None], tolerance: float) -> str | None:
    """The reason against the answers to the keys: that of the first item that has one."""
    if not isinstance(items, list):
        return "array"
    if len(items) != len(keys):
        return "count"
    names, vectors = {shape.key, *shape.fields}, [(field, v.labels) for field, v in shape.fields.items()]
    for item, key in zip(items, keys, strict=True):
        if type(item) is not dict or item.keys() != names:
            return "fields"
        if (item[shape.key] if type(item[shape.key]) is str else None) != key:
            return "order"
        for field, labels in vectors:
            if why := _refused(item[field], labels, tolerance):
                return why
    return None


def _named(shape: dict[str, Vector | Answers], count: int) -> int:
    """How many keys a right response to `count` requested keys has."""
    return len(shape) + sum(len(x.labels) if isinstance(x, Vector) else count * (1 + sum(1 + len(v.labels) for v in x.fields.values())) for x in shape.values())


def _once(pairs: list[tuple[str, object]]) -> dict[str, object]:
    if len(found := dict(pairs)) < len(pairs):
        raise ValueError("a key is repeated")
    return found


def _no_number(name: str) -> None:
    raise ValueError(f"{name} isn't JSON")


PLAIN, STRICT = json.JSONDecoder(parse_constant=_no_number), json.JSONDecoder(object_pairs_hook=_once, parse_constant=_no_number)


def _reason(value: object, keys: list[str | None], shape: dict[str, Vector | Answers], tolerance: float) -> str | None:
    if not isinstance(value, dict) or value.keys() != shape.keys():
        return "fields"
    for name, x in shape.items():
        if isinstance(x, Answers) and (why := _answers_refused(value[name], x, keys, tolerance)):
            return why
    for name, x in shape.items():
        if isinstance(x, Vector) and (why := _refused(value[name], x.labels, tolerance)):
            return why
    return None


def refused(text: str, keys: list[str | None], shape: dict[str, Vector | Answers], tolerance: float = 1e-4) -> str | None:
    """FN14: why the text doesn't answer a request for the keys; None if it does. Answers are checked before vectors.

    A right response with a colon a key repeats none; any other is read again by a reader that refuses repeated keys.
    """
    try:
        why = _reason(PLAIN.decode(text), keys, shape, tolerance)
        if why is not None or text.count(":") != _named(shape, len(keys)):
            STRICT.decode(text)
    except (ValueError, RecursionError):
        return "json"
    return why


def examined(response: Column, keys: Column, shape: dict[str, Vector | Answers], tolerance: float = 1e-4) -> Column:
    """FN14: `refused` of a text and its request's keys, in batches; a text is taken apart once."""

    @F.pandas_udf("string")
    def why(texts: pd.Series, asked: pd.Series) -> pd.Series:
        return pd.Series([refused(t.decode("utf-8", "replace"), list(k), shape, tolerance) for t, k in zip(texts, asked, strict=True)], dtype=object)

    return why(response.cast("binary"), keys)


def bound(responses: DataFrame, requests: DataFrame, shape: dict[str, Vector | Answers], *, tolerance: float = 1e-4) -> DataFrame:
    """SRC9: a row for each request and for each identifier that nobody asked: request_id, reason, value (the VARIANT) and keys.

    responses: request_id, response (text); requests: request_id, keys. An identifier answered more than once
    is refused as `duplicate`, whatever the answers; others are `missing` or `unknown`. The rows are a written
    table, for good and bad ones are read apart, and a filter on the reason would repeat its steps.
    """
    once = responses.repartition("request_id").groupBy("request_id").agg(F.count("*").alias("n"), F.min("response").alias("response"))
    asked = requests.select("request_id", "keys", F.lit(True).alias("asked"))
    rows = asked.join(once, "request_id", "full").withColumn("text", F.coalesce("response", F.lit("")))
    rows = rows.withColumn("why", examined(F.col("text"), F.coalesce("keys", F.array().cast("array<string>")), shape, tolerance))
    reason = F.when(F.col("asked").isNull(), F.lit("unknown")).when(F.col("n").isNull(), F.lit("missing")).when(F.col("n") > 1, F.lit("duplicate")).otherwise(F.col("why"))
    value = F.when(~F.col("why").eqNullSafe("json"), F.try_parse_json("text"))  # one JSON value, as the check has read it
    out = rows.select("request_id", reason.alias("reason"), value.alias("value"), "keys")
    out.write.parquet(path := io.scratch(out.sparkSession, "responses"))
    return out.sparkSession.read.schema(out.schema).parquet(path)


def verdicts(checked: DataFrame) -> DataFrame:
    """The good rows of a verifier's bound responses: request_id, position (from 1), candidate_key, p_violation, p_unknown."""
    items = F.try_variant_get(F.col("value"), "$.candidates", "array<variant>")
    rows = checked.where("reason IS NULL").select("request_id", F.posexplode(items).alias("at", "item"))
    return rows.select("request_id", (F.col("at") + 1).alias("position"), F.try_variant_get("item", "$.candidate_key", "string").alias("candidate_key"), F.try_variant_get("item", "$.admissibility.inadmissible", "double").alias("p_violation"), F.try_variant_get("item", "$.admissibility.unknown", "double").alias("p_unknown"))


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where("reason IS NOT NULL").select("request_id", "reason")


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: one JSON record a file: file, request_id, response; the file is named after the identifier, or the row's request_id is NULL."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("stem"), F.col("_metadata.file_name").alias("file"), strict_json(F.col("value")).alias("v"))
    own = F.try_variant_get("v", "$.request_id", "string")
    return files.select("file", F.when(own == F.col("stem"), own).alias("request_id"), F.to_json(F.try_variant_get("v", "$.response", "variant")).alias("response"))
