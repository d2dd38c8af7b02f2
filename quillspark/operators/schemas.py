"""JSON Schemas of records by type, from all records: Spark merges their shapes, a shape becomes a schema."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: JSON's name of a variant's kind of value.
_KINDS = {"BOOLEAN": "boolean", "STRING": "string", "BIGINT": "integer", "DOUBLE": "number", "FLOAT": "number", "VOID": "null", "VARIANT": None}
_TOKEN = re.compile(r"`(?:[^`]|``)*`|[A-Za-z_][^<>,:()\s]*|\(\d+,\s*\d+\)|[<>,:]")


def _parsed(shape: str) -> dict:
    """The JSON Schema of a shape as ``schema_of_variant_agg`` writes it: OBJECT<a: BIGINT, b: ARRAY<STRING>>."""
    tokens = _TOKEN.findall(shape)
    at = 0

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def value() -> dict:
        name = take()
        if name == "ARRAY":
            take()
            items = value()
            take()
            return {"type": "array", "items": items}
        if name == "OBJECT":
            fields: dict[str, dict] = {}
            if at < len(tokens) and tokens[at] == "<":
                take()
                while tokens[at] != ">":
                    key = take()
                    take()
                    fields[key[1:-1].replace("``", "`") if key[0] == "`" else key] = value()
                    if tokens[at] == ",":
                        take()
                take()
            return {"type": "object", "properties": dict(sorted(fields.items()))}
        if name == "DECIMAL":
            digits = take()
            return {"type": "integer" if digits.rstrip(")").split(",")[1].strip() == "0" else "number"}
        kind = _KINDS.get(name)
        return {"type": kind} if kind else {}

    return value()


def _paths(schema: dict, path: str = "$") -> Iterator[tuple[str, str]]:
    kind = schema.get("type", "any")
    yield path, kind
    if kind == "object":
        for key, inner in schema["properties"].items():
            yield from _paths(inner, f"{path}.{key}")
    elif kind == "array" and schema["items"]:
        yield from _paths(schema["items"], f"{path}[]")


def json_schemas(records: DataFrame, type: str = "type", record: str = "record") -> DataFrame:
    """type, schema: the JSON Schema that all records of a type meet; values of several kinds under one name may be anything.

    Records that are no JSON, or none at all, say nothing. Shapes are merged where records are read, so that one row for
    each type and task is shuffled.
    """
    shapes = records.select(type, F.try_parse_json(F.col(record)).alias("v")).where("v is not null").groupBy(type).agg(F.schema_of_variant_agg("v").alias("shape"))
    written = F.udf(lambda shape: json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema"} | _parsed(shape), ensure_ascii=False), "string")
    return shapes.select(type, written("shape").alias("schema"))


def schema_paths(schemas: DataFrame, type: str = "type") -> DataFrame:
    """type, path, kind: each value that a schema describes."""
    each = F.udf(lambda schema: list(_paths(json.loads(schema))), "array<struct<path:string,kind:string>>")
    return schemas.select(type, F.inline(each("schema")))
