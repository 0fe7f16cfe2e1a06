"""Checking JSON documents against a schema (a subset of JSON Schema 2020-12)."""

from __future__ import annotations

import datetime
import json
import re

import pandas as pd
from pyspark.sql import DataFrame

KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
URI = re.compile(r"^[a-z][a-z0-9+.-]*:\S+$", re.I)


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, KINDS[kind])


def errors(value, schema: dict, root: dict | None = None, path: str = "$") -> list[str]:
    """What is wrong with a value: type, enum, required, additional properties, items,
    least number of items, date and uri formats, references within the document."""
    root = schema if root is None else root
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].lstrip("#/").split("/"):
            target = target[part]
        return errors(value, target, root, path)
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_is(value, k) for k in kinds):
            return [f"{path}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not one of the listed values")
    if isinstance(value, dict):
        props = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in props:
                out += errors(v, props[k], root, f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unexpected")
    elif isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append(f"{path}: fewer than {schema['minItems']} items")
        for i, v in enumerate(value):
            out += errors(v, schema.get("items", {}), root, f"{path}[{i}]")
    elif isinstance(value, str):
        if schema.get("format") == "date":
            try:
                if not re.fullmatch(r"\d{4}-\d\d-\d\d", value):
                    raise ValueError
                datetime.date.fromisoformat(value)
            except ValueError:
                out.append(f"{path}: not a date")
        elif schema.get("format") == "uri" and not URI.match(value):
            out.append(f"{path}: not a uri")
    return out


def validate(docs: DataFrame, schema: dict) -> DataFrame:
    """(id, errors) for documents (id, json); unreadable JSON has the one error 'not JSON'."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["json"]):
                try:
                    rows.append((i, errors(json.loads(text), schema)))
                except (ValueError, TypeError):
                    rows.append((i, ["not JSON"]))
            yield pd.DataFrame(rows, columns=["id", "errors"])

    return docs.select("id", "json").mapInPandas(run, "id string, errors array<string>")
