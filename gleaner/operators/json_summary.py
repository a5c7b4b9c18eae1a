"""Summaries of long JSON arrays: a walk over parsed values, so an Arrow function per text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_ELEMENTS, SAMPLES, MAX_DEPTH = 25, 3, 128
RESULT = "path string, elements bigint, schema array<string>, samples array<string>, depth int"
NAMES = {bool: "bool", int: "number", float: "number", str: "string", list: "array", dict: "object", type(None): "null"}


def depth(value: object) -> int:
    """Nesting of a value: 0 for scalars. Level by level, so deep values need no stack."""
    level, now = 0, [value]
    while nested := [v for v in now if isinstance(v, (list, dict)) and v]:
        now, level = [x for v in nested for x in (v.values() if isinstance(v, dict) else v)], level + 1
    return level


def longest_array(value: object) -> tuple[str, list] | None:
    """Path and value of the longest array, the first of equals; only the first element of an array is entered."""
    best, todo = None, [("", value)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, list):
            if best is None or len(v) > len(best[1]):
                best = (path, v)
            if v:
                todo.append((f"{path}[0]", v[0]))
        elif isinstance(v, dict):
            todo += [(f"{path}.{k}" if path else k, x) for k, x in reversed(v.items())]
    return best and (best[0] or "$", best[1])


def summary(text: str | None, least: int = MIN_ELEMENTS) -> tuple:
    try:
        value = json.loads(text or "")
    except (ValueError, RecursionError):
        return (None, None, None, None, None)
    levels = depth(value)
    found = longest_array(value)
    if levels > MAX_DEPTH or found is None or len(found[1]) < least:
        return (None, None, None, None, levels)
    path, array = found
    keys = [f"{k}: {NAMES[type(v)]}" for k, v in array[0].items()] if array and isinstance(array[0], dict) else []
    rows = [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in array[:SAMPLES]]
    return path, len(array), keys, [r if len(r) <= 400 else r[:400] + "…" for r in rows], levels


def summarized(docs: DataFrame, least: int = MIN_ELEMENTS) -> DataFrame:
    """Add `summary`: path, length, key types and samples of the longest array; nulls where there is none long enough."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([summary(t, least) for t in texts], columns=["path", "elements", "schema", "samples", "depth"])

    return docs.withColumn("summary", run(F.col("text")))
