"""Results as the JSON that dashboards read; the only place where rows are collected."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.values import sample_text, seconds_text
from ..operators.ranges import Grid


def _labels(key) -> dict[str, str]:
    return {x["key"]: x["value"] for x in key}


def streams(entries: DataFrame) -> dict:
    """Log entries grouped by stream, in the order of labels; entries in the order in which they come."""
    out: dict[tuple, dict] = {}
    for r in entries.collect():
        key = tuple((x["key"], x["value"]) for x in r.labels_key)
        values = out.setdefault(key, {"stream": dict(key), "values": []})["values"]
        values.append([str(r.ts_ns), r.line, dict(r.metadata)] if r.metadata else [str(r.ts_ns), r.line])
    return {"resultType": "streams", "result": [out[k] for k in sorted(out)]}


def matrix(vector: DataFrame, grid: Grid) -> dict:
    out: dict[tuple, list] = {}
    for r in vector.orderBy("series", "k").collect():
        out.setdefault(tuple((x["key"], x["value"]) for x in r.series), []).append([seconds_text(grid.start + r.k * grid.step), sample_text(r.value)])
    return {"resultType": "matrix", "result": [{"metric": dict(k), "values": v} for k, v in out.items()]}


def vector(values: DataFrame, at_ns: int) -> dict:
    rows = values.orderBy("series").collect()
    return {"resultType": "vector", "result": [{"metric": _labels(r.series), "value": [seconds_text(at_ns), sample_text(r.value)]} for r in rows]}
