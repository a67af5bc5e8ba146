"""Trace lookup, search and tags over the spans schema."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import ValueProblem, duration
from ..sources.tables import day_of

#: Intrinsic tags, statuses, and limits of a search.
INTRINSICS = ("duration", "name", "status")
STATUS = {"unset": 0, "ok": 1, "error": 2}
DEFAULT_LIMIT, MAX_LIMIT = 20, 1000

_TAG = re.compile(r'[\s,]*([^\s,="]+)=(?:"((?:[^"\\]|\\.)*)"|([^\s,"]*))(?=[\s,]|\Z)')


class TagProblem(ValueError):
    """Tags that cannot be read."""


def scan(spans: DataFrame, tenant: str, start_ns: int | None = None, end_ns: int | None = None, floor_ns: int | None = None) -> DataFrame:
    """Spans of a tenant that overlap [start, end], both inclusive, and that retention still shows."""
    df = spans.where(F.col("tenant") == tenant)
    if start_ns is not None:
        df = df.where(F.col("end_ns") >= start_ns)
        if "reach" in spans.columns:  # partition columns both: days before whose spans all ended are not listed
            df = df.where(F.col("reach").isNull() | (F.date_add("day", F.col("reach")) >= day_of(F.lit(start_ns).cast("long"))))
    if end_ns is not None:
        df = df.where(F.col("start_ns") <= end_ns)
        if "day" in spans.columns:
            df = df.where(F.col("day") <= day_of(F.lit(end_ns).cast("long")))
    if floor_ns is not None:
        df = df.where(F.col("start_ns") >= floor_ns)
    return df


def trace_id(text: str) -> str:
    """A canonical trace id."""
    text = text.strip().lower()
    if not re.fullmatch("[0-9a-f]{32}", text) or not text.strip("0"):
        raise TagProblem(f"invalid trace id {text!r}")
    return text


def trace(spans: DataFrame, id_: str) -> DataFrame:
    return spans.where(F.col("trace_id") == trace_id(id_)).orderBy("start_ns", "span_id")


def parse_tags(text: str) -> list[tuple[str, str]]:
    """name=value pairs between commas or spaces, braces around them allowed."""
    text = text.strip()
    if text.startswith("{") and text.endswith("}"):
        text = text[1:-1]
    out, at = [], 0
    while text[at:].strip(" \t\n\r,"):
        m = _TAG.match(text, at)
        if m is None:
            raise TagProblem(f"invalid tags {text!r}")
        out.append((m[1], re.sub(r"\\(.)", r"\1", m[2]) if m[2] is not None else m[3]))
        at = m.end()
    return out


def tag_value(tag: str) -> Column:
    """A span's value of a tag as text, null if it has none: intrinsics, then its attributes, then its resource's.

    An attribute whose value is no scalar hides the resource's.
    """
    if tag == "name":
        return F.col("name")
    if tag == "duration":
        return (F.col("end_ns") - F.col("start_ns")).cast("string")
    if tag == "status":
        return F.when(F.col("status_code") == 1, "ok").when(F.col("status_code") == 2, "error").otherwise("unset")
    own, resource = F.element_at("attributes", tag), F.element_at("resource.attributes", tag)
    if tag == "service.name":
        return F.coalesce(resource, own)
    return F.when(own.isNotNull(), own).when(F.array_contains("opaque", tag), F.lit(None)).otherwise(resource)


def tag_test(tag: str, value: str) -> Column:
    if tag == "duration":
        try:
            ns = duration(value)
        except ValueProblem:
            return tag_value(tag) == value
        return (tag_value(tag) == value) | (F.col("end_ns") - F.col("start_ns") == ns)
    if tag == "status":
        return F.col("status_code") == STATUS[value.lower()] if value.lower() in STATUS else F.lit(False)
    return F.coalesce(tag_value(tag) == value, F.lit(False))


def search(spans: DataFrame, tags: list[tuple[str, str]] = (), min_ns: int | None = None, max_ns: int | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """A row for each trace that satisfies every tag with some span: its root, extent and number of spans, by trace id.

    The root is the first span without a parent, else the earliest.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise TagProblem(f"a limit lies between 1 and {MAX_LIMIT}")
    rank = F.struct(F.when(F.col("parent_span_id") == "", 0).otherwise(1), "start_ns", "span_id")
    root = F.min_by(F.struct("name", F.coalesce(tag_value("service.name"), F.lit("")).alias("service")), rank)
    has = {f"has{i}": F.bool_or(tag_test(t, v)) for i, (t, v) in enumerate(tags)}
    per = spans.groupBy("trace_id").agg(root.alias("root"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count("*").alias("spans"), *(c.alias(n) for n, c in has.items()))
    extent = F.col("end_ns") - F.col("start_ns")
    tests = [F.col(n) for n in has] + ([extent >= min_ns] if min_ns is not None else []) + ([extent <= max_ns] if max_ns is not None else [])
    found = per.where(reduce(Column.__and__, tests, F.lit(True)))
    return found.select("trace_id", F.col("root.service").alias("root_service"), F.col("root.name").alias("root_name"), "start_ns", extent.alias("duration_ns"), "spans").orderBy("trace_id").limit(limit)


def tag_names(spans: DataFrame) -> DataFrame:
    """scope and tag: intrinsics, and the names that spans and resources have."""
    own = spans.select(F.lit("span").alias("scope"), F.explode(F.concat(F.map_keys("attributes"), "opaque")).alias("tag"))
    resource = spans.select(F.lit("resource").alias("scope"), F.explode(F.map_keys("resource.attributes")).alias("tag"))
    fixed = spans.sparkSession.createDataFrame([("intrinsic", x) for x in INTRINSICS], "scope string, tag string")
    return own.unionByName(resource).distinct().unionByName(fixed).orderBy("scope", "tag")


def tag_values(spans: DataFrame, tag: str) -> DataFrame:
    return spans.select(tag_value(tag).alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value")


def batches(spans: DataFrame) -> DataFrame:
    """Spans put together by resource and scope, as a trace is sent out."""
    from ..functions import labels as L

    span = F.struct(*(F.col(c) for c in ("start_ns", "span_id", "parent_span_id", "trace_id", "name", "end_ns", "kind", "status_code", "attributes")))
    key = L.labels_key(F.col("resource.attributes")).alias("resource_key")
    return spans.groupBy(key, F.col("resource.schema_url").alias("schema_url"), F.col("scope.name").alias("scope_name"), F.col("scope.version").alias("scope_version")).agg(F.array_sort(F.collect_list(F.to_json(span))).alias("spans"))
