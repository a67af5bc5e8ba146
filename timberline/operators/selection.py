"""Matchers, line filters and the ordered stages of a log query, over the logs schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields, regex
from ..functions import labels as L
from ..functions.values import decimal_compare, duration_ns
from ..plans import ast


def matches(m: ast.Matcher) -> Column:
    """A label matcher; an absent label counts as empty."""
    value = L.get(F.col("labels"), m.name)
    if m.op in ("=", "!="):
        test = value == m.value
    else:
        test = value.rlike(regex.anchored(m.value))
    return test if m.op in ("=", "=~") else ~test


def matches_all(matchers: tuple[ast.Matcher, ...]) -> Column:
    return reduce(Column.__and__, map(matches, matchers), F.lit(True))


def passes(f: ast.LineFilter) -> Column:
    test = F.col("line").contains(f.value) if f.op in ("|=", "!=") else F.col("line").rlike(regex.unanchored(f.value))
    return test if f.op in ("|=", "|~") else ~test


def literals(query: ast.LogQuery) -> list[str]:
    """Texts that a stored line must contain to pass a query: its |= filters before the line is formatted anew."""
    out = []
    for stage in query.stages:
        if isinstance(stage, ast.LineFormat):
            break
        if isinstance(stage, ast.LineFilter) and stage.op == "|=":
            out.append(stage.value)
    return out


def field_test(f: ast.FieldFilter) -> Column:
    """A field filter; an absent field is an empty string, and no number or duration, so those tests fail."""
    value = L.get(F.col("fields"), f.name)
    if f.kind in ("string", "regex"):
        test = value == f.value if f.kind == "string" else value.rlike(regex.anchored(f.value))
        return test if f.op in ("=", "=~") else ~test
    if f.kind == "number":
        order = decimal_compare(value, f.value)
    else:
        from ..functions.values import duration

        ns, limit = duration_ns(value), duration(f.value)
        order = F.when(ns < limit, -1).when(ns > limit, 1).when(ns.isNotNull(), 0)
    test = {"=": order == 0, "!=": order != 0, "<": order < 0, "<=": order <= 0, ">": order > 0, ">=": order >= 0}[f.op]
    return F.coalesce(test, F.lit(False))


def rendered(parts: tuple[str, ...], source: Column) -> Column:
    return F.concat(*(L.get(source, x) if i % 2 else F.lit(x) for i, x in enumerate(parts)))


def needs_fields(stages: tuple[ast.Stage, ...]) -> bool:
    return any(not isinstance(s, ast.LineFilter) for s in stages)


def pipeline(logs: DataFrame, stages: tuple[ast.Stage, ...]) -> DataFrame:
    """The rows that pass all stages, in their order, with the line and the column fields as they leave the last."""
    if not needs_fields(stages):
        logs = reduce(lambda df, s: df.where(passes(s)), stages, logs)
        return logs.withColumn("fields", L.joined(F.col("labels"), F.col("metadata")))
    # line filters before the first stage of another kind see the stored line: they come first, so that they reach the scan
    first = next(i for i, s in enumerate(stages) if not isinstance(s, ast.LineFilter))
    df = reduce(lambda df, s: df.where(passes(s)), stages[:first], logs)
    df = df.withColumn("fields", L.joined(F.col("labels"), F.col("metadata")))
    for s in stages[first:]:
        if isinstance(s, ast.LineFilter):
            df = df.where(passes(s))
        elif isinstance(s, ast.Parser):
            df = df.withColumn("fields", (fields.json_stage if s.kind == "json" else fields.logfmt_stage)(F.col("line"), F.col("fields")))
        elif isinstance(s, ast.LineFormat):
            df = df.withColumn("line", rendered(s.parts, F.col("fields")))
        elif isinstance(s, ast.LabelFormat):
            targets = [t for t, _, _ in s.assignments]
            new = F.map_from_arrays(F.array(*map(F.lit, targets)), F.array(*(L.get(F.col("fields"), name) if name is not None else rendered(parts, F.col("fields")) for _, name, parts in s.assignments)))
            df = df.withColumn("fields", F.map_concat(F.map_filter("fields", lambda k, _: ~k.isin(targets)), new))
        else:
            df = df.where(field_test(s))
    return df


def entries(logs: DataFrame, query: ast.LogQuery) -> DataFrame:
    """ts_ns, labels, labels_key, line and metadata (all fields that are no stream labels) of a log query's rows."""
    df = pipeline(logs.where(matches_all(query.matchers)), query.stages)
    if needs_fields(query.stages):
        df = df.withColumn("metadata", F.map_filter("fields", lambda k, _: ~F.map_contains_key("labels", k)))
    return df.select("ts_ns", "labels", L.labels_key(F.col("labels")).alias("labels_key"), "line", "metadata")


def newest(df: DataFrame, limit: int, forward: bool = False) -> DataFrame:
    """The first rows by time over all streams; rows of the same time are ordered by labels, line and metadata."""
    ts = F.col("ts_ns").asc() if forward else F.col("ts_ns").desc()
    return df.orderBy(ts, "labels_key", "line", L.labels_key(F.col("metadata"))).limit(limit)
