"""Range functions and subqueries on an evaluation grid.

An entry at t counts for every grid point whose window (point - offset - range,
point - offset] holds it: a run of grid indexes that integer arithmetic gives, so
no join on a condition is needed. Where windows overlap, entries are first added
up by the common divisor of range and step ("panes"), for quantiles counted by
value, and only those sums are repeated.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.values import duration_ns, finite_double
from ..plans import ast
from . import selection, vectors

#: Evaluations of a query, and points of a subquery's grid.
MAX_POINTS, MAX_INNER_POINTS = 10_000, 1_000_000
#: Panes of a step beyond which adding up by pane no longer pays for its shuffle.
MAX_PANES = 64


class GridProblem(ValueError):
    """A grid that cannot be evaluated."""


@dataclass(frozen=True)
class Grid:
    """start, start + step, ... in nanoseconds; last is the index of the last point."""

    start: int
    step: int
    last: int

    @staticmethod
    def between(start: int, end: int, step: int, most: int = MAX_POINTS) -> Grid:
        if step <= 0 or end < start:
            raise GridProblem("a grid needs a positive step and an end that is not before its start")
        if (end - start) // step + 1 > most:
            raise GridProblem(f"more than {most} evaluations")
        return Grid(start, step, (end - start) // step)

    @staticmethod
    def instant(at: int) -> Grid:
        return Grid(at, 1, 0)

    @property
    def end(self) -> int:
        return self.start + self.last * self.step


def _floor_div(x: str, by: int) -> str:
    return f"(({x}) - pmod({x}, {by}L)) div {by}L"


def _ceil_div(x: str, by: int) -> str:
    return f"-({_floor_div(f'-({x})', by)})"


def _first(x: str, grid: Grid, offset: int) -> str:
    """SQL: index of the first grid point at or after x + offset; may lie outside the grid."""
    return _ceil_div(f"{x} + ({offset - grid.start}L)", grid.step)


def _aggregates(function: str) -> dict[str, Column]:
    value = F.col("v")
    return {
        "rate": {"n": F.count("*")},
        "count_over_time": {"n": F.count("*")},
        "bytes_over_time": {"s": F.sum("v")},
        "sum_over_time": {"s": F.sum("v")},
        "avg_over_time": {"s": F.sum("v"), "n": F.count("*")},
        "min_over_time": {"lo": F.min(value)},
        "max_over_time": {"hi": F.max(value)},
    }[function]


_MERGE = {"n": F.sum, "s": F.sum, "lo": F.min, "hi": F.max}


def _value(function: str, range_ns: int) -> Column:
    return {
        "rate": lambda: F.col("n") / F.lit(range_ns / 1e9),
        "count_over_time": lambda: F.col("n"),
        "bytes_over_time": lambda: F.col("s"),
        "sum_over_time": lambda: F.col("s"),
        "avg_over_time": lambda: F.col("s") / F.col("n"),
        "min_over_time": lambda: F.col("lo"),
        "max_over_time": lambda: F.col("hi"),
    }[function]().cast("double").alias("value")


def samples(logs: DataFrame, m: ast.Range, promoted: frozenset[str]) -> DataFrame:
    """series, ts_ns and v of the entries that a range function sees; series: stream labels and the fields that groupings name."""
    query = m.query
    df = selection.pipeline(logs.where(selection.matches_all(query.matchers)), query.stages)
    key = L.labels_key(F.col("labels"))
    if promoted:
        extra = F.filter(F.map_entries("fields"), lambda x: x["key"].isin(sorted(promoted)) & ~F.map_contains_key("labels", x["key"]))
        key = F.array_sort(F.concat(key, extra))
    if m.unwrap:
        text = F.element_at("fields", m.unwrap.name)
        v = duration_ns(text) / 1e9 if m.unwrap.is_duration else finite_double(text)
        return df.select(key.alias("series"), "ts_ns", v.alias("v")).where(F.col("v").isNotNull())
    if m.function == "bytes_over_time":
        return df.select(key.alias("series"), "ts_ns", F.octet_length("line").cast("long").alias("v"))
    return df.select(key.alias("series"), "ts_ns")


def over_range(rows: DataFrame, m: ast.Range, grid: Grid) -> DataFrame:
    """series, k, value of a range function over (series, ts_ns, v)."""
    quantile, pane = m.function == "quantile_over_time", math.gcd(m.range_ns, grid.step)
    parts = {"n": F.count("*")} if quantile else _aggregates(m.function)
    paned = grid.last > 0 and m.range_ns > grid.step and pane * MAX_PANES >= grid.step
    if paned:  # pane p ends p * pane after the grid's start
        at = F.expr(_first("ts_ns", Grid(grid.start, pane, 0), m.offset_ns))
        rows = rows.withColumn("p", at).groupBy("series", "p", *(["v"] if quantile else [])).agg(*(c.alias(n) for n, c in parts.items()))
        parts = {n: _MERGE[n](n) for n in parts}
        low, high = _ceil_div(f"p * {pane}L", grid.step), _floor_div(f"p * {pane}L + {m.range_ns - pane}L", grid.step)
    else:
        low, high = _first("ts_ns", grid, m.offset_ns), f"{_first('ts_ns', grid, m.offset_ns + m.range_ns)} - 1"
    of = rows.withColumn("k", F.explode(_indexes(f"greatest(0L, {low})", f"least({grid.last}L, {high})"))).groupBy("series", "k")
    if quantile:
        return of.agg(F.percentile("v", F.lit(m.phi), F.col("n") if paned else F.lit(1)).alias("value"))
    return of.agg(*(c.alias(n) for n, c in parts.items())).select("series", "k", _value(m.function, m.range_ns))


def _indexes(low: str, high: str) -> Column:
    return F.expr(f"CASE WHEN {low} <= {high} THEN sequence({low}, {high}) END")


def inner_grid(m: ast.Subquery, grid: Grid) -> Grid:
    """A regular grid that holds every point at which the inner metric is evaluated."""
    start = grid.start - m.offset_ns - m.range_ns + m.step_ns
    count = m.range_ns // m.step_ns
    if count < 1:
        return Grid(start, 1, -1)
    step = math.gcd(m.step_ns, grid.step) if grid.last else m.step_ns
    end = grid.end - m.offset_ns - m.range_ns + m.step_ns * count
    return Grid.between(start, end, step, MAX_INNER_POINTS)


def over_subquery(logs: DataFrame, m: ast.Subquery, grid: Grid, promoted: frozenset[str]) -> DataFrame:
    """series, k, value of a function over the values that an inner metric has on a grid of its own before each point."""
    inner, count = inner_grid(m, grid), m.range_ns // m.step_ns
    if count < 1 or inner.last < 0:
        return logs.sparkSession.createDataFrame([], f"series {L.KEY_TYPE}, k long, value double")
    values = metric(logs, m.inner, inner, promoted).withColumnRenamed("value", "v")
    # inner point i lies i * inner.step after the first; outer point k uses those at k * grid.step + j * step, j < count
    at = f"(k * {inner.step}L)"
    low = f"greatest(0L, {_ceil_div(f'{at} - {m.step_ns * (count - 1)}L', grid.step)})"
    high = f"least({grid.last}L, {_floor_div(at, grid.step)})"
    spread = values.withColumn("outer", F.explode(_indexes(low, high))).where(f"pmod({at} - outer * {grid.step}L, {m.step_ns}L) = 0")
    of = spread.groupBy("series", F.col("outer").alias("k"))
    value = {
        "rate": F.sum("v") / F.lit(m.range_ns / 1e9),
        "count_over_time": F.count("*").cast("double"),
        "sum_over_time": F.sum("v"),
        "avg_over_time": F.avg("v"),
        "min_over_time": F.min("v"),
        "max_over_time": F.max("v"),
        "quantile_over_time": F.percentile("v", F.lit(m.phi if m.phi is not None else 0.5)),
    }[m.function]
    return of.agg(value.cast("double").alias("value"))


def metric(logs: DataFrame, m: ast.Metric, grid: Grid, promoted: frozenset[str] | None = None) -> DataFrame:
    """series (sorted key and value pairs), k (grid index), value of a metric."""
    promoted = ast.grouped_names(m) if promoted is None else promoted
    if isinstance(m, ast.Range):
        return over_range(samples(logs, m, promoted), m, grid)
    if isinstance(m, ast.Subquery):
        return over_subquery(logs, m, grid, promoted)
    inner = metric(logs, m.inner, grid, promoted)
    if isinstance(m, ast.Aggregate):
        return vectors.aggregate(inner, m.op, m.grouping)
    if isinstance(m, ast.TopK):
        return vectors.top(inner, m.k)
    return vectors.with_scalar(inner, m.op, m.value, m.scalar_left)
