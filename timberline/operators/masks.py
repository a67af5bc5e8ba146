"""What a scan must not show: rows outside the window, beyond retention, or deleted."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import duration
from ..plans import ast
from ..plans.parser import QueryProblem, parse_selector
from ..sources.tables import day_of
from . import selection

#: Fixed value: delete requests of a tenant.
MAX_DELETES = 100
RECEIVED, PROCESSED = "received", "processed"


@dataclass(frozen=True)
class Delete:
    """Hides rows of a selector in [start_ns, end_ns)."""

    request_id: str
    tenant: str
    query: str
    start_ns: int
    end_ns: int
    created_at_ns: int = 0
    status: str = RECEIVED


def delete_query(text: str) -> ast.LogQuery:
    """A selector with line filters only, and not of all streams."""
    q = parse_selector(text)
    if not q.matchers or any(not isinstance(s, ast.LineFilter) for s in q.stages):
        raise QueryProblem("a delete takes label matchers and line filters")
    return q


def _hidden(d: Delete) -> Column:
    q = delete_query(d.query)
    test = (F.col("ts_ns") >= d.start_ns) & (F.col("ts_ns") < d.end_ns) & selection.matches_all(q.matchers)
    return reduce(Column.__and__, map(selection.passes, q.stages), test)


def visible(deletes: list[Delete]) -> Column:
    """True for rows that no request hides."""
    return ~reduce(Column.__or__, map(_hidden, deletes), F.lit(False))


def retention_ns(text: str) -> int | None:
    """A retention's nanoseconds; none for an infinite one."""
    return None if text.strip().lower() in ("infinite", "inf", "") else 0 if text.strip() == "0" else duration(text)


def floor(now_ns: int, retention: int | None) -> int | None:
    """The oldest time that is shown: with a retention of 0, nothing up to now is."""
    return None if retention is None else now_ns + 1 if retention == 0 else now_ns - retention


def scan(logs: DataFrame, tenant: str, start_ns: int | None = None, end_ns: int | None = None, deletes: list[Delete] = (), floor_ns: int | None = None) -> DataFrame:
    """Rows of a tenant with start <= ts <= end that no delete hides; every query reads through here."""
    if floor_ns is not None:
        start_ns = floor_ns if start_ns is None else max(start_ns, floor_ns)
    df = logs.where(F.col("tenant") == tenant)
    for bound, op in ((start_ns, "__ge__"), (end_ns, "__le__")):
        if bound is not None:
            df = df.where(getattr(F.col("ts_ns"), op)(bound))
            if "day" in logs.columns:  # the partition column, which the bound on the time itself would not prune
                df = df.where(getattr(F.col("day"), op)(day_of(F.lit(bound).cast("long"))))
    own = [d for d in deletes if d.tenant == tenant]
    return df.where(visible(own)) if own else df
