"""What a query says, as frozen values."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Union


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str
    value: str


@dataclass(frozen=True)
class LineFilter:
    op: str
    value: str


@dataclass(frozen=True)
class Parser:
    kind: str


@dataclass(frozen=True)
class LineFormat:
    """Literal texts and field names in turn; odd places are names."""

    parts: tuple[str, ...]


@dataclass(frozen=True)
class LabelFormat:
    """(target, field name or None, template parts or None)."""

    assignments: tuple[tuple[str, str | None, tuple[str, ...] | None], ...]


@dataclass(frozen=True)
class FieldFilter:
    """kind: string, regex, number or duration."""

    name: str
    op: str
    kind: str
    value: str


Stage = Union[LineFilter, Parser, LineFormat, LabelFormat, FieldFilter]


@dataclass(frozen=True)
class LogQuery:
    matchers: tuple[Matcher, ...]
    stages: tuple[Stage, ...] = ()


@dataclass(frozen=True)
class Unwrap:
    name: str
    is_duration: bool = False


@dataclass(frozen=True)
class Range:
    function: str
    query: LogQuery
    range_ns: int
    offset_ns: int = 0
    unwrap: Unwrap | None = None
    phi: float | None = None


@dataclass(frozen=True)
class Subquery:
    function: str
    inner: "Metric"
    range_ns: int
    step_ns: int
    offset_ns: int = 0
    phi: float | None = None


@dataclass(frozen=True)
class Grouping:
    names: tuple[str, ...]
    without: bool = False


@dataclass(frozen=True)
class Aggregate:
    op: str
    inner: "Metric"
    grouping: Grouping | None = None


@dataclass(frozen=True)
class TopK:
    k: int
    inner: "Metric"


@dataclass(frozen=True)
class Scalar:
    """A metric with a number on one side of an operator."""

    inner: "Metric"
    op: str
    value: float
    scalar_left: bool = False


Metric = Union[Range, Subquery, Aggregate, TopK, Scalar]


def log_query(m: Metric) -> LogQuery:
    """The one log query that a metric reads."""
    return m.query if isinstance(m, Range) else log_query(m.inner)


def lookback(m: Metric) -> int:
    """How far before an evaluation a metric reads."""
    if isinstance(m, Range):
        return m.range_ns + m.offset_ns
    if isinstance(m, Subquery):
        return m.range_ns + m.offset_ns + lookback(m.inner)
    return lookback(m.inner)


def grouped_names(m: Metric) -> frozenset[str]:
    """All names in groupings: fields of these names become labels of the series."""
    if isinstance(m, Range):
        return frozenset()
    own = frozenset(m.grouping.names) if isinstance(m, Aggregate) and m.grouping else frozenset()
    return own | grouped_names(m.inner)
