"""The engine: parses a query, plans it over the tables, and gives a DataFrame or its JSON."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .api import encoders
from .operators import discovery, masks, ranges, selection, traces
from .operators.policies import Deletes, Policies
from .plans import ast
from .plans.parser import QueryProblem, checked, parse, parse_selector

#: Default and largest number of entries of a log query.
DEFAULT_LIMIT, MAX_LIMIT = 100, 100_000


@dataclass
class Engine:
    """Log and span tables with their policies and deletes; everything returned is lazy but the *_json methods."""

    logs: DataFrame
    spans: DataFrame | None = None
    policies: Policies = field(default_factory=Policies)
    deletes: Deletes = field(default_factory=Deletes)
    now_ns: int | None = None

    def _floor(self, tenant: str) -> int | None:
        return self.policies.floor(tenant, self.now_ns) if self.now_ns is not None else None

    def scan(self, tenant: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
        return masks.scan(self.logs, tenant, start_ns, end_ns, self.deletes.list(tenant), self._floor(tenant))

    def log_query(self, tenant: str, text: str, start_ns: int, end_ns: int, limit: int = DEFAULT_LIMIT, direction: str = "backward") -> DataFrame:
        query = parse_selector(text)
        if direction.lower() not in ("forward", "backward"):
            raise QueryProblem(f"unknown direction {direction!r}")
        if not 0 <= limit <= MAX_LIMIT:
            raise QueryProblem(f"a limit lies between 0 and {MAX_LIMIT}")
        return selection.newest(selection.entries(self.scan(tenant, start_ns, end_ns), query), limit, direction.lower() == "forward")

    def metric_query(self, tenant: str, text: str, start_ns: int, end_ns: int, step_ns: int) -> tuple[DataFrame, ranges.Grid]:
        m = parse(text)
        if isinstance(m, ast.LogQuery):
            raise QueryProblem(f"{text!r} is not a metric")
        grid = ranges.Grid.between(start_ns, end_ns, step_ns)
        return ranges.metric(self.scan(tenant, start_ns - ast.lookback(m), end_ns), m, grid), grid

    def instant_query(self, tenant: str, text: str, at_ns: int) -> DataFrame:
        m = parse(text)
        if isinstance(m, ast.LogQuery):
            raise QueryProblem(f"{text!r} is not a metric")
        return ranges.metric(self.scan(tenant, at_ns - ast.lookback(m), at_ns), m, ranges.Grid.instant(at_ns))

    def query_range_json(self, tenant: str, text: str, start_ns: int, end_ns: int, step_ns: int = 10**9, limit: int = DEFAULT_LIMIT, direction: str = "backward") -> dict:
        if isinstance(parse(text), ast.LogQuery):
            return encoders.streams(self.log_query(tenant, text, start_ns, end_ns, limit, direction))
        return encoders.matrix(*self.metric_query(tenant, text, start_ns, end_ns, step_ns))

    def query_json(self, tenant: str, text: str, at_ns: int, limit: int = DEFAULT_LIMIT) -> dict:
        if isinstance(parse(text), ast.LogQuery):
            return encoders.streams(self.log_query(tenant, text, at_ns - 3600 * 10**9, at_ns, limit))
        return encoders.vector(self.instant_query(tenant, text, at_ns), at_ns)

    def format_query(self, text: str) -> str:
        return checked(text)

    def labels(self, tenant: str, start_ns: int, end_ns: int) -> DataFrame:
        return discovery.label_names(self.scan(tenant, start_ns, end_ns))

    def label_values(self, tenant: str, name: str, start_ns: int, end_ns: int) -> DataFrame:
        return discovery.label_values(self.scan(tenant, start_ns, end_ns), name)

    def series(self, tenant: str, selectors: list[str], start_ns: int, end_ns: int) -> DataFrame:
        return discovery.series(self.scan(tenant, start_ns, end_ns), [parse_selector(s) for s in selectors])

    def index_stats(self, tenant: str, selector: str, start_ns: int, end_ns: int) -> DataFrame:
        return discovery.stats(self.scan(tenant, start_ns, end_ns), parse_selector(selector))

    def volume(self, tenant: str, selector: str, start_ns: int, end_ns: int, targets: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
        return discovery.volume(self.scan(tenant, start_ns, end_ns), parse_selector(selector), start_ns, end_ns, targets, limit)

    def volume_range(self, tenant: str, selector: str, start_ns: int, end_ns: int, step_ns: int, targets: tuple[str, ...] = ()) -> DataFrame:
        return discovery.volume_range(self.scan(tenant, start_ns - step_ns, end_ns), parse_selector(selector), start_ns, end_ns, step_ns, targets)

    def detected_labels(self, tenant: str, start_ns: int, end_ns: int) -> DataFrame:
        return discovery.detected_labels(self.scan(tenant, start_ns, end_ns))

    def detected_fields(self, tenant: str, text: str, start_ns: int, end_ns: int) -> DataFrame:
        return discovery.detected_fields(self.scan(tenant, start_ns, end_ns), parse_selector(text))

    def patterns(self, tenant: str, text: str, start_ns: int, end_ns: int, step_ns: int | None = None) -> DataFrame:
        return discovery.patterns(self.scan(tenant, start_ns, end_ns), parse_selector(text), start_ns, end_ns, step_ns)

    def scan_spans(self, tenant: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
        return traces.scan(self.spans, tenant, start_ns, end_ns, self._floor(tenant))

    def trace(self, tenant: str, trace_id: str) -> DataFrame:
        return traces.trace(self.scan_spans(tenant), trace_id)

    def search(self, tenant: str, tags: str = "", start_ns: int | None = None, end_ns: int | None = None, min_ns: int | None = None, max_ns: int | None = None, limit: int = traces.DEFAULT_LIMIT) -> DataFrame:
        return traces.search(self.scan_spans(tenant, start_ns, end_ns), traces.parse_tags(tags), min_ns, max_ns, limit)
