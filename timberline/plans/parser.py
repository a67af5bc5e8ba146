"""The query language's parser: one scanner over the text, by recursive descent."""

from __future__ import annotations

import re

from ..functions import regex
from ..functions.values import ValueProblem, decimal, duration
from . import ast

#: Functions and operators of the language.
RANGE_FUNCTIONS = ("rate", "count_over_time", "bytes_over_time", "sum_over_time", "avg_over_time", "min_over_time", "max_over_time", "quantile_over_time")
UNWRAPPED = ("sum_over_time", "avg_over_time", "min_over_time", "max_over_time", "quantile_over_time")
AGGREGATES = ("sum", "avg", "min", "max")
COMPARISONS = ("==", "!=", ">=", "<=", ">", "<")
#: Operators from the loosest; all bind to the left.
PRECEDENCE = (COMPARISONS, ("+", "-"), ("*", "/", "%"))
MAX_DEPTH = 64

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_LITERAL = re.compile(r"[+-]?[0-9.][A-Za-z0-9.µ]*(?:(?<=[0-9.][eE])[+-][0-9]+)?")
_SCALAR = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?(?![A-Za-z0-9_.µ])")
_DURATION = re.compile(r"[0-9.][0-9.a-zµ]*")
_LONE_NAME = re.compile(r"\{\{\s*\.([A-Za-z0-9_]+)\s*\}\}")


class QueryProblem(ValueError):
    """A query that the language does not have."""


class _Scanner:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def sees(self, *options: str) -> str | None:
        """The first of the options that stands here; words are whole words."""
        self.space()
        for o in options:
            end = self.at + len(o)
            if self.text.startswith(o, self.at) and not (o[-1].isalnum() and end < len(self.text) and (self.text[end].isalnum() or self.text[end] == "_")):
                return o
        return None

    def takes(self, *options: str) -> str | None:
        if o := self.sees(*options):
            self.at += len(o)
        return o

    def needs(self, *options: str) -> str:
        return self.takes(*options) or self.fail(f"expected {' or '.join(map(repr, options))}")

    def match(self, pattern: re.Pattern) -> str | None:
        self.space()
        m = pattern.match(self.text, self.at)
        if m is None:
            return None
        self.at = m.end()
        return m[0]

    def name(self) -> str:
        return self.match(_NAME) or self.fail("expected a name")

    def string(self, raw: bool = True) -> str:
        """A quoted string; with raw also one between backticks."""
        self.space()
        quote = self.text[self.at : self.at + 1]
        if quote == "`" and raw:
            end = self.text.find("`", self.at + 1)
            if end < 0:
                self.fail("unclosed string")
            value, self.at = self.text[self.at + 1 : end], end + 1
            return value
        if quote != '"':
            self.fail("expected a string")
        out, i = [], self.at + 1
        while i < len(self.text) and self.text[i] != '"':
            if self.text[i] == "\\" and i + 1 < len(self.text):
                e = self.text[i + 1]
                if e == "u":
                    code = self.text[i + 2 : i + 6]
                    if not re.fullmatch("[0-9a-fA-F]{4}", code) or 0xD800 <= int(code, 16) <= 0xDFFF:
                        self.fail("invalid escape")
                    out.append(chr(int(code, 16)))
                    i += 6
                    continue
                out.append({"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}.get(e, "\\" + e))
                i += 2
                continue
            out.append(self.text[i])
            i += 1
        if i >= len(self.text):
            self.fail("unclosed string")
        self.at = i + 1
        return "".join(out)

    def duration(self) -> int:
        text = self.match(_DURATION) or self.fail("expected a duration")
        return duration(text)

    def fail(self, why: str):
        raise QueryProblem(f"{why} at {self.at} of {self.text!r}")


def _guarded(f):
    def run(text: str):
        try:
            return f(text)
        except (ValueProblem, regex.RegexProblem) as e:
            raise QueryProblem(str(e)) from e

    return run


@_guarded
def parse(text: str) -> ast.LogQuery | ast.Metric:
    """A log query if the text begins with a selector, else a metric."""
    s = _Scanner(text)
    if s.sees("{"):
        out = _log_query(s)
    else:
        out = _metric(s, 0)
        if isinstance(out, float):
            s.fail("a number alone is no query")
    s.space()
    if s.at < len(text):
        s.fail("unexpected text")
    return out


@_guarded
def parse_selector(text: str) -> ast.LogQuery:
    out = parse(text)
    if not isinstance(out, ast.LogQuery):
        raise QueryProblem(f"{text!r} is not a log query")
    return out


# ---------------------------------------------------------------- log queries


def _log_query(s: _Scanner) -> ast.LogQuery:
    s.needs("{")
    matchers = []
    if not s.takes("}"):
        while True:
            name, op = s.name(), s.needs("=~", "!~", "!=", "=")
            value = s.string(raw=False)
            if op in ("=~", "!~"):
                regex.anchored(value)
            matchers.append(ast.Matcher(name, op, value))
            if s.takes("}"):
                break
            s.needs(",")
    stages = []
    while (stage := _stage(s)) is not None:
        stages.append(stage)
    return ast.LogQuery(tuple(matchers), tuple(stages))


def _is_comparison(s: _Scanner) -> bool:
    return s.sees("=~", "!~", "<=", ">=", "!=", "=", "<", ">") is not None


def _stage(s: _Scanner) -> ast.Stage | None:
    if op := s.takes("|=", "!=", "|~", "!~"):
        value = s.string()
        if op in ("|~", "!~"):
            regex.unanchored(value)
        return ast.LineFilter(op, value)
    start = s.at
    if not s.takes("|"):
        return None
    name = s.name()
    if name == "unwrap" and not _is_comparison(s):
        s.at = start
        return None
    if not _is_comparison(s):
        if name in ("json", "logfmt"):
            return ast.Parser(name)
        if name == "line_format":
            return ast.LineFormat(template(s.string()))
        if name == "label_format":
            return _label_format(s)
        s.fail(f"unknown stage {name!r}")
    op = s.needs("=~", "!~", "<=", ">=", "!=", "=", "<", ">")
    if s.sees('"', "`"):
        value = s.string()
        if op in ("=~", "!~"):
            regex.anchored(value)
            return ast.FieldFilter(name, op, "regex", value)
        if op not in ("=", "!="):
            s.fail("an ordered comparison takes a number or a duration")
        return ast.FieldFilter(name, op, "string", value)
    if op in ("=~", "!~"):
        s.fail("expected a regex")
    literal = s.match(_LITERAL) or s.fail("expected a string, number or duration")
    try:
        decimal(literal)
        return ast.FieldFilter(name, op, "number", literal)
    except ValueProblem:
        duration(literal)
        return ast.FieldFilter(name, op, "duration", literal)


def template(text: str) -> tuple[str, ...]:
    """Literal texts and field names in turn."""
    out, at = [], 0
    for m in _LONE_NAME.finditer(text):
        out += [text[at : m.start()], m[1]]
        at = m.end()
    out.append(text[at:])
    if any("{{" in x or "}}" in x for x in out[::2]):
        raise QueryProblem(f"templates hold only {{{{.name}}}}: {text!r}")
    return tuple(out)


def _label_format(s: _Scanner) -> ast.LabelFormat:
    out: list[tuple[str, str | None, tuple[str, ...] | None]] = []
    while True:
        target = s.name()
        s.needs("=")
        out.append((target, None, template(s.string())) if s.sees('"', "`") else (target, s.name(), None))
        if len({x[0] for x in out}) < len(out):
            s.fail(f"{target!r} is assigned twice")
        if not s.takes(","):
            return ast.LabelFormat(tuple(out))


# -------------------------------------------------------------------- metrics


def _metric(s: _Scanner, depth: int, level: int = 0) -> ast.Metric | float:
    if depth > MAX_DEPTH:
        s.fail("nested too deeply")
    if level == len(PRECEDENCE):
        return _operand(s, depth)
    left = _metric(s, depth, level + 1)
    while op := s.takes(*PRECEDENCE[level]):
        right = _metric(s, depth, level + 1)
        if isinstance(left, float) == isinstance(right, float):
            s.fail("an operator takes a metric and a number")
        left = ast.Scalar(left, op, right) if isinstance(right, float) else ast.Scalar(right, op, left, scalar_left=True)
    return left


def _operand(s: _Scanner, depth: int) -> ast.Metric | float:
    if s.takes("("):
        out = _metric(s, depth + 1)
        s.needs(")")
        return out
    if number := s.match(_SCALAR):
        return float(number)
    name = s.name()
    if name in AGGREGATES:
        grouping = _grouping(s)
        s.needs("(")
        inner = _inner_metric(s, depth)
        s.needs(")")
        after = _grouping(s)
        if grouping and after:
            s.fail("two groupings")
        return ast.Aggregate(name, inner, grouping or after)
    if name == "topk":
        s.needs("(")
        k = s.match(re.compile("[0-9]+")) or s.fail("expected a number of series")
        s.needs(",")
        inner = _inner_metric(s, depth)
        s.needs(")")
        if int(k) < 1:
            s.fail("topk takes at least 1")
        return ast.TopK(int(k), inner)
    if name in RANGE_FUNCTIONS:
        return _range(s, name, depth)
    s.fail(f"unknown function {name!r}")


def _inner_metric(s: _Scanner, depth: int) -> ast.Metric:
    out = _metric(s, depth + 1)
    return out if not isinstance(out, float) else s.fail("expected a metric")


def _grouping(s: _Scanner) -> ast.Grouping | None:
    kind = s.takes("by", "without")
    if not kind:
        return None
    s.needs("(")
    names = [s.name()]
    while s.takes(","):
        names.append(s.name())
    s.needs(")")
    return ast.Grouping(tuple(sorted(set(names))), kind == "without")


def _range(s: _Scanner, function: str, depth: int) -> ast.Range | ast.Subquery:
    s.needs("(")
    phi = None
    if function == "quantile_over_time":
        phi = float(s.match(_SCALAR) or s.fail("expected a quantile"))
        if not 0 <= phi <= 1:
            s.fail("a quantile lies between 0 and 1")
        s.needs(",")
    if not s.sees("{"):
        if function == "bytes_over_time":
            s.fail("bytes_over_time takes a log query")
        inner = _inner_metric(s, depth)
        s.needs("[")
        range_ns = s.duration()
        s.needs(":")
        step_ns = s.duration()
        s.needs("]")
        offset = _offset(s)
        s.needs(")")
        if range_ns <= 0 or step_ns <= 0:
            s.fail("a range and its step are to be positive")
        return ast.Subquery(function, inner, range_ns, step_ns, offset, phi)
    query, unwrap = _log_query(s), None
    if s.takes("|"):
        s.needs("unwrap")
        name = s.name()
        if s.takes("("):
            if name != "duration":
                s.fail(f"unknown conversion {name!r}")
            unwrap = ast.Unwrap(s.name(), True)
            s.needs(")")
        else:
            unwrap = ast.Unwrap(name)
    if (unwrap is not None) != (function in UNWRAPPED):
        s.fail(f"{function} takes {'an' if function in UNWRAPPED else 'no'} unwrap")
    s.needs("[")
    range_ns = s.duration()
    s.needs("]")
    offset = _offset(s)
    s.needs(")")
    if range_ns <= 0:
        s.fail("a range is to be positive")
    return ast.Range(function, query, range_ns, offset, unwrap, phi)


def _offset(s: _Scanner) -> int:
    return s.duration() if s.takes("offset") else 0


# ------------------------------------------------------------- back to text


def selector_text(matchers: tuple[ast.Matcher, ...]) -> str:
    quote = lambda v: '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'
    return "{" + ", ".join(f"{m.name}{m.op}{quote(m.value)}" for m in matchers) + "}"


def checked(text: str) -> str:
    """A valid query's text without space around it."""
    parse(text)
    return text.strip()
