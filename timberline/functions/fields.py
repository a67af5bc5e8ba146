"""The json and logfmt stages: fields of a line with names that the line itself chooses.

Such maps cannot be written as fixed expressions, so both stages are Arrow
functions; each gets the current field map, as names that are taken decide the
names of new fields.
"""

from __future__ import annotations

import json
import re
from collections.abc import Collection, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAP = T.MapType(T.StringType(), T.StringType())
#: The error field and its values.
ERROR = "__error__"
JSON_ERROR, LOGFMT_ERROR = "JSONParserErr", "LogfmtParserErr"

_BAD = re.compile("[^A-Za-z0-9_]")


class ParseProblem(ValueError):
    """A line that is not of the format."""


def clean_name(name: str) -> str:
    """A name that the query language can write."""
    name = _BAD.sub("_", name)
    return "_" if not name else f"_{name}" if name[0].isdigit() else name


def free_name(name: str, taken: Collection[str]) -> str:
    """The name itself; where that is taken with _extracted after it, and then with a number higher than any in use there."""
    other = f"{name}_extracted"
    for candidate in (name, other):
        if candidate not in taken:
            return candidate
    tails = (x[len(other) + 1 :] for x in taken if x.startswith(f"{other}_"))
    return f"{other}_{max([1, *(int(t) for t in tails if t.isascii() and t.isdigit())]) + 1}"


def _put(fields: dict[str, str], name: str, value: str) -> str:
    name = free_name(name, fields)
    fields[name] = value
    return name


class _Number(str):
    """A number as it was written."""


def _refuse(name: str):
    raise ParseProblem(name)


def _leaves(path: str, value) -> Iterator[tuple[str, str]]:
    todo = [(path, value)]
    while todo:
        path, value = todo.pop()
        under = f"{path}_" if path else ""
        if isinstance(value, dict):
            todo += [(under + clean_name(k), value[k]) for k in sorted(value, key=lambda k: k.encode("utf-8", "surrogatepass"), reverse=True)]
        elif isinstance(value, list):
            todo += [(f"{under}{i}", x) for i, x in reversed(list(enumerate(value)))]
        else:
            yield path, "" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)


_DECODER = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_refuse)


def json_fields(line: str) -> dict[str, str]:
    """Names and texts of all values of an object or array."""
    try:
        body = line.strip(" \t\n\r")
        value, end = _DECODER.raw_decode(body)
        if end != len(body) or not isinstance(value, dict | list):
            raise ParseProblem(line)
    except (ValueError, RecursionError) as e:
        raise ParseProblem(line) from e
    fields: dict[str, str] = {}
    for path, text in _leaves("", value):
        _put(fields, path, text)
    return fields


_PAIR = re.compile(r'[ \t\n\x0c\r]*(?:([^ \t\n\x0c\r=]+)=(?:"((?:[^"\\]|\\.)*)"(?=[ \t\n\x0c\r]|\Z)|((?!")[^ \t\n\x0c\r]*))|\Z)', re.S)
_ESCAPE = re.compile(r'\\(?:x(.{2})|u(.{4})|U(.{8})|([0-7].{2})|(.))', re.S)
#: Escapes of one letter.
_LETTERS = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", '"': '"', "\\": "\\"}
_HEX, _OCTAL = re.compile("[+]?[0-9a-fA-F]+"), re.compile("[+]?[0-7]+")


def _unescape(m: re.Match) -> str:
    if m[5] is not None:
        if m[5] not in _LETTERS:
            raise ParseProblem(m[0])
        return _LETTERS[m[5]]
    text, kind, base = (m[4], _OCTAL, 8) if m[4] is not None else (m[1] or m[2] or m[3], _HEX, 16)
    if not kind.fullmatch(text):
        raise ParseProblem(m[0])
    code = int(text, base)
    if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF or ((m[1] or m[4]) and code > 255):
        raise ParseProblem(m[0])
    return chr(code)


def logfmt_fields(line: str) -> dict[str, str]:
    """Names and values of key=value pairs; of a key that comes again the last value stays."""
    fields, stored, at = {}, {}, 0
    while at < len(line):
        m = _PAIR.match(line, at)
        if m is None:
            raise ParseProblem(line)
        at = m.end()
        if m[1] is None:
            break
        value = m[3] if m[2] is None else _ESCAPE.sub(_unescape, m[2]) if "\\" in m[2] else m[2]
        if m[1] in stored:
            fields[stored[m[1]]] = value
        else:
            stored[m[1]] = _put(fields, clean_name(m[1]), value)
    return fields


def _stage(parse, error: str):
    def run(line: str | None, fields: dict[str, str] | None) -> dict[str, str]:
        fields = dict(fields or {})
        try:
            found = parse(line or "")
        except ParseProblem:
            fields[ERROR] = error
            return fields
        for name in sorted(found, key=lambda k: k.encode("utf-8", "surrogatepass")):
            _put(fields, name, found[name])
        return fields

    return run


extract_json, extract_logfmt = _stage(json_fields, JSON_ERROR), _stage(logfmt_fields, LOGFMT_ERROR)


def json_stage(line: Column, fields: Column) -> Column:
    return F.udf(extract_json, MAP, useArrow=True)(line, fields)


def logfmt_stage(line: Column, fields: Column) -> Column:
    return F.udf(extract_logfmt, MAP, useArrow=True)(line, fields)
