"""OTLP exports in protobuf, as the JSON form of the same protocol."""

from __future__ import annotations

import base64
import json
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.values import sample_text
from .push import PushProblem, _message, _signed

#: The protocol's messages, by number the name and kind of each field; a star marks repeated ones.
_ATTRIBUTES = ("attributes", "*pair")
MESSAGES = {
    "logs": {1: ("resourceLogs", "*resource logs")},
    "resource logs": {1: ("resource", "resource"), 2: ("scopeLogs", "*scope logs"), 3: ("schemaUrl", "text")},
    "scope logs": {1: ("scope", "scope"), 2: ("logRecords", "*record"), 3: ("schemaUrl", "text")},
    "record": {
        1: ("timeUnixNano", "long"), 2: ("severityNumber", "int"), 3: ("severityText", "text"), 5: ("body", "any"), 6: _ATTRIBUTES,
        9: ("traceId", "hex"), 10: ("spanId", "hex"), 11: ("observedTimeUnixNano", "long"),
    },
    "spans": {1: ("resourceSpans", "*resource spans")},
    "resource spans": {1: ("resource", "resource"), 2: ("scopeSpans", "*scope spans"), 3: ("schemaUrl", "text")},
    "scope spans": {1: ("scope", "scope"), 2: ("spans", "*span"), 3: ("schemaUrl", "text")},
    "span": {
        1: ("traceId", "hex"), 2: ("spanId", "hex"), 4: ("parentSpanId", "hex"), 5: ("name", "text"), 6: ("kind", "int"),
        7: ("startTimeUnixNano", "long"), 8: ("endTimeUnixNano", "long"), 9: _ATTRIBUTES, 15: ("status", "status"),
    },
    "status": {2: ("message", "text"), 3: ("code", "int")},
    "resource": {1: _ATTRIBUTES},
    "scope": {1: ("name", "text"), 2: ("version", "text"), 3: _ATTRIBUTES},
    "pair": {1: ("key", "text"), 2: ("value", "any")},
    "any": {
        1: ("stringValue", "text"), 2: ("boolValue", "bool"), 3: ("intValue", "signed"), 4: ("doubleValue", "double"),
        5: ("arrayValue", "array"), 6: ("kvlistValue", "list"), 7: ("bytesValue", "base64"),
    },
    "array": {1: ("values", "*any")},
    "list": {1: ("values", "*pair")},
}
#: Fixed value: how deep messages may nest.
MAX_DEPTH = 100

_OF_BYTES = {"text": bytes.decode, "hex": bytes.hex, "base64": lambda b: base64.b64encode(b).decode()}
_OF_NUMBER = {
    "long": str,
    "int": _signed,
    "signed": lambda x: str(_signed(x)),
    "bool": bool,
    "double": lambda x: sample_text(struct.unpack("<d", x.to_bytes(8, "little"))[0]),
}
#: What a field that is not sent stands for; fields of a choice stand for nothing.
_ABSENT = {"text": "", "hex": "", "long": "0", "int": 0}


def decode(data: bytes, message: str, depth: int = 0) -> dict:
    """A message as its JSON form; parts of a single message that is sent in several pieces are one."""
    if depth > MAX_DEPTH:
        raise PushProblem("messages nest too deep")
    fields, out, parts = MESSAGES[message], {}, {}
    for number, value in _message(data):
        if number not in fields:
            continue
        name, kind = fields[number]
        of = kind.removeprefix("*")
        if isinstance(value, bytes) == (of in _OF_NUMBER):
            raise PushProblem(f"wire type of {name}")
        if message == "any":  # a choice: the last one sent counts
            out, parts = {}, {name: parts[name]} if name in parts else {}
        if kind != of:
            out.setdefault(name, []).append(decode(value, of, depth + 1))
        elif kind in MESSAGES:
            parts[name] = parts.get(name, b"") + value
        else:
            out[name] = (_OF_NUMBER.get(kind) or _OF_BYTES[kind])(value)
    kinds = dict(fields.values())
    out |= {name: decode(value, kinds[name], depth + 1) for name, value in parts.items()}
    absent = {} if message == "any" else {name: _ABSENT[kind] for name, kind in kinds.items() if kind in _ABSENT}
    return absent | out


def as_json(body: bytes, message: str) -> str:
    try:
        return json.dumps(decode(body, message))
    except (UnicodeDecodeError, OverflowError, struct.error) as e:
        raise PushProblem(str(e)) from e


def bodies(raw: DataFrame, body: str, message: str) -> DataFrame:
    """tenant and body as JSON: bodies of bytes are protobuf, others are JSON already."""
    if not isinstance(raw.schema[body].dataType, T.BinaryType):
        return raw.select("tenant", body)

    def run(batches):
        for b in batches:
            texts = [None if x is None else as_json(x, message) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["tenant", body])

    return raw.select("tenant", body).mapInArrow(run, f"tenant string, `{body}` string")
