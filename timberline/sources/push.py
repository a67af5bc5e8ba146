"""What agents send: label text, pushes as JSON or snappy-compressed protobuf, and OTLP exports in JSON."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from .tables import LOGS, MAP

PAIRS = "array<struct<key:string,value:string>>"

#: Label names that the storage keeps for itself.
RESERVED = ("_msg", "_tenant", "structured_metadata", "timestamp_ns")

_PAIR = re.compile(r'\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"\s*(,|\Z)', re.S)


class PushProblem(ValueError):
    """A push that cannot be taken."""


def parse_labels(text: str) -> dict[str, str]:
    """Labels of {a="b", ...}."""
    body = text.strip()
    if not (body.startswith("{") and body.endswith("}")):
        raise PushProblem(f"invalid labels {text!r}")
    body, out, at, more = body[1:-1].strip(), {}, 0, False
    while at < len(body) or more:
        m = _PAIR.match(body, at)
        if m is None or m[1] in out or m[1] in RESERVED:
            raise PushProblem(f"invalid labels {text!r}")
        out[m[1]] = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e[1], e[1]), m[2], flags=re.S)
        at, more = m.end(), m[3] == ","
    return out


def label_text(labels: dict[str, str]) -> str:
    quote = lambda v: v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
    return "{" + ", ".join(f'{k}="{quote(v)}"' for k, v in sorted(labels.items())) + "}"


# ----------------------------------------------------------------- JSON push

_PUSH = f"streams array<struct<stream:{MAP}, values:array<array<string>>>>"


def json_push(raw: DataFrame, body: str = "body") -> DataFrame:
    """Rows of the logs schema of pushes {"streams": [{"stream": {}, "values": [[ns, line, {}?]]}]} beside a tenant column."""
    s = raw.select("tenant", F.explode(F.from_json(F.col(body), _PUSH, {"mode": "FAILFAST"})["streams"]).alias("s"))
    v = s.select("tenant", F.col("s.stream").alias("labels"), F.explode("s.values").alias("v"))
    metadata = F.coalesce(F.from_json(F.get("v", F.lit(2)), MAP), F.from_json(F.lit("{}"), MAP))
    return v.select("tenant", F.get("v", F.lit(0)).cast("long").alias("ts_ns"), "labels", F.get("v", F.lit(1)).alias("line"), metadata.alias("metadata"))


# ------------------------------------------------------------- protobuf push


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise PushProblem("truncated number")
        byte = data[at]
        out |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return out, at


def _message(data: bytes):
    """(field number, value) of a protobuf message; bytes for lengths, numbers for others."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = int.from_bytes(data[at : at + n], "little"), at + n
        else:
            raise PushProblem(f"wire type {kind}")
        if at > len(data):
            raise PushProblem("truncated message")
        yield tag >> 3, value


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def decode_push(body: bytes) -> list[tuple[int, dict[str, str], str, list[tuple[str, str]]]]:
    """(ts_ns, labels, line, metadata pairs) of a snappy-compressed push."""
    try:
        size, _ = _varint(body, 0)
        raw = pa.decompress(body, decompressed_size=size, codec="snappy", asbytes=True)
        out = []
        for number, stream in _message(raw):
            if number != 1:
                continue
            parts = list(_message(stream))
            labels = parse_labels(next((v.decode() for n, v in parts if n == 1), "{}"))
            for _, entry in (p for p in parts if p[0] == 2):
                ts, line, metadata = 0, "", []
                for n, v in _message(entry):
                    if n == 1:
                        time = dict(_message(v))
                        ts = _signed(time.get(1, 0)) * 10**9 + _signed(time.get(2, 0))
                    elif n == 2:
                        line = v.decode()
                    elif n == 3:
                        pair = dict(_message(v))
                        metadata.append((pair.get(1, b"").decode(), pair.get(2, b"").decode()))
                out.append((ts, labels, line, metadata))
        return out
    except (pa.ArrowException, OSError, UnicodeDecodeError) as e:
        raise PushProblem(str(e)) from e


def proto_push(raw: DataFrame, body: str = "body") -> DataFrame:
    """Rows of the logs schema of snappy-compressed protobuf pushes beside a tenant column."""

    def run(batches):
        for b in batches:
            rows = [(t, ts, list(labels.items()), line, list(dict(reversed(meta)).items())) for t, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for ts, labels, line, meta in decode_push(data)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            m = pa.map_(pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], m), pa.array(cols[3], pa.string()), pa.array(cols[4], m)], ["tenant", "ts_ns", "labels", "line", "metadata"])

    return raw.select("tenant", body).mapInArrow(run, LOGS)


# ---------------------------------------------------------------------- OTLP

#: Resource attributes that become labels.
PROMOTED = (
    "cloud.availability_zone", "cloud.region", "container.name", "deployment.environment", "deployment.environment.name", "k8s.cluster.name",
    "k8s.container.name", "k8s.cronjob.name", "k8s.daemonset.name", "k8s.deployment.name", "k8s.job.name", "k8s.namespace.name", "k8s.pod.name",
    "k8s.replicaset.name", "k8s.statefulset.name", "service.instance.id", "service.name", "service.namespace",
)

_ANY = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:string,arrayValue:string,kvlistValue:string,bytesValue:string>"
_ATTRIBUTES = f"array<struct<key:string,value:{_ANY}>>"
_LOGS = f"resourceLogs array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeLogs:array<struct<scope:struct<name:string>,logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{_ANY},attributes:{_ATTRIBUTES},traceId:string,spanId:string>>>>>>"
_SPANS = f"resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTES}>,schemaUrl:string,scopeSpans:array<struct<scope:struct<name:string,version:string>,schemaUrl:string,spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRIBUTES},status:struct<code:int>>>>>>>"


def scalar(v: Column) -> Column:
    """A scalar value's text; null for others."""
    return F.coalesce(v["stringValue"], v["boolValue"].cast("string"), v["intValue"], v["doubleValue"])


def any_text(v: Column) -> Column:
    return F.coalesce(scalar(v), F.when(v.isNotNull(), F.to_json(v)))


def _pairs(attributes: Column, keep=lambda a: F.lit(True)) -> Column:
    return F.transform(F.filter(F.coalesce(attributes, F.array().cast(_ATTRIBUTES)), lambda a: a["value"].isNotNull() & keep(a)), lambda a: F.struct(a["key"].alias("key"), any_text(a["value"]).alias("value")))


def otlp_logs(raw: DataFrame, body: str = "body") -> DataFrame:
    """Rows of the logs schema of OTLP log exports, JSON text or protobuf bytes, beside a tenant column."""
    from .otlp_proto import bodies

    r = bodies(raw, body, "logs").select("tenant", F.explode(F.from_json(body, _LOGS)["resourceLogs"]).alias("r"))
    s = r.select("tenant", F.col("r.resource.attributes").alias("resource"), F.explode("r.scopeLogs").alias("s"))
    x = s.select("tenant", "resource", F.coalesce("s.scope.name", F.lit("")).alias("scope"), F.explode("s.logRecords").alias("x"))
    label = lambda a: a["key"].isin(list(PROMOTED)) & scalar(a["value"]).isNotNull()
    labels = F.map_from_entries(F.transform(_pairs(F.col("resource"), label), lambda p: F.struct(F.regexp_replace(p["key"], "[^A-Za-z0-9_]", "_").alias("key"), p["value"])))
    text = lambda name, v: F.when(v.isNotNull() & (v != ""), F.array(F.struct(F.lit(name).alias("key"), v.alias("value")))).otherwise(F.array().cast(PAIRS))
    number = F.when(F.coalesce(F.col("x.severityNumber"), F.lit(0)) != 0, F.col("x.severityNumber").cast("string"))
    metadata = F.concat(
        _pairs(F.col("resource"), lambda a: ~label(a)), text("scope_name", F.col("scope")), text("severity_text", F.col("x.severityText")), text("severity_number", number),
        text("trace_id", F.lower("x.traceId")), text("span_id", F.lower("x.spanId")), _pairs(F.col("x.attributes")),
    )
    at = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    ts = F.when(at("x.timeUnixNano") != 0, at("x.timeUnixNano")).otherwise(at("x.observedTimeUnixNano"))
    return x.select("tenant", ts.alias("ts_ns"), labels.alias("labels"), F.coalesce(any_text(F.col("x.body")), F.lit("")).alias("line"), L.first_of_pairs(metadata).alias("metadata"))


def otlp_spans(raw: DataFrame, body: str = "body") -> DataFrame:
    """Rows of the spans schema of OTLP trace exports, JSON text or protobuf bytes, beside a tenant column; an invalid span is an error."""
    from .otlp_proto import bodies

    r = bodies(raw, body, "spans").select("tenant", F.explode(F.from_json(body, _SPANS)["resourceSpans"]).alias("r"))
    s = r.select("tenant", F.col("r.resource.attributes").alias("resource"), F.coalesce("r.schemaUrl", F.lit("")).alias("url"), F.explode("r.scopeSpans").alias("s"))
    x = s.select("tenant", "resource", "url", "s.scope", F.coalesce("s.schemaUrl", F.lit("")).alias("scope_url"), F.explode("s.spans").alias("x"))
    none = F.lit("")
    parent = F.lower(F.coalesce("x.parentSpanId", none))
    scalars = lambda c: L.first_of_pairs(_pairs(F.col(c), lambda a: scalar(a["value"]).isNotNull()))
    opaque = F.transform(F.filter(F.coalesce("x.attributes", F.array().cast(_ATTRIBUTES)), lambda a: scalar(a["value"]).isNull()), lambda a: a["key"])
    df = x.select(
        "tenant", F.lower("x.traceId").alias("trace_id"), F.lower("x.spanId").alias("span_id"), parent.alias("parent_span_id"), F.coalesce("x.name", none).alias("name"),
        F.col("x.startTimeUnixNano").cast("long").alias("start_ns"), F.col("x.endTimeUnixNano").cast("long").alias("end_ns"), F.coalesce("x.kind", F.lit(0)).alias("kind"), F.coalesce("x.status.code", F.lit(0)).alias("status_code"),
        scalars("x.attributes").alias("attributes"), opaque.alias("opaque"), F.struct(scalars("resource").alias("attributes"), F.col("url").alias("schema_url")).alias("resource"),
        F.struct(F.coalesce("scope.name", none).alias("name"), F.coalesce("scope.version", none).alias("version"), F.col("scope_url").alias("schema_url")).alias("scope"),
    )
    id_ = lambda c, n: F.col(c).rlike(f"^[0-9a-f]{{{n}}}\\z") & ~F.col(c).rlike(r"^0+\z")
    valid = id_("trace_id", 32) & id_("span_id", 16) & ((F.col("parent_span_id") == "") | id_("parent_span_id", 16)) & (F.col("end_ns") >= F.col("start_ns"))
    return df.withColumn("trace_id", F.when(F.coalesce(valid, F.lit(False)), F.col("trace_id")).otherwise(F.raise_error(F.concat(F.lit("invalid span "), F.coalesce("span_id", none)))))
