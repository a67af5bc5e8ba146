import json
import os
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timberline import queries
from timberline.engine import Engine
from timberline.functions import labels as L
from timberline.operators import discovery, maintenance, masks, ranges, traces
from timberline.operators.policies import Deletes, Policies, authorized
from timberline.plans.parser import QueryProblem, parse
from timberline.sources import otlp_proto, push, tables
from timberline.sources.versions import Conflict, Document

S = 10**9
SF = "/root/testdata/sf0.01"


def logs(spark, rows):
    return spark.createDataFrame([("t", ts, lab, line, meta) for ts, lab, line, meta in rows], tables.LOGS)


def vector(df):
    return {(tuple((x.key, x.value) for x in r.series), r.k): r.value for r in df.collect()}


def test_window_is_open_left_and_closed_right(spark):
    e = Engine(logs(spark, [(ts * S, {"app": a}, "x", {}) for a, times in (("a", (5, 6, 10)), ("b", (8, 13, 14))) for ts in times]))
    v, _ = e.metric_query("t", "topk(1, count_over_time({}[5s]))", 10 * S, 15 * S, 5 * S)
    assert vector(v) == {((("app", "a"),), 0): 2.0, ((("app", "b"),), 1): 2.0}
    assert vector(e.metric_query("t", "count_over_time({}[5s])", 10 * S, 10 * S, S)[0]) == {((("app", "a"),), 0): 2.0, ((("app", "b"),), 0): 1.0}


def test_unwrap_functions(spark):
    e = Engine(logs(spark, [(i * S, {"app": "u"}, "x", {"latency": v}) for i, v in enumerate(("10", "20", "60", "slow", "NaN", "inf"), 1)]))
    at = lambda q: list(vector(e.instant_query("t", q, 10 * S)).values())
    for f, want in (("sum", 90), ("avg", 30), ("min", 10), ("max", 60)):
        assert at(f"{f}_over_time({{}} | unwrap latency [10s])") == [want]
    e = Engine(logs(spark, [(i * S, {"app": "u"}, "x", {"latency": str(v)}) for i, v in enumerate((0, 10, 20, 30), 1)]))
    assert at("quantile_over_time(0.5, {} | unwrap latency [10s])") == [15] and at("quantile_over_time(1, {} | unwrap latency [10s])") == [30]


def test_offset_moves_both_edges(spark):
    e = Engine(logs(spark, [(1 * S, {"app": "u"}, "x", {"v": "10"}), (61 * S, {"app": "u"}, "x", {"v": "99"})]))
    assert list(vector(e.instant_query("t", "sum_over_time({} | unwrap v [5s] offset 60s)", 62 * S)).values()) == [10]


def test_subquery(spark):
    e = Engine(logs(spark, [(int(x * S), {"app": "s"}, "x", {}) for x in (1.5, 1.6, 1.7, 9.5)]))
    at = lambda q: list(vector(e.instant_query("t", q, 12 * S)).values())
    assert at("max_over_time(count_over_time({}[1s])[12s:1s])") == [3] and at("min_over_time(count_over_time({}[1s])[12s:1s])") == [1]
    assert at("max_over_time(count_over_time({}[1s])[1s:2s])") == []


def test_panes_equal_plain_windows(spark):
    rows = [((i * 7919) % 100_000_000_000, {"app": str(i % 3)}, "x" * (i % 5), {"v": str(i % 11)}) for i in range(1, 400)]
    df = logs(spark, [(ts * 1, a, b, c) for ts, a, b, c in rows])
    for q in ("count_over_time({}[20s])", "avg_over_time({} | unwrap v [20s])", "min_over_time({} | unwrap v [20s] offset 3s)", "bytes_over_time({}[20s])"):
        m = parse(q)
        panes = vector(ranges.metric(df, m, ranges.Grid.between(10 * S, 90 * S, 5 * S)))
        for k in range(17):
            for (series, _), v in vector(ranges.metric(df, m, ranges.Grid.instant((10 + 5 * k) * S))).items():
                assert panes[series, k] == pytest.approx(v)


def test_missing_labels(spark):
    df = logs(spark, [(S, {"a": "1"}, "x", {}), (2 * S, {"a": "1", "b": "2"}, "x", {}), (3 * S, {"a": "1", "b": ""}, "x", {})])
    e = Engine(df)
    assert e.log_query("t", '{b=""}', 0, 9 * S).count() == 2 and e.log_query("t", '{b!=""}', 0, 9 * S).count() == 1
    got = vector(e.instant_query("t", "sum by (b) (count_over_time({}[9s]))", 9 * S))
    assert {k[0] for k in got} == {(), (("b", "2"),), (("b", ""),)}


def test_label_format_swaps_and_does_not_rename_streams(spark):
    e = Engine(logs(spark, [(S, {"app": "x"}, "l", {"a": "1", "b": "2"})]))
    r = e.log_query("t", '{} | label_format a=b, b=a, app="new" | line_format "{{.app}}{{.a}}{{.b}}"', 0, 9 * S).first()
    assert r.line == "new21" and r.labels == {"app": "x"} and r.metadata == {"a": "2", "b": "1"}


def test_division_by_zero_is_ieee(spark):
    e = Engine(logs(spark, [(S, {"app": "x"}, "l", {"v": v}) for v in ("0", "0")]))
    at = lambda q: list(vector(e.instant_query("t", q, 2 * S)).values())[0]
    assert at("count_over_time({}[5s]) / 0") == float("inf") and at("0 - count_over_time({}[5s]) / 0") == float("-inf")
    assert str(at("sum_over_time({} | unwrap v [5s]) / 0")) == "nan" and str(at("count_over_time({}[5s]) % 0")) == "nan"
    assert at("100 < count_over_time({}[5s]) * 100") == 100 and at("-5.5 - count_over_time({}[5s])") == -7.5


def test_limits_and_direction(spark):
    e = Engine(logs(spark, [(i * S, {"app": str(i % 2)}, str(i), {}) for i in range(10)]))
    assert [r.line for r in e.log_query("t", "{}", 2 * S, 7 * S, 3).collect()] == ["7", "6", "5"]
    assert [r.line for r in e.log_query("t", "{}", 2 * S, 7 * S, 3, "FORWARD").collect()] == ["2", "3", "4"]
    assert e.log_query("t", "{}", 0, 9 * S, 0).count() == 0 and e.log_query("other", "{}", 0, 9 * S).count() == 0
    for bad in (dict(limit=-1), dict(limit=100_001), dict(direction="up")):
        with pytest.raises(QueryProblem):
            e.log_query("t", "{}", 0, S, **bad)
    with pytest.raises(ranges.GridProblem):
        e.metric_query("t", "rate({}[1s])", 0, 10_001 * S, S)


def test_json_results(spark):
    e = Engine(logs(spark, [(S, {"app": "x"}, "l", {"a": "1"}), (2 * S, {"app": "x"}, "m", {})]))
    assert e.query_range_json("t", "{}", 0, 9 * S) == {"resultType": "streams", "result": [{"stream": {"app": "x"}, "values": [["2000000000", "m"], ["1000000000", "l", {"a": "1"}]]}]}
    assert e.query_range_json("t", "rate({}[2s])", 2 * S, 3 * S) == {"resultType": "matrix", "result": [{"metric": {"app": "x"}, "values": [["2", "1"], ["3", "0.5"]]}]}
    assert e.query_json("t", "count_over_time({}[2s])", 2 * S)["result"] == [{"metric": {"app": "x"}, "value": ["2", "2"]}]


def test_patterns(spark):
    lines = [f"user {i} logged in from host alpha" for i in range(20)] + ["constant line"] * 5
    df = logs(spark, [(i * S, {"app": "p"}, line, {}) for i, line in enumerate(lines)])
    got = Engine(df).patterns("t", "{}", 0, 100 * S, 1000 * S).collect()
    assert [(r.pattern, r.n) for r in got] == [("user <_> logged in from host alpha", 20), ("constant line", 5)]
    assert discovery.patterns(df.limit(0), parse("{}"), 0, S).count() == 0


def test_pattern_tokens_of_every_row_match_brute_force(spark, tmp_path):
    space = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
    texts = ["plain text 1", "", None, " é 日本語 x9 ", space, "a\u200bb \x1cc \ufeffd", *(f"a{c}b{c}{c}é7{c}" for c in space)]
    spark.createDataFrame([(i, i % 3, x) for i, x in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    brute = lambda x: None if x is None else " ".join("<_>" if re.search("[0-9]", w) else w for w in re.split(f"[{space}]+", x) if w)
    got = queries.queries()["pattern_tokens"](spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.turn, r.template) for r in got) == [(i, i % 3, brute(x)) for i, x in enumerate(texts)]


def test_deletes_and_retention(spark):
    d = Deletes()
    one = d.submit("t", '{app="drop"} |= "x"', 2 * S, 4 * S, 9 * S)
    for bad in ("{}", "rate({}[1m])", '{a="b"} | json'):
        with pytest.raises(QueryProblem):
            d.submit("t", bad, 0, S, S)
    with pytest.raises(ValueError):
        d.submit("t", '{a="b"}', 5, 5, 5)
    df = logs(spark, [(i * S, {"app": a}, "x", {}) for i in (1, 2, 3, 4) for a in ("keep", "drop")])
    e = Engine(df, deletes=d)
    seen = {(r.ts_ns // S, r.labels["app"]) for r in e.log_query("t", "{}", 0, 9 * S).collect()}
    assert seen == {(i, a) for i in (1, 2, 3, 4) for a in ("keep", "drop")} - {(2, "drop"), (3, "drop")}
    assert d.cancel("t", one.request_id) and not d.list("t") and not d.cancel("t", one.request_id)
    for retention, want in (("infinite", 8), ("2s", 4), ("0", 0)):
        e = Engine(df, policies=Policies([("t", retention, None, None, None, 0)]), now_ns=5 * S)
        assert e.log_query("t", "{}", 0, 9 * S).count() == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_delete_mask_returns_the_whole_window(spark):
    from timberline.queries import END, FROM, HOUR, START, TENANT, TO

    rows = [(r.ts_ns, r.line, r.labels.get("event_type")) for r in tables.event_logs(spark, SF).where(F.col("tenant") == TENANT).collect() if START <= r.ts_ns <= END]
    a = {x for x in rows if x[2] == "click" and FROM <= x[0] < FROM + 100 * HOUR}
    b = {x for x in rows if "7" in x[1] and FROM + 50 * HOUR <= x[0] < TO}
    got = queries.queries()["delete_mask"](spark, SF).collect()
    assert a - b and sorted((r.ts_ns, r.line) for r in got) == sorted(x[:2] for x in rows if x not in a | b)


def test_table_round_trip_compaction_and_pruning(spark, tmp_path):
    day = tables.DAY_NS
    df = logs(spark, [(i * day // 2 - day, {"app": "a"}, f"l{i % 3}", {"k": "v"}) for i in range(10)])
    tables.write_logs(df.unionByName(df), str(tmp_path / "a"))
    back = tables.read(spark, str(tmp_path / "a"), tables.LOGS)
    assert back.count() == 10 and back.select("day").distinct().count() == 5
    assert {str(r.day) for r in back.where("ts_ns < 0").collect()} == {"1969-12-31"}
    plan = masks.scan(back, "t", day, 2 * day)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters" in plan
    p = Policies([("t", "1d", None, None, None, 0)])
    maintenance.rewrite(spark, str(tmp_path / "a"), str(tmp_path / "b"), p, 3 * day, [masks.Delete("x", "t", '{app="a"} |= "l0"', 0, 9 * day)])
    kept = tables.read(spark, str(tmp_path / "b"), tables.LOGS)
    assert kept.where(f"ts_ns < {2 * day}").count() == 0 and kept.where("line = 'l0'").count() == 0 and kept.count() == 2
    actions = {str(r.day): r.action for r in maintenance.expired_days(back, p, 3 * day).collect()}
    assert actions["1969-12-31"] == "drop" and actions["1970-01-03"] == "keep"


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def test_pushes(spark):
    body = {"streams": [{"stream": {"a": "b"}, "values": [["5", "x"], ["6", "y", {"k": "v"}]]}]}
    rows = push.json_push(spark.createDataFrame([("t", json.dumps(body))], "tenant string, body string")).orderBy("ts_ns").collect()
    assert [(r.ts_ns, r.labels, r.line, r.metadata) for r in rows] == [(5, {"a": "b"}, "x", {}), (6, {"a": "b"}, "y", {"k": "v"})]
    entry = _field(1, _field(1, 7) + _field(2, 9)) + _field(2, b"line") + _field(3, _field(1, b"k") + _field(2, b"1")) + _field(3, _field(1, b"k") + _field(2, b"2"))
    raw = _field(1, _field(1, b'{a="b"}') + _field(2, entry))
    packed = pa.compress(raw, codec="snappy", asbytes=True)
    r = push.proto_push(spark.createDataFrame([("t", packed)], "tenant string, body binary")).first()
    assert (r.ts_ns, r.labels, r.line, r.metadata) == (7 * S + 9, {"a": "b"}, "line", {"k": "1"})
    for bad in (b"", b"\x05abc", pa.compress(b"\x0a\x50", codec="snappy", asbytes=True)):
        with pytest.raises(push.PushProblem):
            push.decode_push(bad)


def test_label_text():
    assert push.parse_labels('{a="b", c="d\\"\\n"}') == {"a": "b", "c": 'd"\n'} and push.parse_labels("{}") == {}
    assert push.parse_labels(push.label_text({"x": 'q"\\\n'})) == {"x": 'q"\\\n'}
    for bad in ("a", '{a="b",}', '{a="b" c="d"}', '{a="1",a="2"}', '{_msg="x"}', "{a=b}"):
        with pytest.raises(push.PushProblem):
            push.parse_labels(bad)


def test_otlp(spark):
    value = lambda **k: k
    attrs = [{"key": "service.name", "value": value(stringValue="s")}, {"key": "host.name", "value": value(stringValue="h")}, {"key": "k8s.pod.name", "value": value(arrayValue={"values": []})}]
    record = {"timeUnixNano": "0", "observedTimeUnixNano": "42", "severityNumber": 9, "severityText": "INFO", "body": value(kvlistValue={"values": []}), "attributes": [{"key": "n", "value": value(intValue="5")}, {"key": "host.name", "value": value(stringValue="late")}], "traceId": "AB" * 16}
    body = {"resourceLogs": [{"resource": {"attributes": attrs}, "scopeLogs": [{"scope": {"name": "sc"}, "logRecords": [record]}]}]}
    r = push.otlp_logs(spark.createDataFrame([("t", json.dumps(body))], "tenant string, body string")).first()
    assert r.ts_ns == 42 and r.labels == {"service_name": "s"} and "kvlistValue" in r.line
    assert {k: r.metadata[k] for k in ("host.name", "scope_name", "severity_text", "severity_number", "trace_id", "n")} == {"host.name": "h", "scope_name": "sc", "severity_text": "INFO", "severity_number": "9", "trace_id": "ab" * 16, "n": "5"}
    span = {"traceId": "0A" * 16, "spanId": "0b" * 8, "name": "op", "startTimeUnixNano": "100", "endTimeUnixNano": "650", "attributes": [{"key": "http.route", "value": value(stringValue="/x")}, {"key": "service.version", "value": value(arrayValue={})}], "status": {"code": 2}}
    body = {"resourceSpans": [{"resource": {"attributes": [*attrs[:1], {"key": "service.version", "value": value(stringValue="1")}]}, "scopeSpans": [{"spans": [span]}]}]}
    raw = lambda b: spark.createDataFrame([("t", json.dumps(b))], "tenant string, body string")
    s = push.otlp_spans(raw(body))
    r = traces.search(s, traces.parse_tags("{http.route=/x, status=ERROR duration=550ns}")).first()
    assert (r.trace_id, r.root_name, r.root_service, r.duration_ns) == ("0a" * 16, "op", "s", 550)
    assert traces.tag_values(s, "service.version").count() == 0  # a value that is no scalar hides the resource's
    for change in (dict(traceId="00" * 16), dict(endTimeUnixNano="99"), dict(spanId="xy")):
        span2 = span | change
        body["resourceSpans"][0]["scopeSpans"][0]["spans"] = [span2]
        with pytest.raises(Exception, match="invalid span"):
            push.otlp_spans(raw(body)).collect()


def _any(**v):
    (kind, x), = v.items()
    return {"s": lambda: _field(1, x.encode()), "b": lambda: _field(2, int(x)), "i": lambda: _field(3, x % 2**64), "d": lambda: _varint(4 << 3 | 1) + struct.pack("<d", x), "l": lambda: _field(5, b"".join(_field(1, y) for y in x)), "raw": lambda: _field(7, x)}[kind]()


def _pair(key, **v):
    return _field(1, key.encode()) + _field(2, _any(**v))


def _fixed(number, value):
    return _varint(number << 3 | 1) + struct.pack("<Q", value)


def test_otlp_protobuf(spark):
    attrs = [_pair("service.name", s="s"), _pair("host.name", s="h"), _pair("n", i=-5), _pair("d", d=1.5), _pair("one", d=1.0), _pair("yes", b=True), _pair("list", l=[_any(s="x")])]
    resource = _field(1, b"".join(_field(1, a) for a in attrs))
    record = _fixed(11, 42) + _field(2, 9) + _field(3, b"INFO") + _field(5, _any(s="old") + _any(s="body é")) + _field(9, b"\xab" * 16) + _field(6, _pair("k", s="v")) + _field(99, b"unknown")
    logs_body = _field(1, resource + _field(2, _field(1, _field(1, b"sc")) + _field(2, record)))
    binary = lambda b: spark.createDataFrame([("t", b)], "tenant string, body binary")
    r = push.otlp_logs(binary(logs_body)).first()
    assert (r.tenant, r.ts_ns, r.labels, r.line) == ("t", 42, {"service_name": "s"}, "body é")
    want = {"host.name": "h", "n": "-5", "d": "1.5", "one": "1", "yes": "true", "scope_name": "sc", "severity_text": "INFO", "severity_number": "9", "trace_id": "ab" * 16, "k": "v"}
    assert {k: r.metadata[k] for k in want} == want and "stringValue" in r.metadata["list"] and "span_id" not in r.metadata
    span = _field(1, b"\x0a" * 16) + _field(2, b"\x0b" * 8) + _field(5, b"op") + _fixed(7, 100) + _fixed(8, 650) + _field(15, _field(3, 2)) + _field(9, _pair("x", s="1"))
    spans_body = lambda x: _field(1, resource + _field(2, _field(2, x)))
    s = push.otlp_spans(binary(spans_body(span))).first()
    assert (s.trace_id, s.span_id, s.parent_span_id, s.name, s.start_ns, s.end_ns, s.status_code, s.attributes, s.resource.attributes["n"]) == ("0a" * 16, "0b" * 8, "", "op", 100, 650, 2, {"x": "1"}, "-5")
    assert push.otlp_spans(binary(b"")).count() == 0 and push.otlp_logs(binary(None)).count() == 0
    with pytest.raises(Exception, match="invalid span"):
        push.otlp_spans(binary(spans_body(_field(5, b"no ids")))).collect()
    deep = _any(s="x")
    for _ in range(200):
        deep = _any(l=[deep])
    for bad in (b"\x0a\x50", _field(1, 5), _field(1, _field(1, _field(1, _field(1, b"\xff")))), _field(1, _field(2, _field(2, _field(5, deep))))):
        with pytest.raises(push.PushProblem):
            otlp_proto.as_json(bad, "logs")


def test_policies_and_deletes_are_kept(spark, tmp_path):
    at, requests = Document(spark, str(tmp_path / "p")), Document(spark, str(tmp_path / "d"))
    a, b = Policies.load(at), Policies.load(at)
    a.put("t", "7d", 1, 2, 3, 4)
    a.save(at)
    b.put("u", "1d")
    with pytest.raises(Conflict):
        b.save(at)
    assert Policies.load(at).rows == {"t": ("t", "7d", 1, 2, 3, 4)} and Policies.load(at).floor("t", 8 * 86_400 * S) == 86_400 * S
    d = Deletes.load(requests)
    one = d.submit("t", '{a="b"}', 0, 5, 9)
    d.save(requests)
    d.processed({one.request_id})
    d.save(requests)
    again = Deletes.load(requests)
    assert again.rows == d.rows and again.list("t")[0].status == masks.PROCESSED
    assert authorized("Bearer x", "x") and not authorized("Bearer y", "x") and not authorized(None, "x") and not authorized("Bearer ", "") and not authorized("Bearer None", None)


def test_trace_search(spark):
    base = dict(tenant="t", kind=1, status_code=0, opaque=[], scope=("", "", ""))
    make = lambda t, s, p, a, b, n, at: (base["tenant"], t, s, p, n, a, b, 1, 0, at, [], ({"service.name": "svc"}, ""), base["scope"])
    spans = spark.createDataFrame([make("a", "2", "1", 50, 400, "child", {"x": "1"}), make("a", "1", "", 100, 250, "root", {"y": "2"}), make("b", "3", "9", 600, 700, "lost", {})], tables.SPANS)
    r = traces.search(spans, [("x", "1"), ("y", "2")]).collect()
    assert [(x.trace_id, x.root_name, x.start_ns, x.duration_ns, x.spans) for x in r] == [("a", "root", 50, 350, 2)]
    assert [x.trace_id for x in traces.search(spans, max_ns=100).collect()] == ["b"] and traces.search(spans, min_ns=350).count() == 1
    assert traces.scan(spans, "t", 400, 600).count() == 2 and traces.scan(spans, "t", 401, 599).count() == 0
    with pytest.raises(traces.TagProblem):
        traces.search(spans, limit=0)
    with pytest.raises(traces.TagProblem):
        traces.parse_tags('a="x')
    assert traces.parse_tags('{a=b, c="d e" f=}') == [("a", "b"), ("c", "d e"), ("f", "")]


def test_first_of_pairs(spark):
    df = spark.sql("SELECT array(named_struct('key', 'a', 'value', '1'), named_struct('key', 'b', 'value', '2'), named_struct('key', 'a', 'value', '3')) AS p")
    assert df.select(L.first_of_pairs(F.col("p")).alias("m")).first().m == {"a": "1", "b": "2"}


@pytest.mark.parametrize("range_s, step_s, offset_s", [(12, 6, 0), (7, 5, 0), (9, 6, 4), (5, 7, 1), (6, 6, 0), (1000, 7, 3), (131, 130, 0)])
def test_windows_by_panes_against_brute_force(spark, range_s, step_s, offset_s):
    rng = __import__("random").Random(range_s)
    rows = [(rng.randrange(0, 300 * S) if i % 3 else rng.randrange(300) * S, rng.choice("ab"), rng.randrange(5)) for i in range(200)]
    e = Engine(logs(spark, [(ts, {"app": a}, str(i), {"x": str(x)}) for i, (ts, a, x) in enumerate(rows)]))
    start, end = 20 * S, 280 * S
    for f, of in (("count", len), ("avg", lambda v: sum(v) / len(v)), ("min", min), ("max", max), ("quantile", lambda v: float(np.quantile(v, 0.3)))):
        text = "count_over_time({}[%ds] offset %ds)" if f == "count" else f"{f}_over_time({'0.3, ' if f == 'quantile' else ''}{{}} | unwrap x [%ds] offset %ds)"
        got, want = vector(e.metric_query("t", text % (range_s, offset_s), start, end, step_s * S)[0]), {}
        for k, t in enumerate(range(start, end + 1, step_s * S)):
            for app in "ab":
                if v := [x for ts, a, x in rows if a == app and t - (offset_s + range_s) * S < ts <= t - offset_s * S]:
                    want[((("app", app),), k)] = pytest.approx(of(v))
        assert got == want
