import math
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timberline.functions import values as V
from timberline.functions.fields import JSON_ERROR, LOGFMT_ERROR, ParseProblem, clean_name, extract_json, extract_logfmt, json_fields, logfmt_fields
from timberline.functions.regex import RegexProblem, anchored, unanchored

DURATIONS = {"1s": 10**9, "1h30m": 5400 * 10**9, "1.5ms": 1_500_000, ".5s": 500_000_000, "1.s": 10**9, "0.1ns": 0, "2µs": 2000, "1w2d": 9 * 86400 * 10**9, "5us": 5000}
NO_DURATIONS = ["", "5", "s", "1.2.3s", ".s", "1s ", "-1s", "1 s", "1y", "99999999999w"]


@pytest.mark.parametrize("text,ns", DURATIONS.items())
def test_durations(text, ns):
    assert V.duration(text) == ns


@pytest.mark.parametrize("text", [x for x in NO_DURATIONS if x != "1s "])
def test_no_durations(text):
    with pytest.raises(V.ValueProblem):
        V.duration(text)


def test_durations_in_columns(spark):
    texts = [*DURATIONS, *NO_DURATIONS, None, " 1s "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.duration_ns(F.col("t")).alias("ns")).collect()
    for r in rows:
        try:
            want = None if r.t is None else V.duration(r.t)
        except V.ValueProblem:
            want = None
        assert r.ns == want, r.t


NUMBERS = ["0", "-0", "5", "+5", "-5.50", "1e3", "1E-3", ".5", "5.", "00012", "123456789012345678901234567890", "1e400", "-1e400", "NaN", "inf", "", " 7 ", "1e", "0x10", "1_0", "9" * 40, "1e2000", "42.000"]


@pytest.mark.parametrize("literal", ["0", "5", "-5.5", "1e3", "0.001", "42", "123456789012345678901234567891"])
def test_decimals_in_columns(spark, literal):
    rows = spark.createDataFrame([(t,) for t in NUMBERS], "t string").select("t", V.decimal_compare(F.col("t"), literal).alias("c")).collect()
    for r in rows:
        try:
            x, y = V.decimal(r.t), V.decimal(literal)
            want = (x > y) - (x < y)
        except V.ValueProblem:
            want = None
        assert r.c == want, (r.t, literal)


@settings(max_examples=200, deadline=None)
@given(st.decimals(allow_nan=False, allow_infinity=False, places=6, min_value=-(10**12), max_value=10**12))
def test_canonical_numbers(x):
    sign, magnitude, digits = V.canonical(str(x))
    assert sign * (Decimal(f"0.{digits or 0}") * Decimal(10) ** magnitude) == x


def test_timestamps():
    assert V.timestamp("1700000000") == 1700000000 * 10**9
    assert V.timestamp("1700000000123") == 1700000000123 * 10**6
    assert V.timestamp("1700000000123456789") == 1700000000123456789
    assert V.timestamp("1700000000.5") == 1700000000 * 10**9 + 5 * 10**8
    assert V.timestamp("2024-01-01T00:00:00.000000001Z") == 1704067200 * 10**9 + 1
    assert V.timestamp("2024-01-01T01:00:00+01:00") == 1704067200 * 10**9
    for bad in ("17000000001", "x", "1.0000000001", "2024-13-01T00:00:00Z"):
        with pytest.raises(V.ValueProblem):
            V.timestamp(bad)


def test_steps_and_trace_durations():
    assert V.step(None) == 10**9 and V.step("0.5") == 5 * 10**8 and V.step("5m") == 300 * 10**9
    with pytest.raises(V.ValueProblem):
        V.step("0")
    assert V.trace_duration("2") == 2 * 10**9 and V.trace_duration("20ms") == 20 * 10**6
    with pytest.raises(V.ValueProblem):
        V.trace_duration("-2")


def test_output_texts():
    assert [V.sample_text(x) for x in (0.0, -0.0, 1.0, 1e7, 0.1, 1e-7, math.inf, -math.inf, math.nan)] == ["0", "0", "1", "10000000", "0.1", "0.0000001", "inf", "-inf", "NaN"]
    assert [V.seconds_text(x) for x in (0, 1_500_000_000, 1, -1_500_000_000)] == ["0", "1.5", "0.000000001", "-1.5"]


def test_json_fields():
    assert json_fields('{"b":{"c":1.50,"a":[true,null,"x"]},"a-b":1e3,"9":"n"}') == {"_9": "n", "a_b": "1e3", "b_a_0": "true", "b_a_1": "", "b_a_2": "x", "b_c": "1.50"}
    assert json_fields('[{"id":1},2]') == {"0_id": "1", "1": "2"}
    assert json_fields('{"a-b":1,"a_b":2,"a_b_extracted":3}') == {"a_b": "1", "a_b_extracted": "2", "a_b_extracted_extracted": "3"}
    for bad in ("5", '"x"', "", "{", '{"a":NaN}', '{"a":1} x', "null"):
        with pytest.raises(ParseProblem):
            json_fields(bad)


def test_json_stage():
    assert extract_json('{"app":"x","k":1}', {"app": "y"}) == {"app": "y", "app_extracted": "x", "k": "1"}
    assert extract_json("no", {"app": "y"}) == {"app": "y", "__error__": JSON_ERROR}
    assert extract_json('{"a":1}', {"a": "0", "a_extracted": "9"})["a_extracted_2"] == "1"


def test_logfmt_fields():
    assert logfmt_fields('a=1 b="x y\\t\\"\\x41\\u00e9\\U0001F600\\101" c=') == {"a": "1", "b": 'x y\t"Aé😀A', "c": ""}
    assert logfmt_fields("a=1 a=2") == {"a": "2"}
    assert logfmt_fields("a-b=1 a_b=2 a-b=3") == {"a_b": "3", "a_b_extracted": "2"}
    assert logfmt_fields("  ") == {} and logfmt_fields("a=b=c") == {"a": "b=c"}
    for bad in ("word", "a", '="x"', 'a="x', 'a="x"y', 'a="\\q"', 'a="\\x4"', 'a="\\ud800"', 'a="\\777"', "a =1"):
        with pytest.raises(ParseProblem):
            logfmt_fields(bad)
    assert extract_logfmt("word", {"x": "1"}) == {"x": "1", "__error__": LOGFMT_ERROR}


def test_names():
    assert [clean_name(x) for x in ("a.b", "9a", "", "é", "ok_1")] == ["a_b", "_9a", "_", "_", "ok_1"]


def test_regexes(spark):
    rows = spark.createDataFrame([("err\n",), ("err",), ("é1",), ("a\rb",)], "t string")
    hit = lambda p: [r.t for r in rows.where(F.col("t").rlike(p)).collect()]
    assert hit(anchored("err")) == ["err"]
    assert hit(unanchored("err$")) == ["err"]
    assert hit(anchored(r"\w\d")) == ["é1"]
    assert hit(anchored("a.b")) == ["a\rb"]
    assert hit(unanchored("[]e]rr")) == ["err\n", "err"]
    for bad in ("(", "(?!x)", r"(a)\1", "a++", "[a"):
        with pytest.raises(RegexProblem):
            anchored(bad)
