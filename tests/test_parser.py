import pytest

from timberline.plans import ast
from timberline.plans.parser import QueryProblem, checked, parse, parse_selector, selector_text

REFUSED = [
    '{a="b",}', '{a="b",,c="d"}', "{a=`b`}", '{="b"}', '{a="b"', '{a~"b"}', '{a=~"("}', '{a=~"(?=x)"}', r'{a=~"(a)\1"}',
    '{a="b"} | json | unwrap k', '{a="b"} | json a="b"', '{a="b"} | regexp "x"', '{a="b"} | k > "5"', '{a="b"} | k =~ 5', '{a="b"} | k = ', '{a="b"} |= x',
    '{a="b"} | line_format "{{.a | upper}}"', '{a="b"} | line_format "{{ if }}"', '{a="b"} | label_format a=b, a=c',
    'count_over_time({a="b"} | unwrap k [1m])', 'sum_over_time({a="b"}[1m])', 'sum_over_time({a="b"} | unwrap f(k) [1m])', 'sum_over_time({a="b"} | unwrap k | json [1m])',
    'rate({a="b"}[1m:])', 'bytes_over_time(rate({a="b"}[1m])[1h:1m])', 'rate({a="b"}[0s])', 'rate({a="b"}[1x])', 'rate({a="b"}[1m] offset -1m)',
    'rate({a="b"}[1m]) + rate({a="b"}[1m])', "5", "1 + 2", "topk(0, rate({}[1m]))", "topk(rate({}[1m]))", "sum(5)", "count(rate({}[1m]))", "stddev_over_time({}[1m])",
    'sum by (a) (rate({}[1m])) by (b)', "quantile_over_time(1.5, {} | unwrap k [1m])", "quantile_over_time({} | unwrap k [1m])", 'rate({a="b"}[1m]) and 1', "", 'rate({}[1m]) x',
]


@pytest.mark.parametrize("text", REFUSED)
def test_refused(text):
    with pytest.raises(QueryProblem):
        parse(text)


def test_depth_is_limited():
    deep = "sum(" * 70 + "rate({}[1m])" + ")" * 70
    with pytest.raises(QueryProblem):
        parse(deep)
    parse("sum(" * 20 + "rate({}[1m])" + ")" * 20)


def test_strings_and_stages():
    q = parse('{a="x\\n\\"\\u00e9\\d"} |= `\\d` != "y" |~ "z" !~ "w" | json | logfmt | json = "field"')
    assert q.matchers == (ast.Matcher("a", "=", 'x\n"é\\d'),)
    assert q.stages == (
        ast.LineFilter("|=", "\\d"), ast.LineFilter("!=", "y"), ast.LineFilter("|~", "z"), ast.LineFilter("!~", "w"),
        ast.Parser("json"), ast.Parser("logfmt"), ast.FieldFilter("json", "=", "string", "field"),
    )


def test_field_literals():
    kinds = [s.kind for s in parse("{} | a=5 | a>=-1.5e+3 | a<10ms | a!=1h30m | a=\"x\" | a=~`x`").stages]
    assert kinds == ["number", "number", "duration", "duration", "string", "regex"]


def test_formats():
    q = parse('{} | line_format "a={{.a}} {{ .b }}!" | label_format x=y, z="{{.w}}-"')
    assert q.stages[0] == ast.LineFormat(("a=", "a", " ", "b", "!"))
    assert q.stages[1] == ast.LabelFormat((("x", "y", None), ("z", None, ("", "w", "-"))))


def test_grouping_before_and_after():
    a, b = parse("sum by (y, x, y) (rate({}[1m]))"), parse("sum(rate({}[1m])) by (x, y)")
    assert a == b and a.grouping == ast.Grouping(("x", "y"))
    assert parse("sum without () (rate({}[1m]))" if False else "sum without (x) (rate({}[1m]))").grouping.without


def test_precedence_is_usual_and_to_the_left():
    m = parse("rate({}[1m]) * 2 + 1 > 3")
    assert (m.op, m.inner.op, m.inner.inner.op) == (">", "+", "*")
    m = parse("10 - rate({}[1m]) - -1e-3")
    assert m.op == "-" and m.value == -1e-3 and m.inner.scalar_left
    assert parse("(rate({}[1m]) + 1) * 2").inner.op == "+"


def test_subquery_offset_lookback():
    m = parse("max_over_time(rate({a=\"s\"}[2s] offset 1s)[12s:1s] offset 5s)")
    assert ast.lookback(m) == 20 * 10**9
    assert ast.log_query(m) == parse_selector('{a="s"}')
    assert ast.grouped_names(parse("sum by (a) (max without (b) (rate({}[1m])))")) == {"a", "b"}


def test_text_of_selectors():
    q = parse_selector('{a="x\\"\\n", b=~"c|d"} |= "e"')
    assert parse_selector(selector_text(q.matchers)).matchers == q.matchers
    assert checked('  rate({}[1m])  ') == "rate({}[1m])"
