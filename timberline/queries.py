"""Registered queries of the engine and, for each that SQL can express, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import labels as L
from .functions.values import timestamp, trace_duration
from .operators import discovery, maintenance, masks, ranges, selection, traces
from .operators.policies import Deletes, Policies, usage
from .plans import ast
from .plans.parser import checked, parse, parse_selector
from .sources import push, tables
from .sources.versions import VersionedLogs

Query = Callable[[SparkSession, str], DataFrame]

TENANT = "t1"
HOUR = 3600 * 10**9
#: The whole of the table's time.
START, END, STEP = timestamp("2024-01-01T00:00:00Z"), timestamp("2024-01-31T00:00:00Z"), 6 * HOUR
NOW = timestamp("2024-01-31T00:00:00Z")
LAST = (END - START) // STEP


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None = None


REGISTRY: dict[str, Registered] = {}


def _engine(spark: SparkSession, sf_dir: str, logfmt: bool = False, **more) -> Engine:
    return Engine(tables.event_logs(spark, sf_dir, logfmt), tables.event_spans(spark, sf_dir), **more)


_LOGS = """logs AS (
  SELECT 't' || (user_id % 3) AS tenant, epoch_us(ts) * 1000 AS ts_ns, user_id, event_id, CASE WHEN user_id % 7 = 0 THEN '' ELSE event_type END AS event_type, event_type AS etype,
    props AS line, 'event_id=' || event_id || ' user=' || user_id || ' type=' || event_type || ' dur=' || (event_id % 5000) || 'ms' AS lf, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 5000 AS dur
  FROM events
), s AS (SELECT * FROM logs WHERE tenant = 't1')"""
_SPANS = """spans0 AS (
  SELECT 't' || (user_id % 3) AS tenant, md5(user_id || '|' || CAST(CAST(ts AS DATE) AS VARCHAR)) AS trace_id, lpad(lower(to_hex(event_id + 1)), 16, '0') AS span_id, event_type AS name,
    epoch_us(ts) * 1000 AS start_ns, epoch_us(ts) * 1000 + CAST(round(value * 1000) AS BIGINT) * 1000000 AS end_ns, CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS status_code,
    json_extract_string(props, '$.k') AS k, CAST(user_id AS VARCHAR) AS uid, 'svc' || (user_id % 5) AS service FROM events
), spans AS (
  SELECT *, CASE WHEN first_value(span_id) OVER w = span_id THEN '' ELSE first_value(span_id) OVER w END AS parent_span_id FROM spans0 WINDOW w AS (PARTITION BY trace_id ORDER BY start_ns, span_id)
), sp AS (SELECT * FROM spans WHERE tenant = 't1')"""


def _grid(start: int = START, step: int = STEP, last: int = LAST) -> str:
    return f"grid AS (SELECT {start} + i * {step} AS t FROM range(0, {last + 1}) AS r(i))"


# ------------------------------------------------------------------ log queries


def _log(key: str, text: str, where: str, line: str = "line", logfmt: bool = False) -> None:
    """ts_ns, event_type and line of all entries in the window."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = selection.entries(_engine(spark, sf_dir, logfmt).scan(TENANT, START, END), parse_selector(text))
        return e.select("ts_ns", L.get(F.col("labels"), "event_type").alias("event_type"), "line")

    REGISTRY[key] = Registered(run, f"WITH {_LOGS} SELECT ts_ns, event_type, {line} AS line FROM s WHERE ts_ns BETWEEN {START} AND {END} AND ({where})")


_log("match_eq", '{app="events", event_type="click"}', "event_type = 'click'")
_log("match_neq", '{event_type!="click"}', "event_type <> 'click'")
_log("match_re", '{event_type=~"cl.*|vie[w]"}', "regexp_full_match(event_type, 'cl.*|vie[w]')")
_log("match_nre", '{event_type!~"c.+|err"}', "NOT regexp_full_match(event_type, 'c.+|err')")
_log("match_absent_label", '{event_type=""}', "event_type = ''")
_log("match_all", "{}", "true")
_log("line_contains", '{app="events"} |= "7"', "contains(line, '7')")
_log("line_not_contains", '{app="events"} != "7"', "NOT contains(line, '7')")
_log("line_regex", '{app="events"} |~ "[12][0-9]}$"', "regexp_matches(line, '[12][0-9]}$')")
_log("line_not_regex", '{app="events"} !~ `: \\d}`', "NOT regexp_matches(line, ': [0-9]}')")
_log("field_eq", '{app="events"} | json | k = "42"', "k = 42")
_log("field_neq_absent", '{app="events"} | json | nope != "x"', "true")
_log("field_re", '{app="events"} | json | k =~ "4.?"', "regexp_full_match(CAST(k AS VARCHAR), '4.?')")
_log("field_num_cmp", '{app="events"} | json | k >= 4.2e1 | k != 50', "k >= 42 AND k <> 50")
_log("field_num_unparsable", '{app="events"} | json | user_id != 3 | nope != 3', "false")
_log("field_duration_cmp", '{app="events"} | logfmt | dur > 1s500ms', "dur > 1500", "lf", True)
_log("logfmt_extract", '{app="events"} | logfmt | type = "view" | user_extracted = "" | user != ""', "etype = 'view'", "lf", True)
_log("line_format", '{app="events"} | json | line_format "k={{.k}} u={{.user_id}} {{.none}}!"', "true", "'k=' || k || ' u=' || user_id || ' !'")
_log("line_format_then_filter", '{app="events"} | json | line_format "k={{.k}}" |= "k=1"', "k::VARCHAR LIKE '1%'", "'k=' || k")
_log("label_format", '{app="events"} | json | label_format a=k, k="{{.user_id}}" | line_format "{{.a}}/{{.k}}"', "true", "k || '/' || user_id")
_log("parser_error_kept", '{app="events"} | logfmt | __error__ = "LogfmtParserErr" | json | k < 10', "k < 10")


def log_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir).log_query(TENANT, '{app="events"}', START, END, 50)
    return e.select("ts_ns", L.get(F.col("labels"), "event_type").alias("event_type"), "line")


REGISTRY["log_topn"] = Registered(log_topn, f"WITH {_LOGS} SELECT ts_ns, event_type, line FROM s WHERE ts_ns BETWEEN {START} AND {END} ORDER BY ts_ns DESC LIMIT 50")


def log_topn_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir).log_query(TENANT, '{app="events"} | json', START, END, 20, "Forward")
    return e.select("ts_ns", F.element_at("metadata", "k").alias("k"), F.element_at("metadata", "event_id").alias("event_id"))


REGISTRY["log_topn_forward"] = Registered(log_topn_forward, f"WITH {_LOGS} SELECT ts_ns, CAST(k AS VARCHAR) AS k, CAST(event_id AS VARCHAR) AS event_id FROM s WHERE ts_ns BETWEEN {START} AND {END} ORDER BY ts_ns LIMIT 20")


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field by field what the json stage finds."""
    e = selection.entries(_engine(spark, sf_dir).scan(TENANT, START, END), parse_selector('{app="events"} | json'))
    return e.select("ts_ns", F.explode(F.map_entries("metadata")).alias("x")).select("ts_ns", F.col("x.key").alias("name"), F.col("x.value").alias("value"))


REGISTRY["json_extract"] = Registered(
    json_extract,
    f"WITH {_LOGS}, w AS (SELECT * FROM s WHERE ts_ns BETWEEN {START} AND {END}) SELECT ts_ns, 'k' AS name, CAST(k AS VARCHAR) AS value FROM w UNION ALL SELECT ts_ns, 'user_id', CAST(user_id AS VARCHAR) FROM w UNION ALL SELECT ts_ns, 'event_id', CAST(event_id AS VARCHAR) FROM w",
)


def page_parser_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML is neither JSON nor logfmt: every page is kept, with an error."""
    e = selection.entries(tables.page_logs(spark, sf_dir), parse_selector('{app="pages"} | json'))
    return e.groupBy(F.element_at("metadata", "__error__").alias("error")).agg(F.count("*").alias("n"))


REGISTRY["page_parser_errors"] = Registered(page_parser_errors, "SELECT 'JSONParserErr' AS error, count(*) AS n FROM pages")


def chat_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = selection.entries(tables.chat_logs(spark, sf_dir), parse_selector('{app="chat", role=~"user|assistant"} |~ "(?i)the [a-z]+ing"'))
    return e.groupBy(L.get(F.col("labels"), "role").alias("role")).agg(F.count("*").alias("n"), F.sum(F.octet_length("line")).alias("bytes"))


REGISTRY["chat_regex"] = Registered(chat_regex, "SELECT role, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM conversations WHERE role IN ('user', 'assistant') AND regexp_matches(text, '(?i)the [a-z]+ing') GROUP BY role")

# --------------------------------------------------------------------- metrics


def _flat(vector: DataFrame, names: tuple[str, ...], start: int, step: int) -> DataFrame:
    m = L.labels_map(F.col("series"))
    return vector.select(*(L.get(m, n).alias(n) for n in names), (F.lit(start) + F.col("k") * step).cast("long").alias("eval_ts"), F.round("value", 6).alias("value"))


def _metric(key: str, text: str, sql: str, names: tuple[str, ...] = ("event_type",), logfmt: bool = False, start: int = START, end: int = END, step: int = STEP) -> None:
    """A metric on the grid; sql: select of names, t and v."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vector, grid = _engine(spark, sf_dir, logfmt).metric_query(TENANT, text, start, end, step)
        return _flat(vector, names, grid.start, grid.step)

    outer = ", ".join(names) + ", " if names else ""
    REGISTRY[key] = Registered(run, f"WITH {_LOGS}, {_grid(start, step, (end - start) // step)}, q AS ({sql}) SELECT {outer}t AS eval_ts, round(CAST(v AS DOUBLE), 6) AS value FROM q")


def _over(value: str, hours: float, where: str = "true", by: str = "event_type", offset: float = 0) -> str:
    r, o = int(hours * HOUR), int(offset * HOUR)
    head = by + ", " if by else ""
    return f"SELECT {head}t, {value} AS v FROM grid JOIN s ON ts_ns > t - {o} - {r} AND ts_ns <= t - {o} WHERE {where} GROUP BY {head}t"


_K = '{app="events"} | json | unwrap k'
_metric("count_over_time", 'count_over_time({app="events"}[24h])', _over("count(*)", 24))
_metric("count_over_time_uneven", 'count_over_time({app="events"} |= "k" [7h])', _over("count(*)", 7))
_metric("rate", 'rate({app="events"}[12h])', _over("count(*) / 43200.0", 12))
_metric("bytes_over_time", 'bytes_over_time({app="events"}[12h])', _over("sum(strlen(line))", 12))
_metric("sum_over_time", f"sum_over_time({_K}[12h])", _over("sum(k)", 12))
_metric("avg_over_time", f"avg_over_time({_K}[12h])", _over("avg(k)", 12))
_metric("min_over_time", f"min_over_time({_K}[12h])", _over("min(k)", 12))
_metric("max_over_time", f"max_over_time({_K}[12h])", _over("max(k)", 12))
_metric("quantile_over_time", f"quantile_over_time(0.9, {_K}[24h])", _over("quantile_cont(k, 0.9)", 24))
_metric("unwrap_duration", 'sum_over_time({app="events"} | logfmt | unwrap duration(dur)[12h])', _over("sum(dur) / 1000.0", 12), logfmt=True)
_metric("offset", 'count_over_time({app="events"}[12h] offset 1d)', _over("count(*)", 12, offset=24))
_metric("sum_by", 'sum by (event_type) (count_over_time({app="events"} |= "k" [12h]))', _over("count(*)", 12))
_metric("avg_by_postfix", f"avg(max_over_time({_K}[12h])) by (app)", f"SELECT 'events' AS app, t, avg(v) AS v FROM ({_over('max(k)', 12)}) GROUP BY t", ("app",))
_metric("min_global", f"min(sum_over_time({_K}[12h]))", f"SELECT t, min(v) AS v FROM ({_over('sum(k)', 12)}) GROUP BY t", ())
_metric("max_without", f"max without (event_type) (sum_over_time({_K}[12h]))", f"SELECT 'events' AS app, '' AS event_type, t, max(v) AS v FROM ({_over('sum(k)', 12)}) GROUP BY t", ("app", "event_type"))
_metric("promoted_field_group", f"avg by (user_id) (sum_over_time({_K}[24h]))", f"SELECT user_id, t, avg(v) AS v FROM ({_over('sum(k)', 24, by='event_type, CAST(user_id AS VARCHAR) AS user_id').replace('GROUP BY event_type, CAST(user_id AS VARCHAR) AS user_id', 'GROUP BY event_type, user_id')}) GROUP BY user_id, t", ("user_id",))
_metric("topk", 'topk(2, sum by (event_type) (count_over_time({app="events"}[12h])))', f"SELECT * FROM ({_over('count(*)', 12)}) QUALIFY row_number() OVER (PARTITION BY t ORDER BY v DESC, event_type <> '', event_type) <= 2")
_metric("scalar_arith", '10 - rate({app="events"}[12h]) * 3600 + 1', f"SELECT event_type, t, 10 - v * 3600 + 1 AS v FROM ({_over('count(*) / 43200.0', 12)})")
_metric("scalar_cmp", 'count_over_time({app="events"}[12h]) >= 5', f"SELECT * FROM ({_over('count(*)', 12)}) WHERE v >= 5")
_metric("scalar_cmp_left", '5 < count_over_time({app="events"}[12h])', f"SELECT event_type, t, 5 AS v FROM ({_over('count(*)', 12)}) WHERE 5 < v")
_metric("scalar_div_zero", 'sum(count_over_time({app="events"}[12h])) / 0 > 1', f"SELECT t, 'Infinity'::DOUBLE AS v FROM ({_over('count(*)', 12, by='')})", ())
_metric("scalar_mod", 'sum(count_over_time({app="events"}[12h])) % 7', f"SELECT t, v % 7 AS v FROM ({_over('count(*)', 12, by='')})", ())
_metric(
    "subquery_max",
    'max_over_time(sum(count_over_time({app="events"}[4h]))[12h:3h])',
    f"""SELECT o.t, max(n) AS v FROM grid AS o JOIN (SELECT DISTINCT t - 43200000000000 + j * 10800000000000 AS p FROM grid, range(1, 5) AS r(j)) AS i ON p > o.t - 43200000000000 AND p <= o.t
    JOIN (SELECT p AS pp, count(*) AS n FROM (SELECT DISTINCT t - 43200000000000 + j * 10800000000000 AS p FROM grid, range(1, 5) AS r(j)) JOIN s ON ts_ns > p - 14400000000000 AND ts_ns <= p GROUP BY p) ON pp = p
    WHERE (p - (o.t - 43200000000000)) % 10800000000000 = 0 GROUP BY o.t""",
    (),
)
_metric(
    "subquery_avg_uneven",
    'avg_over_time(count_over_time({app="events"}[5h])[11h:4h] offset 1h)',
    """SELECT event_type, t, avg(n) AS v FROM (SELECT t, j, event_type, count(*) AS n FROM grid, range(1, 3) AS r(j) JOIN s ON ts_ns > t - 3600000000000 - 39600000000000 + j * 14400000000000 - 18000000000000 AND ts_ns <= t - 3600000000000 - 39600000000000 + j * 14400000000000 GROUP BY t, j, event_type) GROUP BY event_type, t""",
)


_EVERY = 600 * 10**9


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in half-hour windows every ten minutes of the whole time, through all of the engine."""
    vector, grid = _engine(spark, sf_dir).metric_query(TENANT, 'sum by (event_type) (count_over_time({app="events"} |= "k" [30m]))', START, END, _EVERY)
    return _flat(vector, ("event_type",), grid.start, grid.step)


REGISTRY["flagship"] = Registered(flagship, f"WITH {_LOGS}, {_grid(START, _EVERY, (END - START) // _EVERY)}, q AS ({_over('count(*)', 0.5)}) SELECT event_type, t AS eval_ts, CAST(v AS DOUBLE) AS value FROM q")


def instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _engine(spark, sf_dir).instant_query(TENANT, 'sum by (event_type) (rate({app="events"}[5d]))', END)
    return _flat(v, ("event_type",), END, 1)


REGISTRY["instant"] = Registered(instant, f"WITH {_LOGS} SELECT event_type, {END} AS eval_ts, round(count(*) / 432000.0, 6) AS value FROM s WHERE ts_ns > {END} - {120 * HOUR} AND ts_ns <= {END} GROUP BY event_type")


def negative_sign_modulo(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _engine(spark, sf_dir).instant_query(TENANT, '(0 - sum by (event_type) (count_over_time({app="events"}[5d]))) % 4', END)
    return _flat(v, ("event_type",), END, 1)


REGISTRY["negative_modulo"] = Registered(negative_sign_modulo, f"WITH {_LOGS} SELECT event_type, {END} AS eval_ts, CAST((0 - count(*)) % 4 AS DOUBLE) AS value FROM s WHERE ts_ns > {END} - {120 * HOUR} AND ts_ns <= {END} GROUP BY event_type")

# ------------------------------------------------------------------- discovery


def _add(key: str, sql: str | None = None):
    def register(f: Query) -> Query:
        REGISTRY[key] = Registered(f, sql)
        return f

    return register


_W = f"ts_ns BETWEEN {START} AND {END}"


@_add("labels", f"WITH {_LOGS} SELECT 'app' AS label FROM s WHERE {_W} UNION SELECT 'event_type' FROM s WHERE {_W} AND event_type <> ''")
def labels(spark, sf_dir):
    return _engine(spark, sf_dir).labels(TENANT, START, END)


@_add("label_values", f"WITH {_LOGS} SELECT DISTINCT event_type AS value FROM s WHERE {_W} AND event_type <> ''")
def label_values(spark, sf_dir):
    return _engine(spark, sf_dir).label_values(TENANT, "event_type", START, END)


@_add("series", f"WITH {_LOGS} SELECT DISTINCT event_type FROM s WHERE {_W} AND event_type IN ('click', 'view', '')")
def series(spark, sf_dir):
    out = _engine(spark, sf_dir).series(TENANT, ['{event_type=~"click|view"}', '{app="events", event_type=""} |= "never"'], START, END)
    return out.select(L.get(L.labels_map(F.col("series")), "event_type").alias("event_type"))


@_add("index_stats", f"WITH {_LOGS} SELECT count(DISTINCT event_type) AS streams, count(*) AS entries, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM s WHERE {_W} AND event_type <> 'view'")
def index_stats(spark, sf_dir):
    return _engine(spark, sf_dir).index_stats(TENANT, '{event_type!="view"}', START, END)


@_add("volume", f"WITH {_LOGS} SELECT event_type, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM s WHERE ts_ns > {START} AND ts_ns <= {END} GROUP BY event_type ORDER BY bytes DESC, event_type <> '', event_type LIMIT 3")
def volume(spark, sf_dir):
    return _engine(spark, sf_dir).volume(TENANT, '{app="events"}', START, END, (), 3).select(L.get(L.labels_map(F.col("series")), "event_type").alias("event_type"), "bytes")


@_add("volume_by_target", f"WITH {_LOGS} SELECT 'events' AS app, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM s WHERE ts_ns > {START} AND ts_ns <= {END}")
def volume_by_target(spark, sf_dir):
    return _engine(spark, sf_dir).volume(TENANT, '{app="events"} |= "ignored"', START, END, ("app",)).select(L.get(L.labels_map(F.col("series")), "app").alias("app"), "bytes")


@_add("volume_range", f"WITH {_LOGS}, {_grid()} SELECT event_type, t AS eval_ts, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM grid JOIN s ON ts_ns > t - {STEP} AND ts_ns <= t GROUP BY event_type, t")
def volume_range(spark, sf_dir):
    v = _engine(spark, sf_dir).volume_range(TENANT, '{app="events"}', START, END, STEP)
    return v.select(L.get(L.labels_map(F.col("series")), "event_type").alias("event_type"), (F.lit(START) + F.col("k") * STEP).alias("eval_ts"), "bytes")


@_add("detected_labels", f"WITH {_LOGS} SELECT 'app' AS label, CAST(1 AS BIGINT) AS cardinality UNION ALL SELECT 'event_type', count(DISTINCT event_type) FROM s WHERE {_W} AND event_type <> ''")
def detected_labels(spark, sf_dir):
    return _engine(spark, sf_dir).detected_labels(TENANT, START, END)


@_add("detected_fields", f"""WITH {_LOGS}, n AS (SELECT * FROM s WHERE {_W} ORDER BY ts_ns DESC LIMIT 1000) SELECT 'k' AS field, 'int' AS type, count(DISTINCT k) AS cardinality FROM n
UNION ALL SELECT 'event_id', 'int', count(DISTINCT event_id) FROM n UNION ALL SELECT 'user_id', 'int', count(DISTINCT user_id) FROM n""")
def detected_fields(spark, sf_dir):
    return _engine(spark, sf_dir).detected_fields(TENANT, '{app="events"} | json', START, END)


@_add("patterns")
def patterns(spark, sf_dir):
    return discovery.patterns(tables.chat_logs(spark, sf_dir), parse_selector('{app="chat"}'), 0, 3600 * 10**9, 10**9)


@_add("pattern_tokens", "SELECT conv_id, turn, list_aggregate(list_transform(list_filter(regexp_split_to_array(text, '[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda w: w <> ''), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<_>' ELSE w END), 'string_agg', ' ') AS template FROM conversations")
def pattern_tokens(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", F.array_join(discovery.tokens(F.col("text")), " ").alias("template"))


# ---------------------------------------------------------------------- traces


@_add("trace_by_id", f"WITH {_SPANS} SELECT span_id, parent_span_id, name, start_ns, end_ns FROM sp WHERE trace_id = md5('4|2024-01-06')")
def trace_by_id(spark, sf_dir):
    import hashlib

    return _engine(spark, sf_dir).trace(TENANT, hashlib.md5(b"4|2024-01-06").hexdigest()).select("span_id", "parent_span_id", "name", "start_ns", "end_ns")


_SUMMARY = "trace_id, arg_min(service, (CASE WHEN parent_span_id = '' THEN 0 ELSE 1 END, start_ns, span_id)) AS root_service, arg_min(name, (CASE WHEN parent_span_id = '' THEN 0 ELSE 1 END, start_ns, span_id)) AS root_name, min(start_ns) AS start_ns, max(end_ns) - min(start_ns) AS duration_ns, count(*) AS spans"


@_add("trace_search", f"WITH {_SPANS} SELECT {_SUMMARY} FROM sp WHERE end_ns >= {START} AND start_ns <= {END} GROUP BY trace_id HAVING bool_or(status_code = 2) AND bool_or(service = 'svc1') AND max(end_ns) - min(start_ns) >= {HOUR} ORDER BY trace_id LIMIT 20")
def trace_search(spark, sf_dir):
    return _engine(spark, sf_dir).search(TENANT, 'status=Error, service.name="svc1"', START, END, min_ns=HOUR)


@_add("trace_search_all", f"WITH {_SPANS} SELECT {_SUMMARY} FROM sp GROUP BY trace_id HAVING bool_or(name = 'view') AND max(end_ns) - min(start_ns) <= {20 * HOUR} ORDER BY trace_id LIMIT 1000")
def trace_search_all(spark, sf_dir):
    return _engine(spark, sf_dir).search(TENANT, "{name=view}", max_ns=20 * HOUR, limit=1000)


@_add("trace_tags", "SELECT * FROM (VALUES ('intrinsic', 'duration'), ('intrinsic', 'name'), ('intrinsic', 'status'), ('span', 'k'), ('span', 'user.id'), ('resource', 'service.name')) AS v(scope, tag)")
def trace_tags(spark, sf_dir):
    return traces.tag_names(_engine(spark, sf_dir).scan_spans(TENANT))


@_add("trace_tag_values", f"WITH {_SPANS} SELECT DISTINCT k AS value FROM sp")
def trace_tag_values(spark, sf_dir):
    return traces.tag_values(_engine(spark, sf_dir).scan_spans(TENANT), "k")


@_add("trace_batches", f"WITH {_SPANS} SELECT service, span_id, parent_span_id, trace_id, name, start_ns, end_ns, CAST(status_code AS BIGINT) AS status_code, k, uid FROM sp WHERE {_W.replace('ts_ns', 'start_ns')}")
def trace_batches(spark, sf_dir):
    s = _engine(spark, sf_dir).scan_spans(TENANT).where(F.col("start_ns").between(START, END))
    x = traces.batches(s).select(F.col("resource_key")[0]["value"].alias("service"), F.explode("spans").alias("x"))
    text = lambda path: F.get_json_object("x", f"$.{path}")
    numbers = [text(c).cast("long").alias(c) for c in ("start_ns", "end_ns", "status_code")]
    return x.select("service", *(text(c).alias(c) for c in ("span_id", "parent_span_id", "trace_id", "name")), *numbers, text("attributes.k").alias("k"), text("attributes['user.id']").alias("uid"))


# ------------------------------------------------- masks, policies, maintenance

#: The time that the deletes are of, within the table's.
FROM, TO = timestamp("2024-01-05T00:00:00Z"), timestamp("2024-01-15T00:00:00Z")
_DELETES = [
    masks.Delete("a", TENANT, '{event_type="click"}', FROM, FROM + 100 * HOUR),
    masks.Delete("b", TENANT, '{app="events"} |= "7"', FROM + 50 * HOUR, TO),
    masks.Delete("c", "t0", '{app="events"}', FROM, TO),
]
_VISIBLE = f"NOT (event_type = 'click' AND ts_ns >= {FROM} AND ts_ns < {FROM + 100 * HOUR}) AND NOT (contains(line, '7') AND ts_ns >= {FROM + 50 * HOUR} AND ts_ns < {TO})"


@_add("delete_mask", f"WITH {_LOGS} SELECT ts_ns, line FROM s WHERE {_W} AND {_VISIBLE}")
def delete_mask(spark, sf_dir):
    e = _engine(spark, sf_dir, deletes=Deletes(_DELETES))
    return selection.entries(e.scan(TENANT, START, END), parse_selector('{app="events"}')).select("ts_ns", "line")


def _policies() -> Policies:
    return Policies([("t0", "infinite", None, None, None, 0), (TENANT, "7d", 1000, 1000, 50, 0)])


@_add("retention_clamp", f"WITH {_LOGS} SELECT event_type, count(*) AS n FROM s WHERE ts_ns >= {NOW - 168 * HOUR} AND ts_ns <= {NOW} GROUP BY event_type")
def retention_clamp(spark, sf_dir):
    e = _engine(spark, sf_dir, policies=_policies(), now_ns=NOW)
    return e.scan(TENANT, START, NOW).groupBy(L.get(F.col("labels"), "event_type").alias("event_type")).agg(F.count("*").alias("n"))


@_add("retention_rewrite", f"WITH {_LOGS} SELECT tenant, count(*) AS n FROM logs WHERE (tenant <> 't1' OR (ts_ns >= {NOW - 168 * HOUR} AND {_VISIBLE})) AND (tenant <> 't0' OR ts_ns < {FROM} OR ts_ns >= {TO}) GROUP BY tenant")
def retention_rewrite(spark, sf_dir):
    kept = maintenance.kept(tables.event_logs(spark, sf_dir), _policies(), NOW, _DELETES)
    return kept.groupBy("tenant").agg(F.count("*").alias("n"))


@_add("expired_days", f"""WITH {_LOGS}, d AS (SELECT CAST(to_timestamp(ts_ns // 1000000000) AT TIME ZONE 'UTC' AS DATE) AS day, count(*) AS rows, count(*) FILTER (tenant <> 't1' OR ts_ns >= {NOW - 168 * HOUR}) AS "left" FROM logs GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, rows, "left", CASE WHEN "left" = 0 THEN 'drop' WHEN rows - "left" > 0 AND rows - "left" >= rows * 0.5 THEN 'rewrite' ELSE 'keep' END AS action FROM d""")
def expired_days(spark, sf_dir):
    logs = tables.event_logs(spark, sf_dir).withColumn("day", tables.day_of(F.col("ts_ns")))
    return maintenance.expired_days(logs, _policies(), NOW).withColumn("day", F.col("day").cast("string"))


@_add("usage", f"WITH {_LOGS} SELECT tenant, count(DISTINCT event_type) AS streams, count(*) AS entries, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM logs GROUP BY tenant")
def tenant_usage(spark, sf_dir):
    return usage(tables.event_logs(spark, sf_dir))


@_add("dedup", f"WITH {_LOGS} SELECT tenant, event_type, count(*) AS n FROM (SELECT DISTINCT tenant, ts_ns, event_type, line, user_id, event_id FROM logs) GROUP BY ALL")
def dedup(spark, sf_dir):
    e = tables.event_logs(spark, sf_dir)
    return tables.distinct_logs(e.unionByName(e)).groupBy("tenant", L.get(F.col("labels"), "event_type").alias("event_type")).agg(F.count("*").alias("n"))


@_add("acceptance_window", f"WITH {_LOGS} SELECT ts_ns >= {END - 168 * HOUR} AND ts_ns <= {END + HOUR} AS accepted, count(*) AS n FROM logs GROUP BY 1")
def acceptance_window(spark, sf_dir):
    from .streaming.live import accepted

    return tables.event_logs(spark, sf_dir).groupBy(accepted(END).alias("accepted")).agg(F.count("*").alias("n"))


@_add("stream_limit", f"WITH {_LOGS}, k AS (SELECT DISTINCT tenant, event_type FROM logs), o AS (SELECT * FROM k WHERE event_type IN ('view', 'error')), a AS (SELECT * FROM o UNION ALL (SELECT * FROM k WHERE event_type NOT IN ('view', 'error') QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY event_type <> '', event_type) + 2 <= 4)) SELECT tenant, event_type, count(*) AS n FROM logs JOIN a USING (tenant, event_type) GROUP BY ALL")
def stream_limit(spark, sf_dir):
    from .streaming.live import within_stream_limit

    logs = tables.event_logs(spark, sf_dir)
    known = logs.where(L.get(F.col("labels"), "event_type").isin("view", "error"))
    return within_stream_limit(logs, known, 4).groupBy("tenant", L.get(F.col("labels"), "event_type").alias("event_type")).agg(F.count("*").alias("n"))


# ----------------------------------------------------- parts, pushes and text


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a local one only where the master is local and none is set."""
    import tempfile
    import uuid

    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        root = tempfile.mkdtemp(prefix="timberline-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@_add("logs_from_parts", f"WITH {_LOGS} SELECT event_type, ts_ns, line FROM s WHERE {_W}")
def logs_from_parts(spark, sf_dir):
    path = _folder(spark, "logs")
    tables.write_logs(tables.event_logs(spark, sf_dir), path)
    logs = Engine(tables.read(spark, path, tables.LOGS)).scan(TENANT, START, END)
    return logs.select(L.get(F.col("labels"), "event_type").alias("event_type"), "ts_ns", "line")


@_add("parts_after_retention", f"WITH {_LOGS} SELECT tenant, count(*) AS n, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM logs WHERE (tenant <> 't1' OR (ts_ns >= {NOW - 168 * HOUR} AND {_VISIBLE})) AND (tenant <> 't0' OR ts_ns < {FROM} OR ts_ns >= {TO}) GROUP BY tenant")
def parts_after_retention(spark, sf_dir):
    old, new = _folder(spark, "logs"), _folder(spark, "logs")
    tables.write_logs(tables.event_logs(spark, sf_dir), old)
    maintenance.rewrite(spark, old, new, _policies(), NOW, _DELETES)
    return tables.read(spark, new, tables.LOGS).groupBy("tenant").agg(F.count("*").alias("n"), F.sum(F.octet_length("line")).alias("bytes"))


@_add("parts_after_deletes", f"WITH {_LOGS} SELECT tenant, event_type, count(*) AS n FROM logs WHERE (tenant <> 't1' OR {_VISIBLE}) AND (tenant <> 't0' OR ts_ns < {FROM} OR ts_ns >= {TO}) GROUP BY ALL")
def parts_after_deletes(spark, sf_dir):
    """Two appends to a table with versions, whose days are then maintained one by one."""
    table, logs = VersionedLogs(spark, _folder(spark, "table")), tables.event_logs(spark, sf_dir)
    for odd in (0, 1):
        table.append(logs.where(F.pmod(F.col("ts_ns"), F.lit(2000)) == odd * 1000))
    maintenance.maintain(table, deletes=_DELETES)
    return table.read().groupBy("tenant", L.get(F.col("labels"), "event_type").alias("event_type")).agg(F.count("*").alias("n"))


@_add("spans_from_parts", f"WITH {_SPANS} SELECT {_SUMMARY} FROM sp WHERE end_ns >= {START} AND start_ns <= {END} GROUP BY trace_id HAVING bool_or(status_code = 2) ORDER BY trace_id LIMIT 100")
def spans_from_parts(spark, sf_dir):
    path = _folder(spark, "spans")
    tables.write_spans(tables.event_spans(spark, sf_dir), path)
    spans = tables.read(spark, path, tables.SPANS)
    return Engine(tables.event_logs(spark, sf_dir), spans).search(TENANT, "status=error", START, END, limit=100)


@_add("json_pushes", f"WITH {_LOGS} SELECT tenant, event_type, ts_ns, line, CAST(user_id AS VARCHAR) AS user_id FROM logs")
def json_pushes(spark, sf_dir):
    """Events packed into push bodies, one for a tenant and hour, and read back."""
    e = tables.event_logs(spark, sf_dir)
    value = F.concat(F.lit("["), F.to_json(F.array(F.col("ts_ns").cast("string"), F.col("line"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col("ts_ns").cast("string"), F.col("line")))) - 2), F.lit(","), F.to_json("metadata"), F.lit("]"))
    streams = e.groupBy("tenant", F.expr(f"ts_ns div {HOUR}").alias("hour"), F.to_json("labels").alias("stream")).agg(F.array_join(F.collect_list(value), ",").alias("values"))
    one = F.concat(F.lit('{"stream":'), F.col("stream"), F.lit(',"values":['), F.col("values"), F.lit("]}"))
    bodies = streams.groupBy("tenant", "hour").agg(F.concat(F.lit('{"streams":['), F.array_join(F.collect_list(one), ","), F.lit("]}")).alias("body"))
    return push.json_push(bodies).select("tenant", L.get(F.col("labels"), "event_type").alias("event_type"), "ts_ns", "line", F.element_at("metadata", "user_id").alias("user_id"))


def _attribute(key: str, value: F.Column) -> F.Column:
    return F.struct(F.lit(key).alias("key"), F.struct(value.cast("string").alias("stringValue")).alias("value"))


@_add("otlp_log_exports", f"WITH {_LOGS} SELECT tenant, 'svc' || (user_id % 5) AS service, etype AS severity, ts_ns, line, CAST(user_id AS VARCHAR) AS uid FROM logs")
def otlp_log_exports(spark, sf_dir):
    """Events as OTLP log records, one export for a tenant and service, and read back."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("*", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"))
    record = F.struct(F.col("ts_ns").cast("string").alias("timeUnixNano"), F.col("event_type").alias("severityText"), F.struct(F.col("props").alias("stringValue")).alias("body"), F.array(_attribute("uid", F.col("user_id"))).alias("attributes"))
    records = e.groupBy((F.col("user_id") % 3).alias("t"), (F.col("user_id") % 5).alias("svc")).agg(F.collect_list(record).alias("logRecords"))
    resource = F.struct(F.array(_attribute("service.name", F.concat(F.lit("svc"), F.col("svc").cast("string"))), _attribute("host.name", F.lit("h"))).alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.struct(F.lit("sc").alias("name")).alias("scope"), F.col("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")))
    logs = push.otlp_logs(records.select(F.concat(F.lit("t"), F.col("t").cast("string")).alias("tenant"), body.alias("body")))
    meta = lambda k: F.element_at("metadata", k)
    return logs.select("tenant", L.get(F.col("labels"), "service_name").alias("service"), meta("severity_text").alias("severity"), "ts_ns", "line", meta("uid").alias("uid"))


@_add("otlp_trace_exports", f"WITH {_SPANS} SELECT tenant, trace_id, span_id, parent_span_id, name, start_ns, end_ns, CAST(status_code AS BIGINT) AS status_code, k, service FROM spans")
def otlp_trace_exports(spark, sf_dir):
    """Spans as OTLP exports, one for a tenant and service, and read back."""
    s = tables.event_spans(spark, sf_dir)
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "name", F.col("start_ns").cast("string").alias("startTimeUnixNano"),
        F.col("end_ns").cast("string").alias("endTimeUnixNano"), F.struct(F.col("status_code").alias("code")).alias("status"), F.array(_attribute("k", F.element_at("attributes", "k"))).alias("attributes"),
    )
    service = F.element_at("resource.attributes", "service.name")
    packed = s.groupBy("tenant", service.alias("service")).agg(F.collect_list(span).alias("spans"))
    resource = F.struct(F.array(_attribute("service.name", F.col("service"))).alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans")))
    back = push.otlp_spans(packed.select("tenant", body.alias("body")))
    return back.select("tenant", "trace_id", "span_id", "parent_span_id", "name", "start_ns", "end_ns", F.col("status_code").cast("long").alias("status_code"), F.element_at("attributes", "k").alias("k"), service.alias("service"))


@_add("name_collisions", f"WITH {_LOGS} SELECT event_id, CAST(k AS VARCHAR) AS k, CAST(k + 1 AS VARCHAR) AS k_extracted, CAST(event_id + 1 AS VARCHAR) AS event_id_extracted, CAST(user_id AS VARCHAR) AS event_id_extracted_extracted, '2' AS _2x FROM s WHERE {_W}")
def name_collisions(spark, sf_dir):
    """Fields whose cleaned names meet each other's, and those of the metadata."""
    logs = tables.event_logs(spark, sf_dir)
    k, id_, user = F.get_json_object("line", "$.k"), F.element_at("metadata", "event_id"), F.element_at("metadata", "user_id")
    line = F.concat(F.lit('{"k":'), k, F.lit(',"k_extracted":'), (k.cast("long") + 1).cast("string"), F.lit(',"event.id":'), (id_.cast("long") + 1).cast("string"), F.lit(',"event_id":'), user, F.lit(',"2x":2}'))
    found = selection.entries(masks.scan(logs.withColumn("line", line), TENANT, START, END), parse_selector('{app="events"} | json'))
    field = lambda name: F.element_at("metadata", name).alias(name)
    return found.select(F.element_at("metadata", "event_id").cast("long").alias("event_id"), *(field(x) for x in ("k", "k_extracted", "event_id_extracted", "event_id_extracted_extracted", "_2x")))


def _texts(rows: list[tuple[str, str]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("('" + a.replace("'", "''") + "', '" + b.replace("'", "''") + "')" for a, b in rows) + ") AS v(given, found)"


_REFUSED = [('{app="a"} | x > "5"', "QueryProblem"), ('sum(rate({app="a"}[5m])) + rate({app="a"}[5m])', "QueryProblem"), ('sum_over_time({app="a"}[5m])', "QueryProblem"), ('rate({app="a"} | unwrap x [5m])', "QueryProblem"), ("{}[5m]", "QueryProblem"), ('topk(0, rate({app="a"}[5m]))', "QueryProblem")]
_TIMES = [("1700000000", "1700000000000000000"), ("1700000000000", "1700000000000000000"), ("1700000000000000", "1700000000000000000"), ("1700000000000000001", "1700000000000000001"), ("2024-01-05T00:00:00Z", "1704412800000000000"), ("2024-01-05T01:30:00.5+01:30", "1704412800500000000"), ("1704412800.25", "1704412800250000000")]
_SPANS_OF_TIME = [("1h30m", "5400000000000"), ("1.5s", "1500000000"), ("100ms", "100000000"), ("2d", "172800000000000"), ("1w", "604800000000000"), ("10", "10000000000"), ("0.5", "500000000")]
_LABEL_TEXTS = [('{b="2",a="1"}', '{a="1", b="2"}'), ('{ a = "x\\"y" }', '{a="x\\"y"}'), ("{}", "{}"), ('{a="l\\n2"}', '{a="l\\n2"}')]
_CHECKED = [('  {app="a"} |= "x"  ', '{app="a"} |= "x"'), (' rate({a="b"}[5m]) ', 'rate({a="b"}[5m])')]


def _found(rows: list[tuple[str, str]], f) -> Query:
    return lambda spark, sf_dir: spark.createDataFrame([(given, str(f(given))) for given, _ in rows], "given string, found string")


def _refusal(text: str) -> str:
    try:
        parse(text)
    except ValueError:
        return "QueryProblem"
    return "taken"


REGISTRY |= {
    "refused_queries": Registered(_found(_REFUSED, _refusal), _texts(_REFUSED)),
    "time_literals": Registered(_found(_TIMES, timestamp), _texts(_TIMES)),
    "trace_durations": Registered(_found(_SPANS_OF_TIME, trace_duration), _texts(_SPANS_OF_TIME)),
    "label_texts": Registered(_found(_LABEL_TEXTS, lambda t: push.label_text(push.parse_labels(t))), _texts(_LABEL_TEXTS)),
    "format_query": Registered(_found(_CHECKED, checked), _texts(_CHECKED)),
}


def queries() -> dict[str, Query]:
    return {k: r.run for k, r in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: r.sql for k, r in REGISTRY.items() if r.sql}


__all__ = ["ast", "flagship", "oracle_sql", "parse", "queries", "ranges"]
