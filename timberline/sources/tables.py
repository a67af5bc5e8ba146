"""Tables of logs and spans: schemas, fixture views, and the day-partitioned layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L

MAP = "map<string,string>"
LOGS = f"tenant string, ts_ns long, labels {MAP}, line string, metadata {MAP}"
SPANS = (
    "tenant string, trace_id string, span_id string, parent_span_id string, name string, start_ns long, end_ns long, kind int, status_code int, "
    f"attributes {MAP}, opaque array<string>, resource struct<attributes:{MAP}, schema_url:string>, scope struct<name:string, version:string, schema_url:string>"
)
DAY_NS = 86_400 * 10**9


def day_of(ts_ns: Column) -> Column:
    """The UTC day of a timestamp, also before 1970."""
    return F.date_add(F.lit("1970-01-01").cast("date"), ((ts_ns - F.pmod(ts_ns, F.lit(DAY_NS))) / F.lit(DAY_NS)).cast("int"))


def distinct_logs(logs: DataFrame) -> DataFrame:
    """Entries without exact repeats; labels_key and metadata_key beside them."""
    df = logs.withColumn("labels_key", L.labels_key(F.col("labels"))).withColumn("metadata_key", L.labels_key(F.col("metadata")))
    return df.dropDuplicates(["tenant", "ts_ns", "labels_key", "line", "metadata_key"])


def write_logs(logs: DataFrame, path: str, mode: str = "append", tasks: int | None = None) -> None:
    """Parquet by UTC day, sorted by tenant and time, so that row groups are pruned by both; exact repeats are written once.

    Tasks (as many as the session shuffles to, unless given) take ranges of day,
    tenant and time of equal size, so that a large day, tenant or stream is several
    tasks' and small days are one's.
    """
    df = distinct_logs(logs).withColumn("day", day_of(F.col("ts_ns")))
    ranges = ("day", "tenant", "ts_ns", "labels_key", "line")
    df = (df.repartitionByRange(tasks, *ranges) if tasks else df.repartitionByRange(*ranges)).sortWithinPartitions(*ranges)
    df.drop("labels_key", "metadata_key").write.mode(mode).partitionBy("day").option("compression", "zstd").parquet(path)


def reach_of(start_ns: Column, end_ns: Column) -> Column:
    """Days by which a span outlasts the day of its start: 0, or rounded up to a power of two, so that there are few values."""
    days = F.greatest(F.lit(0), F.datediff(day_of(end_ns), day_of(start_ns)))
    return F.when(days <= 1, days).otherwise(F.pow(F.lit(2), F.length(F.bin(days - 1))).cast("int"))


def write_spans(spans: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by UTC day of the start and by reach, with a Bloom filter on trace ids."""
    df = spans.dropDuplicates(["tenant", "trace_id", "span_id"]).withColumn("day", day_of(F.col("start_ns"))).withColumn("reach", reach_of(F.col("start_ns"), F.col("end_ns")))
    ranges = ("day", "reach", "tenant", "trace_id", "start_ns", "span_id")
    df = df.repartitionByRange(*ranges).sortWithinPartitions(*ranges)
    df.write.mode(mode).partitionBy("day", "reach").option("compression", "zstd").option("parquet.bloom.filter.enabled#trace_id", "true").parquet(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with the columns that its folders are named by; spans written without reach have none."""
    return spark.read.schema(f"{schema}, day date{', reach int' if schema == SPANS else ''}").parquet(path)


# ------------------------------------------------------------- fixture views


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def event_logs(spark: SparkSession, sf_dir: str, logfmt: bool = False) -> DataFrame:
    """The events table as logs; a seventh of the users have no event_type label."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = lambda c: F.col(c).cast("string")
    labels = F.when(F.col("user_id") % 7 == 0, F.create_map(F.lit("app"), F.lit("events"))).otherwise(F.create_map(F.lit("app"), F.lit("events"), F.lit("event_type"), F.col("event_type")))
    line = F.concat(F.lit("event_id="), text("event_id"), F.lit(" user="), text("user_id"), F.lit(" type="), F.col("event_type"), F.lit(" dur="), (F.col("event_id") % 5000).cast("string"), F.lit("ms")) if logfmt else F.col("props")
    return e.select(
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant"),
        _micros(F.col("ts")).alias("ts_ns"),
        labels.alias("labels"),
        line.alias("line"),
        F.create_map(F.lit("user_id"), text("user_id"), F.lit("event_id"), text("event_id")).alias("metadata"),
    )


def chat_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(
        F.lit("t0").alias("tenant"),
        ((F.col("conv_id") * 1000 + F.col("turn")) * 10**9).alias("ts_ns"),
        F.create_map(F.lit("app"), F.lit("chat"), F.lit("role"), F.col("role")).alias("labels"),
        F.col("text").alias("line"),
        F.create_map(F.lit("conv_id"), F.col("conv_id").cast("string"), F.lit("turn"), F.col("turn").cast("string")).alias("metadata"),
    )


def doc_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        F.lit("t0").alias("tenant"),
        (F.col("doc_id") * 10**9).alias("ts_ns"),
        F.create_map(F.lit("app"), F.lit("docs"), F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("labels"),
        F.col("text").alias("line"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("metadata"),
    )


def page_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select(
        F.lit("t0").alias("tenant"),
        (F.col("page_id") * 10**9).alias("ts_ns"),
        F.create_map(F.lit("app"), F.lit("pages")).alias("labels"),
        F.col("html").alias("line"),
        F.create_map(F.lit("page_id"), F.col("page_id").cast("string")).alias("metadata"),
    )


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as spans: a trace for each user and UTC day, its first event the parent of all others."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = _micros(F.col("ts"))
    trace = F.md5(F.concat(F.col("user_id").cast("string"), F.lit("|"), F.col("ts").cast("date").cast("string")))
    span = F.lpad(F.lower(F.hex(F.col("event_id") + 1)), 16, "0")
    first = F.first("span_id").over(Window.partitionBy("trace_id").orderBy("start_ns", "span_id"))
    s = e.select(
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant"),
        trace.alias("trace_id"),
        span.alias("span_id"),
        F.col("event_type").alias("name"),
        ts.alias("start_ns"),
        (ts + F.round(F.col("value") * 1000).cast("long") * 1_000_000).alias("end_ns"),
        F.lit(1).alias("kind"),
        F.when(F.col("event_type") == "error", 2).otherwise(0).alias("status_code"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("user.id"), F.col("user_id").cast("string")).alias("attributes"),
        F.array().cast("array<string>").alias("opaque"),
        F.struct(F.create_map(F.lit("service.name"), F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string"))).alias("attributes"), F.lit("").alias("schema_url")).alias("resource"),
        F.struct(F.lit("").alias("name"), F.lit("").alias("version"), F.lit("").alias("schema_url")).alias("scope"),
    )
    return s.withColumn("parent_span_id", F.when(first == F.col("span_id"), F.lit("")).otherwise(first))
