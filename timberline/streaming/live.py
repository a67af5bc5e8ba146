"""Structured Streaming: ingest with an acceptance window, stream limits, live tail and continuous windows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import labels as L
from ..operators import masks, selection
from ..plans import ast
from ..sources import files
from ..sources.tables import DAY_NS, LOGS, day_of, write_logs

#: How old and how far ahead an entry may be.
MAX_AGE_NS, MAX_AHEAD_NS = 7 * DAY_NS, 3600 * 10**9
MAX_TAIL_DELAY_S, TAIL_LIMIT = 5, 100


def accepted(now_ns: int, max_age_ns: int = MAX_AGE_NS, max_ahead_ns: int = MAX_AHEAD_NS) -> F.Column:
    """Whether an entry's time lies in the acceptance window, both ends included."""
    return F.col("ts_ns").between(now_ns - max_age_ns, now_ns + max_ahead_ns)


def _streams(logs: DataFrame) -> DataFrame:
    return logs.select("tenant", L.labels_key(F.col("labels")).alias("labels_key")).distinct()


def new_streams(batch: DataFrame, old: DataFrame, max_streams: int) -> DataFrame:
    """tenant and labels_key of the first streams of a batch that are not among the old ones and that a tenant still has room for."""
    count = old.groupBy("tenant").agg(F.count("*").alias("used"))
    rank = F.row_number().over(Window.partitionBy("tenant").orderBy("labels_key"))
    new = _streams(batch).join(old, ["tenant", "labels_key"], "left_anti")
    first = new.withColumn("rank", rank).where(F.col("rank") <= max_streams)  # by task already, before a tenant's streams meet
    return first.join(count, "tenant", "left").where(F.col("rank") + F.coalesce("used", F.lit(0)) <= max_streams).select("tenant", "labels_key")


def _of(batch: DataFrame, streams: DataFrame) -> DataFrame:
    keyed = batch.withColumn("labels_key", L.labels_key(F.col("labels")))
    return keyed.join(streams, ["tenant", "labels_key"], "left_semi").select(*batch.columns)


def within_stream_limit(batch: DataFrame, known: DataFrame, max_streams: int) -> DataFrame:
    """Entries of streams that are known, or are among the first new ones that a tenant still has room for."""
    old = _streams(known)
    return _of(batch, old.unionByName(new_streams(batch, old, max_streams)))


def _known(spark: SparkSession, path: str, number: int) -> DataFrame:
    """tenant and labels_key of the streams that batches before this one brought; a table without the list gets it from its rows."""
    at = f"{path}.streams"
    if not files.exists(spark, at):
        if not any(n.startswith("batch=") for n in files.names(spark, path)):
            return spark.createDataFrame([], f"tenant string, labels_key {L.KEY_TYPE}")
        _streams(spark.read.schema(LOGS).parquet(f"{path}/batch=*")).write.mode("overwrite").parquet(f"{at}/batch=-1")
    return spark.read.schema(f"tenant string, labels_key {L.KEY_TYPE}, batch long").parquet(at).where(F.col("batch") < number).drop("batch")


def _time_of(spark: SparkSession, path: str, number: int, clock) -> int:
    """The time at which a batch was first taken."""
    at = f"{path}.times/{number}"
    if files.text(spark, at) is None:
        files.create(spark, at, str(clock()))
    return int(files.text(spark, at))


def ingest(stream: DataFrame, path: str, checkpoint: str, rejected: str | None = None, clock=lambda: time.time_ns(), max_streams: int | None = None, **trigger) -> StreamingQuery:
    """Write accepted entries to the day-partitioned table; others go to `rejected`.

    Spark's checkpoint holds what has been read, the time of each batch is kept in
    `<path>.times` and the streams that each brought in `<path>.streams`, so a batch
    that is run again after a failure has the same rows; each is written to a folder of
    its own number, and a repeated one overwrites it.
    """
    path = path.rstrip("/")

    def land(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        ok = accepted(_time_of(spark, path, number, clock))
        good = batch.where(ok)
        if max_streams is not None:
            old, at = _known(spark, path, number), f"{path}.streams/batch={number}"
            new_streams(good, old, max_streams).write.mode("overwrite").parquet(at)
            new = spark.read.schema(f"tenant string, labels_key {L.KEY_TYPE}").parquet(at)
            good = _of(good, old.unionByName(new))
        write_logs(good, f"{path}/batch={number}", mode="overwrite")
        if rejected:
            batch.where(~ok).withColumn("day", day_of(F.col("ts_ns"))).write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def landed(spark: SparkSession, path: str) -> DataFrame:
    """The table that ingest writes; entries that came in several batches are still one."""
    df = spark.read.schema(f"{LOGS}, day date").option("basePath", path).parquet(f"{path}/batch=*")
    df = df.withColumn("labels_key", L.labels_key(F.col("labels"))).withColumn("metadata_key", L.labels_key(F.col("metadata")))
    return df.dropDuplicates(["tenant", "ts_ns", "labels_key", "line", "metadata_key"]).drop("labels_key", "metadata_key", "batch")


def tail(stream: DataFrame, tenant: str, query: ast.LogQuery, deletes: list[masks.Delete] = ()) -> DataFrame:
    """A log query over a stream, each entry once; repeats are looked for as long as the watermark keeps them."""
    df = selection.entries(masks.scan(stream, tenant, deletes=deletes), query)
    df = df.withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000"))).withColumn("metadata_key", L.labels_key(F.col("metadata")))
    return df.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["ts_ns", "labels_key", "line", "metadata_key"]).drop("ts", "metadata_key")


class TailCursor:
    """A polled tail over a table: what lies after the last time seen, and what is new at that time."""

    def __init__(self, start_ns: int, limit: int = TAIL_LIMIT):
        self.at, self.seen, self.limit = start_ns, set(), limit

    def poll(self, logs: DataFrame, tenant: str, query: ast.LogQuery, end_ns: int, deletes: list[masks.Delete] = ()) -> list:
        rows = selection.newest(selection.entries(masks.scan(logs, tenant, self.at, end_ns, deletes), query), self.limit + len(self.seen), forward=True).collect()
        identity = lambda r: (r.ts_ns, tuple(map(tuple, r.labels_key)), r.line, tuple(sorted(r.metadata.items())))
        out = [r for r in rows if identity(r) not in self.seen][: self.limit]
        if out:
            last = out[-1].ts_ns
            kept = self.seen if last == self.at else set()
            self.at, self.seen = last, kept | {identity(r) for r in out if r.ts_ns == last}
        return out


def continuous_counts(stream: DataFrame, window: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Entries and bytes by stream in tumbling or sliding windows of event time, for dashboards that follow a stream."""
    df = stream.withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000"))).withColumn("series", L.labels_key(F.col("labels")))
    of = F.window("ts", window, slide) if slide else F.window("ts", window)
    return df.withWatermark("ts", delay).groupBy(of.alias("window"), "tenant", "series").agg(F.count("*").alias("entries"), F.sum(F.octet_length("line")).alias("bytes"))
