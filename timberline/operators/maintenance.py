"""Compaction, retention and physical deletes of the day-partitioned tables."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import LOGS, day_of, read, write_logs
from ..sources.versions import VersionedLogs
from . import masks
from .policies import Policies

#: Fixed value: the share of rows of a day beyond which expired rows are worth a rewrite.
REWRITE_SHARE = 0.5
TARGET_ROWS = 1_000_000
#: Fixed value: so many small files of a day are put together.
MERGE_FILES = 4


def _within(policies: Policies, now_ns: int) -> Column:
    """Whether retention still shows a row."""
    test = F.lit(True)
    for tenant in sorted(policies.rows):
        floor = policies.floor(tenant, now_ns)
        if floor is not None:
            test = test & ((F.col("tenant") != tenant) | (F.col("ts_ns") >= floor))
    return test


def _zero(policies: Policies) -> Column:
    """Rows of tenants that keep nothing."""
    zero = [t for t in policies.rows if policies.rows[t][1].strip() == "0"]
    return F.col("tenant").isin(zero) if zero else F.lit(False)


def kept(logs: DataFrame, policies: Policies, now_ns: int, deletes: list[masks.Delete] = ()) -> DataFrame:
    """Rows that neither retention nor a delete request takes away."""
    test = _within(policies, now_ns)
    for d in deletes:
        test = test & ((F.col("tenant") != d.tenant) | masks.visible([d]))
    return logs.where(test)


def _action(gone: Column) -> Column:
    """What becomes of the rows counted by rows and left, given those that are gone."""
    return F.when(F.col("left") == 0, "drop").when((gone > 0) & ((gone >= F.col("rows") * REWRITE_SHARE) | F.col("zero")), "rewrite").otherwise("keep")


def _counts(policies: Policies, now_ns: int) -> list[Column]:
    return [F.count("*").alias("rows"), F.count_if(_within(policies, now_ns)).alias("left"), F.coalesce(F.bool_or(_zero(policies)), F.lit(False)).alias("zero")]


def expired_days(logs: DataFrame, policies: Policies, now_ns: int) -> DataFrame:
    """day, rows and left for each day; a day with nothing left can go whole, and one with much expired is worth a rewrite."""
    days = logs.groupBy("day").agg(*_counts(policies, now_ns))
    return days.select("day", "rows", "left", _action(F.col("rows") - F.col("left")).alias("action"))


def _touched(logs: DataFrame, deletes: list[masks.Delete]) -> DataFrame:
    """gen and day of the folders that hold rows which a delete hides; the days of the deletes bound the scan."""
    test = F.lit(False)
    for d in deletes:
        days = F.col("day").between(day_of(F.lit(d.start_ns).cast("long")), day_of(F.lit(d.end_ns).cast("long")))
        test = test | (days & (F.col("tenant") == d.tenant) & ~masks.visible([d]))
    return logs.where(test).select("gen", "day").distinct()


def maintain(table: VersionedLogs, policies: Policies | None = None, now_ns: int = 0, deletes: list[masks.Delete] = (), target_rows: int = TARGET_ROWS) -> dict[str, str]:
    """Drop, rewrite or merge the folders of a table that call for it, in one new version; gives the action for each folder taken.

    A folder goes whole once nothing of it is left, is rewritten once half of it has
    expired or a delete hides some of it, and is merged where its day has several small
    files.  All other folders keep their files.  Where another writer has replaced one
    of the folders meanwhile, Conflict is raised and the table stays as that one left it.
    """
    policies, deletes, folders = policies or Policies(), list(deletes), table.folders()
    logs = table.load(folders)
    if not folders:
        return {}
    name = lambda r: f"gen={r.gen}/day={r.day}"
    by_file = logs.groupBy("gen", "day", F.col("_metadata.file_path").alias("file")).agg(*_counts(policies, now_ns))
    stats = by_file.groupBy("gen", "day").agg(F.sum("rows").alias("rows"), F.sum("left").alias("left"), F.bool_or("zero").alias("zero"), F.count("*").alias("files"))
    rows = stats.withColumn("action", _action(F.col("rows") - F.col("left"))).collect()  # one for each folder of the manifest
    hit = {name(r) for r in _touched(logs, deletes).collect()} if deletes else set()
    actions = {name(r): "rewrite" if r.action == "keep" and name(r) in hit else r.action for r in rows}
    small = defaultdict(list)
    for r in rows:
        if actions[name(r)] == "rewrite" or (actions[name(r)] == "keep" and 2 * r.rows < r.files * target_rows):
            small[r.day].append(r)
    for group in small.values():
        many, after = sum(r.files for r in group), -(-sum(r.rows for r in group) // target_rows)
        if many >= MERGE_FILES and after < many:
            actions |= {name(r): "merge" for r in group if actions[name(r)] == "keep"}
    taken = {f: a for f, a in actions.items() if a != "keep"}
    if taken:
        anew = frozenset(f for f, a in taken.items() if a != "drop")
        left = sum(r.left for r in rows if name(r) in anew)
        out = kept(table.load(anew), policies, now_ns, deletes).drop("gen", "day") if anew else None
        table.commit(table.write(out, max(1, -(-left // target_rows))) if anew else frozenset(), frozenset(taken))
    return taken


def rewrite(spark: SparkSession, path: str, to: str, policies: Policies | None = None, now_ns: int = 0, deletes: list[masks.Delete] = (), target_rows: int = TARGET_ROWS) -> list[str]:
    """Write the table anew, compacted, without expired, deleted and repeated rows; gives the ids of the deletes that are done.

    The new table is a folder of its own: readers move to it when it is whole.
    """
    logs = read(spark, path, LOGS)
    rows = kept(logs, policies or Policies(), now_ns, list(deletes)).drop("day")
    write_logs(rows, to, mode="overwrite", tasks=max(1, -(-rows.count() // target_rows)))
    return [d.request_id for d in deletes]
