"""Logs under numbered manifests: a reader sees one whole version, and of two writers of a version one gives way.

A write makes a folder of its own, `parts/gen=<id>`, with a folder for each day; a manifest names the day folders
that make up the table.  A folder that is no longer named stays until `sweep`, for the readers of older versions.
"""

from __future__ import annotations

import json
import time
import uuid

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .tables import LOGS, write_logs

#: How long folders that no manifest names are left to a writer that may yet commit them.
ORPHAN_S = 24 * 3600
#: Numbers that pieces of three characters are hashed to.
PIECES = 1 << 20


def pieces(text: Column) -> Column:
    """Distinct numbers of the three characters at each place of a text: a text that holds another has all of its."""
    c = F.split(text, "")
    of = F.transform(F.sequence(F.lit(2), F.size(c) - 1), lambda i: F.pmod(F.xxhash64(c[i - 2], c[i - 1], c[i]), F.lit(PIECES)).cast("int"))
    return F.when(F.size(c) >= 3, F.array_distinct(of)).otherwise(F.array().cast("array<int>"))


class Conflict(RuntimeError):
    """Another writer has taken what this one was to replace."""


class Document:
    """A small JSON document in numbered versions; who writes names the version that it read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> tuple[int, object]:
        """The last version and its content; 0 and none before the first."""
        last = max((int(n.removesuffix(".json")) for n in files.names(self.spark, self.path) if n.endswith(".json")), default=0)
        return last, json.loads(files.text(self.spark, f"{self.path}/{last:012d}.json")) if last else None

    def write(self, content, after: int) -> int:
        if not files.create(self.spark, f"{self.path}/{after + 1:012d}.json", json.dumps(content)):
            raise Conflict(f"{self.path} has a version after {after}")
        return after + 1


class VersionedLogs:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in files.names(self.spark, f"{self.path}/manifests") if n.endswith(".json"))

    def folders(self, version: int | None = None) -> frozenset[str]:
        """`gen=.../day=...` of each folder of a version, the last one unless given."""
        version = max(self.versions(), default=0) if version is None else version
        return frozenset(json.loads(files.text(self.spark, f"{self.path}/manifests/{version:012d}.json"))) if version else frozenset()

    def load(self, folders: frozenset[str]) -> DataFrame:
        """Rows of day folders, with the columns gen and day that they are partitioned by."""
        schema = f"{LOGS}, gen string, day date"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/parts").parquet(*(f"{self.path}/parts/{f}" for f in sorted(folders)))

    def read(self, version: int | None = None, containing: Collection[str] = ()) -> DataFrame:
        """A version's rows; with texts that each line is to contain, only of files that may hold such lines."""
        folders = self.folders(version)
        return self.load(self._holding(folders, containing) if containing else folders).drop("gen")

    def _holding(self, folders: frozenset[str], texts: Collection[str]) -> frozenset[str]:
        """The folders that have no index, and of the others the files whose lines have all pieces of the texts."""
        wanted = self.spark.createDataFrame([(t,) for t in texts], "t string").select(F.explode(pieces(F.col("t")))).distinct()
        wanted = [r[0] for r in wanted.collect()]
        indexed = set(files.names(self.spark, f"{self.path}/pieces"))
        known = frozenset(f for f in folders if f.split("/")[0] in indexed)
        if not wanted or not known:
            return folders
        index = self.spark.read.schema("file string, piece int, gen string").option("basePath", f"{self.path}/pieces").parquet(*sorted({f"{self.path}/pieces/{f.split('/')[0]}" for f in known}))
        found = index.where(F.col("piece").isin(wanted)).groupBy("gen", "file").agg(F.count_distinct("piece").alias("n")).where(F.col("n") == len(wanted))
        return folders - known | {x for r in found.collect() if (x := f"gen={r.gen}/{r.file}").rsplit("/", 1)[0] in known}

    def write(self, logs: DataFrame, tasks: int | None = None, index: bool = True) -> frozenset[str]:
        """New day folders, which no version names yet, with an index of what pieces the lines of each file have."""
        gen = f"gen={uuid.uuid4().hex}"
        write_logs(logs, f"{self.path}/parts/{gen}", tasks=tasks)
        folders = frozenset(f"{gen}/{n}" for n in files.names(self.spark, f"{self.path}/parts/{gen}") if n.startswith("day="))
        if index and folders:
            file = F.concat(F.lit("day="), F.col("day").cast("string"), F.lit("/"), F.col("_metadata.file_name"))
            of = self.load(folders).select(file.alias("file"), F.explode(pieces(F.col("line"))).alias("piece")).distinct()
            of.repartitionByRange("piece").sortWithinPartitions("piece").write.parquet(f"{self.path}/pieces/{gen}")
        return folders

    def commit(self, added: frozenset[str], removed: frozenset[str] = frozenset()) -> int:
        """A version with some folders in the place of others, after whichever is the last by then; appends so never fail."""
        while True:
            last = max(self.versions(), default=0)
            now = self.folders(last)
            if not removed <= now:
                raise Conflict(f"version {last} no longer has {sorted(removed - now)}")
            if files.create(self.spark, f"{self.path}/manifests/{last + 1:012d}.json", json.dumps(sorted(now - removed | added))):
                return last + 1

    def append(self, logs: DataFrame) -> int:
        return self.commit(self.write(logs))

    def sweep(self, keep: int = 2, orphan_s: float = ORPHAN_S) -> list[str]:
        """Remove day folders that none of the last versions names, and the older manifests; those of late stay for their writers."""
        versions, now = self.versions(), time.time()
        named = frozenset().union(*(self.folders(v) for v in versions[-keep:]))
        gone = []
        for gen in files.names(self.spark, f"{self.path}/parts"):
            for day in files.names(self.spark, f"{self.path}/parts/{gen}"):
                folder = f"{gen}/{day}"
                if day.startswith("day=") and folder not in named and files.age_s(self.spark, f"{self.path}/parts/{folder}", now) >= orphan_s:
                    files.remove(self.spark, f"{self.path}/parts/{folder}")
                    gone.append(folder)
        left = {f.split("/")[0] for f in named} | set(files.names(self.spark, f"{self.path}/parts")) - {f.split("/")[0] for f in gone}
        for gen in set(files.names(self.spark, f"{self.path}/pieces")) - left:
            files.remove(self.spark, f"{self.path}/pieces/{gen}")
        for v in versions[:-keep]:
            files.remove(self.spark, f"{self.path}/manifests/{v:012d}.json")
        return gone
