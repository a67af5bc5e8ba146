"""What there is: labels, series, volumes, detected labels and fields, line patterns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..plans import ast
from . import ranges, selection

#: Limits of the endpoints.
MAX_SELECTORS, FIELD_SAMPLE = 32, 1000
PATTERN_SAMPLE, PATTERN_CLUSTERS, PATTERN_SIMILARITY = 5000, 100, 0.6
WILDCARD = "<_>"


def label_names(logs: DataFrame) -> DataFrame:
    return logs.select(F.explode(F.map_keys("labels")).alias("label")).distinct().orderBy("label")


def label_values(logs: DataFrame, name: str) -> DataFrame:
    return logs.select(F.element_at("labels", name).alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value")


def series(logs: DataFrame, selectors: list[ast.LogQuery]) -> DataFrame:
    """Distinct label sets that any of the selectors matches; their stages do not count, and no selector matches nothing."""
    if len(selectors) > MAX_SELECTORS:
        raise ValueError(f"more than {MAX_SELECTORS} selectors")
    test: Column = reduce(Column.__or__, (selection.matches_all(q.matchers) for q in selectors), F.lit(False))
    return logs.where(test).select(L.labels_key(F.col("labels")).alias("series")).distinct().orderBy("series")


def stats(logs: DataFrame, query: ast.LogQuery) -> DataFrame:
    """Streams, entries and bytes of a selector."""
    rows = logs.where(selection.matches_all(query.matchers)).select(L.labels_key(F.col("labels")).alias("series"), F.octet_length("line").alias("bytes"))
    per = rows.groupBy("series").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return per.agg(F.count("*").alias("streams"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def volume_query(query: ast.LogQuery, range_ns: int, targets: tuple[str, ...] = ()) -> ast.Metric:
    """Bytes of a selector, without its stages, by stream or by target labels."""
    bytes_ = ast.Range("bytes_over_time", ast.LogQuery(query.matchers), range_ns)
    return ast.Aggregate("sum", bytes_, ast.Grouping(tuple(sorted(set(targets))))) if targets else bytes_


def volume(logs: DataFrame, query: ast.LogQuery, start_ns: int, end_ns: int, targets: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """series and bytes in (start, end], the largest first if there is a limit; bounds are cut to milliseconds."""
    start_ns, end_ns = start_ns - start_ns % 10**6, end_ns - end_ns % 10**6
    out = ranges.metric(logs, volume_query(query, end_ns - start_ns, targets), ranges.Grid.instant(end_ns)).select("series", F.col("value").cast("long").alias("bytes"))
    return out if limit is None else out.orderBy(F.desc("bytes"), "series").limit(limit)


def volume_range(logs: DataFrame, query: ast.LogQuery, start_ns: int, end_ns: int, step_ns: int, targets: tuple[str, ...] = ()) -> DataFrame:
    """series, k and bytes for each step."""
    grid = ranges.Grid.between(start_ns, end_ns, step_ns)
    return ranges.metric(logs, volume_query(query, step_ns, targets), grid).select("series", "k", F.col("value").cast("long").alias("bytes"))


def detected_labels(logs: DataFrame) -> DataFrame:
    """label and its number of distinct values."""
    pairs = logs.select(F.explode(F.map_entries("labels")).alias("x")).select(F.col("x.key").alias("label"), F.col("x.value").alias("value")).distinct()
    return pairs.groupBy("label").agg(F.count("*").alias("cardinality")).orderBy("label")


def detected_fields(logs: DataFrame, query: ast.LogQuery, sample: int = FIELD_SAMPLE) -> DataFrame:
    """field, type and cardinality over the newest lines."""
    lines = selection.newest(selection.entries(logs, query), sample)
    x = lines.select(F.explode(F.map_entries("metadata")).alias("x")).select(F.col("x.key").alias("field"), F.col("x.value").alias("value"))
    whole = F.col("value").rlike(r"^[+-]?[0-9]+\z") & F.col("value").try_cast("long").isNotNull()
    number = F.col("value").rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z|^[+-]?(?i:inf|infinity|nan)\z")
    kinds = x.groupBy("field").agg(F.bool_and(whole).alias("w"), F.bool_and(number).alias("n"), F.bool_and(F.col("value").isin("true", "false")).alias("b"), F.count_distinct("value").alias("cardinality"))
    kind = F.when(F.col("w"), "int").when(F.col("n"), "float").when(F.col("b"), "boolean").otherwise("string")
    return kinds.select("field", kind.alias("type"), "cardinality").orderBy("field")


def tokens(line: Column) -> Column:
    """Words of a line; one that holds a digit is a wildcard."""
    words = F.filter(F.split(line, r"(?U)\s+"), lambda t: t != "")
    return F.transform(words, lambda t: F.when(t.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(t))


def clustered(lines: Iterable[tuple[int, list[str]]], step_ns: int) -> list[tuple[str, int, int]]:
    """(pattern, bucket, lines) of (time, words) in their order, the most frequent pattern first.

    Templates of one length are the rows of a table of word numbers, 0 for a
    wildcard, and a line is compared with all rows at once; the first row of which
    enough fixed words agree takes the line in.
    """
    number = {WILDCARD: 0}
    tables: dict[int, np.ndarray] = {}
    made, joined = 0, []
    for ts_ns, words in lines:
        size = len(words)
        line = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        table = tables.get(size, np.zeros((0, size), np.int64))
        fixed, agree = table != 0, table == line
        share = (fixed & agree).sum(axis=1) / np.maximum(fixed.sum(axis=1), 1)
        close = np.flatnonzero(np.where(fixed.any(axis=1), share >= PATTERN_SIMILARITY, agree.all(axis=1)))
        if not size or not len(close) and made >= PATTERN_CLUSTERS:
            continue
        if len(close):
            row = int(close[0])
            table[row, ~agree[row]] = 0
        else:
            row, made = len(table), made + 1
            tables[size] = np.vstack([table, line])
        joined.append((size, row, ts_ns - ts_ns % step_ns))
    word = list(number)
    text = {(size, row): " ".join(word[k] for k in template) for size, table in tables.items() for row, template in enumerate(table.tolist())}
    cells = Counter((text[size, row], bucket) for size, row, bucket in joined)
    whole = Counter(text[size, row] for size, row, _ in joined)
    return [(t, b, n) for (t, b), n in sorted(cells.items(), key=lambda x: (-whole[x[0][0]], *x[0]))]


def patterns(logs: DataFrame, query: ast.LogQuery, start_ns: int, end_ns: int, step_ns: int | None = None, sample: int = PATTERN_SAMPLE) -> DataFrame:
    """pattern, bucket_ns, n over a sample of the newest lines.

    Clusters depend on the order of lines, so the sample, which is bounded, goes
    through one task: streams in the order of labels, newest lines first.
    """
    step = step_ns or max(10**9, (end_ns - start_ns) // 60)
    lines = selection.newest(selection.entries(logs, query), sample).select("labels_key", "ts_ns", "line", tokens(F.col("line")).alias("words"))

    def mine(batches):
        import pyarrow as pa

        rows = clustered(((ts, words) for b in batches for ts, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), step)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["pattern", "bucket_ns", "n"])

    ordered = lines.coalesce(1).sortWithinPartitions("labels_key", F.desc("ts_ns"), "line").select("ts_ns", "words")
    return ordered.mapInArrow(mine, "pattern string, bucket_ns long, n long")
