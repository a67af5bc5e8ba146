"""Operators over (series, k, value): grouping, top k, arithmetic and comparison with a number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..plans import ast


def aggregate(vector: DataFrame, op: str, grouping: ast.Grouping | None) -> DataFrame:
    """sum, avg, min or max over the series of a group, at each point."""
    if grouping is None:
        key = F.array().cast(L.KEY_TYPE)
    elif grouping.without:
        key = L.drop(F.col("series"), list(grouping.names))
    else:
        key = L.keep(F.col("series"), list(grouping.names))
    f = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[op]
    return vector.withColumn("series", key).groupBy("series", "k").agg(f("value").alias("value"))


def top(vector: DataFrame, k: int) -> DataFrame:
    """At each point the k series of the largest values; of equal ones those whose labels come first."""
    order = Window.partitionBy("k").orderBy(F.col("value").desc(), "series")
    return vector.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def with_scalar(vector: DataFrame, op: str, number: float, scalar_left: bool) -> DataFrame:
    """Arithmetic with a number; a comparison keeps its left operand, or drops the series."""
    v, n = F.col("value"), F.lit(float(number))
    a, b = (n, v) if scalar_left else (v, n)
    if op in ("==", "!=", ">", "<", ">=", "<="):
        test = {"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
        return vector.where(test).withColumn("value", a)
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    if op == "/":
        out = F.when((b == 0) & ((a == 0) | F.isnan(a)), nan).when(b == 0, F.signum(a) * inf).otherwise(F.try_divide(a, b))
    elif op == "%":
        out = F.when((b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == inf), nan).when(F.abs(b) == inf, a).otherwise(F.try_mod(a, F.when(b == 0, F.lit(1.0)).otherwise(b)))
    else:
        out = {"+": a + b, "-": a - b, "*": a * b}[op]
    return vector.withColumn("value", out)
