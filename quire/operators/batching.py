"""Batches, cache look-ups and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Batch numbers of ``size`` rows each within ``by``."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(n / size).cast("long"))


def greedy(lengths: Column, most: int = 12, chars: int = 6000) -> Column:
    """Batch number of each length: a new batch at ``most`` items or when the characters would exceed ``chars``; an item
    that is longer goes alone."""
    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("c"), F.array().cast("array<int>").alias("o"))

    def step(a: Column, x: Column) -> Column:
        new = (a["n"] > 0) & ((a["n"] >= most) | (a["c"] + x > chars))
        b = F.when(new, a["b"] + 1).otherwise(a["b"])
        return F.struct(b.alias("b"), F.when(new, 1).otherwise(a["n"] + 1).alias("n"), F.when(new, x.cast("long")).otherwise(a["c"] + x).alias("c"), F.concat(a["o"], F.array(b)).alias("o"))

    return F.aggregate(lengths, start, step, lambda a: a["o"])


def look_up(rows: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses)."""
    return rows.join(cache, key, "inner"), rows.join(cache.select(key), key, "left_anti")


def top(rows: DataFrame, by: str, first: Column, order: str, n: int) -> DataFrame:
    """The first ``n`` rows within ``by``, those with ``first`` before the others."""
    w = Window.partitionBy(by).orderBy(first.desc(), order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
