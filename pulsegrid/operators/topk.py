"""Top-k, sampling and set operations (TK-*, SO-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .sessions import PID


def top_by_count(df: DataFrame, k: int, pid=PID) -> DataFrame:
    """Participants with the most rows (TK-1)."""
    return df.groupBy(pid).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), pid).limit(k)


def top_by_sum(df: DataFrame, value: str, k: int, pid=PID) -> DataFrame:
    """Participants with the largest sum (TK-2)."""
    return df.groupBy(pid).agg(F.sum(value).alias("total")).orderBy(F.col("total").desc(), pid).limit(k)


def top_words(docs: DataFrame, word: str, k: int = 10, by: Sequence[str] = (PID,)) -> DataFrame:
    """Most frequent words per group (TK-3)."""
    counts = docs.groupBy(*by, word).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), word)
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_abs_corr(corr: DataFrame, k: int = 3, by: Sequence[str] = (PID,), value="r", tie: Sequence[str] = ("x", "y")) -> DataFrame:
    """Strongest absolute correlations per group (TK-4)."""
    w = Window.partitionBy(*by).orderBy(F.abs(value).desc(), *tie)
    return corr.filter(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def sample_days(days: DataFrame, n: int, seed: int, by: Sequence[str], day="day") -> DataFrame:
    """``n`` days per class without replacement, drawn by hash so reruns agree (TK-5)."""
    draw = F.xxhash64(*by, day, F.lit(seed))
    w = Window.partitionBy(*by).orderBy(draw, day)
    return days.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def order_by_spread(scores: DataFrame, spread="spread") -> DataFrame:
    return scores.orderBy(F.col(spread).desc())


def union_all(*dfs: DataFrame) -> DataFrame:
    """All part results (SO-1)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def ids_union(a: DataFrame, b: DataFrame, pid=PID) -> DataFrame:
    return a.select(pid).distinct().union(b.select(pid).distinct()).distinct()


def grid_minus(grid: DataFrame, seen: DataFrame, on: Sequence[str]) -> DataFrame:
    """Grid points without an observation (SO-2)."""
    return grid.join(seen.select(*on).distinct(), list(on), "left_anti")


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()
