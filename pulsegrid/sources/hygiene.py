"""Cleaning at ingest (SRC-6..SRC-10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def survey_of_type(df: DataFrame, kind: str, column="survey_type") -> DataFrame:
    return df.filter(F.col(column) == kind)


def union_cohorts(*dfs: DataFrame, header: tuple[str, str] | None = None) -> DataFrame:
    """Union cohort tables by name; drop repeated header rows (SRC-7).

    ``header`` is ``(column, text)`` that marks a header row.
    """
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out if header is None else out.filter(~F.col(header[0]).eqNullSafe(header[1]))


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """One row per key, the first or last in ``order`` (SRC-8).

    Give value columns only as keys to collapse equal readings at different
    times.  The rank filter limits rows before the shuffle, so a key with very
    many copies sends one row per task.
    """
    ordered = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*ordered)))
    return ranked.filter(F.col("_rn") == 1).drop("_rn")


def order(df: DataFrame, time="ts", ascending=True) -> DataFrame:
    """Sort at a sink (SRC-9)."""
    return df.orderBy(F.col(time).asc() if ascending else F.col(time).desc())


def fill_const(df: DataFrame, value, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing to a constant (SRC-10)."""
    return df.fillna(value, subset=list(cols) if cols else None)


def sentinel_to_null(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Null wherever a column's rule holds (zeros, negative padding, blanks)."""
    return df.withColumns({c: F.when(~F.coalesce(rule, F.lit(False)), F.col(c)) for c, rule in rules.items()})
