"""Aggregates that stay defined on constant or single-row groups."""

from pyspark.sql import Column, functions as F

from .time import col


def safe_corr(x, y) -> Column:
    """Pearson correlation; null instead of an error when a column is constant."""
    a, b = F.when(col(y).isNotNull(), col(x)), F.when(col(x).isNotNull(), col(y))
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.when(spread > 0, F.try_divide(F.covar_pop(a, b), spread))
