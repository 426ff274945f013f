"""Error metrics of predictions as aggregate expressions; pairs with a missing side are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _both(observed: Column, predicted: Column) -> tuple[Column, Column]:
    known = observed.isNotNull() & predicted.isNotNull()
    return F.when(known, observed), F.when(known, predicted)


def mae(observed: Column, predicted: Column) -> Column:
    return F.avg(F.abs(observed - predicted))


def rmse(observed: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((observed - predicted) * (observed - predicted)))


def mape(observed: Column, predicted: Column) -> Column:
    """In per cent, of observations that aren't zero."""
    return F.avg(F.when(F.abs(observed) > 1e-6, F.abs((observed - predicted) / observed))) * 100


def r2(observed: Column, predicted: Column) -> Column:
    """1 - residual over total sum of squares; null for fewer than two pairs or equal observations."""
    o, p = _both(observed, predicted)
    total = F.var_pop(o) * F.count(o)
    return F.when((F.count(o) >= 2) & (total > 0), 1 - F.sum((o - p) * (o - p)) / total)


def r2_floored(observed: Column, predicted: Column) -> Column:
    """R2 within -1 and 1: -1 stands for anything worse than the mean."""
    x = r2(observed, predicted)
    return F.when(x.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
