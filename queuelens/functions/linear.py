"""Small linear systems as column expressions: what a fit's normal equations need after their sums are taken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def solved(matrix: Column, rhs: Column, size: int) -> Column:
    """x of matrix x = rhs, by elimination without exchanges: for symmetric positive definite systems, as damped normal
    equations are. matrix: array of rows; null or NaN where it is singular."""
    rows = F.transform(matrix, lambda row, i: F.concat(row, F.array(rhs[i])))

    def eliminated(m: Column, p: Column) -> Column:
        top = F.transform(m[p], lambda x: F.try_divide(x, m[p][p]))
        return F.transform(m, lambda row, i: F.when(i == p, top).otherwise(F.zip_with(row, top, lambda a, b: a - row[p] * b)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), rows, eliminated)
    return F.transform(done, lambda row: row[size])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
