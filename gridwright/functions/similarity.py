"""Normalised indel similarity, 2 * LCS / (len a + len b), as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def indel_ratio(a: Column, b: Column) -> Column:
    """1.0 for two empty strings.  The accumulator is one row of the longest-common-subsequence table."""
    chars = lambda s: F.filter(F.split(s, ""), lambda x: x != "")
    start = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(last: Column, x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.length(b)),
            F.array(F.lit(0)),
            lambda made, j: F.array_append(
                made,
                F.when(F.substr(b, j, F.lit(1)) == x, F.element_at(last, j) + 1).otherwise(
                    F.greatest(F.element_at(last, j + 1), F.element_at(made, -1))
                ),
            ),
        )

    common = F.element_at(F.aggregate(chars(a), start, row), -1)
    total = F.length(a) + F.length(b)
    return (
        F.when(total == 0, F.lit(1.0))
        .when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .otherwise(2.0 * common / F.when(total > 0, total))
    )
