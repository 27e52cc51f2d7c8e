"""Counts that come out of the pass that writes, without a job of their own.

An `Observation` holds its counts once an action on the rows has ended. A
stage that Spark runs again, after an executor was lost, may count its rows
again: take them as a report, not as a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, observed: Observation | None, **conditions: Column) -> DataFrame:
    """The rows unchanged; `observed` gets their number as `rows`, and how many meet each condition."""
    if observed is None:
        return df
    return df.observe(
        observed,
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()],
    )


def kept_rows(df: DataFrame, lost: str, condition: Column, observed: Observation | None) -> DataFrame:
    """Rows that do not meet a condition; those that do are counted under the name `lost`."""
    gone = F.coalesce(condition, F.lit(False))
    return counted(df, observed, **{lost: gone}).where(~gone)
