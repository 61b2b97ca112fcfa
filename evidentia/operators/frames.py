"""Shared relational operators: latest rows, per-group ranks, changes, upserts, densifying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each key. Spark pushes the rank limit below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def change(df: DataFrame, keys: list[str], order: list[Column], value: str = "value", lag: int = 1) -> DataFrame:
    """Percentage change to the row before, against its absolute value."""
    from ..functions.finance import percent_change

    before = F.lag(value, lag).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("prior_value", before).withColumn("change_pct", percent_change(F.col(value), F.col("prior_value")))


def upsert_series(df: DataFrame, keys: list[str], order: list[Column], value: str = "value", tolerance: float = 1e-6) -> DataFrame:
    """Keep an observation if it is the first of its key or differs from the one before; later ones are restated."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(value).over(w)
    out = df.withColumn("prior_value", before)
    return out.filter(F.col("prior_value").isNull() | (F.abs(F.col(value) - F.col("prior_value")) >= tolerance)).withColumn("is_restated", F.col("prior_value").isNotNull())


def merge_latest(current: DataFrame, updates: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """MERGE by key: the newest row of both tables wins."""
    return first_per(current.unionByName(updates), keys, *order).drop("rn")


def densify(axis_a: DataFrame, axis_b: DataFrame, facts: DataFrame, keys: list[str], fill: dict) -> DataFrame:
    """All combinations of two short axes, with defaults where there is no fact."""
    return axis_a.crossJoin(axis_b).join(facts, keys, "left").fillna(fill)
