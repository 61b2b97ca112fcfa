"""Mergeable quantile sketches as rows: counts of logarithmic buckets, so a merge is a sum and nothing is sorted.

A value falls in the bucket whose bounds are ``growth`` apart; a quantile is answered by the middle of the bucket that
holds its rank, at most ERROR off relative to the exact value. A sketch of any number of values has at most a few
thousand rows (log of the values' range over log of growth). Sketches of hours merge into days, days into months, in any order.

Defined results: null and NaN values are left out; zero has a bucket of its own; negative values mirror positive ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

ERROR = 0.01
LOG_GROWTH = math.log((1 + ERROR) / (1 - ERROR))
MIDDLE = 1 - ERROR  # a bucket's upper bound times this is at most ERROR from all its values


def bucket_of(value: Column) -> Column:
    """Buckets in the order of their values: sign first, then the power of growth, which falls with the value where it is negative."""
    power = F.ceil(F.log(F.abs(value)) / LOG_GROWTH).cast("long")
    sign = F.signum(value).cast("int")
    return F.struct(sign.alias("sign"), F.when(sign == 0, F.lit(0)).otherwise(sign * power).cast("long").alias("power"))


def sketch(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, sign, power, n), partial counts in the tasks first."""
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, bucket_of(F.col(value)).alias("b"))
    return rows.groupBy(*keys, "b.sign", "b.power").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer keys to sketches of ``keys``."""
    return sketches.groupBy(*keys, "sign", "power").agg(F.sum("n").alias("n"))


def quantile(sketches: DataFrame, keys: list[str], q: float, name: str = "value") -> DataFrame:
    """(keys, name): the estimate of the value at rank ceil(q * n), at least the first."""
    w = Window.partitionBy(*keys)
    rows = sketches.withColumn("upto", F.sum("n").over(w.orderBy("sign", "power"))).withColumn("rank", F.greatest(F.ceil(F.sum("n").over(w) * q), F.lit(1)))
    hit = rows.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    return hit.select(*keys, (F.col("sign") * F.exp(F.abs("power") * F.signum(F.col("power") * F.col("sign")) * LOG_GROWTH) * MIDDLE).alias(name))
