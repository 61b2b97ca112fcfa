"""Model classes, blended prices and the usage rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Prices per million tokens, three quarters input and one quarter output.
PRICES = {"claude": "30.0", "gpt-4o": "4.375", "local": "0.0"}


def model_class(name: Column) -> Column:
    return F.when(name.isNull() | (name == ""), "local").when(name.contains("claude"), "claude").when(name.contains("gpt"), "gpt-4o").otherwise("local")


def price(model: Column) -> Column:
    out = F.lit(None).cast("decimal(18,6)")
    for name, usd in PRICES.items():
        out = F.when(model == name, F.lit(usd).cast("decimal(18,6)")).otherwise(out)
    return out


def cost(tokens: Column, model: Column) -> Column:
    return (tokens.cast("decimal(20,0)") * price(model)).cast("double") / 1_000_000


def cents(usd: Column) -> Column:
    """Rounded to two places as the twins do it: what hundred times the double comes to, halves to even."""
    return F.rint(usd * 100) / 100


def rollup(log: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens and cost by keys: integer sums per model class first, prices afterwards."""
    spend = F.sum(F.col("tokens_used").cast("decimal(20,0)") * price(F.col("model")))
    return log.groupBy(*keys).agg(F.sum("tokens_used").cast("long").alias("tokens"), cents(spend.cast("double") / 1_000_000).alias("cost_usd"))
