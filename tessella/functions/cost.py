"""Column functions over token counts and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: USD for a million input and output tokens.
PRICES = {
    "llama-3.3-70b-versatile": (0.59, 0.79),
    "llama-3.1-8b-instant": (0.05, 0.08),
    "openai/gpt-oss-20b": (0.075, 0.30),
    "openai/gpt-oss-120b": (0.15, 0.60),
}
CACHED_SHARE = 0.5


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, i, o) for m, (i, o) in PRICES.items()], "model string, in_usd double, out_usd double")


def priced(runs: DataFrame, model_col: str = "model") -> DataFrame:
    """runs with in_usd and out_usd; unknown models cost nothing."""
    table = F.broadcast(prices(runs.sparkSession).withColumnRenamed("model", "_model"))  # four rows
    joined = runs.join(table, F.col(model_col) == F.col("_model"), "left").drop("_model")
    return joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("in_usd", "out_usd")})


def net_cost(prompt: Column, cached: Column, completion: Column, in_usd: Column, out_usd: Column) -> Column:
    return ((prompt - cached) + cached * CACHED_SHARE) * in_usd / 1e6 + completion * out_usd / 1e6


def cache_net_cost(fresh: Column, cached: Column, output: Column, share: float, in_usd: Column, out_usd: Column, overhead: Column, overhead_usd: Column) -> Column:
    """Fresh input in full, cached input by its share, output, and the summarizer's tokens at its input price."""
    return (fresh + cached * share) * in_usd / 1e6 + output * out_usd / 1e6 + overhead * overhead_usd / 1e6


def reduction(base: Column, now: Column) -> Column:
    """Per cent that `now` lies below `base`; 0 without a base."""
    return F.when(base > 0, (base - now) * 100.0 / base).otherwise(0.0)


def change(base: Column, now: Column) -> Column:
    return -reduction(base, now)


def hit_rate(cached: Column, fresh: Column) -> Column:
    return F.coalesce(F.try_divide(cached.cast("double"), cached + fresh), F.lit(0.0))
