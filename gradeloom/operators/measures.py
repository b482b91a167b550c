"""Effort, rates and costs measured from events and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gate import share


def durations(df: DataFrame, keys: list[str], seconds: str, long: float) -> DataFrame:
    """keys, n, median_s, total_s, n_long: the exact median, the mean of the middle two for an even count."""
    return df.groupBy(*keys).agg(
        F.count(seconds).alias("n"), F.round(F.coalesce(F.median(seconds), F.lit(0.0)), 4).alias("median_s"), F.round(F.coalesce(F.sum(seconds), F.lit(0.0)), 2).alias("total_s"), F.count_if(F.col(seconds) > long).alias("n_long"),
    )


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds of a timestamp difference, with fractions."""
    return (end - start).cast("decimal(18,6)").cast("double")


def arms(df: DataFrame, arm: str, measures: dict[str, Column]) -> DataFrame:
    """One row with each measure of both arms and its difference, treated minus control; arm is a boolean column."""
    both = [F.round(m, 6).alias(n) for n, m in measures.items()]
    grouped = df.groupBy().pivot(arm, [True, False]).agg(*both, F.count(F.lit(1)).alias("n"))
    names = [*measures, "n"]
    cols = [F.col(f"true_{n}").alias(f"{n}_with") for n in names] + [F.col(f"false_{n}").alias(f"{n}_without") for n in names]
    return grouped.select(*cols, *[F.round(F.col(f"true_{n}") - F.col(f"false_{n}"), 6).alias(f"{n}_gain") for n in measures])


def hit_share(approved: Column, corrected: Column) -> Column:
    """Approved of those approved or corrected; rejected ones don't count."""
    return share(approved, approved + corrected)


def priced(usage: DataFrame, prices: DataFrame, key: str, tokens: str, discount: float = 1.0) -> DataFrame:
    """usage with cost: tokens times the key's price for a million, times a discount; unknown keys cost nothing."""
    joined = usage.join(prices, key, "left")
    return joined.withColumn("cost", F.round(F.col(tokens) * F.coalesce("price", F.lit(0.0)) * discount / 1_000_000, 6)).drop("price")
