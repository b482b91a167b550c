"""Health checks and constraints as queries that return what violates them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without(parents: DataFrame, key: str, children: DataFrame, foreign: str) -> DataFrame:
    """Parents that no child refers to."""
    return parents.join(children.select(F.col(foreign).alias("_f")), parents[key] == F.col("_f"), "left_anti")


def within(parents: DataFrame, key: str, children: DataFrame, foreign: str) -> DataFrame:
    """Parents that a child refers to."""
    return parents.join(children.select(F.col(foreign).alias("_f")), parents[key] == F.col("_f"), "left_semi")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n of key values that occur more than once; nulls are equal."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(children: DataFrame, foreign: str, parents: DataFrame, key: str) -> DataFrame:
    """Children with a reference to nothing; a null refers to nobody and is none."""
    known = parents.select(F.col(key).alias("_k"))
    return children.where(F.col(foreign).isNotNull()).join(known, F.col(foreign) == F.col("_k"), "left_anti")


def broken(df: DataFrame, check: Column) -> DataFrame:
    """Rows for which a check is false; null passes."""
    return df.where(~F.coalesce(check, F.lit(True)))


def counts(checks: dict[str, Callable[[], DataFrame]], only_failing: bool = False) -> DataFrame:
    """check, n of every check, in one plan."""
    out = None
    for name, check in checks.items():
        one = check().groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0") if only_failing else out
