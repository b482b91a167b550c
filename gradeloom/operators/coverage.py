"""Coverage, gaps and twins: what of the corpus exists in which scope."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Check = Callable[[DataFrame], DataFrame]


def zero_filled(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of an enumeration's values, 0 for those that don't occur."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def dual_scope(tasks: DataFrame, checks: dict[str, Check], status: str = "o_orderstatus") -> DataFrame:
    """check, corpus, parsed: each check's rows counted over the reviewed tasks and over all."""
    out = None
    for name, check in checks.items():
        found = check(tasks).select(F.lit(name).alias("check"), F.col(status).isin("F", "O").alias("_in"))
        out = found if out is None else out.unionByName(found)
    counted = out.groupBy("check").agg(F.count_if("_in").alias("corpus"), F.count(F.lit(1)).alias("parsed"))
    names = tasks.sparkSession.createDataFrame([(n,) for n in checks], "check string")
    return names.join(counted, "check", "left").select("check", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("corpus", "parsed")])


def twins(df: DataFrame, keys: list[str], more_than: int) -> DataFrame:
    """Groups with more members than a bound."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def ordered_list(value: str, order: Column | str, separator: str = ",") -> Column:
    """A group's values in order as one string; nulls keep their place as empty strings."""
    pairs = F.array_sort(F.collect_list(F.struct(F.isnull(order).alias("no"), F.col(order).alias("o") if isinstance(order, str) else order.alias("o"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v"))))
    return F.array_join(F.transform(pairs, lambda x: x["v"]), separator)


def missing_numbers(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """keys, missing: the integers of 1..max that a group lacks, as one string; groups without a gap are left out."""
    found = df.groupBy(*keys).agg(F.max(number).alias("_top"), F.collect_set(number).alias("_seen"))
    gaps = F.array_sort(F.array_except(F.sequence(F.lit(1), F.col("_top")), F.col("_seen")))
    return found.withColumn("_gaps", gaps).where(F.size("_gaps") > 0).select(*keys, F.array_join(F.col("_gaps").cast("array<string>"), ",").alias("missing"))


def free_points(df: DataFrame, keys: list[str], number: str, top: int) -> DataFrame:
    """keys, free: the highest number of 0..top that a group doesn't use yet; null if all are used."""
    used = df.groupBy(*keys).agg(F.collect_set(number).alias("_used"))
    rest = F.array_except(F.sequence(F.lit(0), F.lit(top)), F.col("_used"))
    return used.select(*keys, F.array_max(rest).cast("long").alias("free"))


def norm_or_gap(df: DataFrame, group: str, closed: Column, has: Column) -> DataFrame:
    """group, norm: True if no closed member has it, False if some have, null without closed members."""
    norm = F.when(F.count_if(closed) == 0, F.lit(None).cast("boolean")).otherwise(~F.bool_or(closed & has))
    return df.groupBy(group).agg(norm.alias("norm"))

