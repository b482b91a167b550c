"""Moving between records: neighbours, next pages, previews of children, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, group: list[str], order: list[str], key: str) -> DataFrame:
    """Adds previous and next, the keys beside a row in its group's order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("previous", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))


def next_minimum(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the smallest value of the rows behind in the group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(name, F.min(value).over(w))


def children_preview(children: DataFrame, parent: str, order: list[str], value: str, most: int = 8) -> DataFrame:
    """parent, n_children, preview: how many children and the first of them as one string."""
    w = Window.partitionBy(parent).orderBy(*order)
    ranked = children.withColumn("_k", F.row_number().over(w))
    first = F.array_sort(F.collect_list(F.when(F.col("_k") <= most, F.struct("_k", F.col(value).cast("string").alias("v")))))
    return ranked.groupBy(parent).agg(F.count(F.lit(1)).alias("n_children"), F.array_join(F.transform(first, lambda x: x["v"]), ",").alias("preview"))


def nested(parents: DataFrame, key: str, children: DataFrame, foreign: str, order: list[str], columns: list[str], name: str) -> DataFrame:
    """parents with an ordered array of their children; childless parents have an empty one."""
    rows = children.groupBy(foreign).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias(name))
    joined = parents.join(rows.withColumnRenamed(foreign, "_of"), parents[key] == F.col("_of"), "left").drop("_of")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(rows.schema[name].dataType)))


def ordinal_head(number: Column) -> Column:
    """The integer before the first dot of a number like 4.1; null if there is none."""
    return F.nullif(F.split_part(number, F.lit("."), F.lit(1)), F.lit("")).try_cast("int")


def in_range(number: Column, low: Column, high: Column) -> Column:
    """Whether a dotted number is in a range of dotted numbers. A bound that isn't a number is open; a number
    that isn't one is in no range that has a bound."""
    n, a, b = ordinal_head(number), ordinal_head(low), ordinal_head(high)
    open_ = a.isNull() & b.isNull()
    return open_ | F.coalesce((a.isNull() | (n >= a)) & (b.isNull() | (n <= b)), F.lit(False))


def preceding(headings: DataFrame, rows: DataFrame, group: str, at: str, name: str) -> DataFrame:
    """rows with the last heading at or before them in their group; both have group and at, headings has name."""
    events = headings.select(group, at, name, F.lit(0).alias("_kind")).unionByName(rows.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(group).orderBy(F.col(at), F.col("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(name, F.last(name, ignorenulls=True).over(w)).where("_kind = 1").drop("_kind")
