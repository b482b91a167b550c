"""Digests and differences of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse


def digest(parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of an array of texts, white space collapsed, in order."""
    return F.substring(F.sha2(F.array_join(F.transform(parts, lambda x: collapse(x)), "\n"), 256), 1, 16)


def difference(old: DataFrame, new: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """keys, change and each measure's old and new value: + added, - removed, ~ changed; equal rows are left out."""
    a = old.select(*keys, F.struct(*measures).alias("_old"))
    b = new.select(*keys, F.struct(*measures).alias("_new"))
    change = F.when(F.col("_old").isNull(), "+").when(F.col("_new").isNull(), "-").when(~F.col("_old").eqNullSafe(F.col("_new")), "~")
    both = a.join(b, keys, "full").withColumn("change", change).where("change is not null")
    return both.select(*keys, "change", *[F.col(f"_{s}.{m}").alias(f"{m}_{s}") for m in measures for s in ("old", "new")])
