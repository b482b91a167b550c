"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage, survives the loss of any executor, can be pruned by column, and has
a size that Spark knows, so that it is broadcast only if it really is small.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of our own only in local mode, where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", "")
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="gradeloom-")
    return _LOCAL[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no result reads any more."""
    for table in tables:
        path = getattr(table, "_written_to", None)
        if path:
            spark = table.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def join_uneven(rows: DataFrame, lookup: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join on key, lookup having each key once with n, the number of rows that have it.

    Keys of more than a ten-thousandth of all rows (and of 1000 rows at least), of which there can't be more
    than 10,000, are broadcast; the others are shuffled and none of them is hot."""
    from pyspark.sql import functions as F

    bound = max(1000, total // 10_000)
    hot = lookup.where(F.col(n) > bound).drop(n)
    if not hot.limit(1).count():
        return rows.join(lookup.drop(n), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(lookup.where(F.col(n) <= bound).drop(n), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def with_outputs(row: str, inputs: list[str], outputs: list[str]) -> list:
    """Select list: the packed input columns, those that clash with an output left out, then the outputs."""
    from pyspark.sql import functions as F

    return [F.col(row)[c].alias(c) for c in inputs if c not in outputs] + [F.col(c) for c in outputs]
