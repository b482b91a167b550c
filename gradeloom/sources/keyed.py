"""A table of keyed rows that is loaded key by key: refused, unchanged or replaced as a whole.

Rows are dealt to ``buckets`` partitions by a hash of their key. A load rewrites only the partitions of keys that
change, by dynamic partition overwrite: Spark writes them beside the table and moves them when all tasks are done, so
that a load that fails leaves the old rows. What a key is refused for is looked up in the plan that writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


class Refused(ValueError):
    """Keys that hold reviewed rows were to be loaded."""


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _digests(rows: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """key and a digest of its rows, whatever their order: count and sum of row hashes."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(key).agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(row).alias("h")).alias(name))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table's rows; none where nothing was loaded yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, {BUCKET} int").parquet(path).drop(BUCKET)


def verdicts(stored: DataFrame, incoming: DataFrame, key: str, reviewed: Column, overwrite_reviewed: bool = False) -> DataFrame:
    """key, verdict of every incoming key: refused (a stored row is reviewed), unchanged (the same rows) or loaded.

    A key without changes is unchanged even if it is reviewed: nothing would be lost."""
    columns = stored.columns
    held = stored.groupBy(key).agg(F.max(F.coalesce(reviewed, F.lit(False))).alias("_reviewed"))
    old = _digests(stored, key, columns, "_old").join(held, key)
    both = _digests(incoming, key, columns, "_new").join(old.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    refused = F.lit(not overwrite_reviewed) & F.coalesce(F.col("_reviewed"), F.lit(False))
    verdict = F.when(F.col("_new").eqNullSafe(F.col("_old")), "unchanged").when(refused, "refused").otherwise("loaded")
    return both.select(key, verdict.alias("verdict"))


def load(spark: SparkSession, path: str, schema: str, incoming: DataFrame, key: str, reviewed: Column, overwrite_reviewed: bool = False, strict: bool = False, buckets: int = 64) -> DataFrame:
    """Loads incoming rows and returns key, verdict. strict: one refused key refuses the whole load (Refused), and nothing is written.

    incoming has the schema's columns; the rows of a loaded key replace all its stored rows."""
    stored = read(spark, path, schema)
    incoming = incoming.select(*stored.columns)
    told = verdicts(stored, incoming, key, reviewed, overwrite_reviewed).cache()
    try:
        counts = {r.verdict: r["count"] for r in told.groupBy("verdict").count().collect()}
        if strict and counts.get("refused"):
            raise Refused(f"{counts['refused']} keys hold reviewed rows")
        report = spark.createDataFrame(told.collect(), told.schema)  # a row for each incoming key
        if counts.get("loaded"):
            changed = report.where("verdict = 'loaded'").select(F.col(key).alias("_k")).withColumn(BUCKET, _bucket("_k", buckets))
            same = F.col(key).eqNullSafe(F.col("_k"))
            kept = stored.withColumn(BUCKET, _bucket(key, buckets)).join(changed.select(BUCKET).distinct(), BUCKET, "left_semi").join(changed.drop(BUCKET), same, "left_anti")
            new = incoming.withColumn(BUCKET, _bucket(key, buckets)).join(changed.drop(BUCKET), same, "left_semi")
            rows = kept.select(*stored.columns, BUCKET).unionByName(new.select(*stored.columns, BUCKET))
            rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).option("partitionOverwriteMode", "dynamic").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        return report
    finally:
        told.unpersist()
