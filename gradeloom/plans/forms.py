"""A record and what a reader makes of it, as a form; the SQL says the same path by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recordform
from ..session import table as t
from .registry import query


@query("""WITH c AS (SELECT l_orderkey AS k, l_linenumber AS id, count(*) AS p, min(l_returnflag) AS d, min(l_linestatus) AS s FROM lineitem GROUP BY 1, 2), k AS (SELECT DISTINCT k FROM c)
 SELECT k, unnest(['task.number', 'task.max_points', 'task.kind', 'add_requirement']) AS path, unnest([k::VARCHAR, '3', 'short', '']) AS value FROM k
 UNION ALL SELECT k, 'criterion.' || id || unnest(['.points', '.label', '.description']), unnest([(p + 1)::VARCHAR, '', d]) FROM c WHERE id % 3 > 0 UNION ALL SELECT k, 'condition.' || id * 10 || '.description', s FROM c WHERE id % 3 > 0 AND id % 2 = 1
 UNION ALL SELECT k, 'delete.criterion.' || id, '1' FROM c WHERE id % 3 = 0 UNION ALL SELECT k, 'delete.condition.' || id * 10, '1' FROM c WHERE id % 3 > 0 AND id % 2 = 0""")
def record_forms(spark: SparkSession, d: str) -> DataFrame:
    """Each order's lines as criteria with a condition; the reader drops, raises and rewords some."""
    # dealt out by order once: every step after it finds an order's rows together
    slim = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("id"), "l_returnflag", "l_linestatus").repartition("k")
    lines = slim.groupBy("k", "id").agg(F.count(F.lit(1)).cast("int").alias("p"), F.min("l_returnflag").alias("d"), F.min("l_linestatus").alias("s"))

    def records(rows: DataFrame, points: int, with_condition) -> DataFrame:  # noqa: ANN001
        none = F.array().cast("array<struct<id:long,expression:string>>")
        condition = F.struct((F.col("id") * 10).alias("id"), F.col("s").alias("description"), none.alias("expressions"))
        conditions = F.when(with_condition, F.array(condition)).otherwise(F.array().cast("array<struct<id:long,description:string,expressions:array<struct<id:long,expression:string>>>>"))
        criterion = F.struct("id", (F.col("p") + points).alias("points"), F.lit(None).cast("string").alias("label"), F.col("d").alias("description"), conditions.alias("conditions"))
        versions = F.array().cast("array<struct<id:long,content:string,answers:array<struct<id:long,answer:string>>>>")
        made = rows.groupBy("k").agg(F.sort_array(F.collect_list(F.when(F.col("kept"), criterion))).alias("criteria"))
        return made.select("k", F.col("k").cast("string").alias("number"), F.lit(3).alias("max_points"), F.lit("short").alias("kind"), versions.alias("versions"), "criteria")

    stored = records(lines.withColumn("kept", F.lit(True)), 0, F.lit(True))
    given = records(lines.withColumn("kept", F.col("id") % 3 > 0), 1, F.col("id") % 2 == 1)
    return recordform.form(stored, given, "k")
