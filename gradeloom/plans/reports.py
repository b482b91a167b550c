"""Reports over the review state: gate, progress, coverage, measures, health.

orders stand for tasks (status, kind, year), lineitem for their children, customer for documents,
supplier for exam forms, part for requirements, events for the review journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage, gate, health, measures
from ..session import table as t
from .registry import query

def _year() -> Column:
    return F.year("o_orderdate").cast("long")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O')")
def gate_corpus_view(spark: SparkSession, d: str) -> DataFrame:
    return gate.reviewed(t(spark, d, "orders")).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderkey, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = 1995 AND c_mktsegment = 'BUILDING'")
def scope_optional_params(spark: SparkSession, d: str) -> DataFrame:
    tasks = t(spark, d, "orders").withColumn("year", _year()).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return gate.scoped(tasks, year=1995, c_mktsegment="BUILDING", o_orderpriority=None).select("o_orderkey", "o_orderstatus")


@query("SELECT s AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('P'), ('F'), ('O'), ('R')) v(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY s")
def status_counts_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return coverage.zero_filled(t(spark, d, "orders"), "o_orderstatus", gate.STATUSES)


@query("""SELECT year(o_orderdate)::BIGINT AS year, count(*) FILTER (o_orderstatus = 'F') AS approved, count(*) FILTER (o_orderstatus = 'O') AS corrected,
 count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) AS tasks FROM orders GROUP BY 1""")
def progress_by_year(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return t(spark, d, "orders").groupBy(_year().alias("year")).agg(F.count_if(status == "F").alias("approved"), F.count_if(status == "O").alias("corrected"), F.count_if(status == "P").alias("pending"), F.count(F.lit(1)).alias("tasks"))


@query("""SELECT (SELECT count(*) FROM orders) AS tasks, (SELECT count(*) FROM lineitem) AS criteria, (SELECT count(*) FROM customer) AS documents,
 (SELECT count(*) FROM supplier) AS forms, (SELECT count(*) FROM part) AS requirements, (SELECT count(*) FROM events) AS events,
 (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS approved, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS corrected,
 (SELECT round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) FROM orders WHERE o_orderstatus IN ('F', 'O')) AS hit_share""")
def progress_totals(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    approved, corrected = F.count_if(status == "F"), F.count_if(status == "O")
    one = t(spark, d, "orders").agg(F.count(F.lit(1)).alias("tasks"), approved.alias("approved"), corrected.alias("corrected"), F.round(measures.hit_share(approved, corrected), 6).alias("hit_share"))
    for name, table in (("criteria", "lineitem"), ("documents", "customer"), ("forms", "supplier"), ("requirements", "part"), ("events", "events")):
        one = one.crossJoin(t(spark, d, table).agg(F.count(F.lit(1)).alias(name)))  # one row each
    return one


@query("""SELECT year(o_orderdate)::BIGINT AS year, count(*) FILTER (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) AS with_returned,
 count(*) AS tasks FROM orders GROUP BY 1""")
def report_by_year_exists_filter(spark: SparkSession, d: str) -> DataFrame:
    returned = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct()
    tasks = t(spark, d, "orders").join(returned, F.col("o_orderkey") == F.col("k"), "left")
    return tasks.groupBy(_year().alias("year")).agg(F.count("k").alias("with_returned"), F.count(F.lit(1)).alias("tasks"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share
 FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2""")
def decided_by_breakdown(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    counted = t(spark, d, "orders").where("o_orderstatus <> 'P'").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("o_orderstatus")), 6))


def _presence(spark: SparkSession, d: str) -> dict[str, coverage.Check]:
    lines = t(spark, d, "lineitem")
    return {
        "has_lines": lambda o: health.within(o, "o_orderkey", lines, "l_orderkey"),
        "has_returned": lambda o: health.within(o, "o_orderkey", lines.where("l_returnflag = 'R'"), "l_orderkey"),
        "has_discounted": lambda o: health.within(o, "o_orderkey", lines.where("l_discount >= 0.05"), "l_orderkey"),
        "has_priority": lambda o: o.where("o_orderpriority is not null and o_orderpriority <> ''"),
        "has_price": lambda o: o.where("o_totalprice > 0"),
        "is_urgent": lambda o: o.where("o_orderpriority like '1-%'"),
    }


@query("""WITH o AS (SELECT *, o_orderstatus IN ('F', 'O') AS c, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS a,
 EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS b, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount >= 0.05) AS e FROM orders)
 SELECT 'has_lines' AS "check", count(*) FILTER (c AND a) AS corpus, count(*) FILTER (a) AS parsed FROM o
 UNION ALL SELECT 'has_returned', count(*) FILTER (c AND b), count(*) FILTER (b) FROM o
 UNION ALL SELECT 'has_discounted', count(*) FILTER (c AND e), count(*) FILTER (e) FROM o
 UNION ALL SELECT 'has_priority', count(*) FILTER (c AND o_orderpriority <> ''), count(*) FILTER (o_orderpriority <> '') FROM o
 UNION ALL SELECT 'has_price', count(*) FILTER (c AND o_totalprice > 0), count(*) FILTER (o_totalprice > 0) FROM o
 UNION ALL SELECT 'is_urgent', count(*) FILTER (c AND o_orderpriority LIKE '1-%'), count(*) FILTER (o_orderpriority LIKE '1-%') FROM o""")
def presence_checks_dual_scope(spark: SparkSession, d: str) -> DataFrame:
    return coverage.dual_scope(t(spark, d, "orders"), _presence(spark, d))


@query("""WITH o AS (SELECT *, o_orderstatus IN ('F', 'O') AS c, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS a,
 NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') AS b FROM orders)
 SELECT 'no_lines' AS "check", count(*) FILTER (c AND a) AS corpus, count(*) FILTER (a) AS parsed FROM o
 UNION ALL SELECT 'no_final_line', count(*) FILTER (c AND b), count(*) FILTER (b) FROM o
 UNION ALL SELECT 'cheap', count(*) FILTER (c AND o_totalprice < 2000), count(*) FILTER (o_totalprice < 2000) FROM o""")
def gap_checks_dual_scope(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem")
    return coverage.dual_scope(t(spark, d, "orders"), {
        "no_lines": lambda o: health.without(o, "o_orderkey", lines, "l_orderkey"),
        "no_final_line": lambda o: health.without(o, "o_orderkey", lines.where("l_linestatus = 'F'"), "l_orderkey"),
        "cheap": lambda o: o.where("o_totalprice < 2000"),
    })


@query("""SELECT p_brand, count(DISTINCT o_orderkey) AS tasks, round(sum(o_totalprice), 2) AS points, count(DISTINCT l_suppkey) AS forms
 FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'O') GROUP BY p_brand""")
def requirement_coverage(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(gate.reviewed(t(spark, d, "orders")), F.col("l_orderkey") == F.col("o_orderkey"))
    # points repeat for each version of a task
    return lines.groupBy("p_brand").agg(F.countDistinct("o_orderkey").alias("tasks"), F.round(F.sum("o_totalprice"), 2).alias("points"), F.countDistinct("l_suppkey").alias("forms"))


@query("""SELECT p_brand, count(*) AS tasks, round(sum(o_totalprice), 2) AS points
 FROM (SELECT DISTINCT p_brand, l_orderkey FROM part JOIN lineitem ON l_partkey = p_partkey) JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'O') GROUP BY p_brand""")
def requirement_coverage_no_fanout(spark: SparkSession, d: str) -> DataFrame:
    pairs = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_orderkey").distinct()
    tasks = pairs.join(gate.reviewed(t(spark, d, "orders")), F.col("l_orderkey") == F.col("o_orderkey"))
    return tasks.groupBy("p_brand").agg(F.count(F.lit(1)).alias("tasks"), F.round(F.sum("o_totalprice"), 2).alias("points"))


@query("SELECT p_brand, count(DISTINCT l_orderkey) AS tasks FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 ORDER BY tasks DESC, p_brand LIMIT 10")
def top_requirements(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("p_brand").agg(F.countDistinct("l_orderkey").alias("tasks")).orderBy(F.desc("tasks"), "p_brand").limit(10)


@query("""SELECT l_suppkey, count(*) AS tasks, round(sum(o_totalprice), 2) AS points FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey
 WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""")
def form_list_distinct(spark: SparkSession, d: str) -> DataFrame:
    pairs = t(spark, d, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    tasks = pairs.join(gate.reviewed(t(spark, d, "orders")), F.col("l_orderkey") == F.col("o_orderkey"))
    return tasks.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("tasks"), F.round(F.sum("o_totalprice"), 2).alias("points"))


@query("""SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AS has_answer,
 (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_criteria FROM orders WHERE o_orderstatus = 'F'""")
def form_tasks_flags(spark: SparkSession, d: str) -> DataFrame:
    per = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.count(F.lit(1)).alias("n"))
    tasks = t(spark, d, "orders").where("o_orderstatus = 'F'").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return tasks.select("o_orderkey", F.coalesce("a", F.lit(False)).alias("has_answer"), F.coalesce("n", F.lit(0)).alias("n_criteria"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 6")
def twins(spark: SparkSession, d: str) -> DataFrame:
    return coverage.twins(t(spark, d, "lineitem"), ["l_orderkey"], 6)


@query("""SELECT l_orderkey, string_agg(coalesce(v, ''), ',' ORDER BY o NULLS LAST, coalesce(v, '')) AS versions FROM
 (SELECT l_orderkey, nullif(l_suppkey % 7, 3) AS o, nullif(l_suppkey % 7, 3)::VARCHAR AS v FROM lineitem) GROUP BY 1 HAVING count(*) > 6""")
def twin_list_ordered(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").select("l_orderkey", F.expr("nullif(l_suppkey % 7, 3)").alias("v"))
    return lines.groupBy("l_orderkey").agg(coverage.ordered_list("v", "v").alias("versions"), F.count(F.lit(1)).alias("n")).where("n > 6").drop("n")


@query("SELECT o_orderpriority, count(*) AS tasks FROM (SELECT o_orderkey, o_orderpriority FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1")
def twins_per_group(spark: SparkSession, d: str) -> DataFrame:
    many = coverage.twins(t(spark, d, "lineitem"), ["l_orderkey"], 1)
    return health.within(t(spark, d, "orders"), "o_orderkey", many, "l_orderkey").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("tasks"))


@query("SELECT l_suppkey, count(DISTINCT o_custkey) AS documents FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(DISTINCT o_custkey) > 300")
def multi_document_forms(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("l_suppkey").agg(F.countDistinct("o_custkey").alias("documents")).where("documents > 300")


@query("SELECT event_type, count(value) AS n, round(median(value), 4) AS median_s FROM events GROUP BY 1")
def median_duration(spark: SparkSession, d: str) -> DataFrame:
    return measures.durations(t(spark, d, "events"), ["event_type"], "value", 100).select("event_type", "n", "median_s")


@query("SELECT event_type, count(value) AS n, round(median(value), 4) AS median_s, round(sum(value), 2) AS total_s, count(*) FILTER (value > 100) AS n_long FROM events GROUP BY 1")
def duration_summary(spark: SparkSession, d: str) -> DataFrame:
    return measures.durations(t(spark, d, "events"), ["event_type"], "value", 100)


@query("SELECT p AS pending, round(p * m, 4) AS seconds, round(p * m / 3600, 6) AS hours FROM (SELECT count(*) AS p FROM orders WHERE o_orderstatus = 'P'), (SELECT round(median(value), 4) AS m FROM events)")
def forecast_hours(spark: SparkSession, d: str) -> DataFrame:
    median = measures.durations(t(spark, d, "events"), [], "value", 100).select("median_s")
    pending = t(spark, d, "orders").where("o_orderstatus = 'P'").agg(F.count(F.lit(1)).alias("pending"))
    both = pending.crossJoin(median)  # one row each
    return both.select("pending", F.round(F.col("pending") * F.col("median_s"), 4).alias("seconds"), F.round(F.col("pending") * F.col("median_s") / 3600, 6).alias("hours"))


@query("""WITH a AS (SELECT l.doc_id IS NOT NULL AS w, avg(n_chars) AS m, avg((lang = 'en')::INT) AS e, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1)
 SELECT round(x.m, 6) AS mean_chars_with, round(x.e, 6) AS english_with, x.n AS n_with, round(y.m, 6) AS mean_chars_without, round(y.e, 6) AS english_without, y.n AS n_without,
 round(round(x.m, 6) - round(y.m, 6), 6) AS mean_chars_gain, round(round(x.e, 6) - round(y.e, 6), 6) AS english_gain FROM a x, a y WHERE x.w AND NOT y.w""")
def arm_comparison(spark: SparkSession, d: str) -> DataFrame:
    labelled = t(spark, d, "labels").select("doc_id", F.lit(True).alias("l"))
    docs = t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(labelled, "doc_id", "left").withColumn("arm", F.coalesce("l", F.lit(False)))
    return measures.arms(docs, "arm", {"mean_chars": F.avg("n_chars"), "english": F.avg((F.col("lang") == "en").cast("int"))})


@query("SELECT o_custkey, round(CASE WHEN count(*) FILTER (o_orderstatus IN ('F', 'O')) = 0 THEN 0 ELSE count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus IN ('F', 'O')) END, 6) AS accepted_share FROM orders WHERE o_orderpriority LIKE '1-%' GROUP BY 1")
def share_zero_denominator(spark: SparkSession, d: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    urgent = t(spark, d, "orders").where("o_orderpriority like '1-%'")
    return urgent.groupBy("o_custkey").agg(F.round(gate.share(n("F"), n("F") + n("O")), 6).alias("accepted_share"))


@query("SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def usage_by_conversation(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("""SELECT role, sessions, chars, round(chars * coalesce(price, 0) * 0.5 / 1000000, 6) AS cost FROM
 (SELECT role, count(DISTINCT conv_id) AS sessions, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1) LEFT JOIN (VALUES ('user', 3.0::DOUBLE), ('assistant', 15.0::DOUBLE)) p(role, price) USING (role)""")
def usage_cost(spark: SparkSession, d: str) -> DataFrame:
    usage = t(spark, d, "conversations").groupBy("role").agg(F.countDistinct("conv_id").alias("sessions"), F.sum(F.length("text").cast("long")).alias("chars"))
    return measures.priced(usage, spark.createDataFrame([("user", 3.0), ("assistant", 15.0)], "role string, price double"), "role", "chars", 0.5)


@query("SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY 1")
def conversation_list(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn"))


@query("""SELECT o_custkey, count(*) AS tasks, round(avg(h::INT), 6) AS with_lines, round(avg((o_totalprice > 50000)::INT), 6) AS with_price FROM
 (SELECT *, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS h FROM orders) GROUP BY 1""")
def coverage_by_key(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d).drop("year").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("tasks"), F.round(F.avg("h"), 6).alias("with_lines"), F.round(F.avg((F.col("o_totalprice") > 50000).cast("int")), 6).alias("with_price"))


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    return t(spark, d, "orders").withColumn("year", _year()).join(lines, F.col("o_orderkey") == F.col("k"), "left").withColumn("h", F.col("k").isNotNull().cast("int"))


@query("""SELECT year, count(*) AS documents, round(avg(s), 6) AS mean_share FROM (SELECT year(o_orderdate)::BIGINT AS year, o_custkey,
 avg((EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))::INT) AS s FROM orders GROUP BY 1, 2) GROUP BY 1""")
def coverage_by_year_mean(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d).groupBy("year", "o_custkey").agg(F.avg("h").alias("s")).groupBy("year").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("s"), 6).alias("mean_share"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def health_open_without_criteria(spark: SparkSession, d: str) -> DataFrame:
    return health.without(t(spark, d, "orders").where("o_orderstatus = 'P'"), "o_orderkey", t(spark, d, "lineitem"), "l_orderkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey = o_orderkey AND s_acctbal > 0)")
def health_closed_without_answer(spark: SparkSession, d: str) -> DataFrame:
    answers = t(spark, d, "lineitem").join(t(spark, d, "supplier").where("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey"))
    return health.without(t(spark, d, "orders").where("o_orderstatus = 'F'"), "o_orderkey", answers, "l_orderkey").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size > 25 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)")
def health_unused_requirements(spark: SparkSession, d: str) -> DataFrame:
    return health.without(t(spark, d, "part").where("p_size > 25"), "p_partkey", t(spark, d, "lineitem").where("l_quantity > 48"), "l_partkey").select("p_partkey")


@query("SELECT event_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = e.user_id)")
def health_orphan_events(spark: SparkSession, d: str) -> DataFrame:
    return health.orphans(t(spark, d, "events"), "user_id", t(spark, d, "orders"), "o_orderkey").select("event_id", "event_type")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount = 0)")
def health_no_zero_threshold(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem")
    some = health.within(t(spark, d, "orders"), "o_orderkey", lines, "l_orderkey")
    return health.without(some, "o_orderkey", lines.where("l_discount = 0"), "l_orderkey").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_extendedprice > o_totalprice")
def health_threshold_above_pool(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.where("l_extendedprice > o_totalprice").select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority LIKE '1-%')")
def health_documents_without_urgent(spark: SparkSession, d: str) -> DataFrame:
    return health.without(t(spark, d, "customer"), "c_custkey", t(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority like '1-%'"), "o_custkey").select("c_custkey")


@query("""SELECT o_custkey, o_orderkey FROM orders o WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey)
 AND EXISTS (SELECT 1 FROM orders p JOIN lineitem ON l_orderkey = p.o_orderkey WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = 'F')""")
def health_gap_against_norm(spark: SparkSession, d: str) -> DataFrame:
    closed, lines = t(spark, d, "orders").where("o_orderstatus = 'F'"), t(spark, d, "lineitem")
    norm = health.within(closed, "o_orderkey", lines, "l_orderkey")
    return health.within(health.without(closed, "o_orderkey", lines, "l_orderkey"), "o_custkey", norm, "o_custkey").select("o_custkey", "o_orderkey")


@query("SELECT doc_id FROM documents WHERE n_chars < 60")
def health_short_content(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").where("n_chars < 60").select("doc_id")


@query("SELECT page_id FROM pages WHERE html NOT LIKE '%</body>%'")
def health_cut_pages(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").where(~F.col("html").contains("</body>")).select("page_id")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::INT > 90")
def health_noted_events(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").where(F.get_json_object("props", "$.k").try_cast("int") > 90).select("event_id")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_tax = 0 AND l_discount = 0 AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10) GROUP BY 1")
def health_versions_without_content(spark: SparkSession, d: str) -> DataFrame:
    bare = health.without(t(spark, d, "lineitem").where("l_tax = 0 and l_discount = 0"), "l_partkey", t(spark, d, "part").where("p_size > 10"), "p_partkey")
    return bare.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'open_without_criteria' AS "check", count(*) AS n FROM orders WHERE o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
 UNION ALL SELECT 'short_content', count(*) FROM documents WHERE n_chars < 60 UNION ALL SELECT 'cut_pages', count(*) FROM pages WHERE html NOT LIKE '%</body>%'""")
def health_all_counts(spark: SparkSession, d: str) -> DataFrame:
    return health.counts({"open_without_criteria": lambda: health_open_without_criteria(spark, d), "short_content": lambda: health_short_content(spark, d), "cut_pages": lambda: health_cut_pages(spark, d)})


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def constraint_unique(spark: SparkSession, d: str) -> DataFrame:
    return health.duplicates(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_nationkey, m, count(*) AS n FROM (SELECT c_nationkey, nullif(c_mktsegment, 'BUILDING') AS m FROM customer) GROUP BY 1, 2 HAVING count(*) > 1")
def constraint_unique_nulls(spark: SparkSession, d: str) -> DataFrame:
    return health.duplicates(t(spark, d, "customer").withColumn("m", F.nullif("c_mktsegment", F.lit("BUILDING"))), ["c_nationkey", "m"])


@query("SELECT count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)")
def constraint_foreign_key(spark: SparkSession, d: str) -> DataFrame:
    return health.orphans(t(spark, d, "lineitem"), "l_partkey", t(spark, d, "part"), "p_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (coalesce(nullif(l_quantity, 50) <= 49.5, true)) OR l_quantity = 1")
def constraint_check(spark: SparkSession, d: str) -> DataFrame:
    allowed = F.expr("nullif(l_quantity, 50) <= 49.5") & (F.col("l_quantity") != 1)
    return health.broken(t(spark, d, "lineitem"), allowed).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'parsed' WHEN bool_or(o_orderstatus IN ('F', 'O')) THEN 'approved' ELSE 'rejected' END AS state FROM orders GROUP BY 1")
def document_status(spark: SparkSession, d: str) -> DataFrame:
    return gate.document_status(t(spark, d, "orders"), "o_custkey", "o_orderstatus")


_ACTIONS = {"click": "approve", "view": "correct", "purchase": "reject", "signup": "reopen"}
_ACTION_SQL = "CASE event_type WHEN 'click' THEN 'approve' WHEN 'view' THEN 'correct' WHEN 'purchase' THEN 'reject' WHEN 'signup' THEN 'reopen' ELSE 'note' END"


@query(f"""WITH e AS (SELECT user_id, {_ACTION_SQL} AS a, ts, event_id FROM events), s AS (SELECT user_id, count(*) AS n_events, bool_or(a = 'correct') AS ever_corrected,
 arg_max(a, (ts, event_id)) FILTER (a <> 'note') AS l FROM e GROUP BY 1) SELECT user_id, n_events, ever_corrected, CASE WHEN l IS NULL OR l = 'reopen' THEN 'pending' WHEN l = 'reject' THEN 'rejected'
 WHEN l = 'correct' OR ever_corrected THEN 'corrected' ELSE 'approved' END AS status FROM s""")
def lifecycle_fold(spark: SparkSession, d: str) -> DataFrame:
    action = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in _ACTIONS.items() for x in p]), F.col("event_type")), F.lit("note"))
    return gate.fold_status(t(spark, d, "events").withColumn("action", action), "user_id", "action", ["ts", "event_id"])


@query("""SELECT previous, changed, approving, empty, CASE WHEN empty THEN 'none' WHEN NOT changed AND NOT approving THEN previous
 WHEN NOT changed THEN CASE WHEN previous = 'auto' THEN 'approved' ELSE previous END WHEN previous IN ('auto', 'approved', 'corrected') THEN 'corrected' ELSE 'manual' END AS state, count(*) AS n FROM
 (SELECT (['none', 'auto', 'approved', 'corrected', 'manual'])[(event_id % 5 + 1)::INT] AS previous, event_id % 2 = 0 AS changed, event_id % 3 = 0 AS approving, event_id % 11 = 0 AS empty FROM events) GROUP BY ALL""")
def description_state(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("none", "auto", "approved", "corrected", "manual")])
    k = F.col("event_id")
    rows = t(spark, d, "events").select(F.element_at(names, (k % 5 + 1).cast("int")).alias("previous"), (k % 2 == 0).alias("changed"), (k % 3 == 0).alias("approving"), (k % 11 == 0).alias("empty"))
    state = gate.description_state(F.col("previous"), F.col("changed"), F.col("approving"), F.col("empty"))
    return rows.withColumn("state", state).groupBy("previous", "changed", "approving", "empty", "state").agg(F.count(F.lit(1)).alias("n"))
