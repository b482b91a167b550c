"""Records: filters and pages, neighbours, trees, previews, numbers, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import adhoc, coverage, filters, gate, navigate, snapshot
from ..session import table as t
from .registry import query

Filter = filters.Filter


def _filtered(spark: SparkSession, d: str, table: str, columns: list[str], *wanted: Filter) -> DataFrame:
    return filters.apply(t(spark, d, table), list(wanted)).select(*columns)


@query("SELECT o_orderkey FROM orders WHERE o_custkey::VARCHAR = '7'")
def filter_eq_text(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "orders", ["o_orderkey"], Filter("o_custkey", "eq", "7"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
def filter_ne(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "customer", ["c_custkey"], Filter("c_mktsegment", "ne", "BUILDING"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A_1%'")
def filter_contains(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "part", ["p_partkey", "p_name"], Filter("p_name", "contains", "A_1"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 90000.5")
def filter_gt(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "orders", ["o_orderkey"], Filter("o_totalprice", "gt", "90000.5"))


@query("SELECT p_partkey FROM part WHERE p_size >= 9")
def filter_gte(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "part", ["p_partkey"], Filter("p_size", "gte", "9"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01'")
def filter_lt(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "orders", ["o_orderkey"], Filter("o_orderdate", "lt", "1993-01-01"))


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal <= 0")
def filter_lte(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "supplier", ["s_suppkey"], Filter("s_acctbal", "lte", "0"))


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL")
def filter_null(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").withColumn("decided", F.nullif("o_orderstatus", F.lit("P")))
    return filters.apply(orders, [Filter("decided", "null")]).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT NULL")
def filter_notnull(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").withColumn("decided", F.nullif("o_orderstatus", F.lit("P")))
    return filters.apply(orders, [Filter("decided", "notnull")]).select("o_orderkey")


@query("""SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderpriority ILIKE '%urgent%' AND o_totalprice >= 20000
 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 50""")
def filter_combined_page(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders")
    asked = filters.parse([("o_orderpriority__contains", "urgent"), ("o_totalprice", "20000"), ("op.o_totalprice", "gte"), ("_sort", "o_totalprice"), ("_dir", "desc"), ("_page", "2")], orders.columns)
    found = filters.apply(orders, asked.filters)
    return filters.page(found, asked.sort, asked.descending, ["o_orderkey"], asked.page, asked.per).select("o_orderkey", "o_totalprice", "o_orderstatus")


_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, count(DISTINCT {c}) AS n_distinct, max(length({c}::VARCHAR))::BIGINT AS longest,
 count({c}) >= 20 AND count(DISTINCT {c}) * 4 <= count({c}) AND max(length({c}::VARCHAR)) <= 40 AS is_dictionary FROM orders""" for c in _COLS))
def dictionary_columns(spark: SparkSession, d: str) -> DataFrame:
    return filters.dictionary_columns(t(spark, d, "orders"), _COLS)


@query("""SELECT c_custkey, o_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'
 LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R'""")
def task_tree_flat(spark: SparkSession, d: str) -> DataFrame:
    tasks, lines = t(spark, d, "orders").where("o_orderstatus = 'F'"), t(spark, d, "lineitem").where("l_returnflag = 'R'")
    tree = t(spark, d, "customer").join(tasks, F.col("c_custkey") == F.col("o_custkey"), "left").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return tree.select("c_custkey", "o_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"))


@query("SELECT o_orderkey, count(l_orderkey) AS n_children, coalesce(min(l_linenumber), 0)::BIGINT AS first_child FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def task_tree_nested_counts(spark: SparkSession, d: str) -> DataFrame:
    tree = navigate.nested(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", t(spark, d, "lineitem"), "l_orderkey", ["l_linenumber"], ["l_partkey"], "lines")
    return tree.select("o_orderkey", F.size("lines").cast("long").alias("n_children"), F.coalesce(F.get("lines", F.lit(0))["l_linenumber"], F.lit(0)).cast("long").alias("first_child"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS marking FROM conversations GROUP BY 1")
def marking_text(spark: SparkSession, d: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("marking"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND year(o_orderdate) = 1996 ORDER BY o_orderdate, o_orderkey LIMIT 1")
def worklist_next(spark: SparkSession, d: str) -> DataFrame:
    pending = gate.scoped(t(spark, d, "orders").withColumn("year", F.year("o_orderdate")), o_orderstatus="P", year=1996)
    return pending.orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderpriority NULLS FIRST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 200")
def worklist_top_n(spark: SparkSession, d: str) -> DataFrame:
    pending = gate.scoped(t(spark, d, "orders"), o_orderstatus="P")
    return pending.orderBy(F.col("o_orderpriority").asc_nulls_first(), F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(200).select("o_orderkey", "o_orderpriority")


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return navigate.neighbours(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", "previous", "next")


@query("""SELECT o_orderkey, min(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_page FROM orders""")
def next_page_min(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").withColumn("page", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return navigate.next_minimum(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "page", "next_page").select("o_orderkey", "next_page")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event_per_task(spark: SparkSession, d: str) -> DataFrame:
    return gate.latest(t(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT DISTINCT ON (l_orderkey) l_orderkey, l_partkey, l_suppkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey")
def distinct_on_first(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")]
    return gate.latest(t(spark, d, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_suppkey")


@query("""SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN NULL ELSE NOT bool_or(o_orderstatus = 'F' AND o_orderpriority LIKE '1-%') END AS norm FROM orders GROUP BY 1""")
def sibling_norm_or_gap(spark: SparkSession, d: str) -> DataFrame:
    return coverage.norm_or_gap(t(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F", F.col("o_orderpriority").like("1-%"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE (o_orderkey % 25) || '.1' END AS num, o_orderkey % 25 AS n FROM orders),
 r AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 20)::VARCHAR END AS lo, CASE WHEN c_custkey % 7 = 0 THEN 'end' ELSE (c_custkey % 20 + 6)::VARCHAR END AS hi,
 c_custkey % 20 AS a, c_custkey % 20 + 6 AS b FROM customer)
 SELECT c_custkey, o_orderkey FROM r JOIN o ON o_custkey = c_custkey WHERE (c_custkey % 35 = 0) OR (num <> 'x' AND (c_custkey % 5 = 0 OR n >= a) AND (c_custkey % 7 = 0 OR n <= b))""")
def rule_range_join(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    tasks = t(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(k % 11 == 0, "x").otherwise(F.concat((k % 25).cast("string"), F.lit(".1"))).alias("number"))
    rules = t(spark, d, "customer").select("c_custkey", F.when(c % 5 != 0, (c % 20).cast("string")).alias("low"), F.when(c % 7 == 0, "end").otherwise((c % 20 + 6).cast("string")).alias("high"))
    on = (F.col("o_custkey") == F.col("c_custkey")) & navigate.in_range(F.col("number"), F.col("low"), F.col("high"))
    return rules.join(tasks, on).select("c_custkey", "o_orderkey")


@query("SELECT o_custkey, count(*) AS n_children, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (k <= 8) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) GROUP BY 1")
def children_preview(spark: SparkSession, d: str) -> DataFrame:
    return navigate.children_preview(t(spark, d, "orders"), "o_custkey", ["o_orderkey"], "o_orderkey")


@query("""SELECT r_name, n_name, count(*) AS lines, count(DISTINCT o_orderkey) AS tasks FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
 JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""")
def owner_chain(spark: SparkSession, d: str) -> DataFrame:
    places = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    owners = t(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    lines = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(owners, F.col("o_custkey") == F.col("c_custkey"))
    return lines.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("o_orderkey").alias("tasks"))


@query("""SELECT l_orderkey, string_agg(g::VARCHAR, ',' ORDER BY g) AS missing FROM (SELECT l_orderkey, unnest(range(1, max(l_linenumber) + 1)) AS g FROM lineitem GROUP BY 1) x
 WHERE NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_linenumber = g) GROUP BY 1""")
def numbering_gaps(spark: SparkSession, d: str) -> DataFrame:
    return coverage.missing_numbers(t(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("SELECT l_orderkey, (SELECT max(g) FROM range(0, 8) r(g) WHERE NOT list_contains(u, g))::BIGINT AS free FROM (SELECT l_orderkey, list(l_linenumber) AS u FROM lineitem GROUP BY 1)")
def free_points(spark: SparkSession, d: str) -> DataFrame:
    return coverage.free_points(t(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", 7)


@query("""SELECT o_custkey, count(*) AS tasks, count(*) FILTER (o_orderstatus = 'P') AS pending, round(sum(o_totalprice), 2) AS points, substr(sha256(string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey)), 1, 16) AS digest FROM orders GROUP BY 1""")
def snapshot_measures(spark: SparkSession, d: str) -> DataFrame:
    keys = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.round(F.sum("o_totalprice"), 2).alias("points"), snapshot.digest(keys).alias("digest"))


@query("""WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) % 2 = 1 GROUP BY 1)
 SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.n IS NULL THEN '+' WHEN b.n IS NULL THEN '-' ELSE '~' END AS change, a.n AS n_old, b.n AS n_new
 FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.n IS DISTINCT FROM b.n""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    counted = lambda odd: t(spark, d, "orders").where(F.year("o_orderdate") % 2 == odd).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return snapshot.difference(counted(0), counted(1), ["o_custkey"], ["n"])


@query("SELECT p_partkey, try_cast(nullif(split_part(x, '.', 1), '') AS INTEGER) AS head FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'a.1' WHEN p_partkey % 4 = 1 THEN '' ELSE p_size || '.2' END AS x FROM part)")
def ordinal_head(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    number = F.when(k % 4 == 0, "a.1").when(k % 4 == 1, "").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".2")))
    return t(spark, d, "part").select("p_partkey", navigate.ordinal_head(number).alias("head"))


@query("SELECT p_partkey, list_contains(string_split(v, ','), 'Brand#11') AS has, string_split(v, ',')[1] AS first FROM (SELECT p_partkey, concat_ws(',', nullif(p_brand, 'Brand#12'), p_type) AS v FROM part)")
def csv_membership(spark: SparkSession, d: str) -> DataFrame:
    variants = F.concat_ws(",", F.nullif("p_brand", F.lit("Brand#12")), "p_type")
    return t(spark, d, "part").select("p_partkey", fx.csv_has(variants, "Brand#11").alias("has"), fx.csv_first(variants).alias("first"))


@query("SELECT DISTINCT unnest(string_split(p_brand || ',' || p_type, ',')) AS variant FROM part")
def csv_explode(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.explode(F.split(F.concat_ws(",", "p_brand", "p_type"), ",")).alias("variant")).distinct()


@query("SELECT event_id, list_contains(json_keys(props), 'k') AS has_k, list_contains(json_keys(props), 'notes') AS has_notes FROM events")
def json_key_exists(spark: SparkSession, d: str) -> DataFrame:
    has = lambda k: F.array_contains(F.json_object_keys("props"), k)
    return t(spark, d, "events").select("event_id", has("k").alias("has_k"), has("notes").alias("has_notes"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, greatest(1, least(l_linenumber + 3, 5))::BIGINT AS page, round(greatest(0, least(l_quantity - 2, 40)), 4) AS x0 FROM lineitem")
def clamp_and_slack(spark: SparkSession, d: str) -> DataFrame:
    page = F.greatest(F.lit(1), F.least(F.col("l_linenumber") + 3, F.lit(5))).cast("long")
    x0 = F.round(F.greatest(F.lit(0.0), F.least(F.col("l_quantity") - 2, F.lit(40.0))), 4)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", page.alias("page"), x0.alias("x0"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def adhoc_guarded(spark: SparkSession, d: str) -> DataFrame:
    return adhoc.guarded(spark, "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1", {"orders": t(spark, d, "orders")})


@query("SELECT DISTINCT year(o_orderdate)::BIGINT AS year, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'")
def filter_options(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.year("o_orderdate").cast("long").alias("year"), "o_orderpriority").distinct()


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority LIKE '1-%' AND year(o_orderdate) = 1995)")
def requirements_of_scope(spark: SparkSession, d: str) -> DataFrame:
    used = t(spark, d, "lineitem").join(t(spark, d, "orders").where("o_orderpriority like '1-%' and year(o_orderdate) = 1995"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey")
    return t(spark, d, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


@query("SELECT c_custkey, concat_ws('-', c_mktsegment, nullif(c_nationkey, 3)::VARCHAR, (c_custkey % 3)::VARCHAR) AS label FROM customer")
def form_label(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").select("c_custkey", F.concat_ws("-", "c_mktsegment", F.nullif("c_nationkey", F.lit(3)).cast("string"), (F.col("c_custkey") % 3).cast("string")).alias("label"))


@query("SELECT o_orderkey, coalesce(p, m) AS page FROM (SELECT o_orderkey, nullif(o_custkey % 4, 0) AS p, (SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) AS m FROM orders)")
def backfill_pages(spark: SparkSession, d: str) -> DataFrame:
    least = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("m"))
    orders = t(spark, d, "orders").join(least, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select("o_orderkey", F.coalesce(F.nullif(F.col("o_custkey") % 4, F.lit(0)), "m").cast("long").alias("page"))


@query("""SELECT conv_id, max(CASE WHEN k = 1 THEN substr(text, 1, 120) END) AS title, count(*) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY role <> 'user', turn, text) AS k FROM conversations) GROUP BY 1""")
def conversation_titles(spark: SparkSession, d: str) -> DataFrame:
    first = F.min_by(F.substring("text", 1, 120), F.struct((F.col("role") != "user").alias("a"), "turn", "text"))
    return t(spark, d, "conversations").groupBy("conv_id").agg(first.alias("title"), F.count(F.lit(1)).alias("turns"))
