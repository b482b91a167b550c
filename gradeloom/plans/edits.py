"""Loads, edits, guards and recorded verdicts: tables before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import changes, health
from ..session import spread
from ..session import table as t
from .registry import query


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderpriority").alias("text"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1995 UNION SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = user_id)")
def rerun_refused(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders")
    journal = t(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("o_custkey"))
    return changes.refused_keys(orders, orders, journal, "o_custkey", (F.col("o_orderstatus") == "F") & (F.year("o_orderdate") == 1995))


@query("""WITH refused AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 90000), incoming AS (SELECT o_orderkey + 1000000 AS o_orderkey, o_custkey, 'P' AS o_orderstatus, o_orderpriority AS text FROM orders WHERE o_custkey % 3 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM refused))
 SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority AS text FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM incoming) UNION ALL SELECT * FROM incoming""")
def load_by_key(spark: SparkSession, d: str) -> DataFrame:
    stored = _stored(spark, d)
    incoming = stored.where("o_custkey % 3 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1000000).withColumn("o_orderstatus", F.lit("P"))
    refused = t(spark, d, "orders").where("o_totalprice > 90000").select("o_custkey").distinct()
    once = changes.load_keys(stored, incoming, "o_custkey", refused)
    return changes.load_keys(once, incoming, "o_custkey", refused)  # a second load changes nothing


@query("SELECT p_brand, nullif(p_size % 5, 0) AS stage, arg_min(p_name, p_partkey) AS content, count(DISTINCT p_name) - 1 AS n_divergent FROM part GROUP BY 1, 2")
def keep_first_dictionary(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part").withColumn("stage", F.nullif(F.col("p_size") % 5, F.lit(0))).withColumn("content", F.col("p_name"))
    return changes.keep_first(rows, ["p_brand", "stage"], "content", ["p_partkey"])


@query("""WITH r AS (SELECT p_brand, nullif(p_size % 5, 0) AS stage, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN '' ELSE p_type END AS content, p_partkey FROM part),
 f AS (SELECT p_brand, stage, content AS kept FROM r QUALIFY row_number() OVER (PARTITION BY p_brand, stage ORDER BY p_partkey) = 1), e AS (SELECT p_brand, stage, content, count(*) AS n, min(p_partkey) AS first_part FROM r GROUP BY ALL)
 SELECT e.p_brand, e.stage, content, kept, n, first_part FROM e JOIN f ON e.p_brand = f.p_brand AND e.stage IS NOT DISTINCT FROM f.stage WHERE content IS DISTINCT FROM kept""")
def dictionary_divergences(spark: SparkSession, d: str) -> DataFrame:
    content = F.when(F.col("p_partkey") % 7 == 1, "").when(F.col("p_partkey") % 7 > 1, F.col("p_type"))
    rows = t(spark, d, "part").select("p_brand", F.nullif(F.col("p_size") % 5, F.lit(0)).alias("stage"), content.alias("content"), "p_partkey")
    return changes.divergences(rows, ["p_brand", "stage"], "content", ["p_partkey"]).select("p_brand", "stage", "content", "kept", "n", F.col("first.p_partkey").alias("first_part"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id % 2 DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    events = t(spark, d, "events").select("user_id", "event_type", "event_id", "value", F.struct("ts", F.col("event_id") % 2, "event_id").alias("at"))
    even, odd = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    return changes.replace_latest(even, odd, ["user_id", "event_type"], "at").drop("at")


_EDITS = """edits AS (SELECT o_custkey AS batch, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '  ' || o_orderpriority || ' ' WHEN 1 THEN lower(o_orderpriority) ELSE o_orderpriority || ' x' END AS v, o_orderkey % 7 = 0 AS deleted FROM orders WHERE o_orderkey % 3 <> 0
 UNION ALL SELECT o_custkey, -o_orderkey, 'new', false FROM orders WHERE o_orderkey % 50 = 1),
 x AS (SELECT e.batch, e.o_orderkey, trim(v) AS new, deleted, o.o_orderpriority AS old, o.o_orderkey IS NOT NULL AS stored, CASE WHEN deleted THEN true ELSE NOT contains(v, '4-not') END AS fits FROM edits e LEFT JOIN orders o ON o.o_orderkey = e.o_orderkey),
 c AS (SELECT *, CASE WHEN deleted AND stored THEN 'delete' WHEN NOT deleted AND NOT stored THEN 'insert' WHEN NOT deleted AND new IS DISTINCT FROM old THEN 'update' END AS change, bool_and(fits) OVER (PARTITION BY batch) AS accepted FROM x)"""


def _changes(spark: SparkSession, d: str) -> DataFrame:
    orders, k, p = t(spark, d, "orders"), F.col("o_orderkey"), F.col("o_orderpriority")
    value = F.when(k % 4 == 0, F.concat(F.lit("  "), p, F.lit(" "))).when(k % 4 == 1, F.lower(p)).otherwise(F.concat(p, F.lit(" x")))
    edits = orders.where(k % 3 != 0).select(F.col("o_custkey").alias("batch"), "o_orderkey", value.alias("v"), (k % 7 == 0).alias("deleted"))
    edits = edits.unionByName(orders.where(k % 50 == 1).select(F.col("o_custkey").alias("batch"), (-k).alias("o_orderkey"), F.lit("new").alias("v"), F.lit(False).alias("deleted")))
    return changes.change_set(orders.select("o_orderkey", p.alias("v")), edits, "batch", "o_orderkey", "v", ~F.col("v").contains("4-not"))


@query(f"WITH {_EDITS} SELECT batch, o_orderkey, change, old, CASE WHEN NOT deleted THEN new END AS new, accepted FROM c WHERE change IS NOT NULL")
def change_set(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d)


@query(f"WITH {_EDITS} SELECT change, count(*) AS n FROM c WHERE change IS NOT NULL AND accepted GROUP BY 1")
def dry_run_counts(spark: SparkSession, d: str) -> DataFrame:
    return changes.dry_run(_changes(spark, d))


@query("""WITH g AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM g))
 SELECT 0 AS level, c_custkey::VARCHAR AS id FROM g UNION ALL SELECT 1, o_orderkey::VARCHAR FROM o UNION ALL SELECT DISTINCT 2, l_orderkey || '/' || l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""")
def cascaded_skips(spark: SparkSession, d: str) -> DataFrame:
    gone = t(spark, d, "customer").where("c_mktsegment = 'MACHINERY'")
    lines = t(spark, d, "lineitem").select("l_orderkey", F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"))
    return changes.cascade(gone, "c_custkey", [(t(spark, d, "orders"), "o_custkey", "o_orderkey"), (lines, "l_orderkey", "id")])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 'approved' WHEN l_suppkey % 4 <> 0 AND l_suppkey % 3 <> 0 AND l_suppkey % 5 <> 0 THEN 'auto' ELSE 'failed' END AS status,
 CASE WHEN l_returnflag = 'A' THEN 'own' WHEN l_suppkey % 4 <> 0 AND l_suppkey % 3 <> 0 AND l_suppkey % 5 <> 0 THEN 'v' || l_suppkey END AS value FROM lineitem""")
def fill_expressions(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "A", "approved").otherwise("none").alias("status"), F.when(F.col("l_returnflag") == "A", "own").alias("value"))
    k = F.col("l_suppkey")
    keyed = lines.withColumn("key", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    results = keyed.where(k % 4 != 0).select("key", F.when(k % 5 != 0, F.concat(F.lit("v"), k.cast("string"))).alias("value"), F.when(k % 3 == 0, "prose").alias("reason")).dropDuplicates(["key"])
    return changes.fill_expressions(keyed, results, "key").select("key.l_orderkey", "key.l_linenumber", "key.l_partkey", "status", "value")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'finished' WHEN event_id % 3 = 0 THEN 'failed' WHEN event_type = 'click' THEN 'running' ELSE 'unknown' END AS state FROM events""")
def job_states(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return t(spark, d, "events").select("event_id", changes.job_state(k % 3 == 0, k % 2, F.col("event_type") == "click").alias("state"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unknown' WHEN event_id % 4 = 0 THEN 'pending' WHEN event_id % 4 = 1 THEN 'rejected' WHEN event_id % 3 = 0 THEN 'other arguments' WHEN event_id % 7 = 0 THEN 'used up' ELSE 'run' END AS verdict FROM events""")
def consent_verdicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    args = lambda x: fx.canonical_json({"b": F.lit(None).cast("string"), "a": x})
    asked = t(spark, d, "events").select("event_id", F.lit("write").alias("tool"), args(F.col("user_id")).alias("args"))
    decision = F.when(k % 4 == 1, "rejected").when(k % 4 != 0, "accepted")
    decided = t(spark, d, "events").where(k % 5 != 0).select("event_id", F.lit("write").alias("tool"), args(F.when(k % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))).alias("args"), decision.alias("decision"), (k % 7 == 0).alias("used"))
    return changes.consent(asked, decided, "event_id").select("event_id", "verdict")


@query("""SELECT user_id, count(event_type) - count(DISTINCT event_type) AS n_repeated, count(*) FILTER (NOT (event_id % 50 BETWEEN 1 AND 45)) AS n_out_of_range, count(DISTINCT CASE WHEN event_id % 50 BETWEEN 1 AND 45 THEN event_type END) AS n_answered,
 count(DISTINCT CASE WHEN event_id % 50 BETWEEN 1 AND 45 THEN event_type END) > 0 AS submittable FROM events GROUP BY 1""")
def session_problems(spark: SparkSession, d: str) -> DataFrame:
    return changes.session_problems(t(spark, d, "events").withColumn("place", F.col("event_id") % 50), "user_id", "event_type", "place", 45)


@query("""SELECT DISTINCT l_orderkey, 'crop-' || l_orderkey || '-' || l_linenumber || '.png' AS orphan FROM lineitem WHERE l_linenumber > 2 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')""")
def orphan_crops(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("crop-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") > 2, ".png").otherwise(".jpg"))
    files = t(spark, d, "lineitem").select("l_orderkey", name.alias("orphan")).distinct().where(F.col("orphan").rlike(r"^crop-\d+-\d+\.png$"))
    return health.without(files, "l_orderkey", t(spark, d, "orders").where("o_orderstatus <> 'P'"), "o_orderkey")


_SIDES = """a AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS points, lower(l_returnflag) AS v FROM lineitem WHERE l_suppkey % 2 = 0), b AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS points, lower(l_returnflag) AS v FROM lineitem WHERE l_suppkey % 3 = 0),
 pa AS (SELECT DISTINCT k, points FROM a), pb AS (SELECT DISTINCT k, points FROM b)"""


@query(f"""WITH {_SIDES} SELECT k, points, 'threshold missing' AS hint FROM (SELECT * FROM pb EXCEPT SELECT * FROM pa) UNION ALL SELECT k, points, 'threshold extra' FROM (SELECT * FROM pa EXCEPT SELECT * FROM pb)
 UNION ALL SELECT DISTINCT b.k, b.points, 'condition missing' FROM b JOIN pa ON pa.k = b.k AND pa.points = b.points WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k = b.k AND a.points = b.points AND a.v = b.v)""")
def threshold_hints(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("points"), "l_suppkey", F.concat(F.lit(" "), "l_returnflag").alias("description"))
    return changes.differing_thresholds(lines.where("l_suppkey % 2 = 0"), lines.where("l_suppkey % 3 = 0").withColumn("description", F.lower("description")), "k")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS answer, CASE WHEN o_orderkey % 3 = 0 THEN 'no result' WHEN o_orderkey % 3 = 2 THEN 'overloaded' END AS reason FROM orders")
def batch_answers(spark: SparkSession, d: str) -> DataFrame:
    orders, k = t(spark, d, "orders"), F.col("o_orderkey")
    results = orders.where(k % 3 != 0).select("o_orderkey", F.col("o_orderpriority").alias("answer"), F.when(k % 3 == 2, "overloaded").alias("error"))
    return changes.batch_results(orders.select("o_orderkey"), results, "o_orderkey")


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'token' ELSE event_type END AS kind, event_type AS text, event_id % 10 AS tokens FROM events),
 c AS (SELECT *, CASE WHEN kind = 'token' AND lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) = 'token' THEN 0 ELSE 1 END AS cut FROM e), n AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS item FROM c)
 SELECT user_id, item, first(kind) AS kind, string_agg(text, '' ORDER BY event_id) AS text, sum(tokens)::BIGINT AS tokens FROM n GROUP BY 1, 2""")
def chat_turn_items(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "view"), "token").otherwise(F.col("event_type"))
    events = t(spark, d, "events").select("user_id", "event_id", kind.alias("kind"), F.col("event_type").alias("text"), (F.col("event_id") % 10).alias("tokens"))
    return changes.turn_items(events, "user_id", "event_id")


@query("""WITH log AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'P') SELECT c_custkey AS message, g AS place, o_orderkey AS result FROM customer CROSS JOIN range(1, 4) r(g) LEFT JOIN log ON o_custkey = c_custkey AND log.place = g""")
def replayed_calls(spark: SparkSession, d: str) -> DataFrame:
    calls = t(spark, d, "customer").select(F.col("c_custkey").alias("message"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("place"))
    log = t(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("message"), F.col("o_orderkey").alias("result"))
    return changes.replayed(calls, log, "message", "result", "result").withColumn("place", F.col("place").cast("long"))


@query("SELECT conv_id, count(*) AS messages, count(*) FILTER (role <> 'user') AS answers, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1")
def conversation_history(spark: SparkSession, d: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") != "user").alias("answers"), F.array_join(F.transform(ordered, lambda x: x["role"]), ">").alias("roles"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, least(l_quantity - 5, 40))::DOUBLE AS score, CASE WHEN l_quantity - 5 < 0 THEN 'too low' WHEN l_quantity - 5 > 40 THEN 'too high' END AS reason FROM lineitem")
def graded_scores(spark: SparkSession, d: str) -> DataFrame:
    given = F.col("l_quantity") - 5
    reason = F.when(given < 0, "too low").when(given > 40, "too high")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.greatest(F.lit(0), F.least(given, F.lit(40))).cast("double").alias("score"), reason.alias("reason"))


@query("SELECT o_orderkey, o_custkey, n_orderkey FROM (SELECT o_custkey, year(o_orderdate) AS y, min(o_orderkey) AS n_orderkey FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2) x JOIN (SELECT o_orderkey, o_custkey AS c, year(o_orderdate) AS y FROM orders WHERE o_orderstatus = 'F') z ON z.c = x.o_custkey AND z.y = x.y")
def grade_context(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    lowest = orders.where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("_c"), F.col("y").alias("_y")).agg(F.min("o_orderkey").alias("n_orderkey"))
    asked = orders.where("o_orderstatus = 'F'")
    return asked.join(lowest, (F.col("o_custkey") == F.col("_c")) & (F.col("y") == F.col("_y"))).select("o_orderkey", "o_custkey", "n_orderkey")


@query("SELECT event_id, user_id, substr(coalesce(json_extract_string(props, '$.k'), event_type), 1, 4) AS summary FROM events WHERE event_type <> 'view' OR user_id % 2 = 0")
def audit_records(spark: SparkSession, d: str) -> DataFrame:
    kept = t(spark, d, "events").where((F.col("event_type") != "view") | (F.col("user_id") % 2 == 0))
    return kept.select("event_id", "user_id", F.substring(F.coalesce(F.get_json_object("props", "$.k"), "event_type"), 1, 4).alias("summary"))


@query("SELECT o_orderkey, string_agg(g::VARCHAR, ',' ORDER BY g) AS pages FROM (SELECT o_orderkey, unnest(range(p, greatest(p, least(coalesce(x, 30), p + 4, 30)) + 1)) AS g FROM (SELECT o_orderkey, o_orderkey % 30 + 1 AS p, nullif(o_orderkey % 30 + 1 + o_custkey % 7, o_orderkey % 30 + 1) AS x FROM orders)) GROUP BY 1")
def page_windows(spark: SparkSession, d: str) -> DataFrame:
    page = F.col("o_orderkey") % 30 + 1
    return t(spark, d, "orders").select("o_orderkey", F.array_join(fx.page_window(page, F.nullif(page + F.col("o_custkey") % 7, page), F.lit(30)).cast("array<string>"), ",").alias("pages"))


@query("SELECT s_suppkey, format('{:.1f}%', CASE WHEN n > 0 THEN 100 * r / n ELSE 0 END) AS share FROM (SELECT s_suppkey, count(l_orderkey) AS n, count(*) FILTER (l_returnflag = 'N') AS r FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1)")
def percent_labels(spark: SparkSession, d: str) -> DataFrame:
    per = t(spark, d, "supplier").join(t(spark, d, "lineitem"), F.col("s_suppkey") == F.col("l_suppkey"), "left").groupBy("s_suppkey").agg(F.count("l_orderkey").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("r"))
    return per.select("s_suppkey", fx.percent(F.col("r"), F.col("n")).alias("share"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'x^(-' || p_size || ')+y_(ab)' ELSE 'x^' || (p_size % 10) END AS merged FROM part")
def merged_scripts(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    run = F.concat(F.lit("x^-"), F.array_join(F.transform(F.filter(F.split(size, ""), lambda c: c != ""), lambda c: F.concat(F.lit("^"), c)), ""), F.lit("+y_a_b"))
    text = F.when(F.col("p_partkey") % 2 == 0, run).otherwise(F.concat(F.lit("x^"), (F.col("p_size") % 10).cast("string")))
    return t(spark, d, "part").select("p_partkey", fx.merged_scripts(text).alias("merged"))


@query(r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'P=\frac{' || p_size || '}{2} \cdot 3.5' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'x^{2}-' || p_size END AS latex,
 CASE p_partkey % 4 WHEN 1 THEN 'prose: punkt' WHEN 2 THEN 'root' END AS reason FROM part""")
def normal_expressions(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit("zapisanie: P="), size, F.lit("/2 · 3,5 lub inne"))).when(k % 4 == 1, F.concat(F.lit("punkt "), size)).when(k % 4 == 2, F.concat(F.lit("√"), size)).otherwise(F.concat(F.lit("x²−"), size, F.lit(".")))
    return spread(t(spark, d, "part"), "p_partkey").select("p_partkey", fx.expression(text).alias("e")).select("p_partkey", "e.latex", "e.reason")


@query("SELECT event_id, least(CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2100-01-01' WHEN event_id % 3 = 1 THEN ts END, TIMESTAMP '2030-01-01') AS at FROM events WHERE event_id % 3 <> 2 UNION ALL SELECT event_id, TIMESTAMP '2030-01-01' FROM events WHERE event_id % 3 = 2")
def started_times(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    given = F.when(k % 3 == 0, "2100-01-01T00:00:00").when(k % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise("never")
    return t(spark, d, "events").select("event_id", fx.started_at(given, F.lit("2030-01-01 00:00:00").cast("timestamp")).alias("at"))
