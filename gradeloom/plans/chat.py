"""Chat turns made of the event stream and of conversations; the SQL folds the same events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chat
from ..session import table as t
from .registry import query

#: Events of a user as events of a turn, in SQL that Spark and other engines read alike.
_EVENTS = """SELECT user_id AS k, event_id AS o, case event_id % 11 when 0 then 'tool_call' when 1 then 'tool_result' when 2 then 'confirm' when 3 then 'usage' when 4 then 'ui' when 5 then 'error' when 6 then (case when event_id % 3 = 0 then 'done' else 'token' end) else 'token' end AS kind,
 case when event_id % 13 = 0 then null else event_type || ' ' end AS text, case when event_id % 11 < 2 then cast(event_id % 4 as string) end AS call, case when event_id % 11 = 4 and event_id % 2 = 0 then 'navigate' else event_type end AS name, cast(event_id % 7 as string) AS args,
 event_id % 5 = 0 AS is_error, event_id AS confirmation, '/task/' || cast(event_id % 9 as string) AS url, event_id % 100 AS input_tokens, event_id % 10 AS output_tokens, cast(event_id % 8 as double) / 8 AS usd, case when event_id % 6 = 0 then 'waiting' else 'idle' end AS state FROM events"""
_E = f"e AS MATERIALIZED ({_EVENTS.replace('as string', 'as varchar')})"
_ENDING = "('tool_call', 'confirm', 'done', 'error')"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_EVENTS.replace("FROM events", "FROM {events}"), events=t(spark, d, "events"))


@query(f"""WITH {_E}, p AS (SELECT *, coalesce(sum(CASE WHEN kind IN {_ENDING} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM e),
 x AS (SELECT k, part, string_agg(coalesce(text, ''), '' ORDER BY o) AS text FROM p WHERE kind = 'token' GROUP BY 1, 2),
 r AS (SELECT c.k, c.o, arg_max(r.text, r.o) FILTER (r.text IS NOT NULL) AS ignored, max(r.o) AS at_ FROM e c JOIN e r ON r.k = c.k AND r.kind = 'tool_result' AND r.call = c.call AND r.o > c.o WHERE c.kind = 'tool_call' GROUP BY 1, 2),
 i AS (SELECT p.k, p.o, 0 AS f, 'agent' AS kind, x.text, NULL AS call, NULL AS name, NULL AS args, NULL AS result, NULL AS is_error, NULL::BIGINT AS confirmation, NULL AS state FROM p JOIN x USING (k, part) WHERE p.kind IN {_ENDING} AND x.text <> ''
  UNION ALL SELECT e.k, e.o, 1, CASE e.kind WHEN 'tool_call' THEN 'tool' ELSE e.kind END, CASE e.kind WHEN 'error' THEN e.text WHEN 'ui' THEN e.url END, e.call, e.name, e.args, q.text, q.is_error, e.confirmation, CASE WHEN e.kind = 'tool_call' AND r.at_ IS NULL THEN 'open' WHEN e.kind = 'confirm' THEN 'pending' END
  FROM e LEFT JOIN r ON r.k = e.k AND r.o = e.o LEFT JOIN e q ON q.k = e.k AND q.o = r.at_ WHERE e.kind IN ('tool_call', 'confirm', 'ui', 'error'))
 SELECT k, row_number() OVER (PARTITION BY k ORDER BY o, f) - 1 AS item, kind, text, call, name, args, result, is_error, confirmation, state FROM i""")
def chat_items(spark: SparkSession, d: str) -> DataFrame:
    return chat.items(_events(spark, d), "k", "o")


@query(f"""WITH {_E}, l AS (SELECT k, max(o) FILTER (kind IN {_ENDING}) AS last_o, arg_max(kind, o) FILTER (kind IN {_ENDING}) AS last_kind FROM e GROUP BY 1),
 p AS (SELECT e.k, string_agg(coalesce(text, ''), '' ORDER BY o) FILTER (kind = 'token' AND (last_o IS NULL OR o > last_o)) AS partial, any_value(last_kind) AS last_kind, arg_max(url, o) FILTER (kind = 'ui' AND name = 'navigate') AS navigate_to,
  coalesce(sum(input_tokens) FILTER (kind = 'usage'), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens) FILTER (kind = 'usage'), 0)::BIGINT AS output_tokens, coalesce(sum(usd) FILTER (kind = 'usage'), 0)::DOUBLE AS usd, coalesce(arg_max(state, o) FILTER (kind = 'done') = 'waiting', false) AS waiting FROM e JOIN l USING (k) GROUP BY 1)
 SELECT k, coalesce(partial, CASE WHEN last_kind IN ('tool_call', 'confirm') THEN '' END) AS partial, navigate_to, input_tokens, output_tokens, usd, waiting FROM p""")
def chat_turns(spark: SparkSession, d: str) -> DataFrame:
    return chat.turns(_events(spark, d), "k", "o").withColumn("usd", F.col("usd").cast("double"))


_CALLS = "SELECT user_id % 200 AS conv_id, event_id AS id, cast(event_id % 6 + 1 as bigint) AS message, event_type AS tool, case when event_id % 4 > 0 then event_type end AS summary, event_id % 3 = 0 AS is_error, case when event_id % 5 = 0 then 'accept' when event_id % 5 = 1 then 'reject' end AS decision FROM events"


@query(f"""WITH c AS ({_CALLS}), m AS (SELECT conv_id, turn AS id, role, text FROM conversations), r AS (SELECT conv_id, role AS kind, id AS of, text, NULL AS state, 0 AS a, id AS b, -1 AS c FROM m
 UNION ALL SELECT c.conv_id, 'tool', c.id, tool, CASE WHEN summary IS NULL THEN 'open' WHEN is_error THEN 'error' ELSE 'done' END, 0, message, c.id FROM c JOIN m ON m.conv_id = c.conv_id AND m.id = c.message UNION ALL SELECT conv_id, 'confirm', id, tool, 'pending', 1, id, 0 FROM c WHERE decision IS NULL)
 SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY a, b, c) - 1 AS place, kind, of, text, state FROM r""")
def chat_history(spark: SparkSession, d: str) -> DataFrame:
    calls = spark.sql(_CALLS.replace("FROM events", "FROM {events}"), events=t(spark, d, "events"))
    messages = t(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("id"), "role", F.col("text").alias("content"))
    return chat.history(messages, calls, calls, "conv_id")
