"""Chat turns as tables: events folded into items, history with calls and open confirmations, what a session used.

events: key, order, kind (token, tool_call, tool_result, ui, confirm, usage, done, error) and what they carry: text,
call (the id of a call), name, args, is_error, confirmation, url, input_tokens, output_tokens, usd, state. The fold is a
state machine whose state is where text was last cut off; each item is a row, found by windows over a turn's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Events that end the text before them, and those that are items of their own.
ENDING = ["tool_call", "confirm", "done", "error"]
ITEMS = {"tool_call": "tool", "confirm": "confirm", "ui": "ui", "error": "error"}


def items(events: DataFrame, key: str, order: str) -> DataFrame:
    """key, item (from 0), kind, text, call, name, args, result, is_error, confirmation, state.

    Text between two ends is one item of the agent, at its end's place; without an end it is still being written (``turns``).
    Results are put to the calls of their id that were made before them, the last one counts; a call without one is open
    (state open), a confirmation that was asked for is pending."""
    along = Window.partitionBy(key).orderBy(order)
    ends = F.col("kind").isin(*ENDING)
    # text belongs to the first end at or behind it
    cut = events.withColumn("_part", F.sum(ends.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - ends.cast("int"))
    texts = cut.where(F.col("kind") == "token").groupBy(key, "_part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("_text"))
    closed = cut.where(ends).join(texts, [key, "_part"]).where("_text <> ''")
    said = closed.select(key, F.col(order).alias("_o"), F.lit(0).alias("_first"), F.lit("agent").alias("kind"), F.col("_text").alias("text"))
    kind = F.create_map(*[F.lit(x) for pair in ITEMS.items() for x in pair])[F.col("kind")]
    own = events.where(F.col("kind").isin(*ITEMS)).select(
        key, F.col(order).alias("_o"), F.lit(1).alias("_first"), kind.alias("kind"), F.when(F.col("kind") == "error", F.col("text")).when(F.col("kind") == "ui", F.col("url")).alias("text"), "call", "name", "args", "confirmation",
    )
    results = events.where((F.col("kind") == "tool_result") & F.col("call").isNotNull()).select(F.col(key).alias("_k"), F.col("call").alias("_c"), F.struct(F.col(order).alias("o"), "text", "is_error").alias("_r"))
    calls = own.where(F.col("kind") == "tool").select(key, "_o", F.col("call").alias("_call"))
    answered = calls.join(results, (F.col(key) == F.col("_k")) & (F.col("_call") == F.col("_c")) & (F.col("_r.o") > F.col("_o"))).groupBy(key, "_o").agg(F.max("_r").alias("_r"))
    every = said.unionByName(own, allowMissingColumns=True).join(answered, [key, "_o"], "left")
    mine = F.when(F.col("kind") == "tool", F.col("_r"))
    state = F.when((F.col("kind") == "tool") & F.col("_r").isNull(), "open").when(F.col("kind") == "confirm", "pending")
    number = F.row_number().over(Window.partitionBy(key).orderBy("_o", "_first")) - 1
    return every.select(key, number.alias("item"), "kind", "text", "call", "name", "args", mine["text"].alias("result"), mine["is_error"].alias("is_error"), "confirmation", state.alias("state"))


def decided(folded: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """items with the state of their decisions (key, confirmation, decision: accepted or rejected; the first of each counts)."""
    first = decisions.groupBy(F.col(key).alias("_k"), F.col("confirmation").alias("_c")).agg(F.min_by("decision", "place").alias("_d"))
    joined = folded.join(first, (F.col(key) == F.col("_k")) & (F.col("confirmation") == F.col("_c")) & (F.col("kind") == "confirm"), "left")
    return joined.withColumn("state", F.coalesce("_d", "state")).drop("_k", "_c", "_d")


def turns(events: DataFrame, key: str, order: str) -> DataFrame:
    """key, partial (text behind the last end, null if there was no event of text since), navigate_to, input_tokens, output_tokens, usd, waiting.

    A call or a question leaves an empty text behind it, the end of a turn none."""
    last_end = F.max(F.when(F.col("kind").isin(*ENDING), F.struct(F.col(order).alias("o"), F.col("kind").alias("kind"))))
    marked = events.withColumn("_end", last_end.over(Window.partitionBy(key)))
    writing = (F.col("kind") == "token") & (F.col("_end").isNull() | (F.col(order) > F.col("_end.o")))
    tail = F.array_sort(F.collect_list(F.when(writing, F.struct(F.col(order).alias("o"), F.coalesce("text", F.lit("")).alias("t")))))
    navigating = (F.col("kind") == "ui") & (F.col("name") == "navigate") & (F.col("url") != "")
    used = lambda c: F.coalesce(F.sum(F.when(F.col("kind") == "usage", F.col(c))), F.lit(0)).alias(c)
    rows = marked.groupBy(key).agg(
        tail.alias("_tail"), F.first("_end").alias("_end"), F.max_by("url", F.when(navigating, F.col(order))).alias("navigate_to"), F.count_if(navigating).alias("_n"), used("input_tokens"), used("output_tokens"), used("usd"),
        F.max_by("state", F.when(F.col("kind") == "done", F.col(order))).alias("_state"),
    )
    partial = F.when(F.size("_tail") > 0, F.array_join(F.transform("_tail", lambda x: x["t"]), "")).when(F.col("_end.kind").isin("tool_call", "confirm"), "")
    return rows.select(key, partial.alias("partial"), F.when(F.col("_n") > 0, F.col("navigate_to")).alias("navigate_to"), "input_tokens", "output_tokens", "usd", F.coalesce(F.col("_state") == "waiting", F.lit(False)).alias("waiting"))


def history(messages: DataFrame, calls: DataFrame, confirmations: DataFrame, key: str) -> DataFrame:
    """key, place, kind, of, text, state: messages in order, each with the calls made in it behind it, then the confirmations that wait.

    messages: key, id, role, content; calls: key, id, message, tool, summary, is_error; confirmations: key, id, tool, decision."""
    said = messages.select(key, F.col("role").alias("kind"), F.col("id").alias("of"), F.col("content").alias("text"), F.lit(None).cast("string").alias("state"), F.struct(F.lit(0).alias("a"), F.col("id").alias("b"), F.lit(-1).cast("long").alias("c")).alias("_at"))
    known = messages.select(key, F.col("id").alias("message"))
    own = calls.join(known, [key, "message"])  # calls of messages that are gone aren't shown
    made = own.select(key, F.lit("tool").alias("kind"), F.col("id").alias("of"), F.col("tool").alias("text"), F.when(F.col("summary").isNull(), "open").when(F.col("is_error"), "error").otherwise("done").alias("state"), F.struct(F.lit(0).alias("a"), F.col("message").alias("b"), F.col("id").alias("c")).alias("_at"))
    waiting = confirmations.where("decision is null").select(key, F.lit("confirm").alias("kind"), F.col("id").alias("of"), F.col("tool").alias("text"), F.lit("pending").alias("state"), F.struct(F.lit(1).alias("a"), F.col("id").alias("b"), F.lit(-1).cast("long").alias("c")).alias("_at"))
    rows = said.unionByName(made).unionByName(waiting)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_at")) - 1).select(key, "place", "kind", "of", "text", "state")


def usage(sessions: DataFrame, messages: DataFrame, prices: DataFrame, key: str) -> DataFrame:
    """key, model, input_tokens, output_tokens, turns (messages of the agent), usd; prices: model, input, output for a million tokens."""
    per = messages.groupBy(key).agg(F.sum("input_tokens").alias("_in"), F.sum("output_tokens").alias("_out"), F.count_if(F.col("role") == "agent").alias("_turns"))
    rows = sessions.join(per, key, "left").join(prices, "model", "left")
    whole = lambda c: F.coalesce(F.col(c), F.lit(0))
    usd = F.round((whole("_in") * F.col("input") + whole("_out") * F.col("output")) / 1e6, 4)
    return rows.select(key, "model", whole("_in").alias("input_tokens"), whole("_out").alias("output_tokens"), whole("_turns").alias("turns"), usd.alias("usd"))
