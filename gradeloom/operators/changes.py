"""Loads, edits and their guards as tables before and after: what changes is a query, a written table replaces the old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse


def refused_keys(keys: DataFrame, stored: DataFrame, journal: DataFrame, key: str, reviewed: Column) -> DataFrame:
    """Keys that must not be loaded again: some of their stored rows are reviewed, or the journal knows them."""
    held = stored.where(reviewed).select(key).unionByName(journal.select(key)).distinct()
    return keys.select(key).distinct().join(held, key, "left_semi")


def load_keys(stored: DataFrame, incoming: DataFrame, key: str, refused: DataFrame) -> DataFrame:
    """The table after a load: all rows of a key that isn't refused are replaced, so that a second load changes nothing.

    Write it with dynamic partition overwrite by key, or as a new table."""
    new = incoming.join(refused.select(key), key, "left_anti")
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def keep_first(rows: DataFrame, keys: list[str], content: str, order: list[str]) -> DataFrame:
    """keys, content, n_divergent: the first content of each key (null keys are equal) and how many others came later; null is a content of its own."""
    whole = F.struct(content)
    return rows.groupBy(*keys).agg(F.min_by(whole, F.struct(*order))[content].alias(content), (F.countDistinct(whole) - 1).alias("n_divergent"))


def divergences(rows: DataFrame, keys: list[str], content: str, order: list[str]) -> DataFrame:
    """keys, content, kept, n, first: each other content of a key, the one that was kept, how often it came and where (the order's columns) first."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(content), F.struct(*order))[content].alias("kept"))
    every = rows.groupBy(*keys, content).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    on = F.lit(True)
    renamed = first.select(*[F.col(k).alias(f"_{k}") for k in keys], "kept")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return every.join(renamed, on).where(~F.col(content).eqNullSafe(F.col("kept"))).select(*keys, content, "kept", "n", "first")


def replace_latest(stored: DataFrame, incoming: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row of each key, that of the latest time; the incoming one of equals."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("_new"))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")


def change_set(stored: DataFrame, edits: DataFrame, batch: str, key: str, value: str, allowed: Column) -> DataFrame:
    """batch, key, change (update, delete, insert), old, new, accepted of all real changes.

    edits: batch, key, value, deleted. Texts are compared after their white space is collapsed; an edit to the same
    text is none. Values are checked after deletes are set aside; one value that isn't allowed rejects its batch."""
    new = edits.select(batch, key, collapse(F.col(value)).alias("_new"), "deleted", F.when(F.col("deleted"), True).otherwise(F.coalesce(allowed, F.lit(True))).alias("_fits"))
    old = stored.select(key, collapse(F.col(value)).alias("_old"), F.lit(True).alias("_stored"))
    both = new.join(old, key, "left")
    change = F.when(F.col("deleted") & F.col("_stored").isNotNull(), "delete").when(~F.col("deleted") & F.col("_stored").isNull(), "insert").when(~F.col("deleted") & ~F.col("_new").eqNullSafe(F.col("_old")), "update")
    marked = both.withColumn("change", change).withColumn("accepted", F.min("_fits").over(Window.partitionBy(batch)))
    return marked.where("change is not null").select(batch, key, "change", F.col("_old").alias("old"), F.when(~F.col("deleted"), F.col("_new")).alias("new"), "accepted")


def dry_run(changes: DataFrame) -> DataFrame:
    """change, n: what a change set would do."""
    return changes.where("accepted").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def cascade(deleted: DataFrame, key: str, levels: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """level, id of all rows below deleted ones; levels: (table, its reference, its key), each below the one before."""
    gone = deleted.select(F.col(key).cast("string").alias("_id")).distinct()
    out = gone.select(F.lit(0).alias("level"), F.col("_id").alias("id"))
    for k, (table, foreign, own) in enumerate(levels):
        gone = table.join(gone, F.col(foreign).cast("string") == F.col("_id"), "left_semi").select(F.col(own).cast("string").alias("_id")).distinct()
        out = out.unionByName(gone.select(F.lit(k + 1).alias("level"), F.col("_id").alias("id")))
    return out


def fill_expressions(stored: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """key, status, value after a conversion: results (key, value, reason); approved rows are never touched.

    A refused conversion and one without an answer fail with a null value."""
    joined = stored.join(results.select(key, F.col("value").alias("_v"), "reason", F.lit(True).alias("_answered")), key, "left")
    keep = F.col("status") == "approved"
    good = F.col("_answered").isNotNull() & F.col("reason").isNull() & F.col("_v").isNotNull()
    return joined.select(key, F.when(keep, F.col("status")).when(good, "auto").otherwise("failed").alias("status"), F.when(keep, F.col("value")).when(good, F.col("_v")).alias("value"))


def job_state(ended: Column, code: Column, alive: Column) -> Column:
    """finished, failed, running or unknown."""
    return F.when(ended & (code == 0), "finished").when(ended, "failed").when(alive, "running").otherwise("unknown")


def consent(asked: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """asked (key, tool, args) with verdict: run, or why not. decided: key, tool, args, decision, used.

    Consent holds for the same tool and the very same arguments in canonical form, once."""
    d = decided.select(F.col(key).alias("_k"), F.col("tool").alias("_tool"), F.col("args").alias("_args"), "decision", "used")
    joined = asked.join(d, F.col(key) == F.col("_k"), "left")
    verdict = (
        F.when(F.col("_k").isNull(), "unknown").when(F.col("decision").isNull(), "pending").when(F.col("decision") == "rejected", "rejected")
        .when(F.col("_tool") != F.col("tool"), "other tool").when(F.col("_args") != F.col("args"), "other arguments").when(F.col("used"), "used up").otherwise("run")
    )
    return joined.select(*asked.columns, verdict.alias("verdict"))


def session_problems(answered: DataFrame, key: str, question: str, place: str, total: int) -> DataFrame:
    """key, n_repeated, n_out_of_range, n_answered, submittable of a client's sessions."""
    inside = F.col(place).between(1, total)
    return answered.groupBy(key).agg(
        (F.count(question) - F.countDistinct(question)).alias("n_repeated"), F.count_if(~inside).alias("n_out_of_range"), F.countDistinct(F.when(inside, F.col(question))).alias("n_answered"),
    ).withColumn("submittable", F.col("n_answered") > 0)


def differing_thresholds(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """key, points, hint: thresholds (points, description) that one side lacks, and conditions that differ after tidying."""
    fold = lambda c: F.lower(collapse(F.col(c)))
    a = ours.select(key, "points", fold("description").alias("_a"), F.lit(True).alias("_ours")).distinct()
    b = theirs.select(key, "points", fold("description").alias("_b"), F.lit(True).alias("_theirs")).distinct()
    pa, pb = a.select(key, "points", "_ours").distinct(), b.select(key, "points", "_theirs").distinct()
    points = pa.join(pb, [key, "points"], "full").where("_ours is null or _theirs is null").select(key, "points", F.when(F.col("_ours").isNull(), "threshold missing").otherwise("threshold extra").alias("hint"))
    known = b.join(pa, [key, "points"], "left_semi").join(a.select(F.col(key).alias("_k"), F.col("points").alias("_p"), "_a"), (F.col(key) == F.col("_k")) & (F.col("points") == F.col("_p")) & F.col("_b").eqNullSafe(F.col("_a")), "left_anti")
    return points.unionByName(known.select(key, "points", F.lit("condition missing").alias("hint")).distinct())


def batch_results(asked: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """asked with answer and reason by key, never by position; a missing or failed result says why."""
    r = results.select(F.col(key).alias("_k"), "answer", "error")
    joined = asked.join(r, F.col(key) == F.col("_k"), "left")
    return joined.select(*asked.columns, F.when(F.col("error").isNull(), F.col("answer")).alias("answer"), F.when(F.col("_k").isNull(), "no result").otherwise(F.col("error")).alias("reason"))


def turn_items(events: DataFrame, key: str, order: str) -> DataFrame:
    """key, item, kind, text, tokens: chat events (kind, text, tokens) folded into items.

    Pieces of text that follow each other are one item, which any other event ends."""
    w = Window.partitionBy(key).orderBy(order)
    cut = F.coalesce((F.col("kind") != "token") | (F.lag("kind").over(w) != "token"), F.lit(True))
    numbered = events.withColumn("item", F.sum(cut.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("text", F.lit("")).alias("t"))))
    return numbered.groupBy(key, "item").agg(F.first("kind").alias("kind"), F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"), F.sum("tokens").alias("tokens"))


def replayed(calls: DataFrame, log: DataFrame, message: str, order: str, result: str) -> DataFrame:
    """calls (message, place from 1) with the log's result of the same place within their message."""
    w = Window.partitionBy(message).orderBy(order)
    placed = log.withColumn("_place", F.row_number().over(w)).select(F.col(message).alias("_m"), "_place", result)
    return calls.join(placed, (F.col(message) == F.col("_m")) & (F.col("place") == F.col("_place")), "left").drop("_m", "_place")
