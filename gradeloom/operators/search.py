"""Keyword search over documents: an inverted index as a table and tf-idf scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_terms


def index(sections: DataFrame, key: str, body: str, heading: str | None = None, only: list[str] | None = None) -> DataFrame:
    """key, term, tf, in_heading: the terms of each section's body and heading; only: of these terms alone."""

    def terms(column: str) -> Column:
        found = search_terms(F.col(column))
        return F.filter(found, lambda x: x.isin(*only)) if only else found

    bodies = sections.select(key, F.explode(terms(body)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    if heading is None:
        return bodies.withColumn("in_heading", F.lit(False))
    heads = sections.select(key, F.explode(terms(heading)).alias("term")).distinct().withColumn("in_heading", F.lit(True))
    both = bodies.join(heads, [key, "term"], "full")
    return both.select(key, "term", F.coalesce("tf", F.lit(0)).alias("tf"), F.coalesce("in_heading", F.lit(False)).alias("in_heading"))


def scores(terms: DataFrame, key: str, n: Column | int, query: list[str], name: str | None = None, most: int | None = None) -> DataFrame:
    """key, score of sections that a query's terms occur in: idf * (1 + ln tf) in the body, 3 * idf in the heading, idf in the
    document's name where terms have a column that tells so; the best ``most`` of them, ties by key."""
    asked = terms.where(F.col("term").isin(*query))
    df = asked.groupBy("term").agg(F.countDistinct(key).alias("df"))
    idf = F.log(1 + F.lit(n) / (1 + F.col("df")))
    part = F.when(F.col("tf") > 0, idf * (1 + F.log("tf"))).otherwise(0.0) + F.when(F.col("in_heading"), 3 * idf).otherwise(0.0)
    if name:
        part = part + F.when(F.col(name), idf).otherwise(0.0)
    scored = asked.join(F.broadcast(df), "term").groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))  # df has a row for each query term
    return scored if most is None else scored.orderBy(F.desc("score"), key).limit(most)


def section(sections: DataFrame, heading: str | int) -> DataFrame:
    """Sections (section, title) by number, or by a part of their heading whatever its case."""
    return sections.where(F.col("section") == heading if isinstance(heading, int) else F.contains(F.lower("title"), F.lit(heading.lower())))


def grep(docs: DataFrame, key: str, text: str, pattern: str, most: int) -> DataFrame:
    """key, line_no, line of the first lines that a pattern fits, in order of key and line."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("_k", "line")).where(F.col("line").rlike(pattern))
    return lines.select(key, (F.col("_k") + 1).cast("long").alias("line_no"), "line").orderBy(key, "line_no").limit(most)
