"""Papers read from their pages: tasks with their content, and the figures that belong to them.

pages: page, number (from 0), width, height; texts: page, text; headings: page, task, y (the upper edge of a task's
header); shapes: page, x0, top, x1, bottom; columns: page, left, right of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import geometry
from .parsing import TASK, one_line

#: Words that speak of a figure, the first kind that a content holds is its kind.
GRAPHICS = [("chart", r"wykres\w*"), ("diagram", r"diagram\w*"), ("drawing", r"(?:rysunek|rysunk\w+|siatc\w+|osi liczbowej)")]
#: Most characters of a content, most figures of a task on a page, most shapes of a band that say anything.
MOST_CHARS, MOST_FIGURES, MOST_SHAPES = 1500, 3, 400
#: Fixed values, in points: dots of an answer line; lines as wide as the column; figures that are tables.
DASH_THIN, DASH_LONG, RULE_SHARE, RULE_HIGH, TABLE_SHARE, MARGIN = 1.0, 20.0, 0.95, 20.0, 0.97, 6.0


def graphic_kind(content: Column) -> Column:
    """What kind of figure a content speaks of; null if of none."""
    return F.coalesce(*[F.when(content.rlike(rf"(?i)(?:^|[^\pL\pN_]){p}(?:[^\pL\pN_]|$)"), kind) for kind, p in GRAPHICS])


def occurrences(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """page, number, k, task, content (whole) of every task header in the pages' texts."""
    cut = texts.select("page", F.split("text", TASK).alias("_parts"), F.regexp_extract_all("text", F.lit(TASK), F.lit(1)).alias("_tasks"))
    zipped = F.arrays_zip(F.col("_tasks").alias("task"), F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))).alias("content"))
    rows = cut.select("page", F.posexplode_outer(zipped).alias("k", "_z")).where(F.col("k").isNotNull())
    return rows.join(pages.select("page", "number"), "page").select("page", "number", "k", "_z.task", "_z.content")


def contents(found: DataFrame) -> DataFrame:
    """task, page_number (from 1), content of each task: that of its first header."""
    first = found.groupBy("task").agg(F.min_by(F.struct("number", "content"), F.struct("number", "k")).alias("_f"))
    return first.select("task", (F.col("_f.number") + 1).alias("page_number"), F.substring(one_line(F.col("_f.content")), 1, MOST_CHARS).alias("content"))


def bands(headings: DataFrame, pages: DataFrame) -> DataFrame:
    """page, task, band_top, band_bottom: from a task's header, the first of its number on a page, to the next header or the page's end."""
    along = Window.partitionBy("page").orderBy("y", "task")
    cut = headings.join(pages.select("page", "height"), "page").withColumn("band_bottom", F.coalesce(F.lead("y").over(along), F.col("height")))
    return cut.groupBy("page", "task").agg(F.min_by(F.struct(F.col("y").alias("t"), F.col("band_bottom").alias("b")), "y").alias("_b")).select("page", "task", F.col("_b.t").alias("band_top"), F.col("_b.b").alias("band_bottom"))


def figures(shapes: DataFrame, cut: DataFrame, pages: DataFrame, columns: DataFrame) -> DataFrame:
    """page, task and the four sides of the figures in a task's band; none where too many shapes say nothing.

    A shape belongs to the band that half of its height is in; dots and lines as wide as the column are no figures, and
    neither are regions as wide as the column, which are tables."""
    wide, high = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    span = F.col("right") - F.col("left")
    dash = ((high <= DASH_THIN) & (wide <= DASH_LONG)) | ((wide <= DASH_THIN) & (high <= DASH_LONG))
    rule = (span > 0) & (wide >= RULE_SHARE * span) & (high <= RULE_HIGH)
    overlap = F.least("bottom", "band_bottom") - F.greatest("top", "band_top")
    inside = F.when(high <= 0, F.col("top").between(F.col("band_top"), F.col("band_bottom"))).otherwise(overlap >= high / 2)
    near = shapes.join(cut, "page").join(columns, "page").where(inside & ~dash & ~rule)
    named = near.select(F.to_json(F.struct("page", "task")).alias("_of"), "page", "task", "x0", "top", "x1", "bottom")
    joined = geometry.clusters(named, "_of", most=MOST_SHAPES, pad=0.0).where("not crowded").drop("crowded", "region")
    keyed = joined.join(named.select("_of", "page", "task").distinct(), "_of").join(columns, "page").join(pages.select("page", "width", "height"), "page")
    kept = keyed.where((span <= 0) | (wide < TABLE_SHARE * span))
    return kept.select("page", "task", F.greatest(F.lit(0.0), F.col("x0") - MARGIN).alias("x0"), F.greatest(F.lit(0.0), F.col("top") - MARGIN).alias("top"), F.least("width", F.col("x1") + MARGIN).alias("x1"), F.least("height", F.col("bottom") + MARGIN).alias("bottom"))


def assets(found: DataFrame, framed: DataFrame, pages: DataFrame) -> DataFrame:
    """task, page_number (from 1), kind, the four sides, whole_page of the figures of tasks whose content speaks of one, once for each page.

    Without a figure, or with more than three, the whole page is left to a person."""
    asked = found.withColumn("kind", graphic_kind(F.col("content"))).where("kind is not null").groupBy("page", "task").agg(F.min_by("kind", "k").alias("kind"))
    counted = framed.groupBy("page", "task").agg(F.sort_array(F.collect_list(F.struct("top", "x0", "x1", "bottom"))).alias("_frames"))
    rows = asked.join(counted, ["page", "task"], "left").join(pages, "page")
    good = F.col("_frames").isNotNull() & (F.size("_frames") <= MOST_FIGURES)
    page = F.array(F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("x0"), F.col("width").cast("double").alias("x1"), F.col("height").cast("double").alias("bottom")))
    each = rows.select("task", (F.col("number") + 1).alias("page_number"), "kind", F.explode(F.when(good, F.col("_frames")).otherwise(page)).alias("_f"), (~good).alias("whole_page"))
    return each.select("task", "page_number", "kind", "_f.x0", "_f.top", "_f.x1", "_f.bottom", "whole_page")
