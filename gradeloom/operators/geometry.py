"""Regions of a page: shapes in a band of it, and boxes that lie near each other as one region."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDES = ["x0", "top", "x1", "bottom"]


def candidates(shapes: DataFrame, band_top: Column, band_bottom: Column, column_width: Column, least: float = 3.0) -> DataFrame:
    """Shapes that overlap a band by half of their height or more, without dashes and rules as wide as the column."""
    height = F.greatest(F.col("bottom") - F.col("top"), F.lit(1e-9))
    overlap = F.least(F.col("bottom"), band_bottom) - F.greatest(F.col("top"), band_top)
    dash = (F.col("x1") - F.col("x0") < least) & (F.col("bottom") - F.col("top") < least)
    return shapes.where((overlap >= height / 2) & ~dash & (F.col("x1") - F.col("x0") < column_width))


def fraction_bars(rules: DataFrame, tables: DataFrame, page: str, thickest: float = 1.6, shortest: float = 3.0, longest: float = 90.0) -> DataFrame:
    """Thin short horizontal rules that lie in no table of their page; tables have page and the four sides."""
    thin = rules.where((F.col("bottom") - F.col("top") <= thickest) & (F.col("x1") - F.col("x0")).between(shortest, longest))
    around = tables.select(F.col(page).alias("_page"), *[F.col(s).alias(f"_{s}") for s in SIDES])
    inside = (F.col(page) == F.col("_page")) & (F.col("x0") >= F.col("_x0")) & (F.col("x1") <= F.col("_x1")) & (F.col("top") >= F.col("_top")) & (F.col("bottom") <= F.col("_bottom"))
    return thin.join(around, inside, "left_anti")


def regions(boxes: np.ndarray, gap: float) -> np.ndarray:
    """Bounding boxes (rows of x0, top, x1, bottom) of the classes of boxes that are within the gap of each other.

    A class is what a sweep from left to right connects. Its bounding box may come near others, so the
    bounding boxes are swept again, until all classes are single boxes."""
    while len(boxes) > 1:
        boxes = boxes[np.lexsort(boxes.T[::-1])]
        parent = list(range(len(boxes)))

        def top_of(k: int, parent: list[int] = parent) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        reach = np.searchsorted(boxes[:, 0], boxes[:, 2] + gap, side="right")
        for k in range(len(boxes)):
            right = boxes[k + 1 : reach[k]]
            level = (right[:, 1] <= boxes[k, 3] + gap) & (right[:, 3] >= boxes[k, 1] - gap)
            for j in np.flatnonzero(level):
                parent[top_of(k + 1 + int(j))] = top_of(k)
        classes = np.unique([top_of(k) for k in range(len(boxes))], return_inverse=True)[1]
        if classes.max() + 1 == len(boxes):
            break
        low, high = np.full((classes.max() + 1, 2), np.inf), np.full((classes.max() + 1, 2), -np.inf)
        np.minimum.at(low, classes, boxes[:, :2])
        np.maximum.at(high, classes, boxes[:, 2:])
        boxes = np.hstack([low, high])
    return boxes


def regions_of_pages(page: np.ndarray, boxes: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Pages and regions of many pages' boxes at once: what ``regions`` gives for each page, by page, then x0, top, x1, bottom.

    Neighbours are compared at all pages together, the next one to the right first, then the one after it; so this is meant for
    pages of few boxes. Pages whose regions are single boxes are done, the others are swept again."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(page):
        order = np.lexsort((*boxes.T[::-1], page))
        page, boxes = page[order], boxes[order]
        root = np.arange(len(page))
        left, right = [], []
        k, far = root, 1
        while len(k):
            k = k[k + far < len(page)]
            j = k + far
            reach = boxes[k, 2] + gap
            near = (page[j] == page[k]) & ((boxes[j, 0] <= reach) | np.isnan(reach))
            k, j = k[near], j[near]
            level = (boxes[j, 1] <= boxes[k, 3] + gap) & (boxes[j, 3] >= boxes[k, 1] - gap)
            left.append(k[level])
            right.append(j[level])
            far += 1
        left, right = np.concatenate(left), np.concatenate(right)
        while True:  # each box takes the smallest box that it is linked to, until nothing changes
            low = root.copy()
            np.minimum.at(low, left, root[right])
            np.minimum.at(low, right, root[left])
            low = low[low]
            if np.array_equal(low, root):
                break
            root = low
        heads, classes = np.unique(root, return_inverse=True)
        low, high = np.full((len(heads), 2), np.inf), np.full((len(heads), 2), -np.inf)
        np.minimum.at(low, classes, boxes[:, :2])
        np.maximum.at(high, classes, boxes[:, 2:])
        again = np.isin(page[heads], page[root != np.arange(len(page))])
        page, boxes = page[heads], np.hstack([low, high])
        done.append((page[~again], boxes[~again]))
        page, boxes = page[again], boxes[again]
    pages, found = [np.concatenate(x) for x in zip(*done, strict=True)] if done else (page, boxes)
    order = np.lexsort((*found.T[::-1], pages))
    return pages[order], found[order]


def _regions_of_all(page: np.ndarray, boxes: np.ndarray, gap: float, few: int = 64, at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Pages and regions of boxes that ascend by page: small pages some thousand boxes at a time, large ones each for itself."""
    sizes = np.bincount(page)
    large = sizes[page] > few
    out = [regions_of_pages(page[~large][:0], boxes[:0], gap)]
    small_pages, small_boxes = page[~large], boxes[~large]
    at = 0
    while at < len(small_pages):
        end = int(np.searchsorted(small_pages, small_pages[min(at + at_once, len(small_pages)) - 1], side="right"))
        out.append(regions_of_pages(small_pages[at:end], small_boxes[at:end], gap))
        at = end
    for k in np.unique(page[large]):
        found = regions(boxes[page == k], gap)
        out.append((np.full(len(found), k), found))
    pages, found = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
    order = np.lexsort((*found.T[::-1], pages))
    return pages[order], found[order]


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)  # null as nan


def clusters(boxes: DataFrame, page: str, gap: float = 8.0, least_side: float = 24.0, least_area: float = 2500.0, most_width: float = 1e9, pad: float = 6.0, most: int = 400) -> DataFrame:
    """page, region, the four sides and crowded of each page's regions, from the top left.

    Many boxes of a page are joined within each batch before the shuffle: what a part of the boxes connects, all
    of them connect too. crowded marks pages of more than ``most`` boxes, whose regions say little."""
    kind = dict(boxes.dtypes)[page]
    sides = ", ".join(f"{s} double" for s in SIDES)

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones = pa.array(np.ones(batch.num_rows, dtype=np.int64))
            keys = batch.column(0).dictionary_encode()
            number = keys.indices.to_numpy(zero_copy_only=False)
            many = np.bincount(number, minlength=len(keys.dictionary))[number] > 64  # fewer are joined once, after the shuffle
            whole = pa.RecordBatch.from_arrays([*batch.columns, ones], [page, *SIDES, "n"])
            if not many.any():
                yield whole
                continue
            yield whole.filter(pa.array(~many))
            matrix = np.column_stack([_numbers(c) for c in batch.columns[1:]])
            for k in np.unique(number[many]):
                rows = matrix[number == k]
                joined = regions(rows, gap)
                counts = np.zeros(len(joined), dtype=np.int64)
                counts[0] = len(rows)
                yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(np.full(len(joined), k))), *[pa.array(c, from_pandas=True) for c in joined.T], pa.array(counts)], [page, *SIDES, "n"])

    def wholly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = batch.column(1)
            sizes = np.diff(shapes.offsets.to_numpy())
            flat = shapes.flatten()
            matrix = np.column_stack([_numbers(flat.field(s)) for s in SIDES]) if len(flat) else np.empty((0, 4))
            at, found = _regions_of_all(np.repeat(np.arange(len(sizes)), sizes), matrix, gap)
            width, height = found[:, 2] - found[:, 0], found[:, 3] - found[:, 1]
            kept = (np.minimum(width, height) >= least_side) & (width * height >= least_area) & (width < 0.97 * most_width)
            at, found = at[kept], found[kept]
            order = np.lexsort((found[:, 0], found[:, 1], at))
            at, found = at[order], found[order] + np.array([-pad, -pad, pad, pad])
            region = np.arange(len(at)) - np.searchsorted(at, at)
            crowded = batch.column(2).to_numpy(zero_copy_only=False)[at] > most
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(region, pa.int32()), *[pa.array(c) for c in found.T], pa.array(crowded)], [page, "region", *SIDES, "crowded"])

    slim = boxes.select(page, *[F.col(s).cast("double").alias(s) for s in SIDES]).where(F.col(page).isNotNull())
    joined = slim.mapInArrow(partly, f"{page} {kind}, {sides}, n long")
    pages = joined.groupBy(page).agg(F.collect_list(F.struct(*SIDES)).alias("shapes"), F.sum("n").alias("n"))
    return pages.mapInArrow(wholly, f"{page} {kind}, region int, {sides}, crowded boolean")


def bands(headings: DataFrame, page: str, y: str, height: Column) -> DataFrame:
    """headings with band_bottom: the next heading's place, or the page's height."""
    return headings.withColumn("band_bottom", F.coalesce(F.lead(y).over(Window.partitionBy(page).orderBy(y)), height))


def footnotes(rows: DataFrame, page: str, y: str, size: str, smaller: float = 1.5) -> DataFrame:
    """rows with in_footnote: the rows at a page's end that are all set smaller than its usual size, if one of
    them is smaller by ``smaller`` points or more. The usual size is the most frequent, the larger of equals."""
    sizes = rows.groupBy(page, size).agg(F.count(F.lit(1)).alias("_n"))
    usual = sizes.groupBy(F.col(page).alias("_p")).agg(F.max_by(size, F.struct("_n", size)).alias("_usual"))
    below = Window.partitionBy(page).orderBy(F.col(y).desc()).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.join(usual, F.col(page).eqNullSafe(F.col("_p"))).withColumn("_tail", F.max(F.col(size) >= F.col("_usual")).over(below) == F.lit(False))
    small = F.max(F.col("_tail") & (F.col(size) <= F.col("_usual") - smaller)).over(Window.partitionBy(page))
    return marked.withColumn("in_footnote", F.col("_tail") & small).drop("_p", "_usual", "_tail")
