"""Mixing sources to target weights by entropy balancing.

Targets: the sources, in code point order with null last, have repeating weights and share
``share`` times all words; a target stops at ``cap`` times its source's words and the excess goes
to the others by weight. The water level of that rule is found by a few aggregations.

Rates: among all rates r of the documents with sum(r * size) = target in each source and r <= cap,
those nearest to 1 in entropy are exponentially tilted, r = min(cap, exp(tilt * size / mean size)).
The convex dual splits into one tilt for each source; safeguarded Newton steps move all tilts at
once, each step one aggregation of the (source, size, rows) histogram, an exact summary of the
corpus. A target at the cap is met by the cap itself.

Copies: rows are dealt into blocks of bounded rows and words (a small source is one block, a large one
is cut by size and by a hash of the row), so that no source, however hot, has to meet in one task. In a
block the rates are rounded from the largest document to the smallest, each taking over the words that
those before it were rounded off by, so that a block takes what it should within half of its smallest
document's size or so, and every document its rate rounded down or up.

Only DataFrame functions are used; the driver gets only sums over all sources.

Defined cases: a null or blank text has size 0 and takes no words; texts of any length are counted whole;
a null source is a source, last in the order; repeated rows are rounded each for itself, rows without an
id too; which of several rows that are equal in id, size and ``tie`` gets a copy more is left open; an
empty table gives an empty table; input columns that clash with an output column are replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialize, with_outputs
from .words import word_count

OUTPUTS = ["size", "source_size", "target", "rate", "copies", "taken"]
RANGES = 16


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds _rank from 0 in code point order, null last: ranges are ranked in parallel and shifted by the rows before them."""
    order = F.col("_source").asc_nulls_last()
    ranged = materialize(sources.repartitionByRange(RANGES, order).withColumn("_range", F.spark_partition_id()), "mix_sources")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows at most
    shift = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranged.withColumn("_rank", rank).join(shift, "_range").withColumn("_rank", F.col("_rank") + F.col("_shift")).drop("_range", "_shift")


def targets(histogram: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """_source, _n, _words and _target of every source."""
    totals = histogram.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_rows")).alias("_words"), F.sum("_rows").alias("_n"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = materialize(_ranked(totals).withColumn("_weight", weight), "mix_targets")
    words, all_weight = table.agg(F.sum("_words"), F.sum("_weight")).first()
    if not words:
        return table.withColumn("_target", F.lit(0.0))
    level, stopped = share * words / all_weight, -1
    while True:
        at_cap = F.col("_words") * cap <= F.col("_weight") * level
        n, taken, rest = table.agg(F.count(F.when(at_cap, 1)), F.coalesce(F.sum(F.when(at_cap, F.col("_words") * cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~at_cap, F.col("_weight"))), F.lit(0.0))).first()
        if n == stopped or not rest:
            return table.withColumn("_target", F.least(F.col("_words") * cap, F.col("_weight") * F.lit(level)))
        level, stopped = (share * words - taken) / rest, n


def tilts(histogram: DataFrame, table: DataFrame, cap: float = 2.0, tolerance: float = 1e-7, most_steps: int = 200) -> DataFrame:
    """Adds _tilt to the sources' table: the dual's solution, null where the target is the cap."""
    mean = F.col("_words") / F.col("_n")
    solve = (F.col("_target") < F.col("_words") * cap * (1 - 1e-9)) & (F.col("_target") > 0)
    state = table.withColumn("_mean", mean).withColumn("_tilt", F.when(solve, F.log(F.col("_target") / F.col("_words")))).withColumn("_low", F.lit(-1e6)).withColumn("_high", F.lit(1e6))
    state = materialize(state.withColumn("_done", F.col("_tilt").isNull()), "mix_state")
    sizes = histogram.where("_size > 0")
    for _ in range(most_steps):
        if not state.where("not _done").limit(1).count():
            break
        z = F.col("_size") / F.col("_mean")
        rate = F.exp(F.least(F.col("_tilt") * z, F.lit(math.log(cap))))
        mass = F.col("_size") * F.col("_rows") * rate
        todo = state.where("not _done").select(F.col("_source").alias("_s"), "_tilt", "_mean")
        sums = sizes.join(todo, F.col("_source").eqNullSafe(F.col("_s"))).groupBy("_s").agg(F.sum(mass).alias("_g"), F.sum(F.when(F.col("_tilt") * z < math.log(cap), mass * z).otherwise(0.0)).alias("_dg"))
        df = state.join(sums, F.col("_source").eqNullSafe(F.col("_s")), "left")
        low = F.when(F.col("_g") < F.col("_target"), F.col("_tilt")).otherwise(F.col("_low"))
        high = F.when(F.col("_g") >= F.col("_target"), F.col("_tilt")).otherwise(F.col("_high"))
        newton = F.col("_tilt") + F.log(F.col("_target") / F.col("_g")) * F.col("_g") / F.when(F.col("_dg") > 0, F.col("_dg"))
        middle = F.when(F.col("_high") >= 1e6, F.greatest(F.col("_tilt") * 2, F.lit(1.0))).when(F.col("_low") <= -1e6, F.least(F.col("_tilt") * 2, F.lit(-1.0))).otherwise((F.col("_low") + F.col("_high")) / 2)
        good = F.abs(F.col("_g") - F.col("_target")) <= F.col("_target") * tolerance
        df = df.withColumn("_low", F.when(F.col("_done"), F.col("_low")).otherwise(low)).withColumn("_high", F.when(F.col("_done"), F.col("_high")).otherwise(high))
        df = df.withColumn("_next", F.when((newton > F.col("_low")) & (newton < F.col("_high")), newton).otherwise(middle))
        df = df.withColumn("_was", F.col("_done")).withColumn("_done", F.col("_done") | good)
        df = df.withColumn("_tilt", F.when(F.col("_was") | good, F.col("_tilt")).otherwise(F.col("_next")))
        before, state = state, materialize(df.select(*state.columns), "mix_state")
        discard(before)
    else:
        if state.where("not _done").limit(1).count():
            raise RuntimeError(f"the dual has no solution within {tolerance} after {most_steps} steps")
    # sums of doubles differ in their last digits from run to run: copies must not
    return state.withColumn("_tilt", F.round("_tilt", 10))


def _rate(cap: float) -> Column:
    tilted = F.least(F.exp(F.least(F.col("_tilt") * F.col("_size") / F.col("_mean"), F.lit(math.log(cap)))), F.lit(cap))
    return F.when(F.col("_tilt").isNotNull(), tilted).when((F.col("_target") > 0) | (F.col("_words") == 0), F.lit(cap)).otherwise(F.lit(0.0))


def _rounded(sizes: Column, rates: Column) -> Column:
    """Copies of a block's documents, largest first: each rate rounded down or up so that the words fit best so far."""
    pairs = F.arrays_zip(sizes.alias("s"), rates.alias("r"))

    def step(state: Column, x: Column) -> Column:
        wanted = state["rest"] + (x["r"] - F.floor(x["r"])) * x["s"]
        up = (wanted * 2 >= x["s"]) & (x["r"] > F.floor(x["r"])) & (x["s"] > 0)
        return F.struct((wanted - F.when(up, x["s"]).otherwise(0)).cast("double").alias("rest"), F.concat(state["copies"], F.array((F.floor(x["r"]) + up.cast("int")).cast("int"))).alias("copies"))

    return F.aggregate(pairs, F.struct(F.lit(0.0).alias("rest"), F.array().cast("array<int>").alias("copies")), step, lambda state: state["copies"])


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_rows: int = 1000, block_words: int = 1_000_000, size: Column | None = None, tie: Column | None = None) -> DataFrame:
    """The input's columns with size, source_size, target, rate, copies and taken.

    size: the number of words as an expression over the input, if it's known already; tie: what tells rows of one id
    and size apart, by default the text."""
    told = F.xxhash64(doc_id, F.col(text) if tie is None else tie)
    sized = docs.select(F.struct("*").alias("_row"), F.col(source).alias("_source"), (word_count(F.col(text)) if size is None else size).alias("_size"), told.alias("_hash"))
    histogram = materialize(sized.groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("_rows")), "mix_sizes")
    state = tilts(histogram, targets(histogram, weights, share, cap), cap)
    small = (F.col("_n") <= block_rows) & (F.col("_words") <= 4 * block_words)
    of_size = F.floor(F.log2(F.col("_size") + 1) * 4).cast("int")
    renamed = state.select(F.col("_source").alias("_s"), "_n", "_words", "_target", "_tilt", "_mean")
    on = F.col("_source").eqNullSafe(F.col("_s"))
    cells = histogram.join(renamed, on).withColumn("_cell", F.when(small, F.lit(-1)).otherwise(of_size)).groupBy("_s", "_n", "_words", "_target", "_tilt", "_mean", "_cell").agg(F.sum("_rows").alias("_r"), F.sum(F.col("_rows") * F.col("_size")).alias("_t"))
    salts = F.ceil(F.greatest(F.col("_r") / block_rows, F.col("_t") / block_words, F.lit(1.0))).cast("long")
    cells = materialize(cells.withColumn("_salts", F.when(F.col("_cell") >= 0, salts).otherwise(F.lit(1).cast("long"))).drop("_r", "_t"), "mix_cells")

    def dealt(rows: DataFrame) -> DataFrame:
        placed = rows.join(cells, on & ((F.col("_cell") == of_size) | (F.col("_cell") == -1))).withColumn("rate", _rate(cap))
        return placed.withColumn("_block", F.xxhash64(F.isnull("_source"), "_source", "_cell", F.pmod(F.xxhash64("_hash", F.lit(1)), "_salts")))

    # what a block's documents take, by their place from the largest; only sizes, hashes and rates are needed for it
    order = F.array_sort(F.collect_list(F.struct((-F.col("_size")).alias("s"), F.col("_hash").alias("h"), F.round("rate", 9).alias("r"))))
    blocks = dealt(sized.select("_source", "_size", "_hash")).groupBy("_block").agg(order.alias("_x"))
    blocks = materialize(blocks.select("_block", _rounded(F.transform("_x", lambda x: -x["s"]), F.transform("_x", lambda x: x["r"])).alias("_copies")), "mix_copies")
    place = F.row_number().over(Window.partitionBy("_block").orderBy(F.desc("_size"), "_hash"))
    df = dealt(sized).withColumn("_place", place).join(blocks, "_block").withColumn("copies", F.get("_copies", F.col("_place") - 1))
    df = df.withColumn("size", F.col("_size")).withColumn("source_size", F.col("_words").cast("long")).withColumn("target", F.col("_target")).withColumn("taken", F.col("_size") * F.col("copies"))
    return df.select(with_outputs("_row", docs.columns, OUTPUTS))
