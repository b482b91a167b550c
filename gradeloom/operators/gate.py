"""The review gate: which records are in the corpus, and how their status comes about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PENDING, APPROVED, CORRECTED, REJECTED = "P", "F", "O", "R"
STATUSES = (PENDING, APPROVED, CORRECTED, REJECTED)
REVIEWED = (APPROVED, CORRECTED)


def reviewed(df: DataFrame, status: str = "o_orderstatus", usable: tuple[str, ...] = REVIEWED) -> DataFrame:
    """Only records that passed review; pending ones never leak."""
    return df.where(F.col(status).isin(*usable))


def scoped(df: DataFrame, **wanted) -> DataFrame:
    """Conjunction of the given columns' values; None leaves a column out."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the denominator is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def fold_status(events: DataFrame, task: str, action: str, order: list[str]) -> DataFrame:
    """task, n_events, ever_corrected, status: a task's journal folded to its state.

    The last decision counts; an approval of a task that was ever corrected is a correction; reopening
    makes it pending. Other actions don't decide."""
    decisive = F.col(action).isin("approve", "correct", "reject", "reopen")
    last = F.max_by(F.when(decisive, F.col(action)), F.when(decisive, F.struct(*order)))
    folded = events.groupBy(task).agg(F.count(F.lit(1)).alias("n_events"), F.bool_or(F.col(action) == "correct").alias("ever_corrected"), last.alias("last"))
    status = (
        F.when(F.col("last").isNull() | (F.col("last") == "reopen"), "pending")
        .when(F.col("last") == "reject", "rejected")
        .when((F.col("last") == "correct") | F.col("ever_corrected"), "corrected")
        .otherwise("approved")
    )
    return folded.select(task, "n_events", "ever_corrected", status.alias("status"))


def document_status(tasks: DataFrame, document: str, status: str) -> DataFrame:
    """document, state: any pending task, parsed; else any usable, approved; else rejected."""
    state = F.when(F.bool_or(F.col(status) == PENDING), "parsed").when(F.bool_or(F.col(status).isin(*REVIEWED)), "approved").otherwise("rejected")
    return tasks.groupBy(document).agg(state.alias("state"))


def description_state(previous: Column, changed: Column, approving: Column, empty: Column) -> Column:
    """The next state of a description by its previous one."""
    return (
        F.when(empty, "none")
        .when(~changed & ~approving, previous)
        .when(~changed, F.when(previous == "auto", "approved").otherwise(previous))
        .when(previous.isin("auto", "approved", "corrected"), "corrected")
        .otherwise("manual")
    )


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def to_do(df: DataFrame, status: Column, approved: str, settled: tuple[str, ...], forced: Column) -> DataFrame:
    """Rows that a run may write: those that people settled only if forced, approved ones never."""
    return df.where((status != approved) & (~status.isin(*settled) | forced))
