"""Search in files by a pattern, with limits that the answer names."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is never searched, how many files and bytes of one, how long, how much of a line is shown.
SKIPPED = r"/(?:\.git|\.venv|node_modules|__pycache__|bin|obj|dist)/"
MOST_FILES, MOST_BYTES, MOST_SECONDS, MOST_CHARS = 2000, 2_000_000, 10.0, 400


def files(spark: SparkSession, root: str, glob: str = "*", most_bytes: int = MOST_BYTES) -> DataFrame:
    """path (below root), length, text of the files whose name fits a glob and that are small and text.

    Names and sizes are judged in the listing, before a file is opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    small = listed.where((F.col("length") <= most_bytes) & ~F.col("path").rlike(SKIPPED))
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    below = F.substring_index("path", f"{base}/", -1)
    return small.select(below.alias("path"), "length", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).where("text is not null")


def matches(found: DataFrame, pattern: str) -> DataFrame:
    """path, line (from 1), text of the lines that a pattern fits in any case."""
    lines = found.select("path", F.posexplode(F.split("text", "\r?\n")).alias("_k", "_line")).where(F.col("_line").rlike(f"(?i){pattern}"))
    return lines.select("path", (F.col("_k") + 1).alias("line"), F.substring(F.trim("_line"), 1, MOST_CHARS).alias("text"))


def grep(spark: SparkSession, root: str, pattern: str, glob: str = "*", most_hits: int = 50, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES, most_seconds: float = MOST_SECONDS) -> dict:
    """matches (in order of path and line), truncated, scanned and reason: which limit stopped the search, null if none did."""
    if ".." in glob.split("/"):
        raise ValueError(f"{glob}: a glob can't leave the root")
    context, tag, late, done = spark.sparkContext, f"grep-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def stop() -> None:
        late.set()
        while not done.wait(0.2):
            context.cancelJobsWithTag(tag)

    timer = threading.Timer(most_seconds, stop)
    context.setInterruptOnCancel(True)
    context.addJobTag(tag)
    timer.start()
    try:
        every = files(spark, root, glob, most_bytes)
        paths = [r.path for r in every.select("path").orderBy("path").limit(most_files + 1).collect()]
        read = every.join(F.broadcast(spark.createDataFrame([(p,) for p in paths[:most_files]], "path string")), "path", "left_semi")
        rows = [r.asDict() for r in matches(read, pattern).orderBy("path", "line").limit(most_hits + 1).collect()]
    except Exception:
        if late.is_set():
            return {"matches": [], "truncated": True, "scanned": 0, "reason": "time"}
        raise
    finally:
        done.set()
        timer.cancel()
        context.removeJobTag(tag)
        context.setInterruptOnCancel(False)
    reason = "hits" if len(rows) > most_hits else "files" if len(paths) > most_files else None
    return {"matches": rows[:most_hits], "truncated": reason is not None, "scanned": min(len(paths), most_files), "reason": reason}
