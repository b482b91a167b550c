"""Quality rules with verdicts by host.

Each document is measured by rules; failures are aggregated by host (its source), the failure
rates are shrunk with a beta prior that is fitted to all hosts by moments, and each host's verdict
is joined back to its documents:

* ``blocked`` (shrunk rate over ``block_rate``): no document of the host is kept;
* ``watch`` (shrunk rate over ``watch_rate``): one failed soft rule rejects a document;
* ``ok``: a document may fail one soft rule.

Only DataFrame functions are used. A document whose windows are all distinct, the usual case, is
settled by one hash set; only the others are sorted. Windows are compared by a 64-bit hash within
one document.

Defined cases: a null or blank text has no words and fails; a null host is a host of its own;
repeated rows are measured and counted each; an empty table gives an empty table; input columns
that clash with an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize, with_outputs
from .words import words

WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OUTPUTS = [*MEASURES, "base_failed", "n_failed_soft", "host_verdict", "kept"]


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from the array column _w: words that a repeated window covers."""
    df = df.withColumn("_g", F.transform("_w", lambda w: F.xxhash64(w)))
    window = F.transform("_g", lambda g, i: F.xxhash64(g, *[F.get("_g", i + k) for k in range(1, WINDOW)]))
    df = df.withColumn("_h", F.slice(window, 1, F.greatest(F.size("_g") - (WINDOW - 1), F.lit(0))))
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda e, other: F.coalesce(F.get("_s", other)["h"] == e["h"], F.lit(False))
    found = F.filter("_s", lambda e, i: same(e, i - 1) | same(e, i + 1))
    df = df.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(found, lambda e: e["i"]))))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def measure(docs: DataFrame, text: str = "text", host: str = "source", carry: list[str] | None = None) -> DataFrame:
    """_row (the carried columns packed, all by default), _host and the rules' measures."""
    t = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = docs.select(F.struct(*(docs.columns if carry is None else carry)).alias("_row"), F.col(host).alias("_host"), F.col(text).alias("_text"))
    df = df.select("_row", "_host", words(F.col("_text")).alias("_w"), lines.alias("_lines"), (F.size(F.split(t, "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"))
    df = df.select(
        "_row", "_host", "_w", "n_symbols", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("_n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    df = _repeat_words(df).select("_row", "_host", "_n_lines", *MEASURES)
    soft: list[Column] = [
        F.col("n_symbols") * 100 > F.col("word_chars") * 10,
        F.col("n_dup_lines") * 100 > F.col("_n_lines") * 30,
        F.col("word_chars") > F.col("n_words") * 20,
    ]
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return df.withColumn("base_failed", base).withColumn("n_failed_soft", sum((s.cast("int") for s in soft), F.lit(0)))


def host_rates(measured: DataFrame, most_strength: float = 1000.0) -> DataFrame:
    """_host, n, failed and the shrunk failure rate. The prior's two numbers are all that the driver gets."""
    failed = (F.col("base_failed") | (F.col("n_failed_soft") > 0)).cast("long")
    hosts = measured.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), F.sum(failed).alias("failed"))
    hosts = materialize(hosts, "host_rules")
    n, f, f2, h = hosts.agg(F.sum("n"), F.sum("failed"), F.sum(F.col("failed") * F.col("failed") / F.col("n")), F.count(F.lit(1))).first()
    mean = f / n if n else 0.0
    noise = mean * (1 - mean)
    between = (f2 / n - mean * mean) - noise * (h - 1) / n if n else 0.0
    strength = min(max(noise / between - 1, 1.0), most_strength) if between > 0 else most_strength
    return hosts.withColumn("rate", (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(float(strength))))


def apply_rules(docs: DataFrame, text: str = "text", host: str = "source", watch_rate: float = 0.05, block_rate: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default), the measures, the host's verdict and kept."""
    measured = materialize(measure(docs, text, host, carry), "rules")
    verdict = F.when(F.col("rate") > block_rate, "blocked").otherwise("watch")
    strict = materialize(host_rates(measured).where(F.col("rate") > watch_rate).select(F.col("_host").alias("_strict"), verdict.alias("_verdict")), "strict_hosts")
    df = measured.join(strict, F.col("_host").eqNullSafe(F.col("_strict")), "left")
    df = df.withColumn("host_verdict", F.coalesce("_verdict", F.lit("ok")))
    allowed = F.when(F.col("host_verdict") == "ok", 1).when(F.col("host_verdict") == "watch", 0).otherwise(-1)
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("n_failed_soft") <= allowed))
    return df.select(with_outputs("_row", docs.columns if carry is None else carry, OUTPUTS))
