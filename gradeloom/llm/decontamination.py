"""Benchmark decontamination by template canonicalisation.

Numbers, names (capitalised words inside a sentence) and units after numbers become typed
placeholders; case and punctuation go. What is left of a text is its template. Windows of ``window``
template tokens are hashed and joined with those of the benchmark's items, so that a question with
other numbers or names still meets its original. A document is contaminated by an item if at least
``coverage`` of the item's windows occur in it and the slots are consistent: along the aligned
windows, equal values of the item stand for equal values of the document and different ones for
different ones, taken over all of them or over those of one place that alone cover enough. An item shorter than a window is one window of its own length. Windows with
fewer than ``least_words`` plain words say too little as templates; they are compared on their exact words
and values, so that copies of items of numbers or names are found as well. An item matches by ``coverage``
of all its windows or of those compared as templates. The first word of an item is a name in a document
that has it inside a sentence; its first window is looked for both ways.

Only DataFrame functions are used. The benchmark's windows are broadcast if they are few
(``most_broadcast``), else both sides are shuffled by the window's hash. Only documents with a hit
on an item with slots are read again for the slots' values.

Defined cases: null and blank texts match nothing; texts of any length are compared whole; rows are judged each for itself, those without an id or with a repeated one too, and equal rows give one result;
repeated items are matched each; an empty documents or benchmark table gives no rows; extra columns
are ignored by ``contaminated`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"
_NAME = "\\p{Lu}(?<=[^.!?:\\s\ue001-\ue003] .)[\\p{Ll}\\p{M}]+(?![\\p{L}\\p{N}])"
_NUMBER = "\\p{N}+(?:[.,:/]\\p{N}+)*"
#: Units that are recognised after a number.
UNITS = ["km", "m", "cm", "mm", "kg", "g", "mg", "t", "l", "ml", "s", "sec", "min", "h", "hours", "hour", "days", "day", "years", "year", "minutes", "seconds", "meters", "metres", "miles", "feet", "inches", "pounds", "dollars", "euros", "cents", "percent", "degrees", "kmh", "mph"]


def _clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + UNIT, "   ")


def _marked(text: Column) -> Column:
    """The text's tokens, names, numbers and units behind a mark of their type."""
    t = F.lower(F.regexp_replace(_clean(text), _NAME, f"{NAME}$0"))
    t = F.regexp_replace(t, _NUMBER, f" {NUMBER}$0 ")
    t = F.regexp_replace(t, f"({NUMBER}[^ ]+) +({'|'.join(UNITS)})(?![\\p{{L}}\\p{{N}}])", f"$1 {UNIT}$2 ")
    return F.regexp_extract_all(t, F.lit(f"{NUMBER}[^ ]+|[{NAME}{UNIT}]?[\\p{{L}}\\p{{M}}\\p{{N}}]+"), F.lit(0))


def _plain(x: Column) -> Column:
    # the marks stand between these two; most tokens are settled by the first comparison
    return F.when((x < NAME) | (x >= "\ue004"), x).otherwise(F.substring(x, 1, 1))


def template(text: Column) -> Column:
    """The template's tokens."""
    return F.transform(_marked(text), _plain)


def slot_values(text: Column) -> Column:
    """The values behind the template's names and numbers, in order."""
    return F.regexp_extract_all(_clean(text), F.lit(f"{_NAME}|{_NUMBER}"), F.lit(0))


def _windows(hashes: Column, exact: Column, n: int, least_words: int) -> Column:
    """_w and whether it is compared as a template, of each window; hashes and exact differ where a placeholder is."""

    def window(h: Column, i: Column) -> Column:
        hs = [h, *[F.get(hashes, i + k) for k in range(1, n)]]
        es = [F.get(exact, i + k) for k in range(n)]
        words = sum(((a == b).cast("int") for a, b in zip(hs, es, strict=True)), F.lit(0))
        as_template = words >= min(least_words, n)
        return F.struct(F.when(as_template, F.xxhash64(*hs, F.lit(n))).otherwise(F.xxhash64(*es, F.lit(-n))).alias("_w"), as_template.alias("_k"))

    return F.slice(F.transform(hashes, window), 1, F.greatest(F.size(hashes) - (n - 1), F.lit(0)))


def _seen(hashed: DataFrame, n: int, least_words: int) -> DataFrame:
    """_doc, _did, _j, _w: each window as a template, and on its exact tokens where it holds so many placeholders; from _m, _h and _at."""
    h, m, at = F.col("_h"), F.col("_m"), F.col("_at")
    last = F.size(h) - n
    templates = F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)], F.lit(n))), 1, F.greatest(last + 1, F.lit(0)))
    q = n - min(least_words, n) + 1
    # placeholders a to b, q in all, are in the windows that begin at b - n + 1 to a
    starts = F.transform(at, lambda a, k: F.struct(F.greatest(F.get(at, k + (q - 1)) - (n - 1), F.lit(0)).alias("a"), F.least(a, last).alias("b")))
    starts = F.filter(starts, lambda s: s["a"] <= s["b"])
    starts = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s["a"], s["b"]))))
    df = hashed.withColumn("_starts", F.when(F.size(at) >= q, starts).otherwise(F.array().cast("array<int>"))).withColumn("_n", F.greatest(last + 1, F.lit(0)))
    exact = F.transform("_starts", lambda i: F.xxhash64(*[F.xxhash64(F.translate(F.get(m, i + k), NAME + NUMBER + UNIT, "")) for k in range(n)], F.lit(-n)))
    # hashes alone are exploded; a place behind the templates is one of the exact windows
    rows = df.select("_doc", "_did", "_starts", "_n", F.posexplode(F.concat(templates, exact)).alias("_p", "_w"))
    return rows.select("_doc", "_did", F.when(F.col("_p") < F.col("_n"), F.col("_p")).otherwise(F.get("_starts", F.col("_p") - F.col("_n"))).alias("_j"), "_w")


def _hashes(rows: DataFrame, *carry: str) -> DataFrame:
    """_h of the templates' tokens and _e of the exact ones, from _m."""
    return rows.select(*carry, F.transform("_m", lambda x: F.xxhash64(_plain(x))).alias("_h"), F.transform("_m", lambda x: F.xxhash64(F.translate(x, NAME + NUMBER + UNIT, ""))).alias("_e"))


def _slots(rows: DataFrame, key: str) -> DataFrame:
    """key, position, value of each name and number."""
    df = rows.select(F.col("_id").alias(key), F.filter(F.transform("_t", lambda x, i: F.when(x.isin(NAME, NUMBER), i)), lambda i: i.isNotNull()).alias("_at"), "_v")
    return df.select(key, F.explode(F.arrays_zip("_at", "_v")).alias("_s")).select(key, F.col("_s._at").alias("_at"), F.col("_s._v").alias("_v"))


def _consistency(pairs: DataFrame, *keys: str) -> DataFrame:
    """n_slots and whether values stand for each other one to one."""
    counts = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_slots"), F.countDistinct("_item_value").alias("_a"), F.countDistinct("_v").alias("_b"))
    return counts.withColumn("_consistent", (F.col("n_slots") == F.col("_a")) & (F.col("n_slots") == F.col("_b")))


def _row_key(doc_id: str, text: str) -> Column:
    """Rows are judged each for itself, whatever their ids; equal rows together."""
    return F.xxhash64(doc_id, text)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", window: int = 8, coverage: float = 0.5, least_words: int = 3, most_broadcast: int = 1_000_000, keep_key: bool = False) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, n_slots of every contamination."""
    items = benchmark.select(F.col(item_id).alias("_id"), _marked(F.col("text")).alias("_m"), template(F.col("text")).alias("_t"), slot_values(F.col("text")).alias("_v"))
    items = materialize(items.where(F.size("_t") > 0).withColumn("_row", F.monotonically_increasing_id()), "benchmark")
    short = [r[0] for r in items.where(F.size("_t") < window).select(F.size("_t")).distinct().collect()]  # fewer than window lengths
    lengths = [n for n in range(1, window + 1) if n == window or n in short]
    hashed_items = _hashes(items, "_row")
    first = F.xxhash64(F.lit(NAME))
    parts = []
    for n in lengths:
        of = hashed_items.where(F.size("_h") >= window if n == window else F.size("_h") == n)
        parts.append(of.select("_row", F.posexplode(_windows(F.col("_h"), F.col("_e"), n, least_words)).alias("_i", "_s")))
        # the first word as a name
        named = of.where(F.get("_h", F.lit(0)) == F.get("_e", F.lit(0)))
        named = named.withColumn("_h", F.concat(F.array(first), F.slice("_h", 2, n - 1))).withColumn("_e", F.slice("_e", 1, n))
        parts.append(named.select("_row", F.posexplode(_windows(F.col("_h"), F.col("_e"), n, least_words)).alias("_i", "_s")))
    known = parts[0]
    for p in parts[1:]:
        known = known.unionByName(p)
    known = materialize(known.select("_row", "_i", F.col("_s._w").alias("_w"), F.col("_s._k").alias("_k")).distinct(), "benchmark_windows")
    # as the item itself has it, a window is a template or not; by its first word as a name it may be less
    known_kinds = known.groupBy("_row", "_i").agg(F.bool_or("_k").alias("_k"))
    need = known_kinds.groupBy("_row").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if("_k").alias("_n_templates"))
    enough_of = lambda m, k: (m >= F.col("n_windows") * coverage) | ((k > 0) & (k >= F.col("_n_templates") * coverage))
    i_if_template = F.when(F.col("_k"), F.col("_i"))

    marked = docs.select(_row_key(doc_id, text).alias("_doc"), F.col(doc_id).alias("_did"), _marked(F.col(text)).alias("_m"))
    hashed = marked.select("_doc", "_did", "_m", F.transform("_m", lambda x: F.xxhash64(_plain(x))).alias("_h"))
    hashed = hashed.withColumn("_at", F.filter(F.transform("_m", lambda x, i: F.when((x >= NAME) & (x < "\ue004"), i)), lambda i: i.isNotNull()))
    each = [_seen(hashed, n, least_words) for n in lengths]
    seen = each[0]
    for p in each[1:]:
        seen = seen.unionByName(p)
    side = F.broadcast(known) if known.count() <= most_broadcast else known
    hits = materialize(seen.join(side, "_w").select("_doc", "_did", "_row", "_i", "_j", "_k").distinct(), "template_hits")
    found = hits.groupBy("_doc", "_did", "_row").agg(F.countDistinct("_i").alias("n_matched"), F.countDistinct(i_if_template).alias("_m_templates")).join(need, "_row").where(enough_of(F.col("n_matched"), F.col("_m_templates")))
    found = materialize(found, "template_matches")

    # slots: positions of the item's names and numbers inside matched windows, carried along each diagonal
    lines = hits.join(found.select("_doc", "_row"), (hits["_doc"].eqNullSafe(found["_doc"])) & (hits["_row"] == found["_row"]), "left_semi")
    item_slots = items.where(F.size("_v") > 0).select(F.col("_row").alias("_id"), "_t", "_v")
    item_slots = materialize(_slots(item_slots, "_row").withColumnRenamed("_v", "_item_value"), "item_slots")
    spans = lines.join(items.select("_row", F.least(F.size("_t"), F.lit(window)).alias("_len")), "_row")
    at = spans.join(item_slots, "_row").where((F.col("_at") >= F.col("_i")) & (F.col("_at") < F.col("_i") + F.col("_len")))
    shift = (F.col("_j") - F.col("_i")).alias("_shift")
    at = materialize(at.select("_doc", "_row", "_item_value", shift, (F.col("_at") + shift).alias("_pos")).distinct(), "slots_wanted")
    wanted = at.select(F.col("_doc").alias("_d")).distinct()
    again = docs.select(_row_key(doc_id, text).alias("_id"), F.col(text).alias("_text")).join(wanted, F.col("_id").eqNullSafe(F.col("_d")), "left_semi")
    values = _slots(again.select("_id", template(F.col("_text")).alias("_t"), slot_values(F.col("_text")).alias("_v")), "_d")
    pairs = at.join(values, at["_doc"].eqNullSafe(values["_d"]) & (at["_pos"] == values["_at"])).select("_doc", "_row", "_shift", "_item_value", "_v").distinct()
    pairs = materialize(pairs, "slot_pairs")
    whole = _consistency(pairs.select("_doc", "_row", "_item_value", "_v").distinct(), "_doc", "_row").select("_doc", "_row", "n_slots", "_consistent")
    # a second rendering of the item elsewhere in the text doesn't hide one that is consistent in itself
    enough = lines.groupBy("_doc", "_row", shift).agg(F.countDistinct("_i").alias("_m"), F.countDistinct(i_if_template).alias("_mt")).join(need, "_row").where(enough_of(F.col("_m"), F.col("_mt")))
    by_line = _consistency(pairs, "_doc", "_row", "_shift").where("_consistent")
    single = by_line.join(enough.select(F.col("_doc").alias("_d"), F.col("_row").alias("_r"), F.col("_shift").alias("_s")), F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")) & (F.col("_shift") == F.col("_s")), "left_semi")
    slots = whole.unionByName(single.select("_doc", "_row", "n_slots", "_consistent")).groupBy(F.col("_doc").alias("_d"), F.col("_row").alias("_r")).agg(F.max("n_slots").alias("n_slots"), F.bool_or("_consistent").alias("_consistent"))
    judged = found.join(slots, found["_doc"].eqNullSafe(slots["_d"]) & (found["_row"] == slots["_r"]), "left").where(F.coalesce("_consistent", F.lit(True)))
    named = judged.join(items.select("_row", F.col("_id").alias(item_id)), "_row")
    return named.select(F.col("_did").alias(doc_id), *(["_doc"] if keep_key else []), item_id, "n_windows", "n_matched", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents without the contaminated ones, all columns kept."""
    found = contaminated(docs, benchmark, text=text, doc_id=doc_id, keep_key=True, **options)
    bad = materialize(found.select(F.col(doc_id).alias("_d"), F.col("_doc").alias("_k")).distinct(), "contaminated")
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_id"), _row_key(doc_id, text).alias("_key"))
    return whole.join(bad, (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_d")), "left_anti").select("_row.*")
