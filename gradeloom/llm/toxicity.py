"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labels are learnt from at most ``most_labelled`` labelled rows outside the held-out fold, picked by a hash
of the id (a bound on the training sample, not on what is scored).

* The lexicon holds words and word beginnings that toxic training documents have far more often than the
  others. While training, a document is looked up in the lexicon of the other half of the sample, so that
  its own label isn't in its features; scores use the lexicon of the whole sample.
* Features: how many words the lexicon knows, how dense and how strong they are, how near a second person
  pronoun is, shares of capitals, punctuation marks and obfuscated words, and the length.
* The trees are fitted on three quarters of the sample, the isotonic calibration on the rest.

Defined cases: a row without an id counts as held out; texts of any length are read whole; null and empty texts have all features 0 and get the score of such a text; labels that are
null or neither 0 nor 1 are left out, repeated labels count each; without both labels every score is the share
of toxic labels, or 0; repeated rows are scored each; an empty table gives an empty table; extra columns are
not returned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

FEATURES = ["n_hits", "hit_density", "strongest", "strength_density", "n_strong", "second_person", "capitals", "punctuation", "exclamations", "obfuscated", "log_words"]
PREFIXES = (4, 5, 6)
#: Look-alike characters.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
#: Second person pronouns.
SECOND_PERSON = {"you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros"}
_EDGES = re.compile(r"^[^\w@$]+|[^\w@$]+$")
_INNER = re.compile(r"[^\W\d_][\d@$*!]+[^\W\d_]|[^\W\d_](?:[.\-_*][^\W\d_]){2,}")


def plain_word(word: str) -> str:
    """Lower case, without marks at its ends, look-alikes resolved in words that have letters."""
    w = _EDGES.sub("", word.lower())
    if w.isalpha():
        return w
    if any(c.isalpha() for c in w):
        w = w.translate(LOOKALIKE)
        return "".join(c for c in w if c.isalpha())
    return w


def terms(words: set[str]) -> set[str]:
    """Words and their beginnings, marked with +."""
    out = set(words)
    for n in PREFIXES:
        out.update(w[:n] + "+" for w in words if len(w) >= n)
    return out


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, toxic and clean documents by half, from (text, toxic, half)."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            k = 2 * half + (0 if toxic else 1)
            for t in terms({plain_word(w) for w in (text or "").split()} - {""}):
                counts.setdefault(t, [0, 0, 0, 0])[k] += 1
    rows = [(t, *c) for t, c in counts.items()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string())] + [pa.array(c, pa.int64()) for c in cols[1:]], ["term", "t0", "c0", "t1", "c1"])


def lexicons(train: DataFrame, least: int, strength: float) -> list[dict[str, float]]:
    """Log odds of the terms of the first half, the second half and the whole sample; the sample bounds their size."""
    totals = {(r["half"], r["toxic"]): r["n"] for r in train.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = train.select("text", "toxic", "half").mapInArrow(_term_counts, "term string, t0 long, c0 long, t1 long, c1 long")
    sums = counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")])
    n = {k: (totals.get((k, 1), 0), totals.get((k, 0), 0)) for k in (0, 1)}
    n[2] = (n[0][0] + n[1][0], n[0][1] + n[1][1])

    def odds(t, c, k):
        return F.log((t + 0.5) / (n[k][0] + 1)) - F.log((c + 0.5) / (n[k][1] + 1))

    t, c = F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1")
    whole = odds(t, c, 2)
    scored = sums.select("term", "t0", "t1", t.alias("t"), odds(F.col("t0"), F.col("c0"), 0).alias("s0"), odds(F.col("t1"), F.col("c1"), 1).alias("s1"), whole.alias("s"))
    out: list[dict[str, float]] = [{}, {}, {}]
    for r in scored.where((F.col("t") >= least) & ((F.col("s") >= strength) | (F.col("s0") >= strength) | (F.col("s1") >= strength))).collect():
        for k, (count, s) in enumerate(((r["t0"], r["s0"]), (r["t1"], r["s1"]), (r["t"], r["s"]))):
            if count >= (least if k == 2 else 2) and s >= strength:
                out[k][r["term"]] = s
    return out


def features(text: str, lexicon: dict[str, float], cache: dict[str, tuple[str, float]]) -> list[float]:
    """FEATURES of a whole text."""
    raw = text.split()
    if not raw:
        return [0.0] * len(FEATURES)
    hits, seconds, strengths = [], [], []
    for i, w in enumerate(raw):
        known = cache.get(w)
        if known is None:
            p = plain_word(w)
            known = (p, max([lexicon.get(p, 0.0), *(lexicon.get(p[:n] + "+", 0.0) for n in PREFIXES if len(p) >= n)]))
            cache[w] = known
        if known[1]:
            hits.append(i)
            strengths.append(known[1])
        if known[0] in SECOND_PERSON:
            seconds.append(i)
    near, k = 0, 0
    for i in hits:
        while k < len(seconds) and seconds[k] < i - 5:
            k += 1
        near += k < len(seconds) and seconds[k] <= i + 5
    n, letters = len(raw), sum(map(str.isalpha, text)) or 1
    marks = sum(text.count(c) for c in "!?*#$%&@")
    return [
        math.log1p(len(hits)), 100 * len(hits) / n, max(strengths, default=0.0), 100 * sum(strengths) / n, math.log1p(sum(s >= 3.5 for s in strengths)), near / (len(hits) or 1),
        sum(map(str.isupper, text)) / letters, marks / len(text), text.count("!") / len(text), len(_INNER.findall(text)) / n, math.log1p(n),
    ]


def _featured(rows: DataFrame, lexes, by_half: bool, keep: list[str]) -> DataFrame:
    """keep and the features; rows have them and text. While training each half looks the other half's lexicon up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lexes.value
        caches: list[dict[str, tuple[str, float]]] = [{}, {}, {}]
        for batch in batches:
            of = [1 - h for h in batch.column(batch.schema.get_field_index("half")).to_pylist()] if by_half else [2] * batch.num_rows
            out = []
            for text, k in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), of, strict=True):
                if len(caches[k]) > 200_000:
                    caches[k].clear()
                out.append(features(text or "", lexicon[k], caches[k]))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(c, pa.float64()) for c in cols], keep + FEATURES)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in keep] + [f"{f} double" for f in FEATURES]))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", folds: int = 5, most_labelled: int = 20_000, trees: int = 15, depth: int = 3, least: int = 3, strength: float = 2.0) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(0).cast("long"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("held_out", fold == 0)
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (fold != 0))
    # the rows of the smallest hashes: most_labelled at most, whatever the size of the table
    known = known.withColumn("_h", F.xxhash64("doc_id", F.lit(3))).orderBy("_h", "doc_id", "toxic").limit(most_labelled).drop("_h")
    sample = F.broadcast(known)
    train = rows.join(sample, "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(2)).cast("int")).withColumn("calibrate", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0)
    train = materialize(train.select("doc_id", "text", "toxic", "half", "calibrate"), "toxic_train")
    found = {(r["calibrate"], r["toxic"]): r["n"] for r in train.groupBy("calibrate", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = (sum(v for (_, t), v in found.items() if t == k) for k in (1, 0))
    out = ["doc_id", "held_out", "score", "predicted"]
    if not found.get((False, 1)) or not found.get((False, 0)):
        share = toxic / (toxic + clean) if toxic + clean else 0.0
        flat = rows.withColumn("score", F.lit(float(share))).withColumn("predicted", F.lit(int(share >= 0.5))).select(*out)
        return flat.withColumnRenamed("doc_id", doc_id)
    lexes = docs.sparkSession.sparkContext.broadcast(lexicons(train, least, strength))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="x")
    fit = materialize(_featured(train.repartition(8, "doc_id"), lexes, True, ["toxic", "half", "calibrate"]), "toxic_features")
    x = assembler.transform(fit.withColumn("toxic", F.col("toxic").cast("double"))).coalesce(2).cache()
    trees_ = GBTClassifier(featuresCol="x", labelCol="toxic", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=1, predictionCol="p").fit(x.where("not calibrate"))
    plain = lambda df: df.withColumn("plain", vector_to_array("probability")[1])
    held = plain(trees_.transform(x.where("calibrate")))
    if not (found.get((True, 1)) and found.get((True, 0))):
        held = plain(trees_.transform(x))
    isotonic = IsotonicRegression(featuresCol="plain", labelCol="toxic", predictionCol="calibrated").fit(held.select("plain", "toxic"))
    x.unpersist()
    scored = isotonic.transform(plain(trees_.transform(assembler.transform(_featured(rows, lexes, False, ["doc_id", "held_out"])))))
    # a hundredth of the trees' own probability orders what the calibration ties
    scored = scored.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated") * 0.99 + F.col("plain") * 0.01)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select(*out).withColumnRenamed("doc_id", doc_id)
