"""Vector code compression: parts of vectors coded by codebooks, nearest entries found by annular norm pruning.

Components become integers floor(scale * x) and a vector is cut into equal consecutive parts. A part position's
codebook is fitted by rounds of assigning every part to its nearest entry and moving entries to the floor of their
parts' mean; a round is one pass over the written integers, whose tasks send back sums and counts for each entry.

The nearest entry is found among the entries sorted by norm. As | |x| - |c| | <= |x - c|, an entry within the
distance d of the best so far has its norm in [|x| - d, |x| + d]: the entries beside |x| give the first d, binary
search gives the interval, and the entries in it, ends included, are measured exactly in integers, from |x| outwards;
where one is nearer, the interval is searched anew.

Defined cases: rows whose vector is null or has a null or non-finite component are dropped. The length of vectors is
that of the smallest vec_id whose length is a positive multiple of the parts; rows of another length stay, with null
code and error, and take no part in the fit. Null vec_ids come last, equal ones are ordered by their vectors and are
rows each; with fewer rows than entries the codebooks are smaller; an empty table gives an empty table. Components of
any size are coded exactly; an error beyond 64 bits is null, and so is a label's sum. Ties go to the lower index.
Extra columns are not returned, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import join_uneven, materialize

#: Integers below this keep squared distances of parts of up to 16,384 components within 64 bits.
SMALL = 1 << 23
LIMB = 32


class Annuli:
    """A part position's entries, sorted by norm."""

    def __init__(self, entries: list[list[int]]) -> None:
        small = all(abs(v) < SMALL for e in entries for v in e)
        self.entries = np.array(entries, np.int64 if small else object).reshape(len(entries), -1)
        norms = np.sqrt((self.entries.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.measured = 0

    def _measure(self, parts: np.ndarray, rows: np.ndarray, ranks: np.ndarray, best: np.ndarray, won: np.ndarray) -> None:
        """Exact distances of rows to the entries of these ranks; the lower index wins a tie."""
        index = self.order[ranks]
        distance = ((parts[rows] - self.entries[index]) ** 2).sum(axis=1)
        better = (distance < best[rows]) | ((distance == best[rows]) & (index < won[rows]))
        best[rows[better]], won[rows[better]] = distance[better], index[better]
        self.measured += len(rows)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance of every row."""
        n, last = len(parts), len(self.order) - 1
        if parts.dtype == object or self.entries.dtype == object:
            parts = parts.astype(object)
        norms = np.sqrt((parts.astype(np.float64) ** 2).sum(axis=1))
        everyone = np.arange(n)
        at = np.searchsorted(self.norms, norms)
        above, below = np.minimum(at, last), np.maximum(at - 1, 0)
        won = self.order[above].astype(np.int64)
        best = ((parts - self.entries[won]) ** 2).sum(axis=1)
        self.measured += n
        self._measure(parts, everyone, below, best, won)
        # floats only bound the interval: it is widened by more than their rounding, so that no entry is lost
        low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        moved = everyone
        for step in range(1, last + 1):  # outwards from |x|, the interval shrinking with the best distance
            reach = np.sqrt(best[moved].astype(np.float64))
            reach += 1e-9 * (norms[moved] + reach + self.norms[-1]) + 1e-9
            low[moved] = np.searchsorted(self.norms, norms[moved] - reach, "left")
            high[moved] = np.searchsorted(self.norms, norms[moved] + reach, "right")
            before = best.copy()
            up, down = above + step, below - step
            rows = np.flatnonzero(up < high)
            self._measure(parts, rows, up[rows], best, won)
            rows = np.flatnonzero(down >= low)
            self._measure(parts, rows, down[rows], best, won)
            moved = np.flatnonzero(best < before)
            if not ((up + 1 < high) | (down - 1 >= low)).any():
                break
        return won, best


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers where they are small and as Python's otherwise."""
    scaled = np.floor(values.astype(np.float64) * scale) if np.abs(values).max(initial=0) < 2.0**60 else None
    if scaled is not None and np.abs(scaled).max(initial=0) < SMALL:
        return scaled.astype(np.int64)
    exact = np.empty(values.size, object)
    exact[:] = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.astype(np.float64).ravel().tolist()]
    return exact.reshape(values.shape)


def _parts_of(column: pa.Array, parts: int) -> np.ndarray:
    """Rows x parts x components of a column of equally long vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), parts, -1)


def _kept(vectors: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull()).where(~bad)


def _limbs(total: int) -> list[int]:
    """Signed digits of LIMB bits, the lowest first, of which sums never leave 64 bits."""
    sign, rest, out = (1 if total >= 0 else -1), abs(total), []
    while rest:
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return out or [0]


def fit(kept: DataFrame, vector: str, first: list[list[float]], parts: int, scale: int, rounds: int) -> list[list[list[int]]]:
    """The codebooks (part, entry, component); kept: rows of one length, written; first: the vectors they start from."""
    books = [[list(map(int, row)) for row in part] for part in _integers(np.array(first, np.float64).reshape(len(first), parts, -1), scale).transpose(1, 0, 2)] if first else []
    if not books:
        return books
    width = len(books[0][0])

    for _ in range(rounds):
        current = books

        def partial(batches: Iterator[pa.RecordBatch], books: list = current) -> Iterator[pa.RecordBatch]:
            annuli = [Annuli(b) for b in books]
            sums = [[[0] * width for _ in b] for b in books]
            counts = [[0] * len(b) for b in books]
            for batch in batches:
                whole = _integers(_parts_of(batch.column(0), len(books)), scale)
                for p, search in enumerate(annuli):
                    won, _ = search.nearest(whole[:, p])
                    for e in np.unique(won).tolist():
                        mine = whole[won == e, p]
                        counts[p][e] += len(mine)
                        sums[p][e] = [a + int(b) for a, b in zip(sums[p][e], mine.sum(axis=0), strict=True)]
            rows = []
            for p, part in enumerate(sums):
                for e, entry in enumerate(part):
                    if counts[p][e]:
                        digits = [_limbs(v) for v in entry]
                        for k in range(max(map(len, digits))):
                            rows.append((p, e, k, counts[p][e] if k == 0 else 0, [d[k] if k < len(d) else 0 for d in digits]))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["part", "entry", "limb", "n", "sums"])

        told = kept.select(vector).mapInArrow(partial, "part int, entry int, limb int, n long, sums array<long>")
        totals = told.groupBy("part", "entry", "limb").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)])
        whole: dict[tuple[int, int], list] = {}
        for row in totals.collect():  # parts x entries rows and a few digits
            at = whole.setdefault((row.part, row.entry), [0, [0] * width])
            at[0] += row.n
            at[1] = [v + (row[f"s{k}"] << (LIMB * row.limb)) for k, v in enumerate(at[1])]
        books = [[[v // whole[p, e][0] for v in whole[p, e][1]] if (p, e) in whole else entry for e, entry in enumerate(part)] for p, part in enumerate(books)]
    return books


def assign(kept: DataFrame, vector: str, books: list[list[list[int]]], scale: int, carry: list[str]) -> DataFrame:
    """The carried columns with codes (an index for each part) and error of rows of one length."""
    types = dict(kept.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in carry) + (", " if carry else "") + "codes array<int>, error long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(b) for b in books]
        for batch in batches:
            whole = _integers(_parts_of(batch.column(len(carry)), len(books)), scale)
            found = [search.nearest(whole[:, p]) for p, search in enumerate(annuli)]
            codes = np.stack([won for won, _ in found], axis=1).astype(np.int32)
            errors = [e if e < 1 << 63 else None for e in map(sum, zip(*(d.tolist() for _, d in found), strict=True))]
            arrays = [pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * len(books)), pa.array(codes.ravel())), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *arrays], [*carry, "codes", "error"])

    return kept.select(*carry, vector).mapInArrow(run, schema)


def checksum(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(v) for part in books for entry in part for v in entry).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, list[list[list[int]]]]:
    """vec_id, label, codes, error and label_error of every kept row, and the codebooks (part, entry, component)."""
    slim = vectors.select(F.col(vec_id).alias("_id"), F.col(vector).cast("array<double>").alias("_v") if "double" in dict(vectors.dtypes)[vector] else F.col(vector).alias("_v"), F.col(label).alias("_label"))
    kept = materialize(_kept(slim, "_v").withColumn("_size", F.size("_v")), "vectors")
    fitting = kept.where((F.col("_size") > 0) & (F.col("_size") % parts == 0))
    head = fitting.orderBy(F.col("_id").asc_nulls_last(), "_v").select("_size").first()
    size = head[0] if head else -1
    equal = kept.where(F.col("_size") == size)
    first = [list(r[0]) for r in equal.orderBy(F.col("_id").asc_nulls_last(), "_v").select("_v").limit(entries).collect()]
    books = fit(equal, "_v", first, parts, scale, rounds)
    other = kept.where(F.col("_size") != size).select("_id", "_label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    coded = materialize((assign(equal, "_v", books, scale, ["_id", "_label"]).unionByName(other) if books else other), "codes")
    keyed = coded.withColumn("_key", F.when(F.col("_label").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("_label").cast("string"))))
    sums = materialize(keyed.groupBy("_key").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "label_sums")
    done = join_uneven(keyed, sums, "_key", "_n", coded.count())
    return done.select(F.col("_id").alias(vec_id), F.col("_label").alias(label), "codes", "error", "label_error"), books


def code_text(codes: Column) -> Column:
    """Two lower-case hex digits for each index."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
