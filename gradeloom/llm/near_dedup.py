"""Near-duplicates by MinHash: improved consistent weighted sampling over TF-IDF shingles.

1. In how many documents a shingle occurs is counted over the whole corpus by a count-min sketch. A shingle
   weighs tf * idf, where idf falls from 1 + idf_strength to 1 with the share of documents that hold the
   shingle; shares below 1 / RARE are equally rare. The sketch errs by a share that depends on the length of
   documents and not on their number, so weights are the same at every size of the corpus.
2. Each text gets ``bands * rows`` consistent weighted samples (Ioffe's scheme: r and c from
   gamma(2, 1), beta uniform, the smallest ln a wins); two texts agree in a sample with a probability of
   their weighted Jaccard similarity. Equal texts are one from the start, under a hash of 128 bits.
3. Texts that agree in a band meet in a bucket; buckets of the same texts are one. A bucket is cut into
   blocks of bounded bytes. The texts of all buckets are picked out in one shuffle and dealt to their blocks
   in a second one. In each block an inverted index of the shingles gives the exact weighted Jaccard
   similarity of one text to all others at a time: first of the bucket's smallest text, then of every text
   that isn't linked to it yet, so that a large group of copies takes one look-up and no pair of unlike
   texts is left out. Texts without a link in a bucket of several blocks are taken to its other blocks too.
   Only links leave the tasks, no pairs.
4. Pairs of ``threshold`` or more are links; connected components are the classes.

The hash tables and the sketch have a fixed size; everything else is dealt out by Spark, by the same plan at
every size. With 16 bands of 3 rows a pair of similarity 0.8 is met with a probability of 0.99999.

Defined cases: a null text counts as empty; texts without words are alike only if they are equal; a text
of fewer than five words is one shingle; texts of any length are compared whole; a class is named by its
smallest doc_id, and by null if none of its rows has one; repeated rows and repeated ids are members each,
rows without a doc_id too; an empty table gives an empty table; doc_id must be a number that fits a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import mix64, shingles, text_bytes
from .storage import discard, join_uneven, materialize

WIDTH_BITS = 20
RARE = 256
DEPTH = 2
PARTS = 32
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def _cells(h: np.ndarray, row: int) -> np.ndarray:
    return ((h * _ODD[row]) >> np.uint64(64 - WIDTH_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """Count-min sketch: in how many documents a shingle occurs, at least. DEPTH * 2**WIDTH_BITS numbers at any size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((DEPTH, 1 << WIDTH_BITS), np.int64)
        held: list[np.ndarray] = []

        def flush() -> None:
            if held:
                h = np.concatenate(held)
                for row in range(DEPTH):
                    sketch[row] += np.bincount(_cells(h, row), minlength=1 << WIDTH_BITS)
                held.clear()

        n = 0
        with np.errstate(over="ignore"):
            for batch in batches:
                for s in shingles(batch.column(0)):
                    held.append(np.unique(s))
                    n += len(s)
                    if n > 1 << 20:
                        flush()
                        n = 0
            flush()
        packer = zstandard.ZstdCompressor(level=1)
        parts = sketch.reshape(-1).astype(np.uint32).reshape(PARTS, -1)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "counts": pa.array([packer.compress(p.tobytes()) for p in parts], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        packer = zstandard.ZstdDecompressor()
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(packer.decompress(counts), np.uint32).astype(np.int64)
                sums[part] = sums[part] + new if part in sums else new
        if sums:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    counted = docs.select(text).mapInArrow(count, "part int, counts binary")
    summed = counted.repartition(PARTS, "part").mapInArrow(add, "part int, counts binary")
    out = np.zeros((PARTS, DEPTH * (1 << WIDTH_BITS) // PARTS), np.int64)
    for row in summed.collect():  # of a fixed size
        out[row["part"]] += np.frombuffer(row["counts"], np.int64)
    return out.reshape(DEPTH, -1)


def idf_tables(counts: np.ndarray, rows: int, strength: float) -> np.ndarray:
    """The idf of each of the sketch's cells; a shingle's is its largest."""
    rarity = np.log1p(max(rows, 1) / np.maximum(counts, 1)) / np.log1p(RARE)
    return (1 + strength * np.minimum(rarity, 1)).astype(np.float32)


def weigh(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their tf * idf."""
    h, tf = np.unique(hashes, return_counts=True)
    return h, tf * np.maximum(idf[0][_cells(h, 0)], idf[1][_cells(h, 1)]).astype(np.float64)


class Sampler:
    """Improved consistent weighted sampling with fixed random tables that hashes of the shingles look up."""

    def __init__(self, samples: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, 1 << 16).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, 1 << 16)).astype(np.float32)
        self.beta = rng.random(1 << 16).astype(np.float32)
        self.seeds = rng.integers(0, 1 << 63, samples, dtype=np.uint64)[:, None]

    def samples(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """For each sample a hash of the chosen shingle and its t; very long texts in parts of their shingles."""
        log_w = np.log(w).astype(np.float32)
        best, low = np.zeros(len(self.seeds), np.uint64), np.full(len(self.seeds), np.inf)
        for at in range(0, len(h), 8192):
            part = h[at : at + 8192]
            x = mix64(part[None, :] ^ self.seeds)
            r = self.r[(x & np.uint64(0xFFFF)).astype(np.intp)]
            beta = self.beta[((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.intp)]
            t = np.floor(log_w[None, at : at + 8192] / r + beta)
            log_a = self.log_c[((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.intp)] - r * (t - beta + 1)
            k = log_a.argmin(axis=1)
            i = np.arange(len(k))
            better = log_a[i, k] < low
            chosen = mix64(x[i, k] + t[i, k].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            best[better], low[better] = chosen[better], log_a[i, k][better]
        return best


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """_doc, _key (128 bits of a hash of the text) and _t, the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("_doc"), F.substring(F.unhex(F.sha2(t, 256)), 1, 16).alias("_key"), t.alias("_t"))


def _signatures(keyed: DataFrame, idf, bands: int, rows: int) -> DataFrame:
    """_doc, _key, _n (bytes of the text), _bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, table = Sampler(bands * rows), idf.value
        for batch in batches:
            out = []
            _, offsets = text_bytes(batch.column(2))
            with np.errstate(over="ignore"):
                for s in shingles(batch.column(2)):
                    if len(s):
                        got = sampler.samples(*weigh(s, table)).reshape(bands, rows)
                        band = np.arange(1, bands + 1, dtype=np.uint64)
                        for j in range(rows):
                            band = mix64(band * np.uint64(0x9E3779B97F4A7C15) + got[:, j])
                        out.append(band.astype(np.int64))
                    else:
                        out.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets)), pa.array(out, pa.list_(pa.int64()))], ["_doc", "_key", "_n", "_bands"])

    return keyed.mapInArrow(sign, "_doc long, _key binary, _n long, _bands array<long>")


class Block:
    """Texts of a block with an inverted index of their shingles."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.texts = texts
        sizes = [len(h) for h, _ in texts]
        h = np.concatenate([h for h, _ in texts])
        order = np.argsort(h, kind="stable")
        self.h, self.w, self.of = h[order], np.concatenate([w for _, w in texts])[order], np.repeat(np.arange(len(texts)), sizes)[order]
        self.total = np.array([w.sum() for _, w in texts])

    def similar(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of a text to each of the block's."""
        low, high = np.searchsorted(self.h, h), np.searchsorted(self.h, h, side="right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(self.of[at], np.minimum(self.w[at], np.repeat(w, n)), minlength=len(self.texts))
        return both / (w.sum() + self.total - both)


def _link(ids: list[bytes], texts: list[tuple[np.ndarray, np.ndarray]], own: list[bool], threshold: float) -> tuple[list[tuple[bytes, bytes]], list[bytes]]:
    """Links that join the texts' components, and the texts that aren't joined to the first.

    Rows that aren't the block's own come from other blocks and are only asked for."""
    mine = [k for k, o in enumerate(own) if o]
    links: list[tuple[bytes, bytes]] = []
    if not mine:
        return links, []
    block = Block([texts[k] for k in mine])
    root = {ids[k]: ids[k] for k in range(len(ids))}

    def find(x: bytes) -> bytes:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order = sorted(range(len(ids)), key=lambda k: ids[k])
    first = ids[order[0]]
    rest = []
    for k in order:
        if find(ids[k]) == find(first) and ids[k] != first:
            continue
        for j in np.flatnonzero(block.similar(*texts[k]) >= threshold):
            other = ids[mine[j]]
            a, b = find(ids[k]), find(other)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((ids[k], other))
        if own[k] and find(ids[k]) != find(first):
            rest.append(ids[k])
    return links, [x for x in rest if find(x) != find(first)]


def _compare(rows: DataFrame, idf, threshold: float) -> DataFrame:
    """_bucket and links _a, _b; _b null where a text of a bucket of several blocks has no link to the bucket's first text.

    rows: _bucket, _block, _blocks, _key, _own, _t, the rows of a block together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        key, held, out = None, [], []

        def end() -> None:
            if held:
                links, rest = _link([r[0] for r in held], [r[2] for r in held], [r[1] for r in held], threshold)
                out.extend((key[0], a, b) for a, b in links)
                if key[2] > 1:
                    out.extend((key[0], a, None) for a in rest)
                held.clear()

        def ready() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(cols)], ["_bucket", "_a", "_b"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True))
            for k, (s, text, own) in enumerate(zip(shingles(batch.column(5)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if keys[k] != key:
                    end()
                    key = keys[k]
                held.append((text, own, weigh(s, table)))
            if len(out) > 5000:
                yield ready()
        end()
        yield ready()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("_bucket", "_block", "_blocks", "_key", "_own", "_t").repartition(4 * parts, "_bucket", "_block").sortWithinPartitions("_bucket", "_block")
    return dealt.mapInArrow(run, "_bucket long, _a binary, _b binary")


def _placed(texts: DataFrame, places: DataFrame) -> DataFrame:
    """texts (_key, _t) once for each of their places (_key, _bucket, _block, _blocks, _own)."""
    listed = places.groupBy("_key").agg(F.collect_list(F.struct("_bucket", "_block", "_blocks", "_own")).alias("_places"))
    return texts.join(listed, "_key").select("_key", "_t", F.explode("_places").alias("_p")).select("_key", "_t", "_p.*")


def _classified(docs: DataFrame, text: str, doc_id: str, threshold: float, bands: int, rows: int, idf_strength: float, block_bytes: int, block_texts: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows (_doc, _key), their texts (_key, _doc, _rows, class_id, class_size, _stays) and the number of rows."""
    spark = docs.sparkSession
    total = docs.count()
    idf = spark.sparkContext.broadcast(idf_tables(document_frequencies(docs, text), total, idf_strength))
    keyed = _keyed(docs, text, doc_id)
    signed = materialize(_signatures(keyed, idf, bands, rows), "signatures")
    texts = signed.groupBy("_key").agg(F.min("_doc").alias("_doc"), F.count(F.lit(1)).alias("_rows"), F.first("_n").alias("_n"), F.first("_bands").alias("_bands"))
    texts = materialize(texts, "texts")
    entries = texts.select("_key", "_n", F.explode("_bands").alias("_bucket"))
    shared = entries.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_bucket")
    members = materialize(entries.join(shared, "_bucket"), "buckets")
    sets = members.groupBy("_bucket").agg(F.sum("_n").alias("_bytes"), F.count(F.lit(1)).alias("_k"), F.min("_key").alias("_first"), F.bit_xor(F.xxhash64("_key")).alias("_x"), F.sum(F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(1 << 30))).alias("_y"))
    sets = sets.groupBy("_k", "_first", "_x", "_y").agg(F.min("_bucket").alias("_bucket"), F.first("_bytes").alias("_bytes"))
    blocks = F.ceil(F.greatest(F.col("_bytes") / block_bytes, F.col("_k") / block_texts)).cast("int")
    sets = materialize(sets.select("_bucket", "_first", blocks.alias("_blocks")), "bucket_sets")
    block_of = F.pmod(F.xxhash64("_key", F.lit(2)), "_blocks").cast("int")
    own = members.select("_bucket", "_key").join(sets.select("_bucket", "_blocks"), "_bucket").select("_key", "_bucket", block_of.alias("_block"), "_blocks", F.lit(True).alias("_own"))
    # the bucket's first text goes to all of its blocks
    everywhere = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block")
    guests = sets.where("_blocks > 1").select(F.col("_first").alias("_key"), "_bucket", everywhere, "_blocks", F.lit(False).alias("_own")).where(block_of != F.col("_block"))
    # one plan at every size: the texts of buckets are picked out by a merge join, each from the row of its smallest id
    wanted = members.select("_key").distinct().join(texts.select("_key", "_doc"), "_key").select(F.col("_key").alias("_k"), F.col("_doc").alias("_d"))
    picked = keyed.join(wanted.hint("merge"), (F.col("_key") == F.col("_k")) & F.col("_doc").eqNullSafe(F.col("_d")), "left_semi")
    picked = materialize(picked.select("_key", "_t").dropDuplicates(["_key"]), "bucket_texts")
    found = materialize(_compare(_placed(picked, own.unionByName(guests)), idf, threshold), "links")
    links = found.where("_b is not null").select("_a", "_b")
    alone = found.where("_b is null")
    if alone.limit(1).count():
        lone = alone.select("_bucket", F.col("_a").alias("_key")).join(sets.select("_bucket", "_blocks"), "_bucket")
        asked = lone.select("_key", "_bucket", everywhere, "_blocks", F.lit(False).alias("_own")).where(block_of != F.col("_block"))
        again = own.join(lone.select("_bucket").distinct(), "_bucket", "left_semi").unionByName(asked)
        more = _compare(_placed(picked, again), idf, threshold).where("_b is not null").select("_a", "_b")
        links = materialize(links.unionByName(more), "links")
    joined = components(links, "_a", "_b")
    discard(picked, members, sets, found, links)

    plain = texts.select("_key", "_doc", "_rows")
    linked = plain.join(joined, plain["_key"] == joined["node"]).select("_key", "_doc", "_rows", "label")
    order = F.struct(F.isnull("_doc"), "_doc", "_key")
    named = linked.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.min("_doc").alias("class_id"), F.sum("_rows").alias("class_size"), F.min_by("_key", order).alias("_stay"))
    linked = join_uneven(linked, materialize(named, "named"), "label", "_n", total).select("_key", "_doc", "_rows", "class_id", "class_size", (F.col("_key") == F.col("_stay")).alias("_stays"))
    single = plain.join(joined.select(F.col("node").alias("_key")), "_key", "left_anti").select("_key", "_doc", "_rows", F.col("_doc").alias("class_id"), F.col("_rows").alias("class_size"), F.lit(True).alias("_stays"))
    return signed.select("_doc", "_key"), materialize(linked.unionByName(single), "classed"), total


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8, bands: int = 16, rows: int = 3, idf_strength: float = 0.25, block_bytes: int = 4 << 20, block_texts: int = 1000) -> DataFrame:
    """doc_id, class_id and class_size of every row."""
    signed, texts, total = _classified(docs, text, doc_id, threshold, bands, rows, idf_strength, block_bytes, block_texts)
    out = join_uneven(signed, texts.select("_key", "_rows", "class_id", "class_size"), "_key", "_rows", total)
    return out.select(F.col("_doc").alias(doc_id), "class_id", "class_size")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8, bands: int = 16, rows: int = 3, idf_strength: float = 0.25, block_bytes: int = 4 << 20, block_texts: int = 1000) -> DataFrame:
    """One row of each class, all columns kept: of the smallest doc_id, or of the smallest hash where no row has an id."""
    signed, texts, _ = _classified(docs, text, doc_id, threshold, bands, rows, idf_strength, block_bytes, block_texts)
    stay = materialize(texts.where("_stays").select(F.col("_key").alias("_k"), F.col("_doc").alias("_d")), "stay")
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_x"), F.col(doc_id).alias("_y"))
    keyed = whole.select("_row", F.col("_y").cast("long").alias("_doc"), F.substring(F.unhex(F.sha2(F.coalesce("_x", F.lit("")), 256)), 1, 16).alias("_key"))
    kept = keyed.join(stay.hint("merge"), (F.col("_key") == F.col("_k")) & F.col("_doc").eqNullSafe(F.col("_d")), "left_semi")
    if signed.groupBy("_doc", "_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).count():
        kept = kept.dropDuplicates(["_key", "_doc"])
    discard(texts)
    return kept.select("_row.*")
