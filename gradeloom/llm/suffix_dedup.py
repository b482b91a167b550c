"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of ``match`` bytes that covers it also starts in a document with a smaller id.

0. A text that equals one of a smaller id (by SHA-256) is all repeated, if it is long enough, and takes no
   further part: whatever it holds starts in the smaller document too.
1. Every window of ``match`` bytes holds an anchor, its 16-byte string of the smallest hash (leftmost of
   equals), which depends on the window's bytes only, so equal windows have equal anchors. Anchors that
   two documents have are found by dealing out 8 bytes for each anchor, one copy for each task.
2. Runs of windows with the same shared anchor are cut out of the texts and dealt out by the anchor. Of
   equal runs in a task only those of its smallest document travel; the others are settled at once.
3. Runs with the same anchor meet in a task. Equal runs are one, with their smallest document. The
   suffixes of different runs that have the anchor at the same place are sorted by a merge sort, which begins
   with equal ones as neighbours, leaves out those whose hash no other has, and moves each group of equals by its
   head; two suffixes are compared by binary search for their longest common extension over prefix polynomial
   hashes. Neighbours that agree in ``match`` bytes are verified byte by byte, so a collision of hashes
   can't join them; each class's smallest document owns the string, in all others its bytes are marked.
4. Marked ranges are joined to the documents and cut out.

Texts are dealt out once, by doc_id. Nothing is dropped or capped: a string in a third of all documents
travels once for each task, and all of its occurrences are marked.

Defined cases: a null text is empty; texts shorter than ``match`` keep all bytes; repeated rows have the
same id and so do not count against each other, whether their texts are equal or not (each text of an id then has
a key of its own in the order of ids); ids are numbers that fit a long; a row without an id neither removes nor loses bytes; an empty
table gives an empty table; extra columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .merkle import _places
from .shingles import _VALUE, _powers, mix64, text_bytes
from .storage import join_uneven, materialize

GRAM = 16
CHUNK = 1 << 18
FLUSH = 1 << 21
U = np.uint64


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal keys together and where each group begins in it."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _of_group(begins: np.ndarray, n: int) -> np.ndarray:
    flags = np.zeros(n, np.int64)
    flags[begins[1:]] = 1
    return np.cumsum(flags)


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the lengths, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def anchors(data: np.ndarray, offsets: np.ndarray, match: int) -> tuple[np.ndarray, ...]:
    """For runs of windows with the same anchor: document number, first and last window, anchor's place, its hash."""
    n = len(data) - GRAM + 1
    wide = match - GRAM + 1
    empty = np.zeros(0, np.int64)
    if n < wide or (offsets[1:] - offsets[:-1]).max(initial=0) < match:
        return empty, empty, empty, empty, empty.astype(U)
    with np.errstate(over="ignore"):
        eight = np.ndarray((len(data) - 7,), np.dtype("<u8"), data.tobytes(), 0, (1,))
        h = mix64(eight[:n] * U(0x9E3779B97F4A7C15) + mix64(eight[8 : 8 + n]))
    least = (h & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)
    span = 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    place = (least & U(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(place) + 1, np.int64)
    long = np.flatnonzero(offsets[1:] - offsets[:-1] >= match)
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, offsets[long + 1] - match + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    first = inside.copy()
    first[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= (place[1:] != place[:-1]) | ~inside[1:]
    # documents that touch are told apart by the gap of windows that cross their border
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    at = place[first]
    return np.searchsorted(offsets, first, side="right") - 1, first, last, at, h[at]


def _chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.int64(len(a)).tobytes() + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, kind, n, at + 8))
        at += 8 + n * np.dtype(kind).itemsize
    return out


class _Rows:
    """Rows (bucket, doc, blob) as Arrow batches. Rows for a bucket have no doc, rows for a document have it."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int | None, bytes]] = []

    def by_doc(self, doc: np.ndarray, *values: np.ndarray) -> None:
        order, begins = _groups(doc)
        for b, e in zip(begins, [*begins[1:], len(order)] if len(order) else [], strict=True):
            own = order[b:e]
            d = int(doc[own[0]])
            self.rows.append((d % 1_000_003, d, np.stack([v[own] for v in values], 1).tobytes()))

    def batches(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.rows), 2000):
            part = self.rows[at : at + 2000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.binary())], ["_bucket", "_doc", "_blob"])
        self.rows = []


def _find_anchors(match: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        held, rows = 0, _Rows()

        def flush() -> None:
            h, d = np.concatenate(hashes), np.concatenate(docs)
            order, begins = _groups(h, d)
            h, d = h[order[begins]], d[order[begins]]  # once for each document
            new = np.r_[True, h[1:] != h[:-1]]
            begins = np.flatnonzero(new)
            sizes = np.diff(np.r_[begins, len(h)])
            many = np.repeat(sizes > 1, sizes)
            rows.by_doc(d[many], (h[many] & U(0xFFFFFFFF)).astype(np.uint32))
            sent, owner = h[begins], np.where(sizes > 1, -1, d[begins])
            bucket = (sent >> U(40)).astype(np.int64) % buckets
            o, b = _groups(bucket)
            for s, e in zip(b, np.r_[b[1:], len(o)], strict=True):
                own = o[s:e]
                rows.rows.append((int(bucket[own[0]]), None, _pack(sent[own], owner[own])))

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(1))
            for a, b in _chunks(offsets, CHUNK):
                doc, _, _, _, h = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], match)
                hashes.append(h)
                docs.append(ids[a + doc])
                held += len(h)
            if held > FLUSH:
                flush()
                hashes, docs, held = [], [], 0
                yield from rows.batches()
        if held:
            flush()
            yield from rows.batches()

    return run


def _by_bucket(process):
    """Passes rows for documents on and gives process all blobs of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = defaultdict(list)
        for batch in batches:
            own = batch.column(1).is_null().to_pylist()
            for bucket, blob, mine in zip(batch.column(0).to_pylist(), batch.column(2), own, strict=True):
                if mine:
                    blobs[bucket].append(blob.as_py())
            rest = batch.filter(batch.column(1).is_valid())
            if rest.num_rows:
                yield rest
        rows = _Rows()
        while blobs:
            process(blobs.popitem()[1], rows)
            if len(rows.rows) > 20_000:
                yield from rows.batches()
        yield from rows.batches()

    return run


def _share(blobs: list[bytes], rows: _Rows) -> None:
    """Tells documents which of their anchors another document has."""
    parts = [_unpack(b, U, np.int64) for b in blobs]
    h, d = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order, begins = _groups(h)
    h, d = h[order], d[order]
    sizes = np.diff(np.r_[begins, len(h)])
    low, high = np.minimum.reduceat(d, begins), np.maximum.reduceat(d, begins)
    tell = np.repeat((sizes > 1) & (low != high), sizes) & (d >= 0)
    if tell.any():
        rows.by_doc(d[tell], (h[tell] & U(0xFFFFFFFF)).astype(np.uint32))


def _cut_runs(match: int, buckets: int, shift: int = 0):
    """From texts with their shared anchors: runs for the buckets, ranges for documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, size = _Rows(), [], 0

        def flush() -> None:
            d, s, n, a, h = (np.concatenate([x[k] for x in held]) for k in range(5))
            body = np.concatenate([x[5] for x in held])
            starts = np.cumsum(n) - n
            key = _run_hashes(body, starts, n)
            order, begins = _groups(h, key, n)
            owner = np.minimum.reduceat(d[order], begins)[_of_group(begins, len(order))]
            same = _equal(body, starts[order], starts[order[begins]][_of_group(begins, len(order))], n[order])
            stay = np.zeros(len(d), bool)
            stay[order] = ~same | (d[order] >> shift == owner >> shift)
            gone = ~stay
            if gone.any():
                rows.by_doc(d[gone], s[gone], s[gone] + n[gone])
            keep = np.flatnonzero(stay)
            bucket = (h[keep] >> U(40)).astype(np.int64) % buckets
            o, b = _groups(bucket)
            for x, y in zip(b, np.r_[b[1:], len(o)], strict=True):
                own = keep[o[x:y]]
                cut = body[np.repeat(starts[own], n[own]) + _ramp(n[own])]
                rows.rows.append((int(bucket[o[x]]), None, _pack(h[own], d[own], s[own].astype(np.int32), n[own].astype(np.int32), a[own].astype(np.int32), cut)))

        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(1))
            shared = [np.sort(np.frombuffer(b"".join(x or ()), np.uint32)) for x in batch.column(2).to_pylist()]
            for p, q in _chunks(offsets, CHUNK):
                bytes_ = data[offsets[p] : offsets[q]]
                doc, first, last, at, h = anchors(bytes_, offsets[p : q + 1] - offsets[p], match)
                if not len(h):
                    continue
                hit = np.zeros(len(h), bool)
                cuts = np.searchsorted(doc, np.arange(q - p + 1))
                low = (h & U(0xFFFFFFFF)).astype(np.uint32)
                for k in range(q - p):
                    if len(shared[p + k]) and cuts[k + 1] > cuts[k]:
                        own = low[cuts[k] : cuts[k + 1]]
                        i = np.minimum(np.searchsorted(shared[p + k], own), len(shared[p + k]) - 1)
                        hit[cuts[k] : cuts[k + 1]] = shared[p + k][i] == own
                doc, first, last, at, h = doc[hit], first[hit], last[hit], at[hit], h[hit]
                n = last - first + match
                held.append((ids[p + doc], first - (offsets[p + doc] - offsets[p]), n, at - first, h, bytes_[np.repeat(first, n) + _ramp(n)]))
                size += len(held[-1][5])
                if size > 2 * FLUSH:
                    flush()
                    held, size = [], 0
                    yield from rows.batches()
        if size:
            flush()
        yield from rows.batches()

    return run


def _prefix(body: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes modulo 2**64."""
    power, _ = _powers(len(body) + 1)
    prefix = np.zeros(len(body) + 1, U)
    np.multiply(_VALUE[body], power[: len(body)], out=prefix[1:])
    return np.cumsum(prefix, out=prefix)


def _run_hashes(body: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        prefix = _prefix(body)
        _, inverse = _powers(len(body) + 1)
        return (prefix[starts + n] - prefix[starts]) * inverse[starts]


def _equal(body: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether body[a:a+n] is body[b:b+n], byte by byte."""
    out = np.ones(len(a), bool)
    todo = np.flatnonzero(a != b)
    for at in range(0, len(todo), 50_000):
        k = todo[at : at + 50_000]
        ramp = _ramp(n[k])
        same = body[np.repeat(a[k], n[k]) + ramp] == body[np.repeat(b[k], n[k]) + ramp]
        out[k] = np.logical_and.reduceat(same, np.cumsum(n[k]) - n[k]) if len(k) else True
    return out


class SuffixOrder:
    """Compares suffixes of a byte string, up to a length, by hashes of their common extensions."""

    def __init__(self, body: np.ndarray, most: int) -> None:
        self.body, self.most, self.prefix = body, most, _prefix(body)
        self.inverse = _powers(len(body) + 1)[1]

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the suffixes up to the length."""
        with np.errstate(over="ignore"):
            return (self.prefix[at + self.most] - self.prefix[at]) * self.inverse[at]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.most, np.int64)
        with np.errstate(over="ignore"):
            ia, ib, pa_, pb = self.inverse[a], self.inverse[b], self.prefix[a], self.prefix[b]
            for _ in range(self.most.bit_length()):
                mid = (low + high + 1) >> 1
                same = (self.prefix[a + mid] - pa_) * ia == (self.prefix[b + mid] - pb) * ib
                low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether the suffix at a comes before the one at b (or is equal, where asked)."""
        n = self.extension(a, b)
        end = n == self.most
        i = np.where(end, 0, n)
        return np.where(end, or_equal, self.body[a + i] < self.body[b + i])

    def sort(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Merge sort of the suffixes within each of the cells that follow each other; all cells merge in step."""
        at = at.copy()
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        end = begin + np.repeat(sizes, sizes)
        place = np.arange(len(at)) - begin
        width = 1
        while len(sizes) and width < sizes.max():
            live = np.flatnonzero(end - begin > width)
            run = place[live] // width
            left = run % 2 == 0
            other = begin[live] + np.where(left, run + 1, run - 1) * width
            other_end = np.minimum(other + width, end[live])
            low, high = np.minimum(other, end[live]), other_end.copy()
            first = low.copy()
            while (busy := np.flatnonzero(low < high)).size:
                mid = (low[busy] + high[busy]) >> 1
                # those of the left run go first among equals
                ahead = self.before(at[mid], at[live[busy]], ~left[busy])
                low[busy], high[busy] = np.where(ahead, mid + 1, low[busy]), np.where(ahead, high[busy], mid)
            new = np.where(left, live, live - width) + (low - first)
            new = np.where(other >= end[live], live, new)
            sorted_ = at[live]
            at[new] = sorted_
            width *= 2
        return at


def _sort_runs(match: int, shift: int = 0):
    def process(blobs: list[bytes], rows: _Rows) -> None:
        parts = [_unpack(b, U, np.int64, np.int32, np.int32, np.int32, np.uint8) for b in blobs]
        h, d, s, n, a, body = (np.concatenate([p[k] for p in parts]) for k in range(6))
        s, n, a = s.astype(np.int64), n.astype(np.int64), a.astype(np.int64)
        starts = np.cumsum(n) - n
        order, begins = _groups(h)
        group = np.empty(len(h), np.int64)
        group[order] = _of_group(begins, len(order))
        low, high = np.minimum.reduceat(d[order], begins), np.maximum.reduceat(d[order], begins)
        live = np.flatnonzero((low != high)[group])
        if not len(live):
            return
        # equal runs are one, with their smallest document
        key = _run_hashes(body, starts, n)
        order, begins = _groups(group[live], key[live], n[live], a[live])
        order = live[order]
        kind = _of_group(begins, len(order))
        odd = ~_equal(body, starts[order], starts[order[begins]][kind], n[order])
        if odd.any():  # a collision: runs of their own
            kind[odd] = kind.max() + 1 + np.arange(odd.sum())
        kinds = kind.max() + 1
        owner = np.full(kinds, np.iinfo(np.int64).max)
        np.minimum.at(owner, kind, d[order])
        model = np.empty(kinds, np.int64)
        model[kind[::-1]] = order[::-1]
        late = d[order] >> shift > owner[kind] >> shift
        if late.any():
            k = order[late]
            rows.by_doc(d[k], s[k], s[k] + n[k])
        # suffixes of different runs with the anchor at the same place
        per = np.bincount(group[model])
        many = np.flatnonzero(per[group[model]] > 1)
        if not len(many):
            return
        m = model[many]
        windows = n[m] - match + 1
        of = np.repeat(many, windows)
        j = _ramp(windows)
        at = starts[model[of]] + j
        suffixes = SuffixOrder(body, match)
        # equal windows have equal hashes: those of a hash of their own repeat nowhere, the others begin as runs of equal neighbours
        hashed = suffixes.hashes(at)
        o = np.argsort(hashed)
        apart = hashed[o[1:]] != hashed[o[:-1]]
        o = o[~(np.r_[True, apart] & np.r_[apart, True])]
        if not len(o):
            return
        near = np.flatnonzero(hashed[o[1:]] == hashed[o[:-1]]) + 1
        same = np.zeros(len(o), bool)
        same[near] = _equal(body, at[o[near]], at[o[near - 1]], np.full(len(near), match))
        heads = np.flatnonzero(~same)
        # the sort carries the places of the runs' heads
        head = o[heads]
        g, b = _groups(group[model[of[head]]], a[model[of[head]]] - j[head])
        sizes = np.diff(np.r_[b, len(g)])
        place = suffixes.sort(at[head[g]], sizes)
        by_place = np.argsort(at[head])
        back = by_place[np.searchsorted(at[head], place, sorter=by_place)]
        cell = np.repeat(np.arange(len(sizes)), sizes)
        joined = np.zeros(len(place), bool)
        near = np.flatnonzero(cell[1:] == cell[:-1]) + 1
        near = near[suffixes.extension(place[near], place[near - 1]) >= match]
        joined[near] = _equal(body, place[near], place[near - 1], np.full(len(near), match))
        class_ = np.empty(len(heads), np.int64)
        class_[back] = np.cumsum(~joined) - 1
        class_ = class_[np.cumsum(~same) - 1]
        least = np.full(class_.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, class_, owner[of[o]])
        lost = np.flatnonzero(least[class_] >> shift < owner[of[o]] >> shift)
        if not len(lost):
            return
        run, win = of[o[lost]], j[o[lost]]
        # lost windows of a run, merged, for all of the run's documents
        x = np.lexsort((win, run))
        run, win = run[x], win[x]
        start = np.r_[True, (run[1:] != run[:-1]) | (win[1:] > win[:-1] + match)]
        f = np.flatnonzero(start)
        r, b, e = run[f], win[f], win[np.r_[f[1:] - 1, len(run) - 1]] + match
        by = np.argsort(kind, kind="stable")
        lo, hi = np.searchsorted(kind[by], r), np.searchsorted(kind[by], r, side="right")
        k = order[by[np.repeat(lo, hi - lo) + _ramp(hi - lo)]]
        rows.by_doc(d[k], s[k] + np.repeat(b, hi - lo), s[k] + np.repeat(e, hi - lo))

    return process


def _cut_out(batches: Iterator[pa.RecordBatch], match: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        copy = batch.column(3).is_valid().to_pylist()
        out = []
        for k, blobs in enumerate(batch.column(2).to_pylist()):
            text = data[offsets[k] : offsets[k + 1]]
            if copy[k] and len(text) >= match:
                out.append((len(text), len(text), 1, hashlib.sha256(b"").hexdigest(), [[0, len(text)]]))
                continue
            ranges = np.frombuffer(b"".join(blobs or ()), np.int64).reshape(-1, 2)
            ranges = ranges[ranges[:, 0] < len(text)]
            if not len(ranges):
                out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), []))
                continue
            ranges = ranges[ranges[:, 0].argsort()]
            ends = np.maximum.accumulate(np.minimum(ranges[:, 1], len(text)))
            new = np.flatnonzero(np.r_[True, ranges[1:, 0] > ends[:-1]])
            b, e = ranges[new, 0], ends[np.r_[new[1:] - 1, len(ends) - 1]]
            gone = int((e - b).sum())
            kept = hashlib.sha256()
            for x, y in zip(np.r_[0, e], np.r_[b, len(text)], strict=True):
                kept.update(text[x:y])
            out.append((len(text), gone, len(b), kept.hexdigest(), np.stack([b, e], 1).tolist()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.list_(pa.int64())))], ["_doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _keys(hashes: DataFrame) -> tuple[DataFrame, int]:
    """_doc, _hash, _key: a key for each text of an id, in the order of ids; keys shifted right by the second result are equal for the texts of an id."""
    texts = hashes.distinct()
    most = texts.groupBy("_doc").count().agg(F.max("count")).first()[0]
    shift = int(most).bit_length()
    ids = materialize(texts.select("_doc").distinct().select(F.lit("").alias("_tree"), F.col("_doc").alias("_order"), F.col("_doc").cast("string").alias("_leaf")), "ids")
    ranks = _places(ids).select(F.col("_order").alias("_doc"), F.col("_at").alias("_rank"))
    nth = F.row_number().over(Window.partitionBy("_doc").orderBy("_hash")) - 1
    return materialize(texts.withColumn("_nth", nth).join(ranks, "_doc").select("_doc", "_hash", (F.shiftleft("_rank", shift) + F.col("_nth")).alias("_key")), "keys"), shift


def _repeated(docs: DataFrame, text: str, doc_id: str, match: int) -> tuple[DataFrame, bool]:
    """_id, _hash (of the text, only where an id has several), and what is said of every row; whether an id has several texts."""
    if match < 2 * GRAM:
        raise ValueError(f"match must be {2 * GRAM} or more")
    slim = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).alias("_text"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 8 * partitions
    rows = "_bucket int, _doc long, _blob binary"
    hashed = F.unhex(F.sha2(F.coalesce("_text", F.lit("")), 256))
    hashes = materialize(slim.where("_doc is not null").select("_doc", hashed.alias("_hash")), "hashes")
    total, shift, keys = hashes.count(), 0, None
    short = F.xxhash64("_hash")
    if hashes.groupBy("_doc").agg(F.min(short).alias("_a"), F.max(short).alias("_b")).where("_a <> _b").limit(1).count():
        keys, shift = _keys(hashes)
        slim = slim.withColumn("_hash", hashed).join(keys, ["_doc", "_hash"], "left").select(F.col("_key").alias("_doc"), "_text")
        hashes = materialize(hashes.join(keys, ["_doc", "_hash"]).select(F.col("_key").alias("_doc"), "_hash"), "key_hashes")
    # copies of a text of a smaller id
    owners = hashes.groupBy("_hash").agg(F.min("_doc").alias("_owner"), F.max("_doc").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_owner < _last").select("_hash", "_owner", "_n")
    owned = join_uneven(hashes, materialize(owners, "owners"), "_hash", "_n", total)
    copies = materialize(owned.where("_doc > _owner").select("_doc", F.lit(True).alias("_copy")).distinct(), "copies")
    slim = slim.join(copies, "_doc", "left")
    known = slim.where(F.col("_doc").isNotNull() & F.col("_copy").isNull()).select("_doc", "_text")
    shared = known.mapInArrow(_find_anchors(match, buckets), rows).repartition(partitions, "_bucket").mapInArrow(_by_bucket(_share), rows)
    shared = shared.groupBy("_doc").agg(F.collect_list("_blob").alias("_blobs"))
    # both joins are left joins of the same rows with the same columns, so that the texts are dealt out once
    runs = slim.join(shared, "_doc", "left").select("_doc", "_text", "_blobs", "_copy").mapInArrow(_cut_runs(match, buckets, shift), rows).repartition(partitions, "_bucket").mapInArrow(_by_bucket(_sort_runs(match, shift)), rows)
    marked = runs.groupBy("_doc").agg(F.collect_list("_blob").alias("_blobs"))
    out = slim.join(marked, "_doc", "left").select("_doc", "_text", "_blobs", "_copy").mapInArrow(lambda batches: _cut_out(batches, match), "_doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
    if keys is None:
        return out.withColumnRenamed("_doc", "_id"), False
    return out.join(keys.select(F.col("_key").alias("_doc"), F.col("_doc").alias("_id"), "_hash"), "_doc", "left").drop("_doc"), True


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", match: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (byte ranges) of every row."""
    out, _ = _repeated(docs, text, doc_id, match)
    return out.select(F.col("_id").alias(doc_id), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def strip(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", match: int = 50) -> DataFrame:
    """doc_id and the text that is left, as bytes: a cut may fall inside a character."""
    out, several = _repeated(docs, text, doc_id, match)
    on = ["_id", "_hash"] if several else ["_id"]
    spans = out.select(*on, "spans").where(F.size("spans") > 0).dropDuplicates(on)
    docs = docs.select(F.col(doc_id).alias("_own"), F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    if several:
        docs = docs.withColumn("_hash", F.unhex(F.sha2(F.coalesce("_text", F.lit("")), 256)))
    raw = F.encode("_text", "UTF-8")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s[1]))
    ends = F.concat(F.transform("spans", lambda s: s[0]), F.array(F.octet_length("_text").cast("long")))
    pieces = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda p: F.hex(F.substring(raw, (p["b"] + 1).cast("int"), (p["e"] - p["b"]).cast("int"))))
    return docs.join(spans, on, "left").select(F.col("_own").alias(doc_id), F.when(F.col("spans").isNull(), raw).otherwise(F.unhex(F.array_join(pieces, ""))).alias("kept"))
