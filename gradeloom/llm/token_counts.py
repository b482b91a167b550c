"""Token counts of documents that are edited, without encoding them anew.

A text is cut into pre-tokens by the tokenizer's pattern; a pre-token's number of tokens doesn't depend
on its surroundings. ``grow`` keeps the pre-tokens of each document as a row of a table: version, text,
length and tokens of each pre-token, the leaves of its segment tree. ``edit`` takes such a table and edits
against it and gives the next version. The tree's nodes hold the characters and tokens below them. An edit
finds its place by descending the tree, goes back to a border of pre-tokens that the edit can't have moved,
cuts and counts only from there until the new borders fall on old ones again, and updates the sums above
the leaves that changed. Documents without edits aren't touched.

The vocabulary is a file of ranks, read by the driver and sent to the executors (under 1 MB).

Defined cases: a null text is empty and has no tokens; texts of any length are kept whole; edits of a
document are applied in order of their start (of their end and replacement where those are equal), those
that overlap an earlier one, lie outside the text or have a null in them are skipped; repeated rows are
counted each, and a table of edits holds for all rows of its ids; edits without an id fit no row; an empty
table gives an empty table; extra columns are not returned.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: start, end, replacement, in characters of the text before the edits
Edit = tuple[int, int, str]
#: Characters that a pre-token's end may depend on behind it.
AHEAD = 4
LEAF = 64


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, most: int = 500_000) -> None:
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.most, self.known = most, {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= self.most:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n


class PieceTree:
    """A text's pre-tokens in leaves of a segment tree of sums (characters, tokens, pre-tokens)."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.text, self.counter, self.encoded = text, counter, 0
        self._build(self._cut(counter.pattern.findall(text)))

    @classmethod
    def restored(cls, text: str, lengths: list[int], tokens: list[int], counter: Counter) -> PieceTree:
        """The tree of a text whose pre-tokens are known; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.text, tree.counter, tree.encoded = text, counter, 0
        pairs = list(zip(lengths, tokens, strict=True))
        tree._build([pairs[at : at + LEAF] for at in range(0, len(pairs), LEAF)])
        return tree

    def pieces(self) -> tuple[list[int], list[int]]:
        """Length and tokens of each pre-token."""
        return [p[0] for leaf in self.leaves for p in leaf], [p[1] for leaf in self.leaves for p in leaf]

    def _cut(self, pieces: list[str]) -> list[list[tuple[int, int]]]:
        known, count = self.counter.known, self.counter.count
        pairs = [(len(p), known[p] if p in known else count(p)) for p in pieces]
        self.encoded += len(pairs)
        return [pairs[at : at + LEAF] for at in range(0, len(pairs), LEAF)]

    def _build(self, leaves: list[list[tuple[int, int]]]) -> None:
        self.leaves = leaves
        self.base = 1
        while self.base < max(1, len(leaves)):
            self.base *= 2
        self.sums = [(0, 0)] * (2 * self.base)
        for k, leaf in enumerate(leaves):
            self.sums[self.base + k] = self._sum(leaf)
        for k in range(self.base - 1, 0, -1):
            self.sums[k] = self._join(k)

    @staticmethod
    def _sum(leaf: list[tuple[int, int]]) -> tuple[int, int]:
        return sum(p[0] for p in leaf), sum(p[1] for p in leaf)

    def _join(self, k: int) -> tuple[int, int]:
        a, b = self.sums[2 * k], self.sums[2 * k + 1]
        return a[0] + b[0], a[1] + b[1]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at, and where the leaf begins; the last leaf for the end of the text."""
        if at >= self.sums[1][0]:
            last = max(len(self.leaves) - 1, 0)
            return last, self.sums[1][0] - self.sums[self.base + last][0]
        node, begin = 1, 0
        while node < self.base:
            node *= 2
            if at >= begin + self.sums[node][0]:
                begin += self.sums[node][0]
                node += 1
        return node - self.base, begin

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end]; positions are of the text as it is now."""
        safe = max(0, start - AHEAD)
        first, begin = self.find(safe)
        if first and begin == safe:  # the border itself must lie behind
            first -= 1
            begin -= self.sums[self.base + first][0]
        leaf = self.leaves[first] if self.leaves else []
        head, at = 0, begin
        while head < len(leaf) and at + leaf[head][0] <= safe:
            at += leaf[head][0]
            head += 1
        self.text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        # old borders behind the edit, leaf by leaf
        last, behind = self.find(end)
        tail = 0
        pieces: list[str] = []
        done = False
        for m in self.counter.pattern.finditer(self.text, at):
            old = m.start() - shift
            if m.start() >= start + len(new) and old >= end:
                while last < len(self.leaves) and behind + self.sums[self.base + last][0] <= old and last < len(self.leaves) - 1:
                    behind += self.sums[self.base + last][0]
                    last, tail = last + 1, 0
                border = behind + sum(p[0] for p in self.leaves[last][:tail])
                while tail < len(self.leaves[last]) and border < old:
                    border += self.leaves[last][tail][0]
                    tail += 1
                if border == old:
                    done = True
                    break
            pieces.append(m.group())
        if not done:
            last, tail = max(len(self.leaves) - 1, 0), len(self.leaves[-1]) if self.leaves else 0
        known, count = self.counter.known, self.counter.count
        fresh = [(len(p), known[p] if p in known else count(p)) for p in pieces]
        self.encoded += len(fresh)
        changed = leaf[:head] + fresh + (self.leaves[last][tail:] if self.leaves else [])
        wide = last - first + 1
        if self.leaves and len(changed) <= 2 * LEAF * wide:
            # the leaves in between take the new pieces; only sums above them change
            per = -(-len(changed) // wide) or 1
            for k in range(wide):
                self.leaves[first + k] = changed[k * per : (k + 1) * per]
                self._update(first + k)
        else:
            leaves = self.leaves[:first] + [changed[k : k + LEAF] for k in range(0, len(changed), LEAF)] + self.leaves[last + 1 :]
            self._build(leaves)

    def _update(self, k: int) -> None:
        node = self.base + k
        self.sums[node] = self._sum(self.leaves[k])
        node //= 2
        while node:
            self.sums[node] = self._join(node)
            node //= 2


#: What a redaction replaces.
_REDACTED = regex.compile(r"(?P<mail>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)|(?P<ip>\b\d{1,3}(?:\.\d{1,3}){3}\b)|(?P<secret>\b[0-9a-fA-F]{32,}\b)|(?P<number>\+?\b\d(?:[ -]?\d){8,}\b)")


def redactions(text: str) -> list[Edit]:
    """Edits that replace mail and network addresses, long keys and long numbers by their kind."""
    return [(m.start(), m.end(), f"<{m.lastgroup}>") for m in _REDACTED.finditer(text)]


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def _packed(lengths: list[int], tokens: list[int]) -> bytes:
    """Both lists in one string of bytes: one byte for each number, or four if one doesn't fit."""
    both = np.array([lengths, tokens], np.uint32)
    return (b"\1" + both.astype(np.uint8).tobytes()) if both.max(initial=0) < 256 else (b"\4" + both.tobytes())


def _unpacked(leaves: bytes) -> tuple[list[int], list[int]]:
    lengths, tokens = np.frombuffer(leaves, np.uint8 if leaves[:1] == b"\1" else np.uint32, offset=1).reshape(2, -1)
    return lengths.tolist(), tokens.tolist()


def _fitting(edits: list, length: int) -> list[Edit]:
    """Edits in order that lie inside the text and overlap none before them."""
    out, reached = [], 0
    for start, end, new in sorted(e for e in edits if None not in e):
        if reached <= start <= end <= length:
            out.append((start, end, new))
            reached = end
    return out


def grow(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, version (0), text, n_tokens, n_pretokens and leaves of every row: write it, edits refer to it."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value, pattern)
        known, count = counter.known, counter.count
        for batch in batches:
            tokens, pieces, leaves = [], [], []
            for t in batch.column(1).to_pylist():
                cut = counter.pattern.findall(t)
                counts = [known[p] if p in known else count(p) for p in cut]
                tokens.append(sum(counts))
                pieces.append(len(cut))
                leaves.append(_packed(list(map(len, cut)), counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0] * batch.num_rows, pa.int32()), batch.column(1), pa.array(tokens, pa.int64()), pa.array(pieces, pa.int64()), pa.array(leaves, pa.binary())], [doc_id, "version", "text", "n_tokens", "n_pretokens", "leaves"])

    kind = dict(docs.dtypes)[doc_id]
    slim = docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return slim.mapInArrow(run, f"`{doc_id}` {kind}, version int, text string, n_tokens long, n_pretokens long, leaves binary")


def edit(trees: DataFrame, edits: Callable[[str], list[Edit]] | DataFrame, doc_id: str = "doc_id", vocabulary: str = VOCABULARY, pattern: str = PATTERN, keep: bool = True) -> DataFrame:
    """The next version of the trees: their columns with n_tokens_before, n_edits and n_recounted pre-tokens.

    edits: a table (doc_id, start, end, new), or a function of the text. keep: with the new texts and leaves, so that
    the result is a table for further edits; without them it has the counts only."""
    ranks = trees.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    own = [doc_id, "version", "text", "n_tokens", "n_pretokens", "leaves"]
    rows = trees.select(*own)
    of_text = None if isinstance(edits, DataFrame) else edits
    if isinstance(edits, DataFrame):
        listed = edits.groupBy(F.col(doc_id).alias("_of")).agg(F.collect_list(F.struct("start", "end", "new")).alias("_edits"))
        rows = rows.join(listed, F.col(doc_id) == F.col("_of"), "left").select(*own, "_edits")
    names = [doc_id, "version", "n_tokens", "n_pretokens", "n_tokens_before", "n_edits", "n_recounted", *(["text", "leaves"] if keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value, pattern)
        for batch in batches:
            out = []
            wanted = batch.column(6).to_pylist() if batch.num_columns > 6 else None
            rows = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), batch.column(5), strict=True)
            for k, (version, t, tokens, pieces, leaves) in enumerate(rows):
                asked = [tuple(e.values()) for e in wanted[k] or ()] if of_text is None else of_text(t)
                todo = _fitting(asked, len(t)) if asked else []
                if not todo:
                    out.append((version + 1, tokens, pieces, tokens, 0, 0, t, leaves.as_py() if keep else None))
                    continue
                tree = PieceTree.restored(t, *_unpacked(leaves.as_py()), counter)
                shift = 0
                for start, end, new in todo:
                    tree.edit(start + shift, end + shift, new)
                    shift += len(new) - (end - start)
                now = tree.pieces()
                out.append((version + 1, tree.tokens, len(now[0]), tokens, len(todo), tree.encoded, tree.text, _packed(*now) if keep else None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int32(), *[pa.int64()] * 5, pa.string(), pa.binary()]
            arrays = [pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)][: 8 if keep else 6]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    kind = dict(trees.dtypes)[doc_id]
    return rows.mapInArrow(run, f"`{doc_id}` {kind}, version int, " + ", ".join(f"{n} long" for n in names[2:7]) + (", text string, leaves binary" if keep else ""))


def count_edited(docs: DataFrame, edits: Callable[[str], list[Edit]] | DataFrame = redactions, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens before and n_tokens_edited after the edits, n_edits, n_pretokens after them and n_recounted of every row.

    The trees are written to the shared folder and the edits applied to what was written."""
    trees = materialize(grow(docs, text, doc_id, vocabulary, pattern), "trees")
    done = edit(trees, edits, doc_id, vocabulary, pattern, keep=False)
    return done.select(doc_id, F.col("n_tokens_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_edited"), "n_pretokens", "n_recounted")
