"""SentencePiece merge encoding by backtracking, and decoding.

A merge vocabulary joins, again and again, the two neighbours whose joined text is the piece of the highest score (the
leftmost of equals). A sequence of pieces is what the merges of a text end in exactly if each piece is what its own
text is merged to, and each two neighbours stay two when their joined text is merged alone. So no merge of the whole
text is needed: at each place the longest piece (found by an Aho-Corasick automaton) is tried, then ever shorter ones
that begin it, until one is compatible with the piece before it; a place from which no piece leads on is marked in a
bitfield as failed, its last piece is taken back, and a failed place is never entered again.

Text is cut beforehand where no piece reaches across: in front of a run of space marks, and around characters that
are in no longer piece. What a cut-out stretch is coded to doesn't depend on its surroundings and is remembered.
Characters that are no piece are coded as the bytes of their UTF-8 form.

The vocabulary is a file of the installed library, read by the driver and sent to the executors (about 1 MB). It
has to be of merge type with byte pieces, and without pieces of the user's own.

Defined cases: a null text is empty; an empty text has no ids but the end's; texts of any length are coded whole;
repeated rows are coded each; an empty table gives an empty table; extra columns are returned only if they are
carried, and those that clash with an output are replaced by it. Decoding null ids gives an empty text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: the mark that stands for a space.
MARK = "▁"
#: Fixed value: what an unknown piece is decoded to.
UNKNOWN = " ⁇ "


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their ids and scores; ids of the 256 bytes, of the unknown piece, the end and other controls.

    fickle: pieces that the merges of their own text don't end in."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    unknown: int
    end: int
    controls: frozenset[int]
    fickle: frozenset[str]
    size: int


def read_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, bytes_, controls = {}, {}, [-1] * 256, set()
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_[int(piece[1:-1], 16)] = i
        elif model.is_control(i):
            controls.add(i)
        elif model.is_unused(i):
            raise ValueError(f"{path}: unused piece {piece!r}")
        elif not model.is_unknown(i):
            ids[piece], scores[piece] = i, model.get_score(i)
    probe = "Aﬁ  ① éé"
    if min(bytes_) < 0 or model.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError(f"{path}: only vocabularies with byte pieces, a mark in front and no other normalisation")
    fickle = frozenset(piece for piece in scores if merge(piece, scores) != [piece])
    return Vocabulary(ids, scores, bytes_, model.unk_id(), model.eos_id(), frozenset(controls), fickle, model.vocab_size())


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """Pieces of a short text by merging neighbours outright."""
    parts, get, none = list(text), scores.get, float("-inf")
    joint = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while joint:
        best = max(joint)
        if best == none:
            break
        k = joint.index(best)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del joint[k]
        if k:
            joint[k - 1] = get(parts[k - 1] + parts[k], none)
        if k < len(joint):
            joint[k] = get(parts[k] + parts[k + 1], none)
    return parts


class Decoder:
    """Turns ids into text."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        pieces: list[bytes] = [b""] * vocabulary.size
        for piece, i in vocabulary.ids.items():
            pieces[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(vocabulary.bytes_):
            pieces[i] = bytes([b])
        pieces[vocabulary.unknown] = UNKNOWN.encode()
        self.pieces = pieces
        self.byte_of = {i: b for b, i in enumerate(vocabulary.bytes_)}

    def decode(self, ids: list[int]) -> str:
        """The text of ids: controls give nothing, the first mark goes, bytes that are no UTF-8 give U+FFFD each."""
        whole = b"".join(map(self.pieces.__getitem__, ids))
        first = next((i for i in ids if i not in self.vocabulary.controls), None)
        if first is not None and first not in self.byte_of and whole.startswith(b" ") and first != self.vocabulary.unknown:
            whole = whole[1:]
        try:
            return whole.decode()
        except UnicodeDecodeError:
            return self._by_runs(ids)

    def _by_runs(self, ids: list[int]) -> str:
        out, run, begun = [], bytearray(), False
        for i in [*ids, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                begun = True
                continue
            out.append(_mended(bytes(run)))
            run.clear()
            if i is None or i in self.vocabulary.controls:
                continue
            text = self.pieces[i].decode()
            out.append(text[1:] if not begun and i != self.vocabulary.unknown and text.startswith(" ") else text)
            begun = True
        return "".join(out)


class _Stretches(dict):
    """Codes of stretches as packed ids, computed where they aren't known."""

    def __init__(self, code: Callable[[str], bytes], most: int) -> None:
        self.code, self.most = code, most

    def __missing__(self, text: str) -> bytes:
        out = self.code(text)
        if len(self) >= self.most:
            self.clear()
        if len(text) <= 64:
            self[text] = out
        return out


class Coder(Decoder):
    """Encodes and decodes texts; memory holds at most ``most`` remembered stretches and pairs.

    Inside, pieces and the characters of longer pieces have numbers; pieces that their own text isn't merged to are
    in no result and get none."""

    def __init__(self, vocabulary: Vocabulary, most: int = 500_000) -> None:
        super().__init__(vocabulary)
        self.most = most
        inner = {c for piece in vocabulary.scores if len(piece) > 1 for c in piece}
        self.texts = sorted((vocabulary.scores.keys() - vocabulary.fickle) | inner)
        self.lengths = [len(t) for t in self.texts]
        numbers = {t: k for k, t in enumerate(self.texts)}
        self.single = {t: k for t, k in numbers.items() if len(t) == 1}
        # the longest numbered text that begins a text and isn't all of it, -1 for characters
        self.shorter = [next((numbers[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in numbers), -1) for t in self.texts]
        self.automaton = ahocorasick.Automaton()
        for text, number in numbers.items():
            if len(text) > 1:
                self.automaton.add_word(text, number)
        self.automaton.make_automaton()
        # a mark behind another character inside a piece would reach across the cut in front of marks
        crossing = any(a != MARK and b == MARK for piece in vocabulary.scores for a, b in zip(piece, piece[1:], strict=False))
        joined = "".join(re.escape(c) for c in sorted(inner - {MARK}))
        stretch = f"[{MARK}{joined}]+" if crossing else f"{MARK}+[{joined}]*|[{joined}]+"
        self.stretches = re.compile(f"{stretch}|." if joined else f"{MARK}+|.", re.DOTALL)
        self.pairs: dict[int, bool] = {}
        self.coded = [self._packed(t) for t in self.texts]
        self.known = _Stretches(self._stretch, most)
        self.ending = array("i", [vocabulary.end]).tobytes()

    def _packed(self, piece: str) -> bytes:
        """A piece's id, or those of the bytes of a character that is none, as 32-bit integers."""
        i = self.vocabulary.ids.get(piece)
        return array("i", [self.vocabulary.bytes_[b] for b in piece.encode()] if i is None else [i]).tobytes()

    def _compatible(self, left: int, right: int) -> bool:
        """Whether two neighbours stay these two when their joined text is merged again."""
        if len(self.pairs) >= self.most:
            self.pairs.clear()
        a, b = self.texts[left], self.texts[right]
        known = self.pairs[left * len(self.texts) + right] = merge(a + b, self.vocabulary.scores) == [a, b]
        return known

    def backtrack(self, text: str) -> list[int]:
        """Numbers of the pieces of a text without merging it as a whole; all its characters have to have numbers."""
        n, lengths, shorter, pairs, many = len(text), self.lengths, self.shorter, self.pairs, len(self.texts)
        longest = list(map(self.single.__getitem__, text))
        for last, number in self.automaton.iter(text):
            longest[last + 1 - lengths[number]] = number  # of those that begin at a place the longest ends last
        longest.append(-1)
        failed, marks = 0, bytearray(n // 8 + 1 if n >= 1024 else 0)  # one integer for short texts
        out: list[int] = []
        at, piece, before = 0, longest[0], -1
        while at < n:
            while piece >= 0:
                end = at + lengths[piece]
                if not (marks[end >> 3] >> (end & 7) if marks else failed and failed >> end) & 1:
                    if before < 0:
                        break
                    fits = pairs.get(before * many + piece)
                    if self._compatible(before, piece) if fits is None else fits:
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at, before, piece = end, piece, longest[end]
            else:
                if marks:
                    marks[at >> 3] |= 1 << (at & 7)
                else:
                    failed |= 1 << at
                piece = out.pop()
                at -= lengths[piece]
                before = out[-1] if out else -1
        return out

    def _stretch(self, text: str) -> bytes:
        if len(text) == 1:
            return self._packed(text)
        return b"".join(map(self.coded.__getitem__, self.backtrack(text)))

    def packed(self, text: str) -> bytes:
        """Ids of a text, the end's id last, as 32-bit integers."""
        parts = self.stretches.findall(MARK + text.replace(" ", MARK)) if text else ()
        return b"".join(map(self.known.__getitem__, parts)) + self.ending

    def encode(self, text: str) -> list[int]:
        """Ids of a text, the end's id last."""
        return array("i", self.packed(text)).tolist()


def _mended(run: bytes) -> str:
    """Bytes as text, each byte that begins no character as U+FFFD."""
    out, at = [], 0
    while at < len(run):
        for wide in (1, 2, 3, 4):
            try:
                out.append(run[at : at + wide].decode())
            except UnicodeDecodeError:
                continue
            if at + wide <= len(run):
                at += wide
                break
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _unused(names: list[str]) -> str:
    """A column name that is none of these."""
    return "_value" + "_" * max((len(n) for n in names), default=0)


def _shared(spark: SparkSession, path: str):  # noqa: ANN202
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encode(docs: DataFrame, text: str = "text", carry: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The carried columns (all by default) with ids, the pieces' ids of the text and the end's id."""
    carry = [c for c in (docs.columns if carry is None else carry) if c != "ids"]
    shared = _shared(docs.sparkSession, vocabulary)
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                packed = [coder.packed(t) for t in rows.column(len(carry)).to_pylist()]
                ends = pa.array(np.cumsum([0, *[len(p) // 4 for p in packed]]), pa.int32())
                ids = pa.Array.from_buffers(pa.int32(), sum(map(len, packed)) // 4, [None, pa.py_buffer(b"".join(packed))])
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(carry)], pa.ListArray.from_arrays(ends, ids)], [*carry, "ids"])

    schema = "".join(f"`{c}` {types[c]}, " for c in carry) + "ids array<int>"
    return docs.select(*carry, F.coalesce(F.col(text), F.lit("")).alias(_unused(carry))).mapInArrow(run, schema)


def decode(coded: DataFrame, ids: str = "ids", carry: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The carried columns (all by default) with decoded, the text of the ids."""
    carry = [c for c in (coded.columns if carry is None else carry) if c != "decoded"]
    shared = _shared(coded.sparkSession, vocabulary)
    types = dict(coded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                texts = [decoder.decode(i.values.to_numpy(zero_copy_only=False).tolist()) for i in rows.column(len(carry))]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(carry)], pa.array(texts, pa.string())], [*carry, "decoded"])

    schema = "".join(f"`{c}` {types[c]}, " for c in carry) + "decoded string"
    return coded.select(*carry, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias(_unused(carry))).mapInArrow(run, schema)
