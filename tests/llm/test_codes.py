"""Vector codes, piece coding and the Merkle manifest against brute force, the library and on edge cases."""

import math
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeloom.llm import merkle, piece_coding, queries, vector_codes

CLASHES = ["_row", "_text", "_tree", "_leaf", "_at", "_size", "_id", "_v", "_label", "_key", "_n", "_top", "ids", "codes", "error", "root", "path", "size", "leaf", "_order", "_nth", "_part"]


def clashing(df):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES if c not in df.columns])


# vector codes


def nearest(books, parts):
    return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book)) for x, book in zip(parts, books, strict=True)]


def brute_codes(rows, parts, entries, rounds):
    """rows (id, vector, label) of one length, by plain k-means in Python's integers."""
    ints = [[math.floor(int(x) * 4096 if abs(x) > 2**53 else x * 4096) for x in v] for _, v, _ in rows]
    width = len(ints[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    for _ in range(rounds):
        won = [[e for _, e in nearest(books, x)] for x in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [x[p] for x, w in zip(cut, won, strict=True) if w[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [nearest(books, x) for x in cut]
    return [([e for _, e in f], sum(d for d, _ in f)) for f in found], books


def vectors(seed, n, width, wide=1.0):
    rng = random.Random(seed)
    return [(k, [float(np.float32(rng.choice([rng.gauss(0, wide), 0.0, 0.25]))) for _ in range(width)], rng.choice([None, 1, 2])) for k in range(n)]


@pytest.mark.parametrize("n, wide", [(60, 1.0), (9, 1.0), (40, 3e5), (20, 1e18)])
def test_codes_are_those_of_brute_force(spark, n, wide):
    rows = vectors(n, n, 16, wide) + [(3, [0.5] * 16, 1), (3, [0.5] * 16, 1), (None, [0.25] * 16, None)]
    bad = [(100, None, 1), (101, [], 1), (102, [1.0] * 15 + [None], 2), (103, [math.nan] * 16, 2), (104, [math.inf] + [0.0] * 15, 2), (-1, [1.0] * 12, 2)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").repartition(5)
    coded, books = vector_codes.compress(clashing(df), parts=8, entries=12)
    want, want_books = brute_codes(rows, 8, 12, 6)
    assert books == want_books
    errors = {}
    for (_, _, label), (_, e) in zip(rows, want, strict=True):
        errors[label] = errors.get(label, 0) + e
    long = lambda v: v if v < 1 << 63 else None
    got = sorted(((r.vec_id, r.codes, r.error) for r in coded.collect()), key=str)
    expected = [(i, c, long(e)) for (i, _, _), (c, e) in zip(rows, want, strict=True)] + [(101, None, None), (-1, None, None)]
    assert got == sorted(expected, key=str)
    if wide < 1e6:
        assert {r.label: r.label_error for r in coded.where("vec_id >= 0 or vec_id is null").collect()} == errors
    assert {r.c for r in coded.where("error is not null").select(vector_codes.code_text("codes").alias("c")).collect()} == {"".join(f"{k:02x}" for k in c) for c, e in want if long(e) is not None}


def test_annuli_measure_less_than_everything_and_lose_nothing():
    rng = np.random.default_rng(3)
    book = [[int(v) for v in row] for row in rng.integers(-4000, 4000, (64, 6)) << rng.integers(0, 6, (64, 1))]
    search = vector_codes.Annuli(book + book[:3])  # equal entries: the lower index wins
    parts = np.concatenate([rng.integers(-4000, 4000, (500, 6)) << rng.integers(0, 6, (500, 1)), np.array(book[:20])])
    won, distance = search.nearest(parts)
    assert [(int(d), int(e)) for d, e in zip(distance, won, strict=True)] == [nearest([book + book[:3]], [x])[0] for x in parts.tolist()]
    assert search.measured < 0.5 * len(parts) * len(book)


def test_codes_of_no_rows(spark):
    coded, books = vector_codes.compress(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int"))
    assert (coded.collect(), books) == ([], [])


# piece coding


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_coding.VOCABULARY)


@pytest.fixture(scope="module")
def coder():
    return piece_coding.Coder(piece_coding.read_vocabulary())


ALPHABET = list("abcdetinorsl  \n\t▁éżó.,'()0123") + ["the", "ing", "  ", "        ", "中", "​", "🙂", "\0", "\N{REPLACEMENT CHARACTER}", "<s>", "<0x41>", "nnn"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join))
def test_pieces_are_the_librarys(coder, library, text):
    ids = library.encode(text, add_eos=True)
    assert coder.encode(text) == ids
    assert coder.decode(ids) == library.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999), st.sampled_from([28705, 2287, 198, 172, 229, 153, 132])), max_size=9))
def test_any_ids_are_decoded_as_the_library_does(coder, library, ids):
    assert coder.decode(ids) == library.decode(ids)


def test_backtracking_takes_pieces_back():
    """A vocabulary in which the longest piece is wrong, over several steps."""
    scores = {p: -float(k) for k, p in enumerate(["bc", "cd", "abc", "abcd", "de", "ab", "cde", "ea", "acb", "a", "b", "c", "d", "e"])}
    ids = {p: k + 259 for k, p in enumerate(scores)}
    fickle = frozenset(p for p in scores if piece_coding.merge(p, scores) != [p])
    vocabulary = piece_coding.Vocabulary(ids, scores, list(range(3, 259)), 0, 2, frozenset({1, 2}), fickle, 300)
    coder = piece_coding.Coder(vocabulary)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 14))) for _ in range(2000)] + ["abcde" * 400]
    assert fickle
    for text in texts:
        assert [coder.texts[k] for k in coder.backtrack(text)] == piece_coding.merge(text, scores), text


def test_coding_of_tables(spark, library):
    texts = [None, "", " ", "a\nb", "ž" * 5000, "word " * 30000, "the  end ▁", "the  end ▁"]
    df = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    coded = piece_coding.decode(piece_coding.encode(df, carry=["doc_id", "ids", "_text"]))
    assert coded.columns == ["doc_id", "_text", "ids", "decoded"]
    for row in coded.collect():
        want = library.encode(texts[row.doc_id] or "", add_eos=True)
        assert (row.ids, row.decoded) == (want, library.decode(want))
    assert piece_coding.encode(df.limit(0)).collect() == []
    assert piece_coding.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect() == [(1, None, "")]


def test_the_query_is_the_librarys_result(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_piece_coding(spark, sf).collect()}
    want = {}
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(row.text or "", add_eos=True)
        want[row.doc_id] = (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest())
    assert got == want


# Merkle manifest


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + arity]) for k in range(0, len(out[-1]), arity)])
    return out


def proof(tree, k, arity):
    out = []
    for level in tree[:-1]:
        run = range(k // arity * arity, min(k // arity * arity + arity, len(level)))
        out += [level[j] for j in run if j != k]
        k //= arity
    return out


def encoded(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


DOCS = [(k, ("src", None)[k % 3 == 0], ("en", "fr", None, "ż", "")[0 if k < 40 else k % 5], None if k % 4 == 1 else k, ("", None, "żółw\n", "x" * 50000)[k % 4]) for k in range(101)]
DOCS += [(7, "a", "en", 1, "other"), (7, "a", "en", 1, "other"), (None, "a", "en", 1, "no id"), (None, None, None, None, None), (500, "alone", "zz", 3, "alone")]


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_is_that_of_brute_force(spark, arity):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    df = spark.createDataFrame(DOCS, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    made = merkle.manifest(clashing(df), columns, tree="lang", order="doc_id", arity=arity, carry=["doc_id", "lang", "text", "_tree", "root"])
    rows = made.select("*", merkle.folded(F.col("leaf"), arity).alias("again"), merkle.folded(F.lit(H("forged")), arity).alias("forged")).collect()
    assert len(rows) == len(DOCS)
    trees = {}
    for d in DOCS:
        trees.setdefault(d[2], []).append((d[0] is not None, d[0] or 0, encoded(*d)))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: levels([leaf for *_, leaf in sorted(trees[t])], arity) for t in trees}
    top = levels([built[t][-1][0] for t in order], arity)
    places = {(r.lang, r.at) for r in rows}
    assert places == {(t, k) for t in trees for k in range(len(trees[t]))}
    for r in rows:
        tree = built[r.lang]
        assert (r.leaf, r.subroot, r.root) == (tree[0][r.at], tree[-1][0], top[-1][0])
        assert (bytes(r.path) + bytes(r.top_path)).hex() == "".join(proof(tree, r.at, arity) + proof(top, order.index(r.lang), arity))
        assert r.again == r.root and r.forged != r.root and r["_tree"] == "own _tree"


def test_frontiers_of_many_rounds(spark):
    """Batches of a few rows out of order and groups of four places: nothing is resolved at once."""
    n = [200, 1, 2, 77]
    rows = [(f"={t}", k, size, H(f"{t}/{k}")) for t, size in enumerate(n) for k in range(size)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "_tree string, _at long, _size long, _leaf string").repartition(9)
    for arity in (2, 3):
        got = merkle._combine(df, arity, first=2, wider=1, batch_rows=5).collect()
        assert len(got) == len(rows)
        for t, size in enumerate(n):
            tree = levels([H(f"{t}/{k}") for k in range(size)], arity)
            for r in got:
                if r["_tree"] == f"={t}":
                    assert (r["_subroot"], bytes(r["_path"]).hex()) == (tree[-1][0], "".join(proof(tree, r["_at"], arity)))


def test_manifest_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([(1, "en")], "doc_id long, lang string")
    row = merkle.manifest(df, ["doc_id", "lang"], "lang", "doc_id").first()
    assert row.leaf == row.subroot == row.root == encoded(1, "en") and bytes(row.path + row.top_path) == b""
    assert merkle.manifest(df.limit(0), ["doc_id", "lang"], "lang", "doc_id").collect() == []


def test_tampering_is_found_where_the_contract_says(spark):
    rows = queries.op13_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    for r in rows:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)
    assert len({r.root for r in rows}) == 1
