"""Near-duplicates, repeated strings, toxicity, main texts and token counts against brute force and on edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import components, html_extraction, near_dedup, suffix_dedup, token_counts, toxicity

CLASHES = ["_row", "_text", "_t", "_doc", "_key", "_k", "_d", "_x", "_rep", "_bucket", "_copy", "_blobs", "class_id", "spans", "held_out", "score", "half", "n_tokens", "host", "slot", "n_chars"]


def clashing(df):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES if c not in df.columns])


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 200), (200, 100), (300, 300), (400, 401), (402, 401)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == roots({x for e in edges for x in e}, edges)
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def similarity(a, b, df, n, strength=0.25):
    """Weighted Jaccard similarity of texts by whole shingles, without sketches."""

    def weights(t):
        w = t.split()
        wins = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        return {s: c * (1 + strength * min(1, np.log1p(n / df[s]) / np.log1p(256))) for s, c in wins.items()}

    x, y = weights(a), weights(b)
    low = sum(min(v, y[s]) for s, v in x.items() if s in y)
    return low / (sum(x.values()) + sum(y.values()) - low) if x or y else 0.0


def near_texts():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    out = []
    for _ in range(20):
        base = [word() for _ in range(rng.randrange(60, 200))]
        out.append(" ".join(base))
        for changes in (0, 1, 1, 2, 30):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    group = [word() for _ in range(120)]
    for k in range(150):  # a large group of near copies
        out.append(" ".join(group[:100] + [f"own{k}"] + group[100:]))
    return out


def test_near_duplicates_are_those_of_brute_force(spark):
    texts = near_texts()
    df, n = Counter(), len(texts)
    for t in texts:
        w = t.split()
        df.update({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    links = [(i, j) for i in range(n) for j in range(i + 1, n) if similarity(texts[i], texts[j], df, n) >= 0.8]
    want = roots(range(n), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_dedup.classes(docs).collect()}
    sizes = Counter(want.values())
    assert got == {i: (want[i], sizes[want[i]]) for i in range(n)}
    # blocks of a few texts must not lose a link
    cut = {r.doc_id: r.class_id for r in near_dedup.classes(docs, block_texts=20).collect()}
    assert cut == want


def test_near_duplicates_on_odd_rows(spark):
    text = " ".join(f"t{k}" for k in range(50))
    rows = [(5, text), (3, text), (3, text), (None, text), (7, None), (8, ""), (9, "few words"), (10, "few  words"), (None, "nobody has an id"), (None, "nobody has an id"), (11, " \n"), (12, " ".join(f"l{k}" for k in range(60_000)))]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter(tuple(r) for r in near_dedup.classes(docs).collect())
    want = [(5, 3, 4), (3, 3, 4), (3, 3, 4), (None, 3, 4), (7, 7, 2), (8, 7, 2), (9, 9, 2), (10, 9, 2), (None, None, 2), (None, None, 2), (11, 11, 1), (12, 12, 1)]
    assert got == Counter(want)
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([3, 7, 9, None, 11, 12])
    assert near_dedup.classes(docs.where("false")).collect() == []
    # rows without an id are classed by near texts too, and different texts under one id each by its own
    other = " ".join(f"u{k}" for k in range(50))
    odd = spark.createDataFrame([(1, text), (None, text + " z"), (4, other), (4, "quite another text")], "doc_id long, text string")
    assert Counter(tuple(r) for r in near_dedup.classes(odd).collect()) == Counter([(1, 1, 2), (None, 1, 2), (4, 4, 1), (4, 4, 1)])
    assert Counter(r.doc_id for r in near_dedup.deduplicate(odd).collect()) == Counter([1, 4, 4])


def brute_repeats(rows, match=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for k in range(len(b) - match + 1):
                s = b[k : k + match]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if d is not None:
            for k in range(len(b) - match + 1):
                if first[b[k : k + match]] < d:
                    gone[k : k + match] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("abcä é") for _ in range(n))
    passages = [piece(rng.randrange(48, 140)) for _ in range(12)] + ["ab" * 60, "x" * 130]
    rows = []
    for d in rng.sample(range(1000), 120):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            parts.append(piece(rng.randrange(0, 60)))
            p = rng.choice(passages)
            a = rng.randrange(0, 20)
            parts.append(p[a : len(p) - rng.randrange(0, 20)])
        rows.append((d, "".join(parts)))
    rows += [(2000, rows[0][1]), (2001, rows[0][1]), (2002, None), (2003, ""), (2004, "short"), (None, rows[1][1]), (2005, "q" * 49), (2006, "q" * 50), (2007, "q" * 51), (2008, "1234567890" * 3000), (2009, "z" + "1234567890" * 20)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated(docs).collect())
    assert got == brute_repeats(rows)
    left = {r.doc_id: hashlib.sha256(bytes(r.kept or b"")).hexdigest() for r in suffix_dedup.strip(docs.where("doc_id is not null")).collect()}
    assert left == {d: h for d, _, _, _, h in brute_repeats(rows) if d is not None}


def test_repeats_of_an_empty_table_and_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "k" * 80), (1, "k" * 80), (2, "k" * 80)], "doc_id long, text string")
    assert suffix_dedup.repeated(docs.where("false")).collect() == []
    assert Counter((r.doc_id, r.n_removed) for r in suffix_dedup.repeated(docs).collect()) == Counter([(1, 0), (1, 0), (2, 80)])


def test_windows_that_repeat_nowhere_are_not_sorted(monkeypatch):
    """A line of many documents between words of their own: only the line's own windows go into the sort, and each once."""
    line = "this very common line stands in the middle of all of the texts"
    texts = [f"{hashlib.sha256(b'a%d' % k).hexdigest()} {line} {hashlib.sha256(b'b%d' % k).hexdigest()}" for k in range(300)]
    raw = [x.encode() for x in texts]
    data, offsets = suffix_dedup.text_bytes(pa.array(texts))
    doc, *_, h = suffix_dedup.anchors(data, offsets, 50)
    told = [[(h[doc == k] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()] for k in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array(told, pa.list_(pa.binary())), pa.nulls(len(texts), pa.bool_())], ["_doc", "_text", "_blobs", "_copy"])
    sorted_ = []
    sort = suffix_dedup.SuffixOrder.sort
    monkeypatch.setattr(suffix_dedup.SuffixOrder, "sort", lambda self, at, sizes: sorted_.append(len(at)) or sort(self, at, sizes))
    marked = [(r["_doc"], p) for out in suffix_dedup._by_bucket(suffix_dedup._sort_runs(50))(suffix_dedup._cut_runs(50, 1)([batch])) for r in out.to_pylist() for p in np.frombuffer(r["_blob"], np.int64).reshape(-1, 2).tolist()]
    covered = {k: {i for d, (a, b) in marked if d == k for i in range(a, b)} for k in range(len(texts))}
    at = raw[0].index(line.encode()) - 1
    shared = set(range(at, at + len(line) + 2))
    assert not covered[0] and all(shared <= covered[k] and len(covered[k] - shared) < 8 for k in range(1, len(texts)))
    assert sum(sorted_) < 2 * len(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_of_ids_with_several_texts(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(20)) for _ in range(8)]
    rows = [(1, "a" * 30 + passages[0]), (2, "a" * 30 + passages[0]), (2, "".join(reversed(passages[1])) * 2), (-5, passages[2]), (None, passages[0])]
    for k in range(60):
        rows.append((rng.randrange(0, 25), " ".join([word(), rng.choice(passages), word(), *([rng.choice(passages)] if k % 3 else [])])))
    rows += [rows[7], rows[9]]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated(docs).collect())
    want = brute_repeats(rows)
    assert got == want
    left = Counter((r.doc_id, hashlib.sha256(bytes(r.kept or b"")).hexdigest()) for r in suffix_dedup.strip(docs).collect())
    expected = Counter()
    for (d, _, _, _, h), n in want.items():
        expected[d, h] += n
    assert left == expected


def auc(pairs):
    pairs = sorted(pairs)
    ranks = defaultdict(list)
    for k, (s, _) in enumerate(pairs):
        ranks[s].append(k + 1)
    total = sum(sum(ranks[s]) / len(ranks[s]) for s, y in pairs if y)
    n1 = sum(y for _, y in pairs)
    return (total - n1 * (n1 + 1) / 2) / (n1 * (len(pairs) - n1))


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.collect()}
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.score(docs, labels).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert auc([(r.score, known[r.doc_id]) for r in got if r.held_out]) > 0.95


def test_toxicity_learns_nothing_from_held_out_labels_and_other_columns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    want = {(r.doc_id, round(r.score, 9)) for r in toxicity.score(docs, labels).collect()}
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert {(r.doc_id, round(r.score, 9)) for r in toxicity.score(other, flipped).collect()} == want


def test_toxicity_on_odd_rows(spark):
    docs = clashing(spark.createDataFrame([(1, None), (2, ""), (3, "bad " * 50_000), (None, "no id"), (4, "x"), (4, "x")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 1), (4, 7)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 6
    assert toxicity.score(docs, labels.where("false")).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score(docs.where("false"), labels).collect() == []


PAGE = """<html><head><title>T</title><script>var t="<p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Title &amp; {k}</h1><p>First   para\n graph {k}</p><div class="ad">Buy</div><p>Second<br>line &lt;{k}&gt; caf&eacute;</p></article>
<aside>More</aside><form><input value="x">Send</form><div class="comments"><p>Nice one</p></div><footer>End</footer></body></html>"""


def test_main_text(spark):
    rows = [(k, f"http://h{k % 2}.org/{k}", PAGE.replace("{k}", str(k))) for k in range(20)]
    rows += [(100, None, None), (101, "http://h0.org/", ""), (102, "http://h0.org/x", "plain words only"), (103, None, "<p>Never closed <b>bold"), (103, None, "<p>Never closed <b>bold"), (104, "http://h1.org/y", "<article><p>" + "long " * 100_000 + "</p></article>")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = html_extraction.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = defaultdict(list)
    for r in got.collect():
        assert r.n_chars == len(r.text)
        found[r.page_id].append(r.text)
    for k in range(20):
        assert found[k] == [f"Title & {k}\nFirst para graph {k}\nSecond line <{k}> café"]
    assert found[100] == [""] and found[101] == [""] and found[102] == ["plain words only"]
    assert found[103] == ["Never closed bold"] * 2 and len(found[104][0]) == 5 * 100_000 - 1
    assert html_extraction.extract(pages.where("false")).collect() == []


def test_main_text_by_template_where_no_element_is_named(spark):
    page = '<body><div class="menu"><p>Go</p></div><div class="x"><div class="y"><p>Story {k} is told here at some length for the reader</p><p>and goes on for a while in part {k}</p></div></div><div class="z"><p>Imprint</p></div></body>'
    pages = spark.createDataFrame([(k, f"http://one.org/{k}", page.replace("{k}", str(k))) for k in range(12)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extraction.extract(pages).collect()} == {k: f"Story {k} is told here at some length for the reader\nand goes on for a while in part {k}" for k in range(12)}


def test_main_text_keeps_what_stands_beside_the_paragraphs(spark):
    body = "<h2>Part {k}</h2><p>Story {k} is told here at some length</p><p>with {k} more paragraphs than one, and long ones</p><ul><li>item {k}</li></ul><table><tr><td>cell {k}</td></tr></table><blockquote>said {k}</blockquote>"
    page = f'<body><div class="menu">Go</div><div class="content">{body}</div><div class="z">Imprint</div></body>'
    pages = spark.createDataFrame([(k, f"http://one.org/{k}", page.replace("{k}", str(k))) for k in range(12)], "page_id long, url string, html string")
    want = "Part {k}\nStory {k} is told here at some length\nwith {k} more paragraphs than one, and long ones\nitem {k}\ncell {k}\nsaid {k}"
    assert {r.page_id: r.text for r in html_extraction.extract(pages).collect()} == {k: want.replace("{k}", str(k)) for k in range(12)}


def test_lines_of_the_template_are_no_slots_and_classes_are_valid_only_in_order(spark):
    page = '<body><div class="w"><div class="c"><h1>Title {k}</h1><p>Story {k} is told</p><div class="tip"><b>Write</b> to us</div><p>and {k} goes on</p>{turn}</div></div></body>'
    a, b = '<div class="a">Alpha</div>', '<div class="b">Beta</div><div class="d">Delta</div>'
    rows = [(k, f"http://one.org/{k}", page.replace("{k}", str(k)).replace("{turn}", "")) for k in range(12)]
    rows += [(k, f"http://two.org/{k}", page.replace("{k}", str(k)).replace("{turn}", (a + b if k % 2 else b + a) if k % 3 else "")) for k in range(20, 50)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = lambda k: f"Title {k}\nStory {k} is told\nand {k} goes on"
    assert all(got[k] == text(k) for k in range(12))
    # those of two.org have a vector in common, but no order
    turn = lambda k: "" if k % 3 == 0 else "\nAlpha\nBeta\nDelta" if k % 2 else "\nBeta\nDelta\nAlpha"
    assert all(got[k] == text(k) + turn(k) for k in range(20, 50))


def test_disordered_classes():
    one = lambda s, **sizes: html_extraction.disordered([(t[0], int(t[1])) for t in s.split()], sizes)
    assert one("a0 b0 b1 b0 b1 a1 c0 c1 a2", a=3, b=2, c=2) == set()
    assert one("a0 a2 a1", a=3) == {"a"} and one("a0 a1", a=3) == {"a"} and one("a1 a0", a=2) == {"a"}
    assert one("a0 b0 a1 b1 a2", a=3, b=2) == {"b"} and one("b0 a0 b1 a1 a2", a=3, b=2) == {"b"}
    assert one("a0 a0 a1 a1", a=2) == {"a"}


@pytest.mark.parametrize(
    "page",
    [
        '<html><body class="has-sidebar"><article><p>The story</p></article><div class="sidebar-left">Links</div></body></html>',
        '<body class="sidebar"><article class="post social-science"><p>The story</p></article></body>',
        '<body><article class="related"><p>The story</p></article></body>',
        '<div id="page" class="with-nav"><article class="related-work"><p>The story</p></article></div>',
        '<div class="sidebar-right"><article><p>The story</p></article></div>',
        '<body><form id="aspnet"><div id="content"><p>The story</p></div></form></body>',
        '<body><div id="content"><p>The story</p></div><aside><article>A teaser</article></aside></body>',
        '<body><div id="content"><p>The story</p></div><div class="comments"><article>Nice</article></div></body>',
        '<body><article></article><p>The story</p></body>',
        '<html><head><title>T</title></head><body><nav>The story</nav></body></html>',
        '<header class="h"><div><p>The story</p></div></header>',
    ],
)
def test_names_mark_no_main_text_as_boilerplate(page):
    assert html_extraction.extract_text(page, None) == "The story"


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.read_ranks(token_counts.VOCABULARY))


def test_edits_give_the_counts_of_the_edited_text(counter):
    rng = random.Random(3)
    alphabet = ["a", "b", "don't", "'ll", " ", "  ", "\n", "\n\n", "\t", "7", "1234", "é", "日本", "!", "...", "$", " ", "😀", "'"]
    piece = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    for _ in range(150):
        tree = token_counts.PieceTree(piece(rng.choice([0, 1, 5, 80, 700])), counter)
        for _ in range(6):
            a = rng.randint(0, len(tree.text))
            b = min(len(tree.text), a + rng.choice([0, 0, 1, 3, 40, 500]))
            new = piece(rng.choice([0, 1, 4, 300]))
            want = tree.text[:a] + new + tree.text[b:]
            tree.edit(a, b, new)
            assert tree.text == want
            assert tree.tokens == len(counter.encoding.encode_ordinary(want)), (want, a, b, new)


def test_a_small_edit_recounts_little(counter):
    tree = token_counts.PieceTree("some words and more of them, " * 20_000, counter)
    before = tree.encoded
    tree.edit(250_000, 250_003, "other")
    assert tree.encoded - before < 40 and tree.tokens == len(counter.encoding.encode_ordinary(tree.text))


def test_token_counts(spark, counter):
    n = lambda t: len(counter.encoding.encode_ordinary(t))
    texts = [(1, "mail me at a.b@example.org or 10.0.0.1 now"), (2, None), (3, ""), (4, "plain words " * 30_000), (None, "no id"), (5, "same"), (5, "same")]
    docs = clashing(spark.createDataFrame(texts, "doc_id long, text string"))
    got = token_counts.count_edited(docs)
    want = Counter()
    for d, t in texts:
        new = "mail me at <mail> or <ip> now" if d == 1 else t or ""
        want[(d, n(t or ""), 2 if d == 1 else 0, n(new))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_edited) for r in got.collect()) == want
    assert token_counts.count_edited(docs.where("false")).collect() == []
    plain = spark.createDataFrame([(1, "abcdef"), (2, "abc"), (None, "xyz")], "doc_id long, text string")
    given = spark.createDataFrame([(1, 2, 4, "XY"), (1, 0, 1, ""), (1, 3, 5, "overlaps"), (1, 4, 99, "outside"), (1, None, 5, "x"), (1, 4, 5, None), (None, 0, 1, "q"), (7, 0, 1, "q")], "doc_id long, start int, end int, new string")
    found = {r.doc_id: (r.n_edits, r.n_tokens_edited) for r in token_counts.count_edited(plain, edits=given).collect()}
    assert found == {1: (2, n("bXYef")), 2: (0, n("abc")), None: (0, n("xyz"))}
    # a second round of edits against the kept trees encodes what they touch only
    long = "some words and more of them, " * 3000
    first = token_counts.edit(token_counts.grow(spark.createDataFrame([(1, long)], "doc_id long, text string")), spark.createDataFrame([(1, 50, 55, "X" * 300)], "doc_id long, start int, end int, new string"))
    second = token_counts.edit(first, spark.createDataFrame([(1, 40_000, 40_004, "é")], "doc_id long, start int, end int, new string")).first()
    text = long[:50] + "X" * 300 + long[55:]
    text = text[:40_000] + "é" + text[40_004:]
    assert (second.version, second.text, second.n_tokens) == (2, text, n(text)) and 0 < second.n_recounted < 40
    assert token_counts._unpacked(bytes(second.leaves)) == token_counts.PieceTree(text, counter).pieces()
