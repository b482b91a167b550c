"""Quality rules, decontamination, mixing, sharding and the url filter against brute force and on edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import decontamination, mixing, quality_rules, queries, sharding, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that the operators use inside or return; all of them may be columns of the input.
CLASHES = ["_row", "_text", "_id", "_hash", "_bad", "_host", "_source", "_size", "size", "kept", "n_words", "shard", "slot", "taken", "rate", "host", "path", "verdict", "_grams", "_doc"]


def clashing(df):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES if c not in df.columns])


TEXTS = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "a"),
    (2, "one two three four five six seven eight nine ten eleven twelve", "a"),
    (3, None, "a"),
    (4, "", None),
    (5, " \t\n\x0b\x0c\r ", None),
    (6, "a b c d e f a b c d e x y z q w r t u i", "b"),
    (7, "line one here\nline one here\n\n\nother line # $ % | < >\nline one here", "b"),
    (8, " ".join(f"word{k}" for k in range(30_000)), "c"),
    (9, "x" * 200_000, "c"),
    (10, "so so so so so so so so so so so so", "c"),
    (None, "no id but eleven words are in here so it may stay", "d"),
    (11, "zehn ärgerliche Wörter über Öl \xa0und mehr als elf davon hier ja", "d"),
    (11, "zehn ärgerliche Wörter über Öl \xa0und mehr als elf davon hier ja", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string, source string")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    wins = defaultdict(list)
    for k in range(len(words) - 4):
        wins[tuple(words[k : k + 5])].append(k)
    covered = {p for at in wins.values() if len(at) > 1 for k in at for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs):
    got = quality_rules.apply_rules(clashing(docs)).select("doc_id", *quality_rules.MEASURES, "base_failed", "kept").collect()
    want = Counter((d, *measures(t)) for d, t, _ in TEXTS)
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_verdicts_follow_hosts(spark):
    clean = " ".join(f"w{k}" for k in range(20))
    soft = clean + " " + "#" * 50
    rows = [(k, clean, "good") for k in range(400)] + [(1000, soft, "good")] + [(2000 + k, soft if k % 2 else clean, "mixed") for k in range(100)] + [(3000 + k, "too short", "bad") for k in range(99)] + [(3099, clean, "bad")]
    got = quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = {r.doc_id: (r.host_verdict, r.kept) for r in got.select("doc_id", "host_verdict", "kept").collect()}
    assert found[5] == ("ok", True) and found[1000] == ("ok", True)
    assert found[2000] == ("watch", True) and found[2001] == ("watch", False)
    assert found[3099] == ("blocked", False) and found[3000] == ("blocked", False)


def test_native_operators_on_empty_tables(spark, docs):
    none = docs.where("false")
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id int, text string")
    assert quality_rules.apply_rules(none).collect() == []
    assert mixing.mix(none).collect() == []
    assert sharding.shard(none).collect() == []
    assert decontamination.contaminated(none, items).collect() == []
    assert decontamination.contaminated(docs, items.where("false")).collect() == []
    assert decontamination.decontaminate(docs, items.where("false")).count() == len(TEXTS)


ITEM = "A train leaves Berlin at 120 km with 3 coaches and returns to Berlin after 3 hours of slow travel through hills"
OTHER = "a train leaves Paris at 240 km with 7 coaches and returns to Paris after 7 hours of slow travel through hills"


def test_decontamination(spark):
    odd = OTHER.replace("after 7", "after 9")
    rows = [
        (1, f"Well, {ITEM}. And more"), (2, f"So it is: {OTHER} and more"), (3, f"So it is: {odd} and more"), (4, f"So: {OTHER} . {odd}"), (5, None), (6, ""),
        (7, ITEM.upper()), (8, ITEM[:30]), (9, "filler " * 50_000 + OTHER), (10, "short item"), (11, "nothing of the kind is in this one at all"), (None, ITEM), (1, "the same id again"), (12, "7 8 9 10 11 12 13 14 15 16 17"),
    ]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, "  "), (4, "short item"), (5, "1 2 3 4 5 6 7 8 9")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert got >= {(1, 1), (2, 1), (4, 1), (9, 1), (None, 1), (10, 4)}
    assert {d for d, _ in got} <= {1, 2, 4, 7, 9, 10, None}
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns
    # rows are judged each for itself: a clean one stays though its id is that of another
    left = {(r.doc_id, r.text) for r in kept.collect()}
    assert {d for d, _ in left} >= {3, 5, 6, 8, 11, 12} and not {d for d, _ in left} & {2, 4, 9, 10, None}
    assert {t for d, t in left if d == 1} == {"the same id again"}


def test_decontamination_finds_copies_of_items_that_are_mostly_placeholders(spark):
    texts = ["Compute 12 + 35 * 7.", "What is 17 x 23?", "1 2 3 5 8 13 21 34 55 89 144", "Ask Anna, Bernd, Clara, Dora, Emil, Fritz, Gerda, Hans or Ida", "12 35 7"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id int, text string")
    rows = [(k, f"{before}{t}{after}") for k, t in enumerate(texts) for before, after in (("", ""), ("Well. ", " And more"), ("some words ", " and more"))]
    other = [(100, "Compute 13 + 36 * 8."), (101, "2 4 6 8 10 12 14 16 18 20 22"), (102, "Ask Karl, Lena, Maria, Nils, Otto, Paula, Quirin, Rosa or Sven"), (103, "13 36 8")]
    docs = spark.createDataFrame([(10 * d + k, t) for k, (d, t) in enumerate(rows)], "doc_id long, text string").unionByName(spark.createDataFrame([(1000 + d, t) for d, t in other], "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert got >= {(10 * d + k, d) for k, (d, _) in enumerate(rows)}
    assert not {d for d, _ in got if d >= 1000}


def test_decontamination_by_shuffle_is_the_same(spark):
    docs = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, "none of it")], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    wide = {tuple(r) for r in decontamination.contaminated(docs, items).collect()}
    assert wide == {tuple(r) for r in decontamination.contaminated(docs, items, most_broadcast=0).collect()} and len(wide) == 2


def wanted_targets(sizes, weights=(5, 2, 1)):
    """Targets by source: 150 % of all words by weight, each at most twice its own."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, out = 1.5 * sum(sizes.values()), {}
    while len(out) < len(sizes):
        unit = left / sum(weight[s] for s in sizes if s not in out)
        over = [s for s in sizes if s not in out and weight[s] * unit >= 2 * sizes[s]]
        if not over:
            return out | {s: weight[s] * unit for s in sizes if s not in out}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
    return out


def test_mixing(spark):
    rows = [(k, "w " * (1 + (k * 37) % 200), ("hot" if k % 3 else f"s{k % 7}") if k % 50 else None) for k in range(6000)] + [(9001, None, "s1"), (9002, "", "void"), (9003, " \n", None), (None, "a b c", "s2"), (5, "w w w", "s2"), (5, "w w w", "s2")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    run = lambda: mixing.mix(df, block_rows=500).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    got = run()
    assert Counter(map(tuple, got)) == Counter(map(tuple, run()))
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    wanted, taken = wanted_targets(dict(sizes)), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, wanted[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[r.source] += r.taken
    for s, t in wanted.items():
        assert abs(taken[s] - t) <= max(0.002 * t, 100), (s, taken[s], t)


def test_mixing_where_all_sources_are_capped_or_empty(spark):
    one = spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, source string")
    r = mixing.mix(one).first()
    assert r.target == 4.5 and r.taken in (3, 6)
    none = mixing.mix(one.withColumn("text", F.lit(None).cast("string"))).first()
    assert (none["size"], none.target, none.taken) == (0, 0.0, 0)


def test_sharding(spark, docs):
    many = docs.unionByName(spark.range(100, 4100).select(F.col("id").alias("doc_id"), F.concat(F.lit("text ü "), F.col("id") % 50).alias("text"), F.lit("s").alias("source")))
    got = sharding.shard(clashing(many), block_rows=100).select("doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert len(got) == len(TEXTS) + 4000
    slots, place = defaultdict(list), {}
    for r in got:
        raw = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
        assert place.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(len(s) - 500) < 100 for s in slots.values())
    assert 4000 / 9 * 0.7 < sum(r.grown_shard == 8 for r in got) < 4000 / 9 * 1.3


def drawn(key, tree):
    """The shard of a key, level by level, by draws computed here."""
    def best(options):
        draw = lambda name, w: -math.log((int(hashlib.md5(f"{key}/{name}".encode()).hexdigest()[:12], 16) + 1) / 2**48) / w
        return min(options, key=lambda o: (draw(o[0], o[1]), o[0]))[2]

    racks = best([(r, sum(sum(s.values()) for s in x.values()), x) for r, x in tree.items()])
    shards = best([(k, sum(s.values()), s) for k, s in racks.items()])
    return best([(f"shard{s}", w, s) for s, w in shards.items()])


def test_shards_are_those_of_drawing_by_hand(spark):
    df = spark.createDataFrame([(k, "t") for k in [None, *range(-20, 300)]], "doc_id long, text string")
    tree = sharding.even_tree()
    for r in sharding.shard(df).collect():
        key = "null" if r.doc_id is None else f"id/{r.doc_id}"
        assert (r.shard, r.grown_shard) == (drawn(key, tree), drawn(key, sharding.grow(tree)))


def test_shards_slots_and_checksums_are_those_of_the_sql(docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(f"SELECT doc_id, size, text_crc32, law, shard, slot, grown_shard FROM ({queries.OP5_SQL})").fetchall()
    got = queries.op5_sharding(docs.sparkSession, str(tmp_path)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_reweighting_moves_rows_only_within_the_subtree(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    tree = sharding.even_tree()
    region = next(iter(tree))
    rack = next(iter(tree[region]))
    shard = next(iter(tree[region][rack]))
    lighter = {r: {k: dict(s) for k, s in racks.items()} for r, racks in tree.items()}
    lighter[region][rack][shard] = 0.5
    moves = keys.select(sharding.place(F.col("k"), tree).alias("a"), sharding.place(F.col("k"), lighter).alias("b")).where("a <> b").groupBy("a", "b").count().collect()
    assert moves
    assert {m.a for m in moves} <= {s for shards in tree[region].values() for s in shards}  # rows only leave where the weight fell


URLS = [
    (1, "http://sub.example.com/en/7?x=1", "sub.example.com", "/en/7", "example.com/en/7", "allow"),
    (2, "HTTP://Example.COM/en/8", "example.com", "/en/8", "com/en/", "block"),
    (3, "https://a.net/de/8", "a.net", "/de/8", "net/de/", "allow"),
    (4, "https://example.net/de/8#t", "example.net", "/de/8", "example.net/de/8", "block"),
    (5, "https://myexample.net/de/8", "myexample.net", "/de/8", "net/de/", "allow"),
    (6, "x://y.org/es/://z", "y.org", "/es/://z", "org/es/", "block"),
    (7, "x://y.org?/es/", "y.org", "", None, None),
    (8, "no scheme/en/", "", "", None, None),
    (9, None, "", "", None, None),
    (10, "", "", "", None, None),
    (11, "http://" + "a" * 100_000 + ".com/en/" + "b" * 100_000, "a" * 100_000 + ".com", "/en/" + "b" * 100_000, "com/en/", "block"),
    (12, "http://example.com", "example.com", "", None, None),
    (12, "http://example.com", "example.com", "", None, None),
    (13, "a\n://net/de/", "net", "/de/", "net/de/", "allow"),
]


def test_url_filter(spark):
    df = clashing(spark.createDataFrame([r[:2] for r in URLS], "page_id long, url string"))
    got = url_filter.judge(df)
    assert len(set(got.columns)) == len(got.columns)
    found = Counter((r.page_id, r.host, r.path, r.rule) for r in got.collect())
    assert found == Counter((r[0], r[2], r[3], r[4]) for r in URLS)
    by_rule = {r[0]: r[5] for r in URLS if r[5]}
    for r in got.collect():
        assert r.verdict == by_rule.get(r.page_id, "block" if r.score >= 0.5 else "allow")
    assert url_filter.judge(df.where("false")).collect() == []


def test_url_model_tells_the_labelled_urls_apart(spark):
    df = spark.createDataFrame(url_filter.LABELLED, "url string, label int")
    assert all((r.score >= 0.5) == bool(r.label) for r in url_filter.judge(df).collect())
