"""Text of pages: fractions, lines and columns against a layout by brute force and on given expressions."""

import random

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import pagetext
from gradeloom.operators.pagetext import Glyph, Rule, expression

CHARACTER = "page int, n long, c string, x0 double, x1 double, y0 double, y1 double, size double"
BAR = "page int, x0 double, x1 double, y double"


def run(text, x, y, size=11.0, wide=6.0):
    """Glyphs of a text from a place on, y being the middle."""
    return [Glyph(c, x + k * wide, x + (k + 1) * wide, y, size) for k, c in enumerate(text)]


def test_fractions_fold_from_the_outside_in():
    half = run("1", 20, 93) + run("2", 20, 107)
    assert expression(run("3", 10, 100) + half + run("+x", 30, 100), [Rule(19, 27, 100)]) == "3 1/2+x"  # a mixed number
    assert expression(run("=", 10, 100) + half, [Rule(19, 27, 100)]) == "=1/2"
    # (1/2 + 3) / 4: the bar within the other's width is folded inside its storey
    nested = run("1", 20, 86) + run("2", 20, 95) + run("+3", 28, 91) + run("4", 28, 107)
    assert expression(nested, [Rule(19, 41, 100), Rule(19, 27, 90.5)]) == "1/2+3/4"
    deep = run("1", 20, 80, 6) + run("2", 20, 86, 6) + run("3", 20, 93, 6) + run("4", 20, 106, 6)
    assert expression(deep, [Rule(19, 27, 83), Rule(18.9, 27.1, 89), Rule(18.8, 27.2, 99)]).count("/") >= 1
    assert expression(run("Uwagi", 10, 95) + run("1", 20, 105), [Rule(9, 41, 100)]) == "Uw1agi"  # a word above: the bar underlines
    assert expression(run("12", 10, 95), [Rule(9, 23, 100)]) == "12"  # nothing below
    assert expression([], [Rule(0, 5, 1)]) == ""


def test_powers_indices_and_signs():
    assert expression(run("x", 10, 100) + run("−10", 16, 96, 7), []) == "x-10"  # mostly small: the small size is the base
    assert expression(run("kx2", 10, 100) + run("−10", 28, 96, 7) + run("aaaa", 50, 100), []) == "kx2^(-10)aaaa"
    assert expression(run("P", 10, 100) + run("AE", 16, 104, 7) + run("=15", 30, 100) + run("2", 50, 95, 7), []) == "P_(AE)=15^2"
    assert expression([Glyph("\U0001d465", 1, 2, 5, 11), Glyph("–", 3, 4, 5, 11)], []) == "x-"


def brute_page(glyphs, bars):
    """A page's text, step by step over lists: glyphs in order, bars from the top."""
    even = lambda v: round(v / 3)
    seen = [g for g in glyphs if g.c.strip()]
    if not glyphs:
        return ""
    counts = {}
    for g in seen:
        counts[round(g.size, 1)] = counts.get(round(g.size, 1), 0) + 1
    base = max(counts, key=lambda s: (counts[s], s)) if counts else 11.0
    rows = sorted({even(g.y) * 3.0 for g in seen if round(g.size, 1) >= base - 0.1})
    near = lambda y, most: next((r for r in sorted(rows, key=lambda r: (abs(r - y), r)) if abs(r - y) <= most), y)
    at = {}
    for bar in sorted(bars, key=lambda b: (b.y, b.x0, b.x1)):
        found = pagetext._storeys(glyphs, bar)
        for part in found or ():
            for g in part:
                at[id(g)] = near(bar.y, 3.0)
    for g in seen:
        if id(g) not in at and g.size < base * 0.82:
            at[id(g)] = near(g.y, base)
    lines = {}
    for g in glyphs:
        lines.setdefault(even(at.get(id(g), g.y)), []).append(g)
    out = []
    for row in sorted(lines):
        parts = []
        for g in sorted(lines[row], key=lambda g: g.x0):
            if parts and g.x0 - parts[-1][-1].x1 <= 25:
                parts[-1].append(g)
            else:
                parts.append([g])
        whole = [p for p in parts if any(g.c.strip() for g in p)] or [sorted(lines[row], key=lambda g: g.x0)]
        for part in whole:
            beside = [b for b in bars if abs(b.y - row * 3) <= 3 and part[0].x0 - 25 <= b.x0 and b.x1 <= part[-1].x1 + 25]
            out.append(expression(part, beside))
    return "\n".join(out)


def tables(spark, pages):
    chars = [(p, n, g.c, float(g.x0), float(g.x1), g.y - g.size / 2, g.y + g.size / 2, float(g.size)) for p, (glyphs, _) in pages.items() for n, g in enumerate(glyphs)]
    bars = [(p, float(b.x0), float(b.x1), float(b.y)) for p, (_, rules) in pages.items() for b in rules]
    random.Random(4).shuffle(chars)
    return spark.createDataFrame(chars, CHARACTER).repartition(4), spark.createDataFrame(bars, BAR)


def pages():
    rng = random.Random(8)
    out = {}
    for p in range(25):
        glyphs, bars = [], []
        for line in range(rng.randrange(1, 9)):
            y, x = 100 + line * rng.choice([12, 14, 20]) + rng.choice([0, 0.5]), 50.0
            for _ in range(rng.randrange(1, 9)):
                kind = rng.random()
                if kind < 0.5:
                    glyphs += run(rng.choice(["a", "x=", "12", "Zad", "–", " "]), x, y)
                elif kind < 0.75:
                    glyphs += run(rng.choice(["1", "37", "abc"]), x, y - 6, 9) + run(rng.choice(["2", "x", " "]), x, y + 6, 9)
                    bars.append(Rule(x - 0.5, x + 18, y))
                elif kind < 0.9:
                    glyphs += run(rng.choice(["2", "n"]), x, y + rng.choice([-5, 5]), 7)
                else:
                    x += 40
                x += 20
        out[p] = (glyphs, bars)
    out[90] = (run("   ", 50, 100) + run(" ", 200, 100), [])
    out[91] = (run("left", 50, 100) + run(" ", 120, 100) + run("right", 200, 101), [Rule(10, 20, 100)])
    return out


def test_page_texts_are_those_of_brute_force(spark):
    made = pages()
    characters, bars = tables(spark, made)
    got = {r.page: r.text for r in pagetext.page_texts(characters.withColumn("row", F.lit("own")).drop("row"), bars).collect()}
    assert got == {p: brute_page(*made[p]) for p in made}
    assert got[90] == "    " and got[91] == "left\nright"
    assert sum("/" in t for t in got.values()) > 10 and sum("^" in t for t in got.values()) > 5
    assert pagetext.page_texts(characters.limit(0), bars).collect() == []
    alone = pagetext.page_texts(characters, bars.limit(0))
    assert {r.page: r.text for r in alone.collect()} == {p: brute_page(made[p][0], []) for p in made}


def test_bands_fold_nested_fractions(spark):
    glyphs = run("1", 20, 86) + run("2", 20, 95) + run("+3", 28, 91) + run("4", 28, 107) + run("dalej", 20, 140)
    characters, bars = tables(spark, {1: (glyphs, [Rule(19, 41, 100), Rule(19, 27, 90.5)])})
    bands = spark.createDataFrame([(1, 80.0, 120.0), (1, 130.0, 150.0), (2, 0.0, 9.0)], "page int, top double, bottom double")
    assert sorted((r.top, r.text) for r in pagetext.band_texts(characters, bars, bands).collect()) == [(80.0, "1/2+3/4"), (130.0, "dalej")]


@pytest.mark.parametrize("sizes, base, middle", [([11, 11, 9], 11, 11), ([9, 9, 11, 11], 11, 11), ([7, 8, 9, 10], 10, 9)])
def test_sizes(spark, sizes, base, middle):
    df = spark.createDataFrame([(1, k, "a", 0.0, 1.0, 0.0, 1.0, float(s)) for k, s in enumerate(sizes)], CHARACTER)
    assert [tuple(r) for r in pagetext.sizes(df).collect()] == [(1, base, middle)]


def test_lines_are_numbered_once_for_all_their_characters(spark):
    from gradeloom.plans import layout

    d = "/root/testdata/sf0.001"
    got = layout._characters(spark, d)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 1
    said = spark.sql(layout._CHARACTERS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{d}/lineitem.parquet"))
    assert got.columns == said.columns
    assert got.exceptAll(said).count() == 0 and got.count() == said.count()


def crowded_pages(seed):
    """Pages whose bars stand within each other, share characters or are equal, with blanks, empty texts and close sizes."""
    rng = random.Random(seed)
    out = {}
    for p in range(60):
        glyphs, bars = [], []
        for _ in range(rng.randrange(1, 40)):
            x, y, size = 50 + 4 * rng.randrange(30), 100 + 3.5 * rng.randrange(12), rng.choice([11, 11, 11, 10.75, 7.25, 7, 9])
            glyphs.append(Glyph(rng.choice(["1", "x", "ab", "−", " ", "", "\U0001d465", "^", "_", "²", "abc"]), x, x + rng.choice([4, 6, 18]), y, size))
        for _ in range(rng.randrange(0, 8)):
            x, y = 49 + 4 * rng.randrange(30), 100 + 3.5 * rng.randrange(12)
            wide = rng.choice([8, 8, 20, 60])
            bars.append(Rule(x, x + wide, y))
            glyphs += run(rng.choice(["1", "3n", "x2"]), x + 1, y - 6, 9, 4) + run(rng.choice(["2", "y"]), x + 1, y + 6, 9, 4)
            if rng.random() < 0.4:
                bars.append(Rule(x + rng.choice([0, 1, 3]), x + 6, y + rng.choice([-2, 0, 2])))
        out[p] = (glyphs, sorted(set(bars), key=lambda b: (b.x0, b.x1, b.y)))
    return out


def test_pages_that_come_in_small_batches_are_whole(spark):
    made = crowded_pages(3)
    characters, bars = tables(spark, made)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = []
    try:
        for most in ("3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            texts.append({r.page: r.text for r in pagetext.page_texts(characters, bars).collect()})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert texts[0] == texts[1] == {p: brute_page(*made[p]) for p in made}
    assert sum("/" in t for t in texts[0].values()) > 10 and sum("/" in t.partition("/")[2] for t in texts[0].values()) > 3


def test_characters_without_text_or_place(spark):
    rows = [(1, 0, "a", 10.0, 16.0, 95.0, 106.0, 11.0), (1, 1, None, 16.0, 22.0, 95.0, 106.0, 11.0), (1, 2, "b", 22.0, 28.0, 95.0, 106.0, 11.0), (1, 3, "c", 22.0, 28.0, None, 106.0, 11.0), (None, 4, "d", 1.0, 2.0, 3.0, 4.0, 5.0)]
    characters = spark.createDataFrame(rows, CHARACTER)
    bars = spark.createDataFrame([(1, None, 2.0, 3.0), (5, 1.0, 2.0, 3.0)], BAR)
    assert [(r.page, r.text) for r in pagetext.page_texts(characters, bars).collect()] == [(1, "c\nab")]
    assert sorted((r.n, r.row) for r in pagetext.lines(characters, bars).collect()) == [(0, 34), (1, 34), (2, 34), (3, None)]


@pytest.mark.parametrize("name", ["page_texts", "page_lines", "page_fractions"])
def test_pages_are_gathered_once(spark, name):
    from gradeloom.plans import registry

    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
