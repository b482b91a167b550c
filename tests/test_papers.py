"""Papers: tasks of pages with no, two and four figures."""

import pytest

from gradeloom.operators import papers

TEXT = """Zadanie 1. (0–1)
Na rysunku   pokazano trójkąt.
Zadanie 2. (0–2)
Diagram przedstawia wyniki.
Zadanie 3. (0–1)
Oblicz.
Zadanie 4. (0–3)
Wykresy funkcji."""


@pytest.fixture(scope="module")
def paper(spark):
    pages = spark.createDataFrame([("a", 0, 600.0, 800.0), ("b", 1, 600.0, 800.0)], "page string, number int, width double, height double")
    texts = spark.createDataFrame([("a", TEXT), ("b", "Zadanie 4. (0–3)\nciąg dalszy, rysunek obok\n" + "x" * 2000)], "page string, text string")
    headings = spark.createDataFrame([("a", "1", 100.0), ("a", "2", 250.0), ("a", "3", 450.0), ("a", "4", 500.0), ("b", "4", 50.0)], "page string, task string, y double")
    box = lambda page, x, y, w=60.0, h=60.0: (page, float(x), float(y), float(x + w), float(y + h))
    shapes = [box("a", 100, 120), box("a", 155, 130), box("a", 300, 120), box("a", 50, 240, 500, 2), *[box("a", 100 + 20 * k, 300, 13, 0.5) for k in range(15)]]
    shapes += [box("a", 60 + 130 * k, 600) for k in range(4)] + [box("b", 52, 300, 496, 100)]
    columns = spark.createDataFrame([("a", 50.0, 550.0), ("b", 50.0, 550.0)], "page string, left double, right double")
    return pages, texts, headings, spark.createDataFrame(shapes, "page string, x0 double, top double, x1 double, bottom double"), columns


def test_contents(paper):
    pages, texts, *_ = paper
    got = sorted((r.task, r.page_number, r.content) for r in papers.contents(papers.occurrences(pages, texts)).collect())
    assert got == [("1", 1, "Na rysunku pokazano trójkąt."), ("2", 1, "Diagram przedstawia wyniki."), ("3", 1, "Oblicz."), ("4", 1, "Wykresy funkcji.")]


def test_figures_of_tasks(paper):
    pages, texts, headings, shapes, columns = paper
    cut = papers.bands(headings, pages)
    assert sorted((r.page, r.task, r.band_top, r.band_bottom) for r in cut.collect()) == [("a", "1", 100.0, 250.0), ("a", "2", 250.0, 450.0), ("a", "3", 450.0, 500.0), ("a", "4", 500.0, 800.0), ("b", "4", 50.0, 800.0)]
    framed = papers.figures(shapes, cut, pages, columns)
    counts = {}
    for r in framed.collect():
        counts[r.page, r.task] = counts.get((r.page, r.task), 0) + 1
    assert counts == {("a", "1"): 2, ("a", "4"): 4}  # dots, rules and a region as wide as the column are none
    got = sorted(tuple(r) for r in papers.assets(papers.occurrences(pages, texts), framed, pages).collect())
    assert got == [
        ("1", 1, "drawing", 94.0, 114.0, 221.0, 196.0, False), ("1", 1, "drawing", 294.0, 114.0, 366.0, 186.0, False),  # two shapes that touch are one figure
        ("2", 1, "diagram", 0.0, 0.0, 600.0, 800.0, True), ("4", 1, "chart", 0.0, 0.0, 600.0, 800.0, True), ("4", 2, "drawing", 0.0, 0.0, 600.0, 800.0, True),
    ]


def test_empty_papers(spark, paper):
    pages, texts, headings, shapes, columns = paper
    none = papers.figures(shapes.limit(0), papers.bands(headings.limit(0), pages), pages, columns)
    assert none.collect() == [] and papers.assets(papers.occurrences(pages, texts.limit(0)), none, pages).collect() == []
