"""Main texts: the slot that the classes give decides, and keeps all its lines."""

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import html_extraction

MENU = '<nav><a href="/">Home</a><a href="/all">All</a></nav>'


def story(k, wrap):
    body = f"<h2>Introduction</h2><p>Story {k} opens with words of number {k}.</p><p>Its second part ends at {k * 7}.</p><p>By the staff of the paper</p>"
    return f"<html><body>{MENU}<div class=\"top\">Weather: fine</div>{wrap.format(body)}<div class=\"end\">All rights reserved</div></body></html>", f"Introduction\nStory {k} opens with words of number {k}.\nIts second part ends at {k * 7}.\nBy the staff of the paper"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", '<div class="content">{}</div>', '<main><div class="content">{}</div></main>'])
def test_lines_that_all_articles_have_stay(spark, wrap):
    pages = [(k, f"http://paper.example/{k}", *story(k, wrap)) for k in range(12)]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extraction.extract(df).collect()}
    assert got == {p[0]: p[3] for p in pages}


def test_the_classes_decide_over_a_small_article(spark):
    """Each page shows a teaser as its only article; the text stands in an element without a name."""
    pages, want = [], {}
    for k in range(12):
        text = "\n".join(f"Paragraph {j} of story {k} tells about number {k * 10 + j} at some length." for j in range(5))
        body = "".join(f"<p>{line}</p>" for line in text.split("\n"))
        pages.append((k, f"http://mag.example/{k}", f'<html><body>{MENU}<article class="teaser"><p>Win {k}!</p></article><div class="x1"><div class="x2">{body}</div></div><div class="end">All rights reserved</div></body></html>'))
        want[k] = text
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extraction.extract(df).collect()} == want
    assert all(html_extraction.extract_text(p[2], None) == f"Win {p[0]}!" for p in pages)  # without a template the teaser would win


def test_a_page_without_its_hosts_slot_gives_its_article_else_the_rest(spark):
    pages = [(k, f"http://paper.example/{k}", story(k, '<div class="content">{}</div>')[0]) for k in range(12)]
    pages += [(100, "http://paper.example/100", f"<html><body>{MENU}<div class=\"top\">Weather: fine</div><article><p>Only here</p></article><p>beside</p></body></html>"), (101, "http://paper.example/101", f'<html><body>{MENU}<div class="top">Weather: fine</div><p>Neither slot nor article</p></body></html>')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extraction.extract(df).where(F.col("page_id") >= 100).collect()}
    assert got == {100: "Only here", 101: "Neither slot nor article"}
