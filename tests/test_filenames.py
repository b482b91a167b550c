"""Names of files and links of pages."""

from urllib.parse import quote, unquote, urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from gradeloom.sources import filenames

NAMES = [
    ("OMAP-100-2105-zasady-oceniania.pdf", "/x", ("marking_scheme", "suffix", "since-2023", "OMAP", "100", "2021-05")), ("OMAP-100-2405-zeszyt-zadan.PDF", "/x", ("paper", "suffix", "since-2023", "OMAP", "100", "2024-05")),
    ("zasady_oceniania_OMAP-800-1904.pdf", "/x", ("marking_scheme", "prefix", "prefix", "OMAP", "800", "2019-04")), ("MJA-P1_1P-172-A.pdf", "/a/Odpowiedzi/", ("marking_scheme", "directory", "code-variants-session", "MJA", "P1_1P,A", "2017-05")),
    ("MMA-R1-172a.pdf", None, ("paper", "default", "code-variants-session", "MMA", "R1", "2017-05")), ("EMAP-P0-100.pdf", "/2023/Nagrania/x", ("transcript", "directory", "no-session", "EMAP", "P0,100", "")), ("alone.pdf", "", ("paper", "default", "unknown", "alone", "", "")),
    ("X-2105-2205.pdf", "", ("paper", "default", "code-variants-session", "X", "2105", "2022-05")), ("A-karta.odpowiedzi.pdf", "", ("answer_sheet", "suffix", "since-2023", "A", "", "")), ("B_przykłady_nutowe.pdf", "", ("attachment", "suffix", "since-2023", "B", "", "")),
    (None, None, ("paper", "default", "unknown", "", "", "")),
]


def test_what_names_tell(spark):
    df = spark.createDataFrame([(k, n, f) for k, (n, f, _) in enumerate(NAMES)], "k int, n string, f string")
    got = {r.k: tuple(r.m) for r in df.select("k", filenames.parse(F.col("n"), F.col("f")).alias("m")).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(NAMES)}


PAGE = "https://www.board.example/egzamin/arkusze/2021.html?a=1"
LINKS = ["x.pdf", "../y/z.pdf", "/abs/ż ó.pdf", "//www.board.example/q.pdf", "http://other.org/a%20b/c+d.pdf?x=1#top", "./././k.pdf", "../../../../deep.pdf", "https://board.example/ok(1).pdf", " ?only=query.pdf", "a/./b/../c.pdf", "%C5%BC.pdf", "HTTP://BOARD.example/x.pdf"]


def by_library(href, page):
    parts = urlsplit(urljoin(page, href.strip()))
    host = "board.example" if parts.netloc == "www.board.example" else parts.netloc
    return f"https://{host}{quote(unquote(parts.path), safe=chr(47) + '%:@!$&' + chr(39) + '()*+,;=~')}" + (f"?{parts.query}" if parts.query else "")


@pytest.mark.parametrize("page", [PAGE, "http://one.org", "http://one.org/a/b/"])
def test_links_resolve_as_the_library_does(spark, page):
    df = spark.createDataFrame(list(enumerate(LINKS)), "k int, h string")
    got = {r.k: r.u for r in df.select("k", filenames.resolve(F.col("h"), F.lit(page), ("board.example",)).alias("u")).collect()}
    assert got == {k: by_library(h, page) for k, h in enumerate(LINKS)}


def test_harvest_takes_either_quote_and_any_place(spark):
    html = """<a class="x" href='a.pdf'>A</a><A HREF = "b/c.PDF" id=1><a href="page.html"></a><link data-href="d.pdf">"""
    got = filenames.harvest(spark.createDataFrame([(1, PAGE, html)], "p int, u string, h string"), "p", "u", "h", ("board.example",)).orderBy("place").collect()
    assert [(r.href, r.url) for r in got] == [("a.pdf", "https://board.example/egzamin/arkusze/a.pdf"), ("b/c.PDF", "https://board.example/egzamin/arkusze/b/c.PDF"), ("d.pdf", "https://board.example/egzamin/arkusze/d.pdf")]


def test_a_name_is_read_once(spark):
    plan = spark.range(1).select(filenames.parse(F.col("id").cast("string"), F.lit("/x")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("cast(id") == 1
