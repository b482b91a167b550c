import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.functions import text as fx
from gradeloom.operators import adhoc, coverage, filters, gate, geometry, health, measures, navigate, parsing, search, sections, snapshot
from gradeloom.sources import inventory


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("number", "expected"), [("16", True), ("18", True), ("21", True), ("18.2", True), ("15", False), ("22", False), ("x", False)])
def test_rule_range(spark, number, expected):
    assert one(spark, navigate.in_range(F.lit(number), F.lit("16"), F.lit("21"))) is expected
    assert one(spark, navigate.in_range(F.lit(number), F.lit(None).cast("string"), F.lit("end"))) is True


def test_median_and_empty(spark):
    df = spark.createDataFrame([(float(v),) for v in (40, 55, 60, 65, 80, 36000)], "s double")
    r = measures.durations(df, [], "s", 3600).first()
    assert (r.n, r.median_s, r.total_s, r.n_long) == (6, 62.5, 36300.0, 1)
    assert tuple(measures.durations(df.where("s < 0"), [], "s", 1).first()) == (0, 0.0, 0.0, 0)


def test_seconds_between(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 1, 0, 1, 30, 500000))], "a timestamp, b timestamp")
    assert df.select(measures.seconds_between(F.col("a"), F.col("b"))).first()[0] == 90.5


def test_shares(spark):
    assert one(spark, gate.share(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, measures.hit_share(F.lit(6), F.lit(2))) == 0.75


def test_filter_operators(spark):
    df = spark.createDataFrame([(1, 2, "a1"), (2, 4, None), (3, 10, "b%")], "id int, points int, name string")
    ids = lambda *f: [r.id for r in filters.apply(df, list(f)).orderBy("id").collect()]
    F_ = filters.Filter
    assert ids(F_("points", "gt", "2")) == [2, 3]
    assert ids(F_("points", "gte", "2")) == [1, 2, 3]
    assert ids(F_("points", "lt", "9")) == [1, 2]
    assert ids(F_("name", "contains", "A_")) == [1]
    assert ids(F_("name", "ne", "a1")) == [3]
    assert ids(F_("name", "null")) == [2]
    assert ids(F_("name", "notnull"), F_("points", "eq", "10")) == [3]
    with pytest.raises(filters.FilterError):
        filters.apply(df, [F_("points", "gt", "many")])
    with pytest.raises(filters.FilterError):
        filters.apply(df, [F_("nothing", "eq", "1")])


def test_filter_syntax():
    asked = filters.parse([("a__gt", "1"), ("b", "x"), ("op.b", "contains"), ("c", "1"), ("a__odd", "1"), ("b__null", ""), ("a", ""), ("_page", "3"), ("_per", "25"), ("_sort", "zz")], ["a", "b"])
    assert asked.filters == [filters.Filter("a", "gt", "1"), filters.Filter("b", "contains", "x"), filters.Filter("b", "null")]
    assert asked.rejected == ["c", "a__odd", "_sort"] and (asked.page, asked.per) == (3, 25)
    assert filters.parse([("op.a", "null"), ("op.b", "gt"), ("op.z", "null")], ["a", "b"]).filters == [filters.Filter("a", "null")]


def test_listing(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(60)], "id int, v int")
    shown, total, rejected = filters.listing(df, filters.parse([("v__gte", "1"), ("id__gt", "x"), ("_per", "25"), ("_page", "2")], df.columns), ["id"])
    assert total.first().total == 40 and [r.id for r in shown.collect()][0] == 38 and rejected == ["id__gt"]


def test_page_has_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7), (4, 5)], "id int, v int")
    assert [r.id for r in filters.page(df, "v", False, ["id"]).collect()] == [2, 4, 3, 1]
    assert [r.id for r in filters.page(df, "v", True, ["id"], 2, 2).collect()] == [4, 1]


def test_dictionary_columns_and_suggestions(spark):
    df = spark.range(40).select(F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("k"), F.col("id").cast("string").alias("u"))
    assert {r.column: r.is_dictionary for r in filters.dictionary_columns(df, ["k", "u"]).collect()} == {"k": True, "u": False}
    assert filters.suggestions(df, ["k", "u"]) == {"k": ["x", "y"]}


def test_lifecycle(spark):
    log = [(1, 1, "approve"), (2, 1, "correct"), (2, 2, "reopen"), (2, 3, "approve"), (3, 1, "reject"), (4, 1, "reopen"), (5, 1, "note"), (6, 1, "approve"), (6, 2, "note")]
    found = gate.fold_status(spark.createDataFrame(log, "t int, at int, action string"), "t", "action", ["at"])
    assert {r.t: r.status for r in found.collect()} == {1: "approved", 2: "corrected", 3: "rejected", 4: "pending", 5: "pending", 6: "approved"}


def test_document_and_description_state(spark):
    tasks = spark.createDataFrame([(1, "P"), (1, "F"), (2, "O"), (2, "R"), (3, "R")], "d int, s string")
    assert dict(rows(gate.document_status(tasks, "d", "s"))) == {1: "parsed", 2: "approved", 3: "rejected"}
    state = lambda p, c, a, e: one(spark, gate.description_state(F.lit(p), F.lit(c), F.lit(a), F.lit(e)))
    assert [state("auto", False, True, False), state("auto", True, True, False), state("none", True, False, False), state("manual", True, True, True)] == ["approved", "corrected", "manual", "none"]


def test_zero_filled_and_gaps(spark):
    df = spark.createDataFrame([("P", 1, 1), ("P", 1, 4), ("F", 2, 1)], "s string, k int, n int")
    assert dict(rows(coverage.zero_filled(df, "s", ("P", "R")))) == {"P": 2, "R": 0}
    assert rows(coverage.missing_numbers(df, ["k"], "n")) == [(1, "2,3")]
    assert dict(rows(coverage.free_points(df, ["k"], "n", 4))) == {1: 3, 2: 4}


def test_norm_or_gap(spark):
    df = spark.createDataFrame([(1, True, False), (2, True, True), (2, True, False), (3, False, True)], "g int, closed boolean, has boolean")
    assert dict(rows(coverage.norm_or_gap(df, "g", F.col("closed"), F.col("has")))) == {1: True, 2: False, 3: None}


def test_constraints(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 61), (2, "a", None)], "k int, v string, p int")
    assert rows(health.duplicates(df, ["k", "v"])) == [(1, None, 2)]
    assert [r.p for r in health.broken(df, F.col("p").between(0, 60)).collect()] == [61]
    parents = spark.createDataFrame([(1,)], "id int")
    assert [r.k for r in health.orphans(df, "k", parents, "id").collect()] == [2]
    counted = health.counts({"a": lambda: df, "b": lambda: df.where("k > 9")}, only_failing=True)
    assert rows(counted) == [("a", 3)]


def test_tree_keeps_childless_parents(spark):
    parents, children = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "of int, pos int, v string")
    tree = {r.id: [c.v for c in r.kids] for r in navigate.nested(parents, "id", children, "of", ["pos"], ["v"], "kids").collect()}
    assert tree == {1: ["a", "b"], 2: []}
    assert "CartesianProduct" not in navigate.nested(parents, "id", children, "of", ["pos"], ["v"], "kids")._jdf.queryExecution().toString()


def test_preceding_heading(spark):
    heads = spark.createDataFrame([(1, 10.0, "h1"), (1, 50.0, "h2")], "page int, y double, h string")
    found = navigate.preceding(heads, spark.createDataFrame([(1, 5.0), (1, 10.0), (1, 60.0)], "page int, y double"), "page", "y", "h")
    assert {r.y: r.h for r in found.collect()} == {5.0: None, 10.0: "h1", 60.0: "h2"}


def test_text_functions(spark):
    assert one(spark, fx.collapse(F.lit("  a \t\n b  "))) == "a b"
    assert one(spark, fx.fold(F.lit("Zażółć"))) == "zazolc"
    assert len(fx.FOLD_FROM) == len(fx.FOLD_TO)
    assert one(spark, fx.search_terms(F.lit("The Trójkąty of x"))) == ["trojkaty", "troj", "trojka"]
    assert one(spark, fx.session_date(F.lit("2105"))) == "2021-05" and one(spark, fx.session_date(F.lit("192"))) == "2019-05" and one(spark, fx.session_date(F.lit("991"))) == ""
    assert one(spark, fx.clip(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, fx.reason_label(F.lit("prose (a word)"))) == "prose"


def test_collation(spark):
    words = spark.createDataFrame([("mama",), ("łąka",), ("lampa",)], "w string")
    assert [r.w for r in words.orderBy(F.expr("w COLLATE pl")).collect()] == ["lampa", "łąka", "mama"]


def test_snapshot_difference(spark):
    a, b = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "k int, n int"), spark.createDataFrame([(2, 2), (3, 4), (4, 1)], "k int, n int")
    assert sorted(rows(snapshot.difference(a, b, ["k"], ["n"]))) == [(1, "-", 1, None), (3, "~", 3, 4), (4, "+", None, 1)]


def test_sections(spark):
    md = "before\n# One\ntext\n```\n# no heading\n```\n## Two\nmore"
    found = sections.of_markdown(spark.createDataFrame([(1, md)], "id int, t string"), "id", "t").orderBy("section").collect()
    assert [(r.level, r.title) for r in found] == [(0, ""), (1, "One"), (2, "Two")] and "# no heading" in found[1].body
    html = "<nav>menu</nav><p>start</p><h1>A &amp; B</h1><script>x()</script><p>body</p><h2>C</h2>end"
    got = sections.of_html(spark.createDataFrame([(1, html)], "id int, h string"), "id", "h").orderBy("section").collect()
    assert [(r.level, r.title, r.body) for r in got] == [(0, "", "start"), (1, "A & B", "body"), (2, "C", "end")]
    html = "<!-- <h1>no</h1> --><nav><h2>Menu</h2></nav><h3 id=x>&#379;&#x41;<b>b</b></h3><div>one<br/>two &lt;p&gt; &eacute;&nbsp; x &odd; a&b</div>"
    got = sections.of_html(spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, h string"), "id", "h").collect()
    assert [(r.id, r.section, r.level, r.title, r.body) for r in got] == [(1, 1, 3, "ŻAb", "one\ntwo <p> é x &odd; a&b")]


def by_pairs(boxes, gap):
    """Joins any two boxes within the gap until there are none."""
    boxes = [tuple(b) for b in boxes]
    while True:
        pair = next(((a, b) for i, a in enumerate(boxes) for b in boxes[i + 1 :] if a[0] - gap <= b[2] and b[0] - gap <= a[2] and a[1] - gap <= b[3] and b[1] - gap <= a[3]), None)
        if pair is None:
            return sorted(boxes)
        for x in pair:
            boxes.remove(x)
        boxes.append((*map(min, pair[0][:2], pair[1][:2]), *map(max, pair[0][2:], pair[1][2:])))


@pytest.mark.parametrize("seed", range(8))
def test_regions_are_those_of_pairwise_joins(seed):
    rng = np.random.default_rng(seed)
    corner = rng.integers(0, 300, (60, 2))
    boxes = np.hstack([corner, corner + rng.integers(1, 30, (60, 2))]).astype(float)
    assert sorted(map(tuple, geometry.regions(boxes, 4).tolist())) == by_pairs(boxes.tolist(), 4)


@pytest.mark.parametrize("few, at_once", [(64, 20_000), (64, 90), (20, 30), (0, 5)])
def test_many_pages_are_joined_at_once_as_each_for_itself(few, at_once, monkeypatch):
    rng = np.random.default_rng(few)
    page = np.sort(rng.integers(0, 40, 900) ** 2 // 40)
    corner = rng.integers(0, 250, (len(page), 2))
    boxes = np.hstack([corner, corner + rng.integers(1, 30, (len(page), 2))]).astype(float)
    boxes[::97, rng.integers(0, 4)] = np.nan
    want = [(k, *b) for k in np.unique(page).tolist() for b in sorted(map(tuple, geometry.regions(boxes[page == k], 4).tolist()), key=lambda b: [(np.isnan(x), x) for x in b])]
    if few:
        monkeypatch.setattr(geometry, "regions", lambda b, gap, whole=geometry.regions: whole(b, gap) if len(b) > few else pytest.fail("a call for each small page"))
    at, found = geometry._regions_of_all(page, boxes, 4, few=few, at_once=at_once)
    np.testing.assert_array_equal(np.column_stack([at, found]), np.array(want))


def test_region_clusters(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 60.0, 60.0), (1, 64.0, 0.0, 100.0, 60.0), (1, 300.0, 300.0, 310.0, 310.0)], "page int, x0 double, top double, x1 double, bottom double")
    assert rows(geometry.clusters(df, "page")) == [(1, 0, -6.0, -6.0, 106.0, 66.0, False)]
    assert rows(geometry.clusters(df, "page", most=2)) == [(1, 0, -6.0, -6.0, 106.0, 66.0, True)]
    assert rows(geometry.clusters(df.where("false"), "page")) == []
    row = spark.range(200).select(F.lit(1).alias("page"), (F.col("id") * 30.0).alias("x0"), F.lit(0.0).alias("top"), (F.col("id") * 30.0 + 25).alias("x1"), F.lit(40.0).alias("bottom"))
    assert rows(geometry.clusters(row, "page", most=199)) == [(1, 0, -6.0, -6.0, 200 * 30.0 - 5 + 6, 46.0, True)]


def test_bands_bars_and_footnotes(spark):
    shapes = spark.createDataFrame([("in", 0.0, 10.0, 50.0, 20.0), ("half", 0.0, 95.0, 50.0, 105.0), ("out", 0.0, 96.0, 50.0, 106.0), ("dash", 0.0, 10.0, 2.0, 12.0), ("rule", 0.0, 10.0, 500.0, 12.0)], "k string, x0 double, top double, x1 double, bottom double")
    assert {r.k for r in geometry.candidates(shapes, F.lit(0.0), F.lit(100.0), F.lit(400.0)).collect()} == {"in", "half"}
    heads = spark.createDataFrame([(1, 10.0), (1, 50.0), (2, 5.0)], "page int, y double")
    assert {(r.page, r.y): r.band_bottom for r in geometry.bands(heads, "page", "y", F.lit(800.0)).collect()} == {(1, 10.0): 50.0, (1, 50.0): 800.0, (2, 5.0): 800.0}
    rules = spark.createDataFrame([(1, 10.0, 5.0, 40.0, 6.0), (1, 10.0, 55.0, 40.0, 56.0), (1, 10.0, 5.0, 140.0, 6.0), (1, 10.0, 5.0, 40.0, 9.0)], "page int, x0 double, top double, x1 double, bottom double")
    tables = spark.createDataFrame([(1, 0.0, 50.0, 100.0, 90.0)], "page int, x0 double, top double, x1 double, bottom double")
    assert [(r.x1, r.top) for r in geometry.fraction_bars(rules, tables, "page").collect()] == [(40.0, 5.0)]
    lines = spark.createDataFrame([(1, 1.0, 11.0), (1, 2.0, 8.0), (1, 3.0, 11.0), (1, 4.0, 10.0), (1, 5.0, 9.0), (2, 1.0, 11.0), (2, 2.0, 11.0), (2, 3.0, 10.5)], "page int, y double, size double")
    assert {(r.page, r.y) for r in geometry.footnotes(lines, "page", "y", "size").where("in_footnote").collect()} == {(1, 4.0), (1, 5.0)}


def test_search_prefers_headings(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "alpha"), (2, "alpha alpha", "beta"), (3, "gamma", "gamma")], "id int, body string, head string")
    found = search.scores(search.index(docs, "id", "body", "head"), "id", 3, ["alpha"]).orderBy(F.desc("score")).collect()
    assert [r.id for r in found] == [1, 2]


def test_inventory(spark, tmp_path):
    header = "\t".join(["segment", "rocznik", "rocznik_w_sciezce", "podkatalog", "plik", "kod", "warianty", "sesja", "typ", "zrodlo_typu", "wzorzec", "url", "sciezka"])
    (tmp_path / "i.tsv").write_text(header + "\ne8\t2021\t\t\tf.pdf\tOMAP\tA,B\t2105\tkey\tprefix\t\thttp://x/f.pdf\te8\\2021\\f.pdf\n")
    found = inventory.select(inventory.read_tsv(spark, str(tmp_path / "i.tsv")), kinds=["key"], variants=["A"], years=[2021])
    assert [r.local_path for r in found.collect()] == ["e8/2021/f.pdf"]
    assert one(spark, inventory.local_path(F.lit("https://h/a/files/2021/x/f.pdf"), "files")) == "2021/x/f.pdf"
    assert one(spark, inventory.local_path(F.lit("https://h/a/b/c/f.pdf"), "files")) == "b/c/f.pdf"
    assert one(spark, inventory.normal_url(F.lit("http://www.h.org/p?q=1#f"))) == "https://h.org/p?q=1"


@pytest.mark.parametrize("sql", [
    "SELECT * FROM parquet.`/tmp/x`", "SELECT reflect('java.lang.System', 'currentTimeMillis')", "DROP TABLE t", "CREATE VIEW v AS SELECT 1", "INSERT INTO t VALUES (1)", "SELECT 1; SELECT 2", "SET a=b",
    "SELECT (SELECT max(java_method('java.lang.Math', 'abs', 1)) FROM t)", "WITH c AS (SELECT java_method('java.lang.Math', 'abs', 1)) SELECT * FROM c", "SELECT TRANSFORM(k) USING 'cat' AS (k) FROM t",
    "EXPLAIN SELECT 1", "SELECT * FROM unknown", "SELECT 1) UNION ALL (SELECT 2",
])
def test_adhoc_refuses(spark, sql):
    with pytest.raises(adhoc.Refused):
        adhoc.guarded(spark, sql, {"t": spark.range(3).toDF("k")})


@pytest.mark.parametrize("sql", ["SELECT * FROM secret_view", "SELECT k FROM t WHERE k IN (SELECT k FROM secret_view)", "WITH secret_view AS (SELECT * FROM secret_view) SELECT * FROM secret_view", "SELECT * FROM global_temp.secret_global", "SELECT * FROM secret_table"])
def test_adhoc_reads_no_other_relation(spark, sql):
    spark.range(2).toDF("k").createOrReplaceTempView("secret_view")
    spark.range(2).toDF("k").createOrReplaceGlobalTempView("secret_global")
    try:
        with pytest.raises(adhoc.Refused):
            adhoc.guarded(spark, sql, {"t": spark.range(3).toDF("k")})
    finally:
        spark.catalog.dropTempView("secret_view")
        spark.catalog.dropGlobalTempView("secret_global")


def test_adhoc_stops_slow_statements(spark):
    with pytest.raises(adhoc.Refused):
        adhoc.ask(spark, "SELECT count(*) FROM t WHERE sqrt(id) < 0", {"t": spark.range(10**13)}, most_seconds=1)


def test_adhoc_answers(spark):
    t = {"t": spark.range(300).withColumn("v", F.lit("x" * 500))}
    got = adhoc.ask(spark, "WITH a AS (SELECT id, v FROM t WHERE id IN (SELECT id FROM t WHERE id > 1)) SELECT id, v FROM a ORDER BY id", t)
    assert got["columns"] == ["id", "v"] and got["row_count"] == 200 and got["truncated"] and len(got["rows"][0][1]) == 401
    assert adhoc.ask(spark, "SELECT count(*) AS n FROM t", t)["rows"] == [["300"]]


def test_signs_and_vocabulary(spark):
    assert one(spark, fx.plain_signs(F.lit("𝑥 − 𝟓 – 𝐀𝔷"))) == "x - 5 - Az"
    assert one(spark, fx.merged_scripts(F.lit("k^-^1^0 P_A_E x^2"))) == "k^(-10) P_(AE) x^2"
    assert one(spark, fx.from_vocabulary(F.lit("a"), {"a": "1"})) == "1"
    with pytest.raises(Exception, match="unknown word"):
        one(spark, fx.from_vocabulary(F.lit("b"), {"a": "1"}))
    assert one(spark, fx.same_text(F.lit(" A  b"), F.lit("a B "))) is True
    assert one(spark, fx.migration_hash(F.lit("a\r\nb"))) == one(spark, fx.migration_hash(F.lit("a\nb")))


@pytest.mark.parametrize(("text", "latex", "reason"), [("1/2/3", None, None), ("2^(10) ≤ a/b", "2^{10} \\le \\frac{a}{b}", None), ("60 min/40 min", "60 min/40 min", None), ("obliczenie 240 ∶ 60", "240 \\div 60", None), ("gdzie a", None, "empty"), ("+", None, "nothing to count"), ("50%.", "50\\%", None)])
def test_expressions(spark, text, latex, reason):
    got = one(spark, fx.expression(F.lit(text)))
    assert got.reason == reason
    if latex:
        assert got.latex == latex


def test_percent_is_rounded_as_the_double_that_it_is(spark):
    """Against Python's own formatting, which rounds a double's exact value, half to even."""
    rows = [(k, n) for n in (0, 1, 3, 7, 8, 16, 40, 400, 800, 2000, 4000) for k in range(0, n + 1)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", fx.percent(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in got] == [f"{100 * r.a / r.b if r.b else 0.0:.1f}%" for r in got]


def test_titles_with_some_names_of_characters_decoded(spark):
    pages = spark.createDataFrame([(1, "<h1>a &quot;b&quot; &lt;c&gt; &amp;lt; &#65;</h1>x")], "k long, html string")
    title = lambda *names: sections.of_html(pages, "k", "html", *names).where("section = 1").first().title
    assert title() == 'a "b" <c> &lt; A'
    assert title(("lt", "gt", "amp")) == "a &quot;b&quot; <c> &lt; &#65;"
