"""Pages made of line items, each a line of characters with a fraction and a power: fractions, lines, texts, tables, figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pagetext, requirements
from ..session import spread
from ..session import table as t
from .registry import query

_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS i FROM lineitem"


def _glyph(k: int, c: str, x0: float, y: str, size: float, where: str = "true", wide: float = 6.0) -> str:
    return f"SELECT l_orderkey AS page, cast(i * 20 + {k} AS bigint) AS n, {c} AS c, cast({x0} AS double) AS x0, cast({x0 + wide} AS double) AS x1, cast({y} AS double) AS y0, cast({y} + {size} AS double) AS y1, cast({size} AS double) AS size FROM numbered WHERE {where}"


def _struct(k: int, c: str, x0: float, y: str, size: float, where: str = "true", wide: float = 6.0) -> str:
    return f"case when {where} then named_struct('n', cast(i * 20 + {k} AS bigint), 'c', {c}, 'x0', cast({x0} AS double), 'x1', cast({x0 + wide} AS double), 'y0', cast({y} AS double), 'y1', cast({y} + {size} AS double), 'size', cast({size} AS double)) end"


#: Characters as SQL that Spark and other engines read alike: place in the line, character, x, y, size, for which lines, width.
_GLYPHS = [
    (0, "l_returnflag", 50, "100 + 14 * i", 11), (1, "'−'", 58, "100 + 14 * i", 11), (2, "cast(l_suppkey % 10 AS string)", 66, "100 + 14 * i", 11),
    # a fraction whose lower storey is a word in one line of five: its bar underlines
    (3, "cast(l_partkey % 10 AS string)", 74, "96 + 14 * i", 9), (4, "case when l_partkey % 5 = 0 then 'abc' else cast(l_partkey % 7 AS string) end", 74, "107 + 14 * i", 9),
    (5, "'2'", 82, "99 + 14 * i", 7, "l_suppkey % 2 = 0", 4), (6, "'n'", 82, "106 + 14 * i", 7, "l_suppkey % 2 = 1", 4), (7, "' '", 90, "100 + 14 * i", 11),
    (8, "l_linestatus", 150, "100.5 + 14 * i", 11, "l_partkey % 3 > 0"), (9, "' '", 400, "100 + 14 * i", 11, "l_partkey % 4 = 0"),
]
_CHARACTERS = f"WITH numbered AS ({_NUMBERED}) " + " UNION ALL ".join(_glyph(*g) for g in _GLYPHS)
#: The bar of a line, and which lines have one.
_BAR = ({"x0": "cast(73.5 AS double)", "x1": "cast(80.5 AS double)", "y": "cast(105.5 + 14 * i AS double)"}, "l_partkey % 11 > 0")
_BARS = f"SELECT l_orderkey AS page, {', '.join(f'{x} AS {name}' for name, x in _BAR[0].items())} FROM ({_NUMBERED}) numbered WHERE {_BAR[1]}"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Lines as parts of their pages, with the characters of _CHARACTERS and the bars of _BARS: lines are dealt out and numbered once."""
    lines = spark.sql(_NUMBERED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spread(t(spark, d, "lineitem"), "l_orderkey"))
    every = F.array(*[F.expr(_struct(*g)) for g in _GLYPHS])
    bar = F.expr(f"case when {_BAR[1]} then array(named_struct({', '.join(f'{chr(39)}{name}{chr(39)}, {x}' for name, x in _BAR[0].items())})) end")
    return lines.select(F.col("l_orderkey").alias("page"), F.filter(every, lambda x: x.isNotNull()).alias("glyphs"), bar.alias("bars"))


def _characters(spark: SparkSession, d: str) -> DataFrame:
    """The rows of _CHARACTERS; lines are numbered once, not for each character of a line, and stay dealt out by page."""
    return _parts(spark, d).select("page", F.inline_outer("glyphs"))


_SIZES = f"""characters AS MATERIALIZED ({_CHARACTERS.replace("AS string", "AS varchar")}), bars AS ({_BARS}),
 seen AS (SELECT page, round_even(size, 1) AS s, count(*) AS n FROM characters WHERE trim(c) <> '' GROUP BY 1, 2),
 sizes AS (SELECT page, max(middle) AS middle, max(base) AS base FROM (SELECT page, list_sort(list(size))[len(list(size)) // 2 + 1] AS middle, NULL AS base FROM characters GROUP BY page UNION ALL SELECT page, NULL, arg_max(s, n * 1000 + s) FROM seen GROUP BY page) GROUP BY page)"""
_FRACTIONS = f"""{_SIZES}, near AS (SELECT b.*, c.n, c.c, (c.y0 + c.y1) / 2 < b.y AS up, c.x0 >= b.x0 - 2.2 AND c.x1 <= b.x1 + 2.2 AS inside FROM characters c JOIN bars b USING (page) JOIN sizes USING (page)
  WHERE (c.x0 + c.x1) / 2 BETWEEN b.x0 - 1.2 AND b.x1 + 1.2 AND abs((c.y0 + c.y1) / 2 - b.y) < 1.45 * middle AND (c.y0 + c.y1) / 2 <> b.y),
 storeys AS (SELECT page, x0, x1, y, up, list_sort(list(n)) AS ns, bool_and(inside OR trim(c) = '') AND count(*) FILTER (trim(c) <> '') > 0 AND NOT (regexp_matches(string_agg(c, '' ORDER BY n) FILTER (trim(c) <> ''), '^\\pL+$') AND length(string_agg(trim(c), '')) > 2) AS fits FROM near GROUP BY ALL),
 fractions AS (SELECT a.page, a.x0, a.x1, a.y, a.ns AS above, b.ns AS below FROM storeys a JOIN storeys b ON a.page = b.page AND a.x0 = b.x0 AND a.x1 = b.x1 AND a.y = b.y AND a.up AND NOT b.up WHERE a.fits AND b.fits)"""
_LINES = rf"""{_FRACTIONS}, base_rows AS (SELECT DISTINCT page, round_even((y0 + y1) / 2 / 3, 0) * 3 AS r FROM characters JOIN sizes USING (page) WHERE trim(c) <> '' AND round_even(size, 1) >= base - 0.1),
 held AS (SELECT page, n, arg_max(y, bar) AS y FROM (SELECT f.page, f.y AS bar, unnest(list_concat(above, below)) AS n, coalesce((SELECT arg_min(r, abs(r - f.y) * 100000 + r) FROM base_rows b WHERE b.page = f.page AND abs(r - f.y) <= 3), f.y) AS y FROM fractions f) GROUP BY 1, 2),
 levels AS (SELECT c.*, h.y AS held_y, base, (c.y0 + c.y1) / 2 AS cy FROM characters c JOIN sizes USING (page) LEFT JOIN held h USING (page, n)),
 placed AS (SELECT *, round_even(CASE WHEN held_y IS NOT NULL THEN held_y WHEN trim(c) <> '' AND size < base * 0.82 THEN coalesce((SELECT arg_min(r, abs(r - cy) * 100000 + r) FROM base_rows b WHERE b.page = l.page AND abs(r - cy) <= base), cy) ELSE cy END / 3, 0)::BIGINT AS row FROM levels l),
 gaps AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page, row ORDER BY x0, n) > 25 THEN 1 ELSE 0 END AS gap FROM placed),
 cut AS (SELECT *, sum(gap) OVER (PARTITION BY page, row ORDER BY x0, n) AS segment FROM gaps),
 lines AS (SELECT *, bool_or(trim(c) <> '') OVER (PARTITION BY page, row, segment) AS s, bool_or(trim(c) <> '') OVER (PARTITION BY page, row) AS w FROM cut)"""


@query(f"WITH {_FRACTIONS} SELECT page, x0, y, above[1] AS first_above, below[1] AS first_below, len(above) + len(below) AS n FROM fractions")
def page_fractions(spark: SparkSession, d: str) -> DataFrame:
    found = pagetext.fractions_of(_parts(spark, d))
    return found.select("page", "x0", "y", F.get("above", F.lit(0)).alias("first_above"), F.get("below", F.lit(0)).alias("first_below"), (F.size("above") + F.size("below")).alias("n"))


@query(f"WITH {_LINES} SELECT page, row, (CASE WHEN w THEN segment ELSE 0 END)::BIGINT AS segment, string_agg(c, '' ORDER BY x0, n) AS glyphs FROM lines WHERE s OR NOT w GROUP BY ALL")
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return pagetext.line_glyphs_of(_parts(spark, d))


@query()
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole pages with fractions, powers and indices; SQL can't fold them."""
    return pagetext.page_texts_of(_parts(spark, d))


@query("""WITH marks AS (SELECT o_custkey AS k, month(o_orderdate)::INT AS page, (o_orderkey % 100)::DOUBLE AS y, o_orderkey FROM orders), tasks AS (SELECT o_custkey AS k, floor(count(*) / 2)::INT AS n FROM orders GROUP BY 1),
 heads AS (SELECT k, page, y, row_number() OVER (PARTITION BY k ORDER BY page, y) - 1 AS task FROM marks WHERE o_orderkey % 5 > 1),
 told AS (SELECT t.k, n, count(h.k) < n AS by_order FROM tasks t LEFT JOIN heads h ON h.k = t.k GROUP BY t.k, n),
 tabled AS (SELECT m.*, row_number() OVER (PARTITION BY k ORDER BY page, y, o_orderkey) - 1 AS i FROM marks m WHERE o_orderkey % 5 < 2),
 near AS (SELECT t.k, t.o_orderkey, t.page, t.y, t.i, max(h.task) AS task FROM tabled t JOIN told USING (k) JOIN heads h ON h.k = t.k AND h.task < n AND (h.page < t.page OR (h.page = t.page AND h.y <= t.y + 6)) WHERE NOT by_order GROUP BY ALL),
 firsts AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY k, task ORDER BY page, y, i) = 1)
 SELECT k, task, o_orderkey AS table_id, false AS by_order FROM firsts UNION ALL SELECT k, i, o_orderkey, true FROM tabled JOIN told USING (k) WHERE by_order AND i < n""")
def tables_of_tasks(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders")
    marks = orders.select(F.col("o_custkey").alias("k"), F.month("o_orderdate").alias("page"), (F.col("o_orderkey") % 100).cast("double").alias("y"), "o_orderkey")
    tasks = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.floor(F.count(F.lit(1)) / 2).cast("int").alias("n"))
    tables = marks.where("o_orderkey % 5 < 2").withColumnRenamed("o_orderkey", "table")
    placed = requirements.tables_of_tasks(marks.where("o_orderkey % 5 > 1"), tables, tasks, "k")
    return placed.select("k", F.col("task").cast("long").alias("task"), F.col("table").alias("table_id"), "by_order")


_ACT_TEXT = """case o_orderkey % 6 when 0 then 'Wymagania egzaminacyjne 2021 i 2022' when 1 then 'Podstawa programowa^(1) 2012' when 2 then 'Podstawa programowa 2' when 3 then 'Wymagania określone w podstawie programowej'
 when 4 then 'Wymagania egzaminacyjne 2023^1' else 'bez podpisu' end || chr(10) || 'Zadanie' || chr(10) || case o_custkey % 3 when 0 then 'Podstawa programowa 2017' when 1 then 'Podstawa programowa' else 'Wymagania egzaminacyjne   2021' end || chr(10) || o_orderpriority"""
_ACT_NOTES = """case when o_custkey % 5 = 0 then null else '1 Rozporządzenie Ministra ' || o_orderpriority || ' z 2012 r. (Dz.U. z 2012 r. poz. ' || case o_custkey % 4 when 0 then '977' when 1 then '356' when 2 then '1019' else '12' end || ', ze zm.) ^2 Załącznik nr '
 || cast(o_orderkey % 9 as string) || ' do innego rozporządzenia' || chr(10) || '2 krótki' end"""
_ACTS = " UNION ALL ".join(f"SELECT k, exam, act, {n} AS o, unnest(regexp_extract_all(t, '{p}', 0)) AS caption, unnest(regexp_extract_all(t, '(?:{p}){requirements.REFERENCE}', {1 + p.count(requirements.YEAR)})) AS number, generate_subscripts(regexp_extract_all(t, '{p}', 0), 1) AS i, {'NULL' if name is None else repr(name)} AS name FROM keys" for n, p, name in requirements.CAPTIONS)


@query(rf"""WITH keys AS (SELECT k, t, f, 'e8' AS exam, CASE {" ".join(f"WHEN regexp_matches(coalesce(f, '') || chr(10) || t, '{p}') THEN '{act}'" for _, p, act in requirements.GAZETTE)} ELSE '{requirements.GENERAL}' END AS act FROM (SELECT o_orderkey AS k, {_ACT_TEXT} AS t, {_ACT_NOTES.replace("as string", "as varchar")} AS f FROM orders)),
 captions AS ({_ACTS}), years AS (SELECT *, regexp_extract(caption, '{requirements.CAPTIONS[0][1]}', 1) AS y1, nullif(regexp_extract(caption, '{requirements.CAPTIONS[0][1]}', 2), '') AS y2 FROM captions),
 coded AS (SELECT k, o, i, caption, nullif(number, '') AS number, exam || '-' || CASE WHEN name IS NULL THEN 'wym' || y1 || coalesce('-' || y2, '') WHEN name = '{requirements.GENERAL}' THEN act ELSE name END AS code FROM years),
 firsts AS (SELECT * FROM coded QUALIFY row_number() OVER (PARTITION BY k, code ORDER BY o, i) = 1),
 marked AS (SELECT k, regexp_replace(coalesce(f, '') || chr(10) || t, '{requirements.NOTE_BORDER}', chr(1) || '\1', 'g') || chr(1) AS m FROM keys),
 notes AS (SELECT k, unnest(regexp_extract_all(m, '{requirements.NOTE}', 1)) AS number, unnest(regexp_extract_all(m, '{requirements.NOTE}', 2)) AS note, generate_subscripts(regexp_extract_all(m, '{requirements.NOTE}', 2), 1) AS i FROM marked),
 lasts AS (SELECT k, number, trim(regexp_replace(replace(note, chr(1), ''), '\s+', ' ', 'g')) AS note FROM notes QUALIFY row_number() OVER (PARTITION BY k, number ORDER BY i DESC) = 1)
 SELECT c.k, code, trim(regexp_replace(caption, '\s+', ' ', 'g')) AS caption, coalesce(nullif(regexp_extract(note, '{requirements.PLACE}', 0), ''), substr(note, 1, 200)) AS source, row_number() OVER (PARTITION BY c.k ORDER BY o, c.i) - 1 AS place FROM firsts c LEFT JOIN lasts n ON n.k = c.k AND n.number = c.number""")
def key_regimes(spark: SparkSession, d: str) -> DataFrame:
    keys = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr(_ACT_TEXT).alias("t"), F.expr(_ACT_NOTES).alias("f"))
    return requirements.regimes(keys, "k", "t", "f", F.lit("e8"))


#: Rows of a table of four columns as SQL that Spark and other engines read alike: row, the cells, for which orders.
_CELLS = [
    (0, "case when o_orderkey % 2 = 0 then 'Podstawa programowa 2012' else '' end", "''", "case when o_orderkey % 4 = 0 then 'Podstawa programowa 2017' else '' end", "''"),
    (1, "'Wymaganie ogólne'", "'Wymagania szczegółowe'", "'Wymagania ogólne'", "'Wymaganie szczegółowe'", "o_orderkey % 3 > 0"),
    (2, "case o_orderkey % 4 when 0 then 'I. Sprawność' when 1 then 'IV. Rozumowanie' else 'bez numeru' end", "case o_custkey % 4 when 0 then 'KLASY IV–VI' when 1 then 'Klasy VII i VIII' when 2 then 'IV — VI' else 'KLASY VII - VIII' end", "'II. Wykorzystanie'", "'1. Liczby. Uczeń: 7) dzieli ' || o_orderpriority"),
    (3, "'rachunkowa'", "'2. Działania. Uczeń: 3) dodaje  liczby 12) mnoży ' || o_orderpriority", "null", "'KLASY IV–VI IX. Ułamki. Zdający: 1) skraca ułamki 2) mnoży je'"),
    (4, "'Zadanie 7'", "'XI. Nic. Uczeń: 1) to nie treść'", "''", "''"),
]


def _table_row(row: int, c0: str, c1: str, c2: str, c3: str, where: str = "") -> str:
    if row:
        return f"SELECT o_orderkey, cast(o_custkey % 3 AS int), {row}, {c0}, {c1}, {c2}, {c3} FROM orders" + (f" WHERE {where}" if where else "")
    return f"SELECT o_orderkey AS k, cast(o_custkey % 3 AS int) AS tab, cast(0 AS int) AS row, {c0} AS c0, {c1} AS c1, {c2} AS c2, {c3} AS c3 FROM orders"


_ROWS = "\n UNION ALL ".join(_table_row(*c) for c in _CELLS)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """The rows of _ROWS; orders are dealt out by key before they become rows, so that a table's rows stay together."""
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").repartition("o_orderkey")
    every = F.array(*[F.expr(f"case when {(*c, 'true')[5]} then named_struct('row', {c[0]}, 'cells', array({', '.join(c[1:5])})) end") for c in _CELLS])
    return orders.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 3).cast("int").alias("table"), F.lit(False).alias("explicit"), F.inline(F.filter(every, lambda x: x.isNotNull())))


@query(rf"""WITH cells AS MATERIALIZED (SELECT k, tab, row, [c0, c1, c2, c3] AS c FROM ({_ROWS})), headed AS (SELECT k, tab, bool_or(regexp_matches(trim(c[1]), '{requirements.IN_GENERAL}')) AS two FROM cells GROUP BY ALL),
 pairs AS (SELECT k, tab, unnest(CASE WHEN two THEN [0, 1] ELSE [0] END) AS pair, unnest(CASE WHEN two THEN [1, 3] ELSE [1] END) AS a, unnest(CASE WHEN two THEN [2, 4] ELSE [4] END) AS b FROM headed),
 over_ AS (SELECT k, tab, pair, row, trim(array_to_string(list_transform(c[a:b], lambda x: coalesce(trim(x), '')), ' ')) AS x FROM cells JOIN pairs USING (k, tab)),
 named AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(x, '{p}') THEN " + ("'wym' || regexp_extract(x, '" + p + "', 1)" if name is None else repr(name)) for _, p, name in requirements.CAPTIONS)} END AS n FROM over_ WHERE x <> '' AND NOT contains(x, '{requirements.HEADER}')),
 captioned AS (SELECT k, tab, pair, arg_min(n, row) AS n FROM named WHERE n IS NOT NULL GROUP BY ALL), codes AS (SELECT ['e8-wym2021', 'e8-pp2012'] AS l),
 kept AS (SELECT * FROM cells WHERE len(list_filter(c, lambda x: contains(x, '{requirements.HEADER}') OR regexp_matches(trim(x), '{requirements.NO_CONTENT}'))) = 0 AND len(list_filter(c, lambda x: trim(coalesce(x, '')) <> '')) > 0),
 texts AS (SELECT k, tab, pair, coalesce(CASE WHEN n <> '{requirements.GENERAL}' THEN coalesce(list_filter(l, lambda x: ends_with(x, n))[1], n) END, l[pair + 1], l[1]) AS regime, string_agg(trim(coalesce(c[a], '')), ' ' ORDER BY row) AS lt, string_agg(trim(coalesce(c[b], '')), ' ' || chr(10) ORDER BY row) AS rt
  FROM kept JOIN pairs USING (k, tab) LEFT JOIN captioned USING (k, tab, pair), codes GROUP BY k, tab, pair, n, l),
 general AS (SELECT k, tab, 'general' AS kind, regime, NULL AS stage, regexp_extract(lt, '{requirements.GENERAL_PATH}', 1) AS path, trim(regexp_extract(trim(regexp_replace(lt, '\s+', ' ', 'g')), '{requirements.GENERAL_PATH}', 2)) AS content, pair, 0 AS p, 0 AS i FROM texts WHERE regexp_matches(lt, '{requirements.GENERAL_PATH}')),
 pieces AS (SELECT k, tab, pair, regime, unnest(string_split_regex(rt, '{requirements.STAGE}')) AS x, unnest([NULL] || regexp_extract_all(rt, '{requirements.STAGE}', 1)) AS s, generate_subscripts(string_split_regex(rt, '{requirements.STAGE}'), 1) AS p FROM texts),
 shown AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^(?:KLASY|Klasy)\s+', ''), '\s+[iI]\s+', '-'), '\s', '', 'g'), '[–—−]', '-', 'g') AS stage, regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '{requirements.ITEMS["section"][0]}', chr(1) || '\1', 'g') || chr(1) AS m FROM pieces),
 items AS (SELECT k, tab, pair, regime, stage, p, unnest(regexp_extract_all(m, '{requirements.ITEMS["section"][1]}', 1)) AS section, unnest(regexp_extract_all(m, '{requirements.ITEMS["section"][1]}', 2)) AS number, unnest(regexp_extract_all(m, '{requirements.ITEMS["section"][1]}', 3)) AS content, generate_subscripts(regexp_extract_all(m, '{requirements.ITEMS["section"][1]}', 1), 1) AS i FROM shown),
 carried AS (SELECT *, last_value(nullif(section, '') IGNORE NULLS) OVER (PARTITION BY k, tab, pair, p ORDER BY i) AS sec FROM items),
 both_ AS (SELECT * FROM general UNION ALL SELECT k, tab, 'detailed', regime, stage, sec || '.' || number, trim(replace(content, chr(1), ' ')), pair, p, i FROM carried WHERE number <> '' AND sec IS NOT NULL)
 SELECT k, tab, kind, regime, stage, path, content, row_number() OVER (PARTITION BY k, tab, kind ORDER BY pair, p, i) - 1 AS place FROM (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY k, tab, kind, regime, stage, path ORDER BY pair, p, i) = 1)""")
def key_requirements(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    codes = t(spark, d, "orders").select(F.col("o_orderkey").alias("k")).repartition("k").distinct().withColumn("codes", F.array(F.lit("e8-wym2021"), F.lit("e8-pp2012")))
    return requirements.requirements(cells, codes, "k").withColumnRenamed("table", "tab")
