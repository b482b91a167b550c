"""Marking keys: texts made of orders, read by the parser; the SQL reads the same texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dialects, parsing
from ..session import spread
from ..session import table as t
from .registry import query


def _s(x: str) -> str:
    return f"cast({x} as string)"


_NL = "chr(10)"
def _choice(*texts: str) -> str:
    """The text of a key's dialect: e8-2019, e8-2020, matura, matura-2015."""
    return "case o_orderkey % 4 " + " ".join(f"when {k} then {x}" for k, x in enumerate(texts)) + " end"


#: A key as an expression that Spark and other engines read alike; each dialect writes it in its own way.
_KEY = " || ".join([
    _choice("'Egzamin ósmoklasisty'", "'Egzamin ósmoklasisty z matematyki – termin maj 2021 r.'", "'Egzamin maturalny'", "'Egzamin maturalny z matematyki'"), _NL,
    "'Termin egzaminu: ' || " + _s("o_custkey % 28 + 1") + " || case o_orderkey % 3 when 0 then ' maja ' when 1 then ' czerwca ' else ' nigdy ' end || '2021 r.'", _NL,
    "case when o_orderkey % 5 = 0 then 'bez formy' else 'OMAP-' || " + _s("o_orderkey % 9") + " || '00-2105 OMAP-' || " + _s("o_orderkey % 9") + " || '00 wersje arkusza: X i Y' || chr(10) || 'MMAP-P0-' || " + _s("o_custkey % 9") + " || '00' end", _NL,
    _choice("'Uwagi ogólne:'", "'Uwagi ogólne'", "'Uwagi ogólne:'", "'ZADANIA OTWARTE 1–30'"), _NL,
    _choice("'• '", "'• '", "'1. '", "'1. '") + " || 'Za błędy rachunkowe w zadaniach ' || " + _s("o_custkey % 5") + " || '–' || " + _s("o_custkey % 5 + 3") + " || ' odejmuje się punkt.'", _NL,
    _choice("'• '", "'• '", "'2. '", "'2. '") + " || 'Zdający nie może   używać' || chr(10) || 'kalkulatora: ' || lower(o_orderpriority)", _NL,
    _choice("'• '", "'• '", "'3. '", "'3. '") + " || 'W zadaniach 5., 7. i ' || " + _s("o_custkey % 7 + 8") + " || '. tylko poprawny wynik'", _NL, _NL,
    "'Zadanie ' || " + _s("o_orderkey % 30") + " || '. (0–' || " + _s("o_custkey % 4 + 1") + " || ')'", _NL, "'Zasady oceniania'", _NL,
    _choice("'2 punkty – pełne'", "'2 pkt – metoda ' || o_orderpriority", "'2 pkt metoda ' || o_orderpriority", "'Zdający otrzymuje ............ 2 p.'"), _NL,
    _choice("'metoda ' || o_orderpriority || chr(10) || 'lub'", "'LUB'", "'ALBO'", "'metoda ' || o_orderpriority || chr(10) || 'ALBO,'"), _NL,
    "'zapis (lub rysunek), np. x = ' || " + _s("o_custkey") + " || " + _choice("'    albo    '", "'    lub    '", "chr(10) || 'albo' || chr(10)", "'   lub   '") + " || 'y = ' || " + _s("o_orderkey"), _NL,
    "'Strona 3 z 20'", _NL, _choice("'1 punkt początek'", "'1 punkt początek'", "'1 pkt – początek'", "'1 pkt – początek'"), _NL, "'• krok pierwszy;'", _NL, "'2 pkt – powtórka'", _NL,
    "'Uwagi:'", _NL, "'1. Uwaga o ' || o_orderpriority || ' jest długa'", _NL, "'2. krótka'", _NL, "'3. Druga długa uwaga dla zadania'", _NL,
    _choice("'Przykładowe rozwiązanie ocenione na 2 punkty'", "'Przykładowe rozwiązania'", "'Przykładowe pełne rozwiązanie ocenione na 2 punkty'", "'Przykładowe pełne rozwiązania'"), _NL,
    _choice("'I sposób'", "'I sposób'", "'Sposób 1.'", "'Sposób I'"), _NL, "'x = ' || " + _s("o_custkey"), _NL, _choice("'II sposób'", "'krótszy niż poprzedni'", "'Sposób 2.'", "'Sposób II.'"), _NL, "'y  = 2'", _NL,
    "'Zadanie ' || " + _s("o_orderkey % 30") + " || '.1. (3 pkt)'", _NL,
    _choice("'Rozwiązanie'", "'Rozwiązanie – wersja X' || chr(10) || 'Rozwiązanie – wersja Y'", "'Rozwiązanie' || chr(10) || 'Wersja A' || chr(10) || 'Wersja B'", "'Rozwiązanie – wersja A^(2)' || chr(10) || 'Rozwiązanie – wersja B'"), _NL,
    "case when o_orderkey % 8 < 4 then '1.1. TAK' || chr(10) || '1.1. NIE' || chr(10) || '1.2. A' else 'B' || chr(10) || 'C' end", _NL, _NL,
    "'Zadanie 99. (0-1)'", _NL, "'Rozwiązanie'", _NL, "case when o_orderkey % 7 = 0 then ' ' else o_orderpriority end", _NL, _NL,
    "'Zasady oceniania'", _NL, "'1 pkt – odpowiedź'", _NL, _choice("'Ocena prac osób'", "'Ogólne zasady oceniania'", "'II. Dodatkowe szczegółowe zasady oceniania'", "'Kryteria uwzględniające specyficzne trudności'"), _NL, "'3 pkt – koniec'",
])
_KEYS = f"keys AS (SELECT o_orderkey AS k, {_KEY} AS t FROM orders)"


def _line(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _tidy(x: str) -> str:
    return rf"trim(replace(regexp_replace(regexp_replace({_line(x)}, '^[•– -]+', ''), '^[ ,;]+|[ ,;]+$', '', 'g'), '{parsing.CRITERIA}', ''))"


def _by(role: str, show: Callable[[str], str]) -> str:
    """An expression with the pattern that each dialect has for a role, null where it has none."""
    rows = [(d, dialects.layout(d)[role]) for d in dialects.DIALECTS]
    return "CASE dialect " + " ".join(f"WHEN '{d}' THEN {show(chr(39) + str(p) + chr(39))}" for d, p in rows if p is not None) + " END"


def _first(text: str, role: str) -> str:
    return _by(role, lambda p: f"string_split_regex({text}, {p})[1]")


def _group(text: str, role: str, k: int) -> str:
    return _by(role, lambda p: f"regexp_extract({text}, {p}, {k})")


def _has(text: str, role: str) -> str:
    return _by(role, lambda p: f"regexp_matches({text}, {p})")


_TOLD = rf"""{_KEYS}, told AS (SELECT k, t, CASE WHEN contains(substr(t, 1, 4000), 'Egzamin maturalny') THEN CASE WHEN regexp_matches(t, '{dialects.OLD_POINTS}') THEN 'matura-2015' ELSE 'matura' END
 WHEN regexp_matches(t, '{dialects.MODERN_PAGE}') THEN 'e8-2020' ELSE 'e8-2019' END AS dialect FROM keys)"""
_TASKS = rf"""{_TOLD}, cut AS (SELECT k, dialect, string_split_regex(t, '{parsing.TASK}') AS parts, regexp_extract_all(t, '{parsing.TASK}', 0) AS h, regexp_extract_all(t, '{parsing.TASK}', 1) AS n, regexp_extract_all(t, '{parsing.TASK}', 2) AS a, regexp_extract_all(t, '{parsing.TASK}', 3) AS b FROM told),
 every AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM cut), ended AS (SELECT *, CASE WHEN i = len(h) THEN {_first('parts[i + 1]', 'task_end')} ELSE parts[i + 1] END AS whole FROM every),
 tasks AS MATERIALIZED (SELECT k, dialect, i::INT AS ordinal, n[i] AS number, coalesce(nullif(a[i], ''), nullif(b[i], ''))::INT AS points, {_by('page', lambda p: f"regexp_replace(whole, {p}, '', 'g')")} AS body,
 length(array_to_string(list_slice(parts, 1, i), '') || array_to_string(list_slice(h, 1, i), '')) AS starts FROM ended)"""
_READ = " UNION ALL ".join(f"SELECT k, ordinal, {n} AS place, length({_first('body', f'answers_{n}')}) + 1 AS found_at, {_group('body', f'answers_{n}', 1)} AS v1, {_group('body', f'answers_{n}', 2)} AS v2, {_group('body', f'answers_{n}', 3)} AS block FROM tasks WHERE {_has('body', f'answers_{n}')}" for n in range(1, dialects.READERS + 1))
_SECTIONS = rf"""{_TASKS}, read AS ({_READ}),
 won AS (SELECT * FROM read WHERE {_line('block')} <> '' QUALIFY row_number() OVER (PARTITION BY k, ordinal ORDER BY place) = 1),
 solved AS (SELECT k, ordinal, {_group('body', 'solutions', 0)} AS head, length({_first('body', 'solutions')}) + 1 AS found_at FROM tasks WHERE {_has('body', 'solutions')}),
 bounded AS (SELECT t.*, w.block, w.v1, w.v2, s.head AS solved_head, substr(body, s.found_at + length(s.head)) AS solved_tail, greatest(position('{parsing.CRITERIA}' IN body), 1) AS b,
  w.found_at AS answer_at, s.found_at AS solved_at FROM tasks t LEFT JOIN won w USING (k, ordinal) LEFT JOIN solved s USING (k, ordinal)),
 texts AS (SELECT *, substr(body, b, coalesce(least(CASE WHEN answer_at > b THEN answer_at END, CASE WHEN solved_at > b THEN solved_at END), length(body) + 1) - b) AS x FROM bounded),
 sections AS MATERIALIZED (SELECT *, {_first('x', 'notes')} AS criteria, CASE WHEN {_has('x', 'notes')} THEN substr(x, length({_first('x', 'notes')}) + length({_group('x', 'notes', 0)}) + 1) END AS noted FROM texts)"""
_THRESHOLDS = rf"""{_SECTIONS}, heads AS (SELECT k, ordinal, dialect, {_by('threshold', lambda p: f'string_split_regex(criteria, {p})')} AS parts, {_by('threshold', lambda p: f'regexp_extract_all(criteria, {p}, 0)')} AS h FROM sections),
 each AS (SELECT *, parts[i + 1] AS rest, h[i] AS head FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM heads)),
 forms AS (SELECT *, {", ".join(f"nullif({_group('head', 'threshold', 2 * n - 1)}, '') AS p{n}, {_group('head', 'threshold', 2 * n)} AS t{n}, {_by(f'tail_is_condition_{n}', lambda p: p)} = 'True' AS c{n}" for n in range(1, dialects.FORMS + 1))} FROM each),
 firsts AS (SELECT *, coalesce(p1, p2, p3)::INT AS points, CASE WHEN p1 IS NOT NULL THEN c1 WHEN p2 IS NOT NULL THEN c2 ELSE c3 END AS inline, trim(regexp_replace(concat(t1, t2, t3), '^[ \t–—−-]+|[ \t–—-]+$', '', 'g')) AS tail FROM forms QUALIFY row_number() OVER (PARTITION BY k, ordinal, points ORDER BY i) = 1),
 thresholds AS (SELECT k, ordinal, dialect, points, row_number() OVER (PARTITION BY k, ordinal ORDER BY i) AS place, CASE WHEN NOT inline THEN nullif(tail, '') END AS label, CASE WHEN inline THEN tail || chr(10) || rest ELSE rest END AS block FROM firsts)"""
_ANSWERED = f"""lines AS (SELECT k, ordinal, v1, v2, list_filter(list_transform(string_split(block, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM sections WHERE block IS NOT NULL),
 spread AS (SELECT *, unnest(l) AS line, generate_subscripts(l, 1) AS i, len(l) AS n FROM lines), numbered AS (SELECT *, nullif(regexp_extract(line, '{parsing.SUB_POINT}', 1), '') AS part FROM spread),
 turned AS (SELECT *, count(part) OVER (PARTITION BY k, ordinal) = n AND (v1 = '' OR n >= 2) AS listed, row_number() OVER (PARTITION BY k, ordinal, part ORDER BY i) AS occ FROM numbered),
 answers AS (SELECT k, ordinal, CASE WHEN v1 <> '' THEN CASE WHEN NOT listed THEN [v1, v2][i] WHEN occ = 2 THEN v2 ELSE v1 END END AS version, CASE WHEN listed THEN part END AS part, CASE WHEN listed THEN regexp_extract(line, '{parsing.SUB_POINT}', 2) ELSE line END AS answer, i - 1 AS place FROM turned WHERE listed OR (v1 <> '' AND i < 3) OR i = 1)"""
_SOLVED = rf"""methods AS (SELECT k, ordinal, nullif(regexp_extract({_line('solved_head')}, '{parsing.SOLUTION_POINTS}', 1), '')::INT AS points, {_by('method', lambda p: f'regexp_extract_all(solved_tail, {p}, 1)')} AS m, {_by('method', lambda p: f'string_split_regex(solved_tail, {p})')} AS p FROM sections WHERE solved_head IS NOT NULL),
 ways AS (SELECT *, unnest(range(0, len(m) + 1)) AS i FROM methods), solutions AS (SELECT k, ordinal, CASE WHEN i > 0 THEN m[i] END AS method, points, {_line('p[i + 1]')} AS content, i AS place FROM ways WHERE i > 0 OR (len(m) = 0 AND length({_line('p[1]')}) > 20))"""
_FACTS = f"""facts AS (SELECT s.k, s.ordinal, s.number, CASE WHEN w.k IS NULL AND s.block IS NOT NULL THEN 'closed' WHEN s.points <= 2 THEN 'short' ELSE 'extended' END AS kind, s.block IS NOT NULL AS answered, {_has('criteria', 'threshold')} AS judged
 FROM sections s LEFT JOIN (SELECT DISTINCT k, ordinal FROM solutions) w ON w.k = s.k AND w.ordinal = s.ordinal)"""
_NOTED = rf"""pieces AS (SELECT k, ordinal, number, unnest(string_split(regexp_replace(noted, '{parsing.NOTE_BORDER}', chr(1) || '\1', 'g'), chr(1))) AS x, generate_subscripts(string_split(regexp_replace(noted, '{parsing.NOTE_BORDER}', chr(1) || '\1', 'g'), chr(1)), 1) AS i FROM sections WHERE noted IS NOT NULL),
 notes AS (SELECT k, ordinal, number, {_line('x')} AS content, row_number() OVER (PARTITION BY k, ordinal ORDER BY i) - 1 AS place FROM pieces WHERE length(trim(x, ' ' || chr(9) || chr(10))) > 15 QUALIFY place < 6)"""
_KIND = "CASE " + " ".join("WHEN " + " AND ".join(f"contains(content, '{p}')" for p in phrases) + f" THEN '{kind}'" for kind, phrases in parsing.RULE_KINDS) + " ELSE 'other' END"


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return spread(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey").select(F.col("o_orderkey").alias("k"), F.expr(_KEY).alias("t"))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return parsing.tasks(_keys(spark, d), "k", "t")


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return parsing.sections(_tasks(spark, d))


@query(rf"WITH {_TOLD} SELECT k, dialect FROM told")
def key_dialect(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d).select("k", dialects.dialect(F.col("t"), F.lit("")).alias("dialect"))


@query(f"WITH {dialects.layouts_sql()} SELECT dialect, answers_1, answers_2, answers_3, threshold, alternative, count(*) AS keys FROM layouts JOIN (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'e8-2019' WHEN 1 THEN 'e8-2020' WHEN 2 THEN 'matura' ELSE 'matura-2015' END AS dialect FROM orders) USING (dialect) GROUP BY ALL")
def key_layouts(spark: SparkSession, d: str) -> DataFrame:
    told = _keys(spark, d).select(dialects.dialect(F.col("t"), F.lit("")).alias("dialect")).groupBy("dialect").agg(F.count(F.lit(1)).alias("keys"))
    return dialects.with_layout(told, ["answers_1", "answers_2", "answers_3", "threshold", "alternative"])


@query(rf"""WITH {_KEYS}, p AS (SELECT k, regexp_extract(t, '{parsing.EXAM_DATE}', 1) AS d, regexp_extract(t, '{parsing.EXAM_DATE}', 2) AS m, regexp_extract(t, '{parsing.EXAM_DATE}', 3) AS y FROM keys)
 SELECT k, CASE m WHEN 'maja' THEN y || '-05-' || lpad(d, 2, '0') WHEN 'czerwca' THEN y || '-06-' || lpad(d, 2, '0') END AS day FROM p""")
def key_exam_date(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d).select("k", parsing.exam_date(F.col("t")).cast("string").alias("day"))


@query(f"WITH {_TASKS} SELECT k, ordinal, number, points, body, starts FROM tasks")
def key_tasks(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).drop("dialect")


@query(f"""WITH {_TASKS}, begins AS (SELECT k, unnest(range(1, 21)) AS page, (unnest(range(1, 21)) - 1) * 101 AS begins_at FROM keys) SELECT k, ordinal, max(page) AS page FROM tasks t JOIN (SELECT k, page AS page, begins_at FROM begins) b USING (k) WHERE begins_at <= starts GROUP BY 1, 2""")
def key_task_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = _keys(spark, d).select("k", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("page")).withColumn("page_text", F.repeat(F.lit("x"), 100))
    places = _tasks(spark, d).select("k", "ordinal", "starts")
    return parsing.page_of(pages, places, "k", "page", "page_text", "starts").select("k", "ordinal", F.col("page").cast("long").alias("page"))


_FORMS = rf"""l AS (SELECT k, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM keys),
 f AS (SELECT k, i, line, unnest(regexp_extract_all(line, '{parsing.FORM}', 0)) AS form FROM l), p AS (SELECT k, i, line, form, regexp_extract(form, '{parsing.FORM}', 1) AS code, regexp_extract(form, '{parsing.FORM}', 2) AS variant, nullif(regexp_extract(form, '{parsing.FORM}', 3), '') AS session FROM f),
 o AS (SELECT k, code, variant, arg_min(line, i) AS line, min(session) AS session FROM p GROUP BY 1, 2, 3)"""


@query(rf"WITH {_KEYS}, {_FORMS} SELECT k, code, variant, session, unnest(CASE WHEN contains(line, 'wersje') THEN ['X', 'Y'] ELSE [NULL] END) AS version FROM o")
def key_forms(spark: SparkSession, d: str) -> DataFrame:
    return parsing.forms(_keys(spark, d), "k", "t")


@query(f"WITH {_SECTIONS}, {_ANSWERED} SELECT k, ordinal, version, part, answer, place FROM answers")
def key_answers(spark: SparkSession, d: str) -> DataFrame:
    return parsing.answers(_sections(spark, d), "k")


@query(rf"WITH {_SECTIONS}, {_SOLVED} SELECT k, ordinal, method, points, content, place FROM solutions")
def key_solutions(spark: SparkSession, d: str) -> DataFrame:
    return parsing.solutions(_sections(spark, d), "k")


@query(f"WITH {_THRESHOLDS} SELECT k, ordinal, place, points, label FROM thresholds")
def key_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return parsing.thresholds(_sections(spark, d), "k").select("k", "ordinal", "place", "points", "label")


@query(rf"""WITH {_THRESHOLDS}, s AS (SELECT *, {_by('alternative', lambda p: f'string_split_regex(block, {p})')} AS l FROM thresholds), w AS (SELECT k, ordinal, points, label, dialect, unnest(l) AS x, generate_subscripts(l, 1) AS place FROM s),
 bare AS (SELECT *, regexp_replace(x, '{parsing.ASIDE}', '', 'g') AS y FROM w),
 e AS (SELECT k, ordinal, points, label, place, {_tidy('x')} AS description, list_filter(list_transform({_by('equivalent', lambda p: f'string_split_regex(y, {p})')}, lambda z: {_tidy('z')}), lambda z: z <> '') AS pieces FROM bare)
 SELECT k, ordinal, points, label, place, description, CASE WHEN len(pieces) > 1 THEN len(pieces) ELSE 0 END AS n_expressions, CASE WHEN len(pieces) > 1 THEN regexp_replace(pieces[1], '{parsing.FOR_EXAMPLE}', '') END AS first FROM e WHERE description <> ''""")
def key_criteria(spark: SparkSession, d: str) -> DataFrame:
    found = parsing.conditions(parsing.thresholds(_sections(spark, d), "k"), "k")
    return found.select("k", "ordinal", "points", "label", "place", "description", F.size("expressions").alias("n_expressions"), F.get("expressions", F.lit(0)).alias("first"))


@query(f"WITH {_SECTIONS}, {_SOLVED}, {_FACTS} SELECT k, ordinal, kind, answered, judged FROM facts")
def key_task_kinds(spark: SparkSession, d: str) -> DataFrame:
    return parsing.facts(_sections(spark, d), "k").select("k", "ordinal", "kind", "answered", "judged")


@query(rf"""WITH {_SECTIONS}, {_NOTED}, tails AS (SELECT k, dialect, substr(t, length({_first('t', 'rules')}) + length({_group('t', 'rules', 0)}) + 1, 4000) AS x FROM told WHERE {_has('t', 'rules')}),
 paged AS (SELECT k, dialect, {_by('page', lambda p: f"regexp_replace(string_split_regex(x, '{parsing.TASK}')[1], {p}, '', 'g')")} AS x FROM tails),
 bordered AS (SELECT k, dialect, {_by('rule_border', lambda p: f"regexp_replace(x, {p}, chr(1) || chr(10) || '{chr(92)}1', 'g')")} AS x FROM paged),
 found AS (SELECT k, {_by('rule_item', lambda p: f'regexp_extract_all(x, {p}, 1)')} AS l FROM bordered),
 items AS (SELECT k, unnest(l) AS item, generate_subscripts(l, 1) - 1 AS position FROM found),
 said AS (SELECT k, position, {_line("replace(item, chr(1), ' ')")} AS content FROM items),
 several AS (SELECT k, content, coalesce(nullif(regexp_extract(content, '{parsing.RULE_RANGE}', 1), ''), nullif(regexp_extract(content, '{parsing.RULE_LIST}', 1), '')) AS low, coalesce(nullif(regexp_extract(content, '{parsing.RULE_RANGE}', 2), ''), nullif(regexp_extract(content, '{parsing.RULE_LIST}', 2), '')) AS high, position FROM said),
 every_rule AS (SELECT * FROM several UNION ALL SELECT k, content, number, number, 1000 + 10 * ordinal + place FROM notes)
 SELECT k, {_KIND} AS kind, content, low, high, position FROM every_rule""")
def key_rules(spark: SparkSession, d: str) -> DataFrame:
    return parsing.rules(_keys(spark, d), "k", "t").unionByName(parsing.note_rules(parsing.notes(_sections(spark, d), "k"), "k"))


@query(rf"""WITH {_SECTIONS}, {_SOLVED}, {_FACTS}, {_FORMS}, per AS (SELECT k, count(*) FILTER (kind <> 'closed' AND NOT judged) AS open_bare, count(*) FILTER (kind <> 'closed') AS open_, count(*) FILTER (kind = 'closed' AND judged) AS closed_judged, count(*) FILTER (kind = 'closed') AS closed,
 count(*) FILTER (kind = 'closed' AND NOT answered) AS unanswered, array_to_string(list_slice(list(number ORDER BY ordinal) FILTER (kind = 'closed' AND NOT judged), 1, 8), ', ') AS named FROM facts GROUP BY k)
 SELECT k, 'no form in the header' AS warning, 1 AS n, 1 AS of, '' AS named FROM keys WHERE k NOT IN (SELECT k FROM o)
 UNION ALL SELECT k, 'open tasks without criteria', open_bare, open_, '' FROM per WHERE open_bare > 0
 UNION ALL SELECT k, 'closed tasks without criteria', closed - closed_judged, closed, named FROM per WHERE closed_judged > 0 AND closed_judged < closed""")
def key_warnings(spark: SparkSession, d: str) -> DataFrame:
    keys = _keys(spark, d)
    return parsing.warnings(keys, parsing.facts(_sections(spark, d), "k"), parsing.forms(keys, "k", "t"), "k")


@query("""WITH v AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE chr((65 + l_linenumber % 3)::INT) END AS letter, l_partkey FROM lineitem),
 p AS (SELECT l_orderkey AS k, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE chr((65 + l_suppkey % 3)::INT) END AS letter, min(l_suppkey) AS paper FROM lineitem GROUP BY 1, 2), c AS (SELECT k, count(*) AS n, min(paper) AS any_, min(paper) FILTER (letter IS NULL) AS plain FROM p GROUP BY 1)
 SELECT v.k, v.letter, l_partkey, coalesce(p.paper, CASE WHEN count(*) OVER (PARTITION BY v.k) = 1 AND c.n = 1 THEN any_ END, plain) AS paper FROM v LEFT JOIN p ON p.k = v.k AND p.letter = v.letter LEFT JOIN c ON c.k = v.k""")
def paper_of_version(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem")
    letter = lambda c: F.when(F.col(c) % 3 != 0, F.char(65 + F.col(c) % 3))
    papers = lines.groupBy(F.col("l_orderkey").alias("k"), letter("l_suppkey").alias("letter")).agg(F.min("l_suppkey").alias("paper"))
    return parsing.match_versions(lines.select(F.col("l_orderkey").alias("k"), letter("l_linenumber").alias("letter"), "l_partkey"), papers, "k", "letter", "paper")


@query("""WITH v AS (SELECT DISTINCT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'A' END AS letter FROM orders), a AS (SELECT l_orderkey AS k, CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS letter, l_linenumber * 1000000 + l_partkey AS o, l_partkey AS answer FROM lineitem)
 SELECT v.k, v.letter, CASE WHEN v.letter IS NULL THEN (SELECT arg_min(answer, o) FROM a WHERE a.k = v.k) ELSE (SELECT arg_min(answer, o) FROM a WHERE a.k = v.k AND a.letter = v.letter) END AS answer FROM v""")
def answer_of_version(spark: SparkSession, d: str) -> DataFrame:
    answered = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_suppkey") % 2 == 0, "A").otherwise("B").alias("letter"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("o"), F.col("l_partkey").alias("answer"))
    versions = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 2 != 0, "A").alias("letter")).distinct()
    return parsing.first_answer(versions, answered, "k", "letter", "o", "answer")
