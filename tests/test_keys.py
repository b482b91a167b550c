"""Marking keys of the four dialects: what is read, spelled out from the keys' texts."""

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import dialects, parsing

E8_2019 = """Egzamin ósmoklasisty
OMAP-100-1904 OMAP-200-1904
Uwagi ogólne:
• Za błędy rachunkowe w zadaniach 16–21 odejmuje się jeden punkt.
• Uczeń korzysta z dostosowanych zasad oceniania w całości.

Zadanie 1. (0–1)
Rozwiązanie
B

Zadanie 2. (0–2)
Zasady oceniania
2 punkty – rozwiązanie pełne
zapisanie równania
lub
narysowanie osi (lub wykresu), np. x = 1    albo    y = 2
1 punkt
zapisanie sumy lub różnicy
LUB
Strona 7 z 20
ustalenie reszty
0 punktów
brak
Przykładowe rozwiązanie ocenione na 2 punkty
I sposób
x = 1
IV sposób graficzny
y = 2
Ocena prac osób
3 punkty
nie należy do zadania
"""
E8_2020 = """Egzamin ósmoklasisty z matematyki – termin maj 2021 r.
OMAP-X00-2105 wersje arkusza: X i Y
Zadanie 3. (0–1)
Zasady oceniania
1 pkt – poprawna odpowiedź
0 pkt – odpowiedź niepoprawna
Rozwiązanie – wersja X
Rozwiązanie – wersja Y^(2)
B
D

Zadanie 4. (0–1)
Rozwiązanie – wersja X
Rozwiązanie – wersja Y
4.1. TAK
4.1. NIE
4.2. A
4.2. B
4.2. C

Zadanie 5. (0–3)
Zasady oceniania
3 punkty pełne
rozwiązanie lub inne
LUB
drugie
1 punkt
początek
Uwagi.
1. Nie wymaga się zapisu jednostek.
2. krótka
Przykładowe rozwiązania
x równa się 14, bo suma wynosi 28
Ogólne zasady oceniania
2 pkt – dalej
"""
MATURA = """Egzamin maturalny
MMAP-P0-100-2305
Uwagi ogólne:
1. Za samą tylko poprawny wynik bez obliczeń przyznaje się punkt w zadaniach 5., 7. i 12.
2. Kalkulator prosty.
3. Zdający może otrzymać punkt, gdy kalkulator zawiedzie.

Zadanie 1. (0–1)
Rozwiązanie
Wersja A
Wersja B
C
A

Zadanie 15.2. (2 pkt)
Zasady oceniania
2 pkt – metoda pierwsza
ALBO
metoda druga
1 punkt to nie próg
1 pkt – początek
albo
zapis
Przykładowe pełne rozwiązania
Sposób 1.
pierwszy
Sposób 2
drugi
I. Dodatkowe szczegółowe zasady oceniania
1 pkt – aneks
"""
MATURA_2015 = """Egzamin maturalny z matematyki
ZADANIA OTWARTE 26–34
1. Akceptowane są wszystkie odpowiedzi merytorycznie poprawne i sprzecznych nie ma.
2. Jeżeli błędem rachunkowym jest pomyłka, punktu nie odejmuje się w zadaniach 26 – 30.

Zadanie 26. (2 pkt)
Zasady oceniania
Zdający otrzymuje ............................ 1 p.
gdy zapisze równanie
ALBO,
narysuje wykres
Zdający otrzymuje …… 2 pkt
gdy rozwiąże
Przykładowe pełne rozwiązania
Sposób I
x = 2
Kryteria uwzględniające specyficzne trudności
Zdający otrzymuje ...... 3 p.
"""
KEYS = {"e8-2019": E8_2019, "e8-2020": E8_2020, "matura": MATURA, "matura-2015": MATURA_2015}


@pytest.fixture(scope="module")
def keys(spark):
    return spark.createDataFrame(list(KEYS.items()) + [("none", None), ("empty", ""), ("bare", "Zadanie 1. (0–2)"), ("short", "Zadanie 1. (0–2)\nbody\nOcena prac\nx")], "k string, t string").repartition(3)


@pytest.fixture(scope="module")
def cut(keys):
    return parsing.sections(parsing.tasks(keys, "k", "t")).cache()


def found(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_dialects(keys):
    got = dict(found(keys, "k", dialects.dialect(F.col("t"), F.lit(None))))
    assert got == {k: k for k in KEYS} | {k: "e8-2019" for k in ("none", "empty", "bare", "short")}
    named = keys.where("k = 'short'").select(dialects.dialect(F.col("t"), F.lit("EMAP-P0-100.pdf"))).first()[0]
    assert named == "matura"


def test_every_dialect_has_every_role(spark):
    for name in dialects.DIALECTS:
        row = dialects.layout(name)
        assert all(row[c] for c in (*dialects.SINGLE, "answers_1", "threshold", "rule_border", "rule_item"))
    assert dialects.layouts(spark).count() == 4
    assert not any(mark in str(p) for *_, p in dialects.PATTERNS for mark in ("(?=", "(?!", "(?<"))


def test_tasks(keys, cut):
    assert found(parsing.tasks(keys, "k", "t"), "k", "ordinal", "number", "points") == sorted([
        ("e8-2019", 1, "1", 1), ("e8-2019", 2, "2", 2), ("e8-2020", 1, "3", 1), ("e8-2020", 2, "4", 1), ("e8-2020", 3, "5", 3), ("matura", 1, "1", 1), ("matura", 2, "15.2", 2), ("matura-2015", 1, "26", 2), ("short", 1, "1", 2),
    ])
    for row in parsing.tasks(keys, "k", "t").collect():
        text = KEYS.get(row.k, "Zadanie 1. (0–2)\nbody\nOcena prac\nx")
        assert text[row.starts :].startswith(row.body[:6]) and "Strona" not in row.body and "nie należy" not in row.body and "aneks" not in row.body
    assert found(parsing.facts(cut, "k"), "k", "ordinal", "kind", "answered", "solved", "judged") == [
        ("e8-2019", 1, "closed", True, False, False), ("e8-2019", 2, "short", False, True, True),
        ("e8-2020", 1, "closed", True, False, True), ("e8-2020", 2, "closed", True, False, False), ("e8-2020", 3, "extended", False, True, True),
        ("matura", 1, "closed", True, False, False), ("matura", 2, "short", False, True, True), ("matura-2015", 1, "short", False, True, True), ("short", 1, "short", False, False, False),
    ]


def test_answers_come_from_the_first_reader_that_succeeds(cut):
    got = [(r.k, r.ordinal, r.version, r.part, r.answer) for r in parsing.answers(cut, "k").orderBy("k", "ordinal", "place").collect()]
    assert got == [
        ("e8-2019", 1, None, None, "B"), ("e8-2020", 1, "X", None, "B"), ("e8-2020", 1, "Y", None, "D"),
        ("e8-2020", 2, "X", "4.1", "TAK"), ("e8-2020", 2, "Y", "4.1", "NIE"), ("e8-2020", 2, "X", "4.2", "A"), ("e8-2020", 2, "Y", "4.2", "B"), ("e8-2020", 2, "X", "4.2", "C"),
        ("matura", 1, "A", None, "C"), ("matura", 1, "B", None, "A"),
    ]


def test_thresholds_and_conditions(cut):
    rows = parsing.thresholds(cut, "k")
    assert found(rows, "k", "ordinal", "place", "points", F.coalesce("label", F.lit("-"))) == [
        ("e8-2019", 2, 1, 2, "rozwiązanie pełne"), ("e8-2019", 2, 2, 1, "-"), ("e8-2019", 2, 3, 0, "-"),
        ("e8-2020", 1, 1, 1, "-"), ("e8-2020", 1, 2, 0, "-"), ("e8-2020", 3, 1, 3, "pełne"), ("e8-2020", 3, 2, 1, "-"),
        ("matura", 2, 1, 2, "-"), ("matura", 2, 2, 1, "-"), ("matura-2015", 1, 1, 1, "-"), ("matura-2015", 1, 2, 2, "-"),
    ]
    got = [(r.k, r.ordinal, r.points, r.description, r.expressions) for r in parsing.conditions(rows, "k").orderBy("k", "ordinal", F.desc("points"), "place").collect()]
    assert got == [
        ("e8-2019", 2, 2, "zapisanie równania", []), ("e8-2019", 2, 2, "narysowanie osi (lub wykresu), np. x = 1 albo y = 2", ["x = 1", "y = 2"]),
        ("e8-2019", 2, 1, "zapisanie sumy lub różnicy", []), ("e8-2019", 2, 1, "ustalenie reszty", []), ("e8-2019", 2, 0, "brak", []),
        ("e8-2020", 1, 1, "poprawna odpowiedź", []), ("e8-2020", 1, 0, "odpowiedź niepoprawna", []),
        ("e8-2020", 3, 3, "rozwiązanie lub inne", []), ("e8-2020", 3, 3, "drugie", []), ("e8-2020", 3, 1, "początek", []),
        ("matura", 2, 2, "metoda pierwsza", []), ("matura", 2, 2, "metoda druga 1 punkt to nie próg", []), ("matura", 2, 1, "początek albo zapis", ["początek", "zapis"]),
        ("matura-2015", 1, 2, "gdy rozwiąże", []), ("matura-2015", 1, 1, "gdy zapisze równanie", []), ("matura-2015", 1, 1, "narysuje wykres", []),
    ]


def test_solutions_notes_and_rules(keys, cut):
    got = [(r.k, r.ordinal, r.method, r.points, r.content) for r in parsing.solutions(cut, "k").orderBy("k", "ordinal", "place").collect()]
    assert got == [
        ("e8-2019", 2, "I", 2, "x = 1"), ("e8-2019", 2, "IV", 2, "graficzny y = 2"), ("e8-2020", 3, None, None, "x równa się 14, bo suma wynosi 28"),
        ("matura", 2, "1", None, "pierwszy"), ("matura", 2, "2", None, "drugi"), ("matura-2015", 1, "I", None, "x = 2"),
    ]
    assert [tuple(r) for r in parsing.notes(cut, "k").collect()] == [("e8-2020", 3, "5", "1. Nie wymaga się zapisu jednostek.", 0)]
    got = [(r.k, r.position, r.kind, r.low, r.high, r.content[:12]) for r in parsing.rules(keys, "k", "t").orderBy("k", "position").collect()]
    assert got == [
        ("e8-2019", 0, "arithmetic", "16", "21", "Za błędy rac"), ("e8-2019", 1, "adapted", None, None, "Uczeń korzys"),
        ("matura", 0, "result_only", "5", "7", "Za samą tylk"), ("matura", 1, "calculator", None, None, "Kalkulator p"),
        ("matura-2015", 0, "contradictory", None, None, "Akceptowane "), ("matura-2015", 1, "arithmetic", "26", "30", "Jeżeli błęde"),
    ]
    # the second rule of matura is shorter than 20 characters to its border and takes the third with it
    merged = [r.content for r in parsing.rules(keys, "k", "t").where("k = 'matura' and position = 1").collect()]
    assert merged == ["Kalkulator prosty. 3. Zdający może otrzymać punkt, gdy kalkulator zawiedzie."]


def test_warnings(keys, cut):
    got = found(parsing.warnings(keys, parsing.facts(cut, "k"), parsing.forms(keys, "k", "t"), "k"), "k", "warning", "n", "of", "named")
    assert got == [
        ("bare", "no form in the header", 1, 1, ""), ("bare", "no task", 1, 1, ""), ("e8-2020", "closed tasks without criteria", 1, 2, "4"), ("empty", "no form in the header", 1, 1, ""), ("empty", "no task", 1, 1, ""),
        ("matura-2015", "no form in the header", 1, 1, ""), ("none", "no form in the header", 1, 1, ""), ("none", "no task", 1, 1, ""), ("short", "no form in the header", 1, 1, ""), ("short", "open tasks without criteria", 1, 1, ""),
    ]


def test_keys_are_read_without_a_shuffle(keys):
    plan = parsing.thresholds(parsing.sections(parsing.tasks(keys, "k", "t")), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert not any(node in plan for node in ("Window", "Aggregate", "Join", "Sort"))


def test_the_layout_joins_to_rows_by_dialect(keys):
    told = keys.select("k", dialects.dialect(F.col("t"), F.lit("")).alias("dialect"))
    rows = {r.k: r for r in dialects.with_layout(told, ["answers_2", "alternative"]).collect()}
    assert rows["matura"].alternative == dialects.layout("matura")["alternative"] and rows["e8-2019"].answers_2 is None


def test_odd_keys(keys, cut):
    assert [(r.points, r.body) for r in parsing.tasks(keys, "k", "t").where("k in ('none', 'empty', 'bare', 'short')").collect()] == [(2, "\nbody")]
    for read in (parsing.answers, parsing.solutions, parsing.notes, parsing.thresholds):
        assert read(cut.where("k = 'short'"), "k").collect() == []
    assert parsing.rules(keys.where("t is null or t = ''"), "k", "t").collect() == []
    assert parsing.sections(parsing.tasks(keys.limit(0), "k", "t")).collect() == []


def test_no_pattern_of_a_part_runs_in_a_filter(spark):
    """A filter on a part would be pushed down to the texts and run all patterns once more."""
    keys = spark.range(3).select(F.col("id").alias("k"), F.concat(F.lit("Zadanie 1. (0-1)\nUwagi:\n"), F.col("id").cast("string")).alias("t"))
    cut = parsing.sections(parsing.tasks(keys, "k", "t"))
    for rows in (parsing.notes(cut, "k"), parsing.solutions(cut, "k"), parsing.rules(keys, "k", "t"), parsing.forms(keys, "k", "t")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.splitlines() if "Filter" in line]
        assert not [line for line in filters if any(x in line for x in ("Uwag", "rozwi", "A-Z", "split(t"))]


def test_no_part_of_a_key_is_made_twice(spark):
    from gradeloom.plans import keys

    plan = keys.key_criteria(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert filters and not any(f in line for line in filters for f in ("split(", "regexp_replace(", "regexp_extract("))


def test_texts_are_cut_as_by_split_and_searched_where_they_say_it(spark):
    texts = [*KEYS.values(), *[part for text in KEYS.values() for part in text.split("\n\n")]]
    texts += ["", "\u0001", "a\n LUB \nb\u0001c", "\n LUB \n", "x   albo   y   lub   z\n ALBO ,\n", "2 pkt\n1 punkt a\n\u0001\n3 punkty", "Zdający otrzymuje ... 2 p.\nStrona 1 z 2\nUwagi:\n\n Sposób I\n II sposób", "Egzamin ósmoklasisty z matematyki – termin maj 2021 r."]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").cache()
    split = [p for p in dialects.SAYS if p != dialects.OLD_POINTS]
    got = rows.select(
        F.array(*[parsing._split("t", p) for p in split]).alias("cut"), F.array(*[F.split("t", p) for p in split]).alias("said"),
        F.array(*[F.when(F.col("t").rlike(p), dialects.may_match(F.col("t"), p)).otherwise(True) for p in dialects.SAYS]).alias("found"), F.array(*[F.col("t").rlike(p) for p in dialects.SAYS]).alias("any"),
    ).collect()
    assert all(r.cut == r.said and all(r.found) for r in got)
    assert sum(any(r.any[k] for r in got) for k in range(len(dialects.SAYS))) > len(dialects.SAYS) // 2


def test_a_key_with_the_character_of_borders(spark):
    text = "Zadanie 1. (0–2)\nZasady oceniania\n2 pkt – a\u0001b\nzapis   albo   in\u0001ny\nUwagi:\n1. Uwaga, która jest długa\u0001\nZadanie 2. (0–1)\nZasady oceniania\n1 pkt\nx\nOgólne zasady oceniania\n1 pkt"
    cut = parsing.sections(parsing.tasks(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t"))
    found = parsing.conditions(parsing.thresholds(cut, "k"), "k").orderBy("ordinal").collect()
    assert [(r.ordinal, r.points, r.label, r.description, r.expressions) for r in found] == [(1, 2, None, "a\u0001b zapis albo in\u0001ny", ["a\u0001b zapis", "in\u0001ny"]), (2, 1, None, "x", [])]
    assert [r.content for r in parsing.notes(cut, "k").collect()] == ["1. Uwaga, która jest długa"]
