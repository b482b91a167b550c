"""Acts with their footnotes, tables of tasks, requirements: expected rows spelled out from the texts."""

from pyspark.sql import functions as F

from gradeloom.operators import requirements as rq

OLD = """Wymagania egzaminacyjne 2021 i 2022
Podstawa programowa^(1) 2012
Podstawa programowa 2
Wymagania określone w podstawie programowej
Wymagania egzaminacyjne   2021 i 2022
"""
NOTES = """1 Rozporządzenie Ministra Edukacji Narodowej z 27 sierpnia 2012 r. (Dz.U. z 2012 r. poz. 977, ze zm.) ^2 Załącznik nr 2 do rozporządzenia z 2024 r. (Dz. U. z 2024 r. poz. 1019) koniec
2 krótki"""


def test_the_gazette_decides_over_the_heading(spark):
    keys = spark.createDataFrame([("a", OLD, NOTES), ("b", "Podstawa programowa 3\n3 Rozporządzenie bez numeru, ale dość długie, by być przypisem", None), ("c", None, None), ("d", "Podstawa programowa 2017 (Dz. U. poz. 356)", "")], "k string, t string, f string")
    got = [tuple(r) for r in rq.regimes(keys, "k", "t", "f", F.lit("e8")).orderBy("k", "place").collect()]
    assert got == [
        ("a", "e8-wym2021-2022", "Wymagania egzaminacyjne 2021 i 2022", None, 0),
        ("a", "e8-pp2012", "Podstawa programowa^(1) 2012", None, 1),
        # printed without a year: the gazette's number of 2024 decides
        ("a", "e8-pp2024", "Wymagania określone w podstawie programowej", None, 2),
        ("b", "e8-pp-akt", "Podstawa programowa", "Rozporządzenie bez numeru, ale dość długie, by być przypisem", 0),
        ("d", "e8-pp2017", "Podstawa programowa 2017", None, 1 - 1),
    ]
    notes = {(r.k, r.number): r.note for r in rq.footnotes(keys, "k", "t", "f").collect()}
    assert notes["a", "1"].endswith("poz. 977, ze zm.)") and notes["a", "2"].startswith("Załącznik nr 2") and ("a", "3") not in notes
    one = spark.createDataFrame([("x", "Podstawa programowa^(2)", NOTES)], "k string, t string, f string")
    assert [(r.code, r.source) for r in rq.regimes(one, "k", "t", "f", F.lit("m")).collect()] == [("m-pp2024", "Dz. U. z 2024 r. poz. 1019")]


def test_a_table_goes_to_the_heading_over_it(spark):
    headings = spark.createDataFrame([("a", 0, 100.0), ("a", 0, 300.0), ("a", 1, 50.0), ("b", 0, 10.0), ("c", 0, 10.0), ("c", 0, 90.0)], "k string, page int, y double")
    tables = spark.createDataFrame(
        [("a", 0, 20.0, "before"), ("a", 0, 95.0, "frame over its heading"), ("a", 0, 200.0, "second of the first"), ("a", 0, 294.0, "tie"), ("a", 1, 40.0, "next page, second of the second"), ("a", 1, 60.0, "third"), ("b", 0, 5.0, "one"), ("b", 2, 5.0, "two"), ("b", 3, 5.0, "three"), ("c", 0, 100.0, "beyond the tasks")],
        "k string, page int, y double, table string",
    )
    tasks = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "k string, n int")
    got = sorted(tuple(r) for r in rq.tables_of_tasks(headings, tables, tasks, "k").collect())
    assert got == [
        ("a", 0, "frame over its heading", False), ("a", 1, "tie", False), ("a", 2, "third", False),
        ("b", 0, "one", True), ("b", 1, "two", True),  # one heading for two tasks: by order
        ("c", 0, "beyond the tasks", False),
    ]


ROWS = [
    ("k", 1, False, 0, ["Podstawa programowa 2012", "", "Podstawa programowa 2017", ""]),
    ("k", 1, False, 1, ["Wymaganie ogólne", "Wymagania szczegółowe", "Wymagania ogólne", "Wymaganie szczegółowe"]),
    ("k", 1, False, 2, ["I. Sprawność", "KLASY IV–VI", "II. Wykorzystanie", "Klasy VII i VIII"]),
    ("k", 1, False, 3, ["rachunkowa.", "2. Działania. Uczeń: 3) dodaje  liczby 12) mnoży je", "", "IV. Ułamki. Zdający: 1) skraca ułamki"]),
    ("k", 1, False, 4, ["", "IV — VI\n2. Działania. Uczeń: 3) dodaje znowu VII–VIII 9. Wzory. Uczeń: 1) przekształca", "", "1) bez działu"]),
    ("k", 2, False, 0, ["Zadanie 3", "Wymaganie"]),
    ("k", 2, False, 1, ["III. Modelowanie", "KLASY VII–VIII 6. Równania. Uczeń: 2) rozwiązuje"]),
    ("m", 1, True, 0, ["IV. Rozumowanie", "XIII.R1) liczy prawdopodobieństwo G1.6) stosuje wzory 1.3) krótko"]),
    ("n", 1, True, 0, ["alone"]),
    ("n", 2, True, 0, [None, ""]),
]


def test_requirements(spark):
    cells = spark.createDataFrame(ROWS, "k string, table int, explicit boolean, row int, cells array<string>").repartition(3)
    codes = spark.createDataFrame([("k", ["e8-wym2021", "e8-pp2012", "e8-pp2017"]), ("m", ["m-pp2024"])], "k string, codes array<string>")
    assert sorted(tuple(r) for r in rq.column_pairs(cells, ["k", "table"]).collect()) == [("k", 1, 0, 0, 1), ("k", 1, 1, 2, 3), ("k", 2, 0, 0, 1), ("m", 1, 0, 0, 1), ("n", 2, 0, 0, 1)]
    got = [tuple(r) for r in rq.requirements(cells, codes, "k").orderBy("k", "table", F.desc("kind"), "place").collect()]
    assert got == [
        ("k", 1, "general", "e8-pp2012", None, "I", "Sprawność rachunkowa.", 0), ("k", 1, "general", "e8-pp2017", None, "II", "Wykorzystanie", 1),
        ("k", 1, "detailed", "e8-pp2012", "IV-VI", "2.3", "dodaje liczby", 0), ("k", 1, "detailed", "e8-pp2012", "IV-VI", "2.12", "mnoży je", 1),
        ("k", 1, "detailed", "e8-pp2012", "VII-VIII", "9.1", "przekształca", 2), ("k", 1, "detailed", "e8-pp2017", "VII-VIII", "IV.1", "skraca ułamki", 3),
        ("k", 2, "general", "e8-wym2021", None, "III", "Modelowanie", 0), ("k", 2, "detailed", "e8-wym2021", "VII-VIII", "6.2", "rozwiązuje", 0),
        ("m", 1, "general", "m-pp2024", None, "IV", "Rozumowanie", 0),
        ("m", 1, "detailed", "m-pp2024", None, "XIII.R1", "liczy prawdopodobieństwo", 0), ("m", 1, "detailed", "m-pp2024", None, "G1.6", "stosuje wzory", 1), ("m", 1, "detailed", "m-pp2024", None, "1.3", "krótko", 2),
    ]
    assert rq.requirements(cells.limit(0), codes, "k").collect() == []


def test_a_table_is_gathered_once(spark):
    from gradeloom.plans import layout

    d = "/root/testdata/sf0.001"
    said = spark.sql(layout._ROWS.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{d}/orders.parquet"))
    got = layout._cells(spark, d).select("k", "table", "row", *[F.col("cells")[i] for i in range(4)])
    assert got.exceptAll(said).count() == 0 and got.count() == said.count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = layout.key_requirements(spark, d)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 2 and plan.count("FileScan") == 2  # the orders' and the codes'
