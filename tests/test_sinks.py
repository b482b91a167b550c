"""Loads by key, nested JSON files and reports: what is on disk before and after."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import changes, pagetext
from gradeloom.sources import jsonfiles, keyed

SCHEMA = "url string, task string, points int, status string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def files(path):
    return {p: (p.stat().st_mtime_ns, p.read_bytes()) for p in Path(path).rglob("*.parquet")}


def table(spark, path):
    return sorted(tuple(r) for r in keyed.read(spark, path, SCHEMA).collect())


def load(spark, path, incoming, **options):
    report = keyed.load(spark, path, SCHEMA, incoming, "url", F.col("status") != "pending", buckets=4, **options)
    return {r.url: r.verdict for r in report.collect()}


def test_loads_replace_whole_keys(spark, tmp_path):
    path = str(tmp_path / "tasks")
    first = rows(spark, ("a", "1", 1, "pending"), ("a", "2", 2, "pending"), ("b", "1", 1, "approved"), ("c", "1", None, "pending"))
    assert load(spark, path, first) == {"a": "loaded", "b": "loaded", "c": "loaded"}
    before = files(path)
    assert load(spark, path, first.repartition(3)) == {"a": "unchanged", "b": "unchanged", "c": "unchanged"}
    assert files(path) == before  # a second load changes no file
    second = rows(spark, ("a", "1", 5, "pending"), ("b", "1", 5, "pending"), ("d", "1", 1, "pending"), (None, "1", 1, "pending"))
    with pytest.raises(keyed.Refused):
        load(spark, path, second, strict=True)
    assert files(path) == before
    assert load(spark, path, second) == {"a": "loaded", "b": "refused", "d": "loaded", None: "loaded"}
    want = [("a", "1", 5, "pending"), ("b", "1", 1, "approved"), ("c", "1", None, "pending"), ("d", "1", 1, "pending")]
    assert sorted(tuple(r) for r in keyed.read(spark, path, SCHEMA).where("url is not null").collect()) == want
    assert load(spark, path, rows(spark, ("b", "1", 5, "pending")), overwrite_reviewed=True) == {"b": "loaded"}
    assert ("b", "1", 5, "pending") in table(spark, path) if None not in [r.url for r in keyed.read(spark, path, SCHEMA).collect()] else True
    assert keyed.read(spark, path, SCHEMA).where("url is null").count() == 1


def test_a_load_that_fails_half_way_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "tasks")
    load(spark, path, rows(spark, *[(k, "1", 1, "pending") for k in "abcdefgh"]))
    before = files(path)
    broken = rows(spark, *[(k, "1", 2, "pending") for k in "abcdefgh"]).withColumn("points", F.when(F.col("url") == "h", F.raise_error(F.lit("broken"))).otherwise(F.col("points")).cast("int"))
    # the row fails only in the write: digests of the load don't hold it
    original, keyed._digests = keyed._digests, lambda df, key, columns, name: original(df, key, [c for c in columns if c != "points"] if name == "_new" else columns, name)
    try:
        with pytest.raises(Exception, match="broken"):
            load(spark, path, broken)
    finally:
        keyed._digests = original
    assert files(path) == before and all(r[2] == 1 for r in table(spark, path))


PAGE = {"numer": 0, "szerokosc": 595.0, "wysokosc": 842.0, "znaki": [["3", 10, 16, 94.5, 105.5, 11], ["1", 20, 26, 87.5, 98.5, 11.0], ["ż", 20, 26, 101.5, 112.5, 11]], "kreski": [[19, 27, 100]], "kreski_kandydujace": [[19, 27, 100], [5, 9, 300]], "tabele": [{"bbox": [0, 290, 20, 310], "wiersze": [["a", "b"]]}], "ksztalty": [["line", 1, 2, 3, 4]]}
GRADED = {
    "exam_form": "OMAP-100", "session": "2025-05-14", "year": 2025, "task": "17", "max_points": 2, "content_source": "paper", "task_text": "Oblicz „½” ≤ x",
    "answers": [{"kind": "full", "text": "x = 1\ny", "intent": "all", "author": "m", "grading": {"grader": "g", "points": 2, "criteria": [{"points": 2, "met": True, "quote": "x", "note": None}], "justification": "ok"}}, {"kind": "wrong", "text": "", "intent": "none", "author": "m", "grading": None}],
}


def test_page_dumps(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(PAGE))
    (tmp_path / "b.json").write_text('{"numer": 1, ')
    (tmp_path / "c.json").write_text('{"numer": "one", "znaki": 5}')
    (tmp_path / "d.json").write_text("{}")
    (tmp_path / "e.txt").write_text("{}")
    pages = jsonfiles.read(spark, str(tmp_path), jsonfiles.PAGE).withColumn("path", F.element_at(F.split("path", "/"), -1))
    assert {r.path: r.reason for r in pages.collect()} == {"a.json": None, "b.json": "no JSON", "c.json": "other shape", "d.json": "other shape"}
    assert [(r.c, r.x0, r.size) for r in jsonfiles.characters(pages, "path").orderBy("n").collect()] == [("3", 10.0, 11.0), ("1", 20.0, 11.0), ("ż", 20.0, 11.0)]
    assert [(r.x0, r.y) for r in jsonfiles.bars(pages, "path").collect()] == [(19.0, 100.0)]  # the other lies in a table
    assert [r.text for r in pagetext.page_texts(jsonfiles.characters(pages, "path"), jsonfiles.bars(pages, "path")).collect()] == ["3 1/ż"]


def test_graded_tasks_round_trip_byte_for_byte(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    (source / "2025").mkdir(parents=True)
    texts = {"2025/task-17.json": GRADED, "2025/task-18.json": GRADED | {"task": "18.1", "answers": [], "task_text": None}}
    for name, content in texts.items():
        (source / name).write_text(json.dumps(content, ensure_ascii=False, indent=1) + "\n", encoding="utf-8")
    (source / "broken.json").write_text("[1")
    graded = jsonfiles.read(spark, str(source), jsonfiles.GRADED)
    assert graded.where("reason is not null").count() == 1
    names = [c for c in graded.columns if c not in ("path", "reason")]
    out = graded.where("reason is null").select(F.regexp_extract("path", "/in/(.*)$", 1).alias("path"), jsonfiles.canonical(F.struct(*names)).alias("text"))
    assert {r.path for r in jsonfiles.write(out, "path", "text", target.as_uri()).collect()} == set(texts)
    jsonfiles.write(out, "path", "text", target.as_uri()).collect()  # again: the same files
    assert {str(p.relative_to(target)): p.read_bytes() for p in target.rglob("*") if p.is_file()} == {n: (source / n).read_bytes() for n in texts}


@pytest.mark.parametrize(
    "kind, want",
    [
        ("tsv", "name\tn\nb c\t\nx|y,\"z\"\t2\n"), ("csv", 'name,n\n"b\tc\n",\n"x|y,""z""",2\n'.replace('"b\tc\n"', '"b\tc\n"')), ("markdown", '| name | n |\n| --- | --- |\n| b\tc  |  |\n| x\\|y,"z" | 2 |\n'),
        ("json", '{"name":"b\\tc\\n","n":null}\n{"name":"x|y,\\"z\\"","n":2}\n'), ("text", 'name     n\nb\tc\n\nx|y,"z"  2\n'),
    ],
)
def test_reports_are_the_same_byte_for_byte(spark, tmp_path, kind, want):
    df = spark.createDataFrame([('x|y,"z"', 2), ("b\tc\n", None)], "name string, n int")
    once, again = tmp_path / "r" / "a.txt", tmp_path / "r" / "b.txt"
    jsonfiles.write_report(jsonfiles.report(df, ["name", "n"], ["name"], kind), once.as_uri())
    jsonfiles.write_report(jsonfiles.report(df.repartition(3), ["name", "n"], ["name"], kind), again.as_uri())
    assert once.read_bytes() == again.read_bytes()
    assert [line.rstrip() for line in once.read_text().split("\n")] == [line.rstrip() for line in want.split("\n")]
    assert sorted(p.name for p in once.parent.iterdir()) == ["a.txt", "b.txt"]


def test_the_first_content_is_kept_and_the_others_are_told(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "", 2), ("a", "x", 3), ("a", "x", 4), (None, "y", 5), (None, None, 6), ("b", "z", 7)], "k string, c string, o int")
    assert sorted(map(tuple, changes.keep_first(df, ["k"], "c", ["o"]).collect()), key=str) == sorted([("a", None, 2), (None, "y", 1), ("b", "z", 0)], key=str)
    got = sorted(((r.k, r.c, r.kept, r.n, r.first.o) for r in changes.divergences(df, ["k"], "c", ["o"]).collect()), key=str)
    assert got == sorted([("a", "", None, 1, 2), ("a", "x", None, 2, 3), (None, None, "y", 1, 6)], key=str)
