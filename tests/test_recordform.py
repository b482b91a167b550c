"""Records as forms and back."""

import random

from gradeloom.operators import recordform

SCHEMA = "task long, " + recordform.RECORD


def record(task, points=2, versions=None, criteria=None):
    return (task, f"{task}.1", points, "short", versions or [], criteria or [])


STORED = [
    record(1, versions=[(10, "text", [(20, "A"), (21, "B")]), (11, None, [])], criteria=[(30, 2, None, "all", [(40, "done", [(50, "x=1"), (51, "x=2")]), (41, "else", [])]), (31, 1, "begun", None, [(42, "", [(52, "y")])])]),
    record(2), record(3, criteria=[(32, 1, None, None, [])]),
]
GIVEN = [
    record(1, points=3, versions=[(10, "new text", [(20, "A'"), (99, "of no stored version")])], criteria=[(30, 3, "full", "all", [(40, "done well", [(51, "x=3")])])]),
    record(2), record(3, criteria=[(32, 1, None, None, []), (None, 0, None, None, [])]), record(4),
]


def test_a_record_becomes_a_form_with_deletes(spark):
    stored, given = spark.createDataFrame(STORED, SCHEMA), spark.createDataFrame(GIVEN, SCHEMA)
    got = {}
    for r in recordform.form(stored, given, "task").collect():
        assert r.path not in got.setdefault(r.task, {})
        got[r.task][r.path] = r.value
    assert got == {
        1: {
            "task.number": "1.1", "task.max_points": "3", "task.kind": "short", "add_requirement": "", "version.10.content": "new text", "answer.20.answer": "A'", "delete.answer.21": "1",
            "criterion.30.points": "3", "criterion.30.label": "full", "criterion.30.description": "all", "condition.40.description": "done well", "expression.51.expression": "x=3",
            "delete.criterion.31": "1", "delete.condition.41": "1", "delete.expression.50": "1",  # nothing of 42 and 52, which go with 31
        },
        2: {"task.number": "2.1", "task.max_points": "2", "task.kind": "short", "add_requirement": ""},
    }
    assert [tuple(r) for r in recordform.uncreated(given, "task").collect()] == [(3, "criterion", 1)]


def test_a_form_applied_gives_the_record(spark):
    stored, given = spark.createDataFrame(STORED[:2], SCHEMA), spark.createDataFrame(GIVEN[:2], SCHEMA)
    got = {r.task: r for r in recordform.apply(stored, recordform.form(stored, given, "task"), "task").collect()}
    one = got[1]
    assert (one.number, one.max_points, one.kind) == ("1.1", 3, "short")
    assert [(v.id, v.content, [tuple(a) for a in v.answers]) for v in one.versions] == [(10, "new text", [(20, "A'")]), (11, None, [])]  # a version that lacks stays
    assert [(c.id, c.points, c.label, c.description, [(w.id, w.description, [tuple(e) for e in w.expressions]) for w in c.conditions]) for c in one.criteria] == [(30, 3, "full", "all", [(40, "done well", [(51, "x=3")])])]
    assert (got[2].versions, got[2].criteria) == ([], [])
    # a record that says what is stored changes nothing
    same = {r.task: r for r in recordform.apply(stored, recordform.form(stored, stored, "task"), "task").collect()}
    for r in stored.collect():
        assert same[r.task].versions == r.versions and [c.id for c in same[r.task].criteria] == [c.id for c in r.criteria]
    left = spark.createDataFrame(list(got.values()), SCHEMA)
    again, first = recordform.form(stored, left, "task"), recordform.form(stored, given, "task")
    assert {tuple(r) for r in again.where("path not like '%version.11%'").collect()} == {tuple(r) for r in first.collect()}


def brute_form(stored, given):
    """(key, path, value) of a form, row by row over dictionaries."""
    def rows(record):  # kind, id, parent, fields
        _, _, _, _, versions, criteria = record
        for v in versions:
            yield "version", v[0], None, {"content": v[1]}
            yield from (("answer", a[0], v[0], {"answer": a[1]}) for a in v[2])
        for c in criteria:
            yield "criterion", c[0], None, {"points": c[1], "label": c[2], "description": c[3]}
            for w in c[4]:
                yield "condition", w[0], c[0], {"description": w[1]}
                yield from (("expression", e[0], w[0], {"expression": e[1]}) for e in w[2])

    out, old = [], {r[0]: r for r in stored}
    for g in given:
        if g[0] not in old or any(i is None for _, i, _, _ in rows(g)):
            continue
        was, now = {r[:3] for r in rows(old[g[0]])}, {r[:3] for r in rows(g)}
        out += [(g[0], "task.number", g[1]), (g[0], "task.max_points", str(g[2])), (g[0], "task.kind", g[3]), (g[0], "add_requirement", "")]
        out += [(g[0], f"{k}.{i}.{f}", "" if v is None else str(v)) for k, i, p, fields in rows(g) if k not in ("version", "answer") or (k, i, p) in was for f, v in fields.items()]
        kept = {r[:2] for r in now}
        out += [(g[0], f"delete.{k}.{i}", "1") for k, i, p in was - now if k == "criterion" or k != "version" and (recordform.PARENTS[k], p) in kept]
    return sorted(out)


def test_forms_are_those_of_brute_force(spark):
    rng = random.Random(3)
    few = lambda make, n=3: [make(i) for i in rng.sample(range(5), rng.randrange(n))]  # noqa: E731  # ids are few, so that rows move between parents

    def made(task):
        name = lambda: rng.choice([None, "", "a", "b|c.1"])
        expressions = lambda: few(lambda i: (i, name()))
        return record(task, rng.randrange(4), few(lambda i: (i, name(), few(lambda j: (j, name()), 4))), few(lambda i: (i, rng.randrange(3), name(), name(), few(lambda j: (j, name(), expressions())))))

    stored, given = [made(t) for t in range(60)], [made(t) for t in range(5, 64)]
    given[7] = record(12, criteria=[(1, 1, None, None, [(None, "no id", [])])])
    got = recordform.form(spark.createDataFrame(stored, SCHEMA).repartition(3), spark.createDataFrame(given, SCHEMA), "task")
    assert sorted(tuple(r) for r in got.collect()) == brute_form(stored, given)


def test_a_form_is_made_in_one_shuffle_of_each_side(spark):
    from gradeloom.plans import forms

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = forms.record_forms(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 2
