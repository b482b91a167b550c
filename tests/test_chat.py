"""Chat turns: a turn's items spelled out, and the fold against one event after the other."""

import random

from pyspark.sql import functions as F

from gradeloom.operators import chat

SCHEMA = "k string, o long, kind string, text string, call string, name string, args string, is_error boolean, confirmation long, url string, input_tokens long, output_tokens long, usd double, state string"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def event(k, o, kind, **fields):
    return tuple({"k": k, "o": o, "kind": kind, **fields}.get(f) for f in FIELDS)


TURN = [
    event("a", 1, "token", text="Let me "), event("a", 2, "token", text="look."), event("a", 3, "tool_call", call="c1", name="grep", args="{}"), event("a", 4, "tool_call", call="c2", name="read", args="{}"),
    event("a", 5, "tool_result", call="c1", text="no hit", is_error=True), event("a", 6, "ui", name="navigate", url="/task/7"), event("a", 7, "usage", input_tokens=10, output_tokens=2, usd=0.5), event("a", 8, "token", text="May I?"),
    event("a", 9, "confirm", name="save", args="[1]", confirmation=5), event("a", 10, "usage", input_tokens=1, output_tokens=1, usd=0.25), event("a", 11, "token", text="Sorry"), event("a", 12, "error", text="lost"), event("a", 13, "done", state="waiting"),
    event("b", 1, "token", text="still writing"), event("c", 1, "tool_result", call="c9", text="of no call"), event("c", 2, "tool_call", call="c9", name="x"),
]


def test_a_turn_with_an_open_call_a_question_and_an_error(spark):
    events = spark.createDataFrame(TURN, SCHEMA).repartition(3)
    got = [tuple(r)[1:] for r in chat.items(events, "k", "o").where("k = 'a'").orderBy("item").collect()]
    assert got == [
        (0, "agent", "Let me look.", None, None, None, None, None, None, None), (1, "tool", None, "c1", "grep", "{}", "no hit", True, None, None), (2, "tool", None, "c2", "read", "{}", None, None, None, "open"),
        (3, "ui", "/task/7", None, "navigate", None, None, None, None, None), (4, "agent", "May I?", None, None, None, None, None, None, None), (5, "confirm", None, None, "save", "[1]", None, None, 5, "pending"),
        (6, "agent", "Sorry", None, None, None, None, None, None, None), (7, "error", "lost", None, None, None, None, None, None, None),
    ]
    assert [tuple(r)[:3] for r in chat.items(events, "k", "o").where("k <> 'a'").collect()] == [("c", 0, "tool")]
    state = {r.k: tuple(r)[1:] for r in chat.turns(events, "k", "o").collect()}
    assert state == {"a": (None, "/task/7", 11, 3, 0.75, True), "b": ("still writing", None, 0, 0, 0.0, False), "c": ("", None, 0, 0, 0.0, False)}
    decisions = spark.createDataFrame([("a", 5, "accepted", 1), ("a", 5, "rejected", 2), ("a", 6, "rejected", 1)], "k string, confirmation long, decision string, place int")
    states = [r.state for r in chat.decided(chat.items(events, "k", "o"), decisions, "k").where("kind = 'confirm'").collect()]
    assert states == ["accepted"]


def one_by_one(events):
    """Items and state of a turn, event after event."""
    items, partial, navigate, used, waiting = [], None, None, [0, 0, 0.0], False

    def flush():
        nonlocal partial
        if partial:
            items.append(["agent", partial, None, None, None])
        partial = None

    for e in events:
        e = dict(zip(FIELDS, e, strict=True))
        if e["kind"] == "token":
            partial = (partial or "") + (e["text"] or "")
        elif e["kind"] in ("tool_call", "confirm"):
            flush()
            partial = ""
            items.append(["tool", None, e["call"], None, "open"] if e["kind"] == "tool_call" else ["confirm", None, e["call"], None, "pending"])
        elif e["kind"] == "tool_result":
            for item in items:
                if item[0] == "tool" and e["call"] is not None and item[2] == e["call"]:
                    item[3], item[4] = e["text"], None
        elif e["kind"] == "ui":
            items.append(["ui", e["url"], e["call"], None, None])
            if e["name"] == "navigate" and e["url"]:
                navigate = e["url"]
        elif e["kind"] == "usage":
            used = [used[0] + e["input_tokens"], used[1] + e["output_tokens"], used[2] + e["usd"]]
        elif e["kind"] == "done":
            flush()
            waiting = e["state"] == "waiting"
        elif e["kind"] == "error":
            flush()
            items.append(["error", e["text"], e["call"], None, None])
    return [(k, *item) for k, item in enumerate(items)], (partial, navigate, *used, waiting)


def test_turns_fold_as_one_event_after_the_other(spark):
    rng = random.Random(6)
    made = {}
    for k in range(60):
        kinds = ["token"] * 4 + ["tool_call", "tool_result", "tool_result", "ui", "confirm", "usage", "done", "error"]
        made[str(k)] = [event(str(k), o * 3, rng.choice(kinds), text=rng.choice(["x", "y ", "", None]), call=rng.choice(["1", "2", None]), name=rng.choice(["navigate", "open"]), url=rng.choice(["/a", "/b", "", None]), input_tokens=o, output_tokens=1, usd=0.5, state=rng.choice(["waiting", "idle"])) for o in range(rng.randrange(1, 25))]
    events = spark.createDataFrame([e for turn in made.values() for e in turn], SCHEMA).repartition(5)
    items = {}
    for r in chat.items(events, "k", "o").orderBy("k", "item").collect():
        items.setdefault(r.k, []).append((r.item, r.kind, r.text, r.call, r.result, r.state))
    state = {r.k: (r.partial, r.navigate_to, r.input_tokens, r.output_tokens, r.usd, r.waiting) for r in chat.turns(events, "k", "o").collect()}
    for k, turn in made.items():
        want_items, want_state = one_by_one(turn)
        assert items.get(k, []) == want_items and state[k] == want_state, (turn, items.get(k), state[k])


def test_history_and_usage(spark):
    messages = spark.createDataFrame([("s", 1, "user", "hi", 0, 0), ("s", 2, "agent", "yes", 1000, 200), ("t", 1, "user", None, None, None)], "k string, id long, role string, content string, input_tokens long, output_tokens long")
    calls = spark.createDataFrame([("s", 7, 2, "grep", "ok", False), ("s", 6, 2, "read", None, None), ("s", 8, 1, "sql", "no", True), ("s", 9, 99, "gone", "x", False)], "k string, id long, message long, tool string, summary string, is_error boolean")
    asked = spark.createDataFrame([("s", 3, "save", None), ("s", 2, "drop", "reject")], "k string, id long, tool string, decision string")
    assert [(r.kind, r.of, r.text, r.state) for r in chat.history(messages, calls, asked, "k").where("k = 's'").orderBy("place").collect()] == [
        ("user", 1, "hi", None), ("tool", 8, "sql", "error"), ("agent", 2, "yes", None), ("tool", 6, "read", "open"), ("tool", 7, "grep", "done"), ("confirm", 3, "save", "pending"),
    ]
    sessions = spark.createDataFrame([("s", "m"), ("t", "m"), ("u", "other")], "k string, model string")
    prices = spark.createDataFrame([("m", 3.0, 15.0)], "model string, input double, output double")
    assert sorted(tuple(r) for r in chat.usage(sessions, messages, prices, "k").select("k", "input_tokens", "output_tokens", "turns", F.coalesce("usd", F.lit(-1.0))).collect()) == [("s", 1000, 200, 1, 0.006), ("t", 0, 0, 0, 0.0), ("u", 0, 0, 0, -1.0)]
