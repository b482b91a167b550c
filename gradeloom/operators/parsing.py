"""Marking keys read into rows: tasks, exam forms, answers, solutions, criteria, notes and rules.

A key is a text; its dialect decides the patterns it is read with (``dialects``). Each step adds columns to rows, or
makes rows of the parts of one column, so that a pattern runs once over a text; keys are read in parallel and only
small tables are shuffled. Rows without a part are left out behind the rows made of it: a filter on a part would be
pushed down to the texts, with all patterns that the part is made of once more. Patterns use no look-around, so that other engines can check them.

Texts that lack the words of a pattern aren't searched for it (``may_match``), and parts of a body are cut where a pattern was
replaced by one character: Spark compiles a pattern that is replaced once, but one that a text is split by for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dialects import DASH, FORMS, READERS, by, dialect, may_match

#: How keys are written in all dialects.
TASK = rf"Zadanie\s+(\d+(?:\.\d+)*)\.\s*\(\s*(?:0\s*{DASH}\s*(\d+)|(\d+)\s*pkt)\s*\)"
FORM = r"\b([A-Z]{4})-((?:[A-Z]\d-)?[A-Z0-9]{3})(?:-(\d{4}))?\b"
VERSIONS = r"(?i)wersj\w*\s+arkusza:?\s+([A-Z])\s+i\s+([A-Z])"
EXAM_DATE = r"Termin\s*egzaminu:\s*(\d{1,2})\s+(\S+)\s+(\d{4})"
MONTHS = ("stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "września", "października", "listopada", "grudnia")
SUB_POINT = r"^(\d+(?:\.\d+)+)\.?\s+(.+)$"
SOLUTION_POINTS = r"ocenion\w+ na\s+(\d+)\s+punkt"
CRITERIA = "Zasady oceniania"
ASIDE = r"\((?:lub|albo)[^)]*\)"
FOR_EXAMPLE = r"^.*?,?\s*np\.\s*"
NOTE_BORDER = r"\n\s*(\d+\.\s)"
RULE_RANGE = rf"zadani\w+\s+(\d+)[.,]?\s*{DASH}\s*(\d+)"
RULE_LIST = r"zadani\w+\s+(\d+)\.(?:,| i)\s.*?(\d+)\."
#: The kind of a rule by phrases of which all have to occur, the first row that fits wins.
RULE_KINDS = [
    ("arithmetic", ["błęd", "rachunkow"]),
    ("result_only", ["tylko poprawny końcowy wynik"]),
    ("result_only", ["tylko poprawny wynik"]),
    ("contradictory", ["sprzecznych"]),
    ("adapted", ["dostosowanych zasad"]),
    ("adapted", ["dyskalkulią"]),
    ("calculator", ["kalkulator"]),
]


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def one_line(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tidy(text: Column) -> Column:
    """One line without bullets in front, commas and semicolons at its ends, and the criteria's heading."""
    return F.trim(F.replace(F.btrim(F.ltrim(one_line(text), F.lit("•– -")), F.lit(" ,;")), F.lit(CRITERIA), F.lit("")))


#: What stands for a border in a text that is to be cut there.
_CUT = "\u0001"


def _split(text: str, pattern: str) -> Column:
    """A column cut at all matches of a pattern that matches no empty text."""
    whole = F.col(text)
    cut = F.when(whole.contains(_CUT), F.split(whole, pattern)).otherwise(F.split(F.regexp_replace(whole, pattern, _CUT), _CUT))
    return F.when(may_match(whole, pattern), cut).when(whole.isNotNull(), F.array(whole))


def _replace(text: str, pattern: str, shown: str) -> Column:
    return F.when(may_match(F.col(text), pattern), F.regexp_replace(text, pattern, shown)).otherwise(F.col(text))


def _extract(text: str, pattern: str, group: int) -> Column:
    return F.when(may_match(F.col(text), pattern), F.regexp_extract(text, pattern, group)).when(F.col(text).isNotNull(), F.lit(""))


def _extract_all(text: str, pattern: str, group: int) -> Column:
    return F.when(may_match(F.col(text), pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).when(F.col(text).isNotNull(), F.array().cast("array<string>"))


def _lines(block: Column) -> Column:
    return F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def exam_date(text: Column) -> Column:
    """The date of the exam from the key's header; null if it has none or the month is unknown."""
    part = lambda k: F.regexp_extract(_text(text), EXAM_DATE, k)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(2)))
    return F.when(month > 0, F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(1), 2, "0")).try_cast("date"))


def tasks(keys: DataFrame, key: str, text: str, name: str | None = None) -> DataFrame:
    """key, dialect, ordinal, number, points, body, starts: a task from the end of its header to the next one, the last up to its dialect's end marker; page lines aren't part of a body."""
    t = _text(F.col(text))
    told = keys.select(key, t.alias("_t"), dialect(F.col(text), F.col(name) if name else F.lit("")).alias("dialect"))
    cut = told.select(key, "dialect", F.split("_t", TASK).alias("_parts"), F.regexp_extract_all("_t", F.lit(TASK), F.lit(0)).alias("_heads"))
    # where each body starts: the lengths of all before it, added up along the array
    lengths = F.zip_with(F.slice("_parts", 1, F.size("_heads")), "_heads", lambda p, h: F.length(p) + F.length(h))
    starts = F.aggregate(lengths, F.array().cast("array<int>"), lambda acc, n: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n))
    # the last body is cut before there are rows: a filter on what is made of a row's parts is pushed down and makes it twice
    cut = cut.select("*", F.element_at("_parts", -1).alias("_tail"), starts.alias("_starts"))
    last = F.when(F.size("_heads") > 0, F.array(by("task_end", lambda p: F.get(_split("_tail", p), F.lit(0))))).otherwise(F.array().cast("array<string>"))
    bodies = F.concat(F.slice("_parts", 2, F.greatest(F.size("_parts") - 2, F.lit(0))), last)
    cut = cut.select(key, "dialect", "_starts", F.arrays_zip(bodies.alias("body"), F.col("_heads").alias("head")).alias("_tasks"))
    rows = cut.select(key, "dialect", "_starts", F.posexplode_outer("_tasks").alias("_k", "_z")).where(F.col("_k").isNotNull() & (F.length("_z.body") > 0))
    part = lambda g: F.nullif(F.regexp_extract("_z.head", TASK, g), F.lit(""))
    points = F.coalesce(part(2), part(3)).cast("int")
    out = rows.select(key, "dialect", (F.col("_k") + 1).alias("ordinal"), part(1).alias("number"), points.alias("points"), F.col("_z.body").alias("_body"), F.get("_starts", F.col("_k")).cast("long").alias("starts"))
    return out.select(key, "dialect", "ordinal", "number", "points", by("page", lambda p: _replace("_body", p, "")).alias("body"), "starts")


def page_of(pages: DataFrame, places: DataFrame, key: str, page: str, text: str, at: str) -> DataFrame:
    """places with the page that holds the character at: pages are joined by one character each."""
    w = Window.partitionBy(key).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    begins = pages.select(key, F.col(page).alias("page"), F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0)).cast("long").alias(at))
    both = begins.withColumn("_row", F.lit(0)).unionByName(places.withColumn("_row", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy(at, "_row").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("page", F.last(F.when(F.col("_row") == 0, F.col("page")), ignorenulls=True).over(upto)).where("_row = 1").drop("_row")


def forms(keys: DataFrame, key: str, text: str) -> DataFrame:
    """key, code, variant, session, version: each form once, with both versions if its line names two."""
    lines = keys.select(key, F.posexplode_outer(F.split(_text(F.col(text)), "\n")).alias("_k", "_line"))
    part = lambda k: F.regexp_extract_all("_line", F.lit(FORM), F.lit(k))
    pair = lambda k: F.upper(F.regexp_extract("_line", VERSIONS, k))
    versions = F.when(pair(1) != "", F.array(pair(1), pair(2))).otherwise(F.array(F.lit(None).cast("string")))
    found = lines.select(key, "_k", versions.alias("_versions"), F.posexplode_outer(F.arrays_zip(part(1).alias("code"), part(2).alias("variant"), part(3).alias("session"))).alias("_i", "_f")).where(F.col("_f").isNotNull())
    first = found.groupBy(key, "_f.code", "_f.variant").agg(F.min_by(F.struct(F.nullif(F.col("_f.session"), F.lit("")).alias("session"), "_versions"), F.struct("_k", "_i")).alias("_x"))
    return first.select(key, "code", "variant", "_x.session", F.explode("_x._versions").alias("version"))


def sections(found: DataFrame) -> DataFrame:
    """Tasks with the parts of their bodies.

    _answer (the block that the first successful reader took) and its _versions, _solved (heading) and _solutions,
    _criteria (from their heading, or the body's begin, to the answers or solutions behind) and _notes."""
    readers = range(1, READERS + 1)
    rows = found.select("*", *[by(f"answers_{k}", lambda p: _extract("body", p, 0)).alias(f"_taken_{k}") for k in readers], by("solutions", lambda p: _extract("body", p, 0)).alias("_head"))
    rows = rows.withColumn("_solved", F.nullif("_head", F.lit("")))
    # a reader's block is what its third group holds; it succeeds if that isn't blank
    group = lambda k, g: by(f"answers_{k}", lambda p: _extract(f"_taken_{k}", p, g))
    rows = rows.select("*", *[group(k, 3).alias(f"_block_{k}") for k in readers])
    rows = rows.select("*", F.coalesce(*[F.when(F.col(f"_block_{k}").rlike(r"\S"), F.lit(k)) for k in readers]).alias("_won"))
    won = lambda value: F.coalesce(*[F.when(F.col("_won") == k, value(k)) for k in readers])
    rows = rows.select("*", won(lambda k: F.col(f"_taken_{k}")).alias("_taken"), won(lambda k: F.col(f"_block_{k}")).alias("_block"), won(lambda k: F.array(group(k, 1), group(k, 2))).alias("_both"))
    rows = rows.select(
        "*", F.coalesce("_block", F.lit("")).alias("_answer"), F.when(F.get("_both", F.lit(0)) != "", F.col("_both")).alias("_versions"),
        F.position(F.col("_taken"), F.col("body")).alias("_answer_at"), F.position("_solved", F.col("body")).alias("_solved_at"), F.position(F.lit(CRITERIA), F.col("body")).alias("_heading_at"),
    )
    begin = F.greatest(F.col("_heading_at"), F.lit(1))
    behind = lambda c: F.when(F.col(c) > begin, F.col(c))
    end = F.coalesce(F.least(behind("_answer_at"), behind("_solved_at")), F.length("body") + 1)
    rows = rows.select("*", F.substr(F.col("body"), begin, end - begin).alias("_text"), F.substr(F.col("body"), F.col("_solved_at") + F.length("_solved")).alias("_solutions"))
    rows = rows.select("*", by("notes", lambda p: F.get(_split("_text", p), F.lit(0))).alias("_criteria"), by("notes", lambda p: _extract("_text", p, 0)).alias("_noted"))
    notes = F.when(F.col("_noted") != "", F.substr(F.col("_text"), F.length("_criteria") + F.length("_noted") + 1))
    return rows.select(*found.columns, "_solved", "_answer", "_versions", "_solutions", "_criteria", notes.alias("_notes"))


def answers(cut: DataFrame, key: str) -> DataFrame:
    """Model answers of sections: key, ordinal, version, part, answer, place; lines that are all numbered are parts.

    Of two columns the second row of a number belongs to the second version, any further one to the first; rows without
    numbers are a version each. Of one block without numbers the first line is the answer."""
    lines = cut.select(key, "ordinal", "_versions", _lines(F.col("_answer")).alias("_lines"))
    numbers = F.transform("_lines", lambda x: F.regexp_extract(x, SUB_POINT, 1))
    rows = lines.select(key, "ordinal", "_versions", F.size("_lines").alias("_n"), numbers.alias("_numbers"), F.posexplode_outer("_lines").alias("place", "_line")).where(F.col("_line").isNotNull())
    twins, at = F.col("_versions").isNotNull(), F.col("place")
    number = F.get("_numbers", at)
    listed = (F.array_position("_numbers", F.lit("")) == 0) & (~twins | (F.col("_n") >= 2))
    before = F.size(F.array_compact(F.filter(F.slice("_numbers", 1, at + 1), lambda n: n == number))) - 1
    version = F.when(listed, F.coalesce(F.get("_versions", before), F.get("_versions", F.lit(0)))).otherwise(F.get("_versions", at))
    answer = F.when(listed, F.regexp_extract("_line", SUB_POINT, 2)).otherwise(F.col("_line"))
    shown = F.when(twins & listed, answer).otherwise(F.substring(answer, 1, 200))
    wanted = listed | (twins & (at < 2)) | (at == 0)
    return rows.where(wanted).select(key, "ordinal", F.when(twins, version).alias("version"), F.when(listed, number).alias("part"), shown.alias("answer"), "place")


def solutions(cut: DataFrame, key: str) -> DataFrame:
    """Example solutions of sections: key, ordinal, method, points, content, place; without methods one, if it is longer than 20 characters."""
    points = F.regexp_extract(one_line(F.col("_solved")), SOLUTION_POINTS, 1).try_cast("int")
    rows = cut.select(key, "ordinal", points.alias("points"), by("method", lambda p: F.split("_solutions", p)).alias("_parts"), by("method", lambda p: F.regexp_extract_all("_solutions", F.lit(p), F.lit(1))).alias("_methods"))
    each = rows.select(key, "ordinal", "points", F.size("_methods").alias("_n"), "_methods", F.posexplode_outer("_parts").alias("_k", "_part"))
    content = F.substring(one_line(F.col("_part")), 1, 4000)
    shown = each.select(key, "ordinal", F.get("_methods", F.col("_k") - 1).alias("method"), "points", content.alias("content"), F.col("_k").alias("place"), "_n")
    return shown.where((F.col("place") > 0) | ((F.col("_n") == 0) & (F.length("content") > 20))).drop("_n")


def notes(cut: DataFrame, key: str) -> DataFrame:
    """A task's own notes: key, ordinal, number, content, place (from 0): at most six, of 16 characters or more."""
    parts = F.split(F.regexp_replace("_notes", NOTE_BORDER, "\u0001$1"), "\u0001")
    long = F.slice(F.filter(parts, lambda x: F.length(F.btrim(x, F.lit(" \t\n\r\f"))) > 15), 1, 6)
    rows = cut.select(key, "ordinal", "number", F.posexplode_outer(long).alias("place", "_note"))
    return rows.where(F.col("_note").isNotNull()).select(key, "ordinal", "number", one_line(F.col("_note")).alias("content"), "place")


def thresholds(cut: DataFrame, key: str) -> DataFrame:
    """Thresholds of sections, the first of each number of points: key, ordinal, place (from 1), points, label, and the _block of its conditions."""
    heads = cut.select(key, "dialect", "ordinal", by("threshold", lambda p: _split("_criteria", p)).alias("_parts"), by("threshold", lambda p: _extract_all("_criteria", p, 0)).alias("_heads"))
    points = F.transform("_heads", lambda h: F.regexp_extract(h, r"(\d+)", 1).cast("int"))
    # never null: else a filter on it would be inferred and pushed down to the texts with all that it is made of
    heads = heads.select(key, "dialect", "ordinal", F.coalesce(points, F.array().cast("array<int>")).alias("_all"), F.arrays_zip(F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))).alias("rest"), F.col("_heads").alias("head")).alias("_zipped"))
    rows = heads.select(key, "dialect", "ordinal", "_all", F.posexplode_outer("_zipped").alias("_k", "_z")).where(F.col("_k").isNotNull())
    number = F.get("_all", F.col("_k"))
    rows = rows.where(F.array_position("_all", number) == F.col("_k") + 1)
    # which form a head has: only that form's groups hold anything, its points and what is left of the line
    forms = range(1, FORMS + 1)
    shown = "".join(f"${2 * k - 1}{_CUT}" for k in forms) + "".join(f"${2 * k}" for k in forms)
    rows = rows.select("*", F.split(by("threshold", lambda p: F.regexp_replace("_z.head", p, shown)), _CUT, FORMS + 1).alias("_groups"))
    form = lambda value: F.coalesce(*[F.when(F.get("_groups", F.lit(k - 1)) != "", value(k)) for k in forms])
    tail = F.trim(F.rtrim(F.ltrim(F.get("_groups", F.lit(FORMS)), F.lit(" \t–—−-")), F.lit(" \t–—-")))
    before = F.size(F.array_distinct(F.slice("_all", 1, F.col("_k") + 1)))
    rows = rows.select(key, "dialect", "ordinal", before.alias("place"), number.alias("points"), tail.alias("_tail"), form(lambda k: by(f"tail_is_condition_{k}", lambda said: F.lit(said == "True"))).alias("_inline"), F.col("_z.rest").alias("_rest"))
    block = F.when(F.col("_inline"), F.concat("_tail", F.lit("\n"), "_rest")).otherwise(F.col("_rest"))
    return rows.select(key, "dialect", "ordinal", "place", "points", F.when(~F.col("_inline"), F.nullif("_tail", F.lit(""))).alias("label"), block.alias("_block"))


def conditions(found: DataFrame, key: str) -> DataFrame:
    """Conditions of thresholds: key, ordinal, points, label, place (from 1), description and the expressions that are worth the same."""
    cut = found.select(key, "dialect", "ordinal", "points", "label", by("alternative", lambda p: _split("_block", p)).alias("_parts"))
    cut = cut.select(key, "dialect", "ordinal", "points", "label", F.arrays_zip(F.col("_parts").alias("part"), F.transform("_parts", tidy).alias("said")).alias("_zipped"))
    rows = cut.select(key, "dialect", "ordinal", "points", "label", F.posexplode_outer("_zipped").alias("_k", "_z")).where(F.col("_z.said") != "")
    said = rows.select(key, "dialect", "ordinal", "points", "label", "_k", F.col("_z.said").alias("_said"), F.regexp_replace("_z.part", ASIDE, "").alias("_bare"))
    said = said.select(key, "ordinal", "points", "label", "_k", "_said", by("equivalent", lambda p: _split("_bare", p)).alias("_pieces"))
    several = F.when(F.size("_pieces") > 1, F.filter(F.transform("_pieces", tidy), lambda x: x != ""))  # else there is nothing worth the same
    pieces = said.select(key, "ordinal", "points", "label", "_k", "_said", several.alias("_pieces"))
    first = F.get("_pieces", F.lit(0))
    begun = F.regexp_replace(first, FOR_EXAMPLE, "")
    shown = F.concat(F.array(F.when(begun == "", first).otherwise(begun)), F.slice("_pieces", 2, 5))
    expressions = F.when(F.size("_pieces") > 1, shown).otherwise(F.array().cast("array<string>"))
    return pieces.select(key, "ordinal", "points", "label", (F.col("_k") + 1).alias("place"), F.substring("_said", 1, 600).alias("description"), expressions.alias("expressions"))


def task_kind(n_solutions: Column, n_answers: Column, points: Column) -> Column:
    """closed if the key answers it without a solution, else by its points."""
    return F.when((n_solutions == 0) & (n_answers > 0), "closed").when(points <= 2, "short").otherwise("extended")


def rule_kind(text: Column) -> Column:
    """What a rule is about."""
    out = F.lit("other")
    for kind, phrases in reversed(RULE_KINDS):
        holds = F.lit(True)
        for phrase in phrases:
            holds &= text.contains(phrase)
        out = F.when(holds, kind).otherwise(out)
    return out


def rules(keys: DataFrame, key: str, text: str, name: str | None = None) -> DataFrame:
    """Rules for several tasks: key, kind, content, low, high, position (from 0): the marked items of 20 to 600 characters that stand in the 4000 behind their heading and before a task."""
    told = keys.select(key, _text(F.col(text)).alias("_t"), dialect(F.col(text), F.col(name) if name else F.lit("")).alias("dialect"))
    parts = told.select(key, "dialect", by("rules", lambda p: F.split("_t", p, 2)).alias("_parts"))
    tail = parts.select(key, "dialect", F.element_at(F.split(F.substring(F.get("_parts", F.lit(1)), 1, 4000), TASK, 2), 1).alias("_tail"))
    block = tail.select(key, "dialect", by("page", lambda p: F.regexp_replace("_tail", p, "")).alias("_block"))
    marked = block.select(key, "dialect", by("rule_border", lambda p: F.regexp_replace("_block", p, "\u0001\n$1")).alias("_marked"))
    items = marked.select(key, F.posexplode_outer(by("rule_item", lambda p: F.regexp_extract_all("_marked", F.lit(p), F.lit(1)))).alias("position", "_item")).where(F.col("_item").isNotNull())
    said = items.select(key, "position", one_line(F.regexp_replace("_item", "\u0001", " ")).alias("content"))
    end = lambda k: F.coalesce(*[F.nullif(F.regexp_extract("content", p, k), F.lit("")) for p in (RULE_RANGE, RULE_LIST)])
    return said.select(key, rule_kind(F.col("content")).alias("kind"), "content", end(1).alias("low"), end(2).alias("high"), "position")


def note_rules(noted: DataFrame, key: str) -> DataFrame:
    """Notes as rules of one task: key, kind, content, low, high, position (1000 + 10 * ordinal + place)."""
    return noted.select(key, rule_kind(F.col("content")).alias("kind"), "content", F.col("number").alias("low"), F.col("number").alias("high"), (1000 + 10 * F.col("ordinal") + F.col("place")).alias("position"))


def facts(cut: DataFrame, key: str) -> DataFrame:
    """What each task has: key, ordinal, number, kind, answered, solved, judged (has thresholds)."""
    answered = F.trim(F.regexp_replace(F.coalesce("_answer", F.lit("")), r"\s+", " ")) != ""
    methods = by("method", lambda p: F.regexp_count("_solutions", F.lit(p)))
    solved = F.col("_solved").isNotNull() & ((methods > 0) | (F.length(one_line(F.col("_solutions"))) > 20))
    judged = F.coalesce(by("threshold", lambda p: F.col("_criteria").rlike(p)), F.lit(False))
    rows = cut.select(key, "ordinal", "number", "points", answered.alias("answered"), F.coalesce(solved, F.lit(False)).alias("solved"), judged.alias("judged"))
    kind = task_kind(F.col("solved").cast("int"), F.col("answered").cast("int"), F.col("points"))
    return rows.select(key, "ordinal", "number", kind.alias("kind"), "answered", "solved", "judged")


def warnings(keys: DataFrame, told: DataFrame, found_forms: DataFrame, key: str) -> DataFrame:
    """What a reader of a key should know: key, warning, n, of, tasks; told: facts; keys give those without tasks too.

    Closed tasks without criteria are only a gap where other closed tasks of the key have some; their first eight numbers are named."""
    closed, bare = F.col("kind") == "closed", ~F.col("judged")
    unjudged = F.sort_array(F.collect_list(F.when(closed & bare, F.struct("ordinal", "number"))))
    per = told.groupBy(key).agg(
        F.count_if(~closed & bare).alias("open_bare"), F.count_if(~closed).alias("open"), F.count_if(closed & ~bare).alias("closed_judged"), F.count_if(closed).alias("closed"),
        F.count_if(closed & ~F.col("answered")).alias("unanswered"), unjudged.alias("_unjudged"), F.count(F.lit(1)).alias("tasks"),
    )
    formed = found_forms.select(key).distinct().withColumn("_formed", F.lit(True))
    rows = keys.select(key).join(per, key, "left").join(formed, key, "left")
    long = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    said = lambda name, n, of, named=None: F.struct(F.lit(name).alias("warning"), n.cast("long").alias("n"), of.cast("long").alias("of"), (F.lit("") if named is None else named).alias("named"))
    named = F.array_join(F.transform(F.slice(F.coalesce("_unjudged", F.array().cast("array<struct<ordinal:int,number:string>>")), 1, 8), lambda x: x["number"]), ", ")
    one = F.lit(1)
    every = F.array(
        F.when(F.col("_formed").isNull(), said("no form in the header", one, one)),
        F.when(long("tasks") == 0, said("no task", one, one)),
        F.when(long("open_bare") > 0, said("open tasks without criteria", long("open_bare"), long("open"))),
        F.when((long("closed_judged") > 0) & (long("closed_judged") < long("closed")), said("closed tasks without criteria", long("closed") - long("closed_judged"), long("closed"), named)),
        F.when(long("unanswered") > 0, said("closed tasks without answer", long("unanswered"), long("closed"))),
    )
    return rows.select(key, F.explode_outer(F.array_compact(every)).alias("_w")).where(F.col("_w").isNotNull()).select(key, "_w.*")


def match_versions(versions: DataFrame, papers: DataFrame, key: str, letter: str, value: str) -> DataFrame:
    """versions with the paper of their letter; the only paper of an only version; else the paper without a letter."""
    own = papers.where(F.col(letter).isNotNull()).select(F.col(key).alias("_k"), F.col(letter).alias("_l"), F.col(value).alias("_own"))
    per = papers.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_any"), F.min(F.when(F.col(letter).isNull(), F.col(value))).alias("_plain"))
    counted = versions.withColumn("_v", F.count(F.lit(1)).over(Window.partitionBy(key)))
    joined = counted.join(own, (F.col(key) == own["_k"]) & (F.col(letter) == own["_l"]), "left").drop("_k", "_l").join(per, F.col(key) == per["_k"], "left")
    only = F.when((F.col("_v") == 1) & (F.col("_n") == 1), F.col("_any"))
    return joined.withColumn(value, F.coalesce("_own", only, "_plain")).drop("_k", "_v", "_own", "_n", "_any", "_plain")


def first_answer(versions: DataFrame, answered: DataFrame, key: str, letter: str, ordinal: str, answer: str) -> DataFrame:
    """versions with their letter's answer, a version without a letter with the first answer of its task."""
    own = answered.groupBy(F.col(key).alias("_k"), F.col(letter).alias("_l")).agg(F.min_by(answer, ordinal).alias("_own"))
    first = answered.groupBy(F.col(key).alias("_f")).agg(F.min_by(answer, ordinal).alias("_first"))
    joined = versions.join(own, (F.col(key) == F.col("_k")) & F.col(letter).eqNullSafe(F.col("_l")), "left").join(first, F.col(key) == F.col("_f"), "left")
    return joined.withColumn(answer, F.coalesce("_own", F.when(F.col(letter).isNull(), F.col("_first")))).drop("_k", "_l", "_f", "_own", "_first")
