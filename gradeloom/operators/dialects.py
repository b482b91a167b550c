"""How marking keys of different years are written, as a table: dialect, role, place, pattern.

One plan reads keys of all dialects: ``by`` turns a role's rows of the table into a choice by the row's dialect, in which
each pattern is a constant and compiled once (a pattern that comes as a column is compiled anew whenever two rows' dialects
differ); ``with_layout`` joins the table itself. Roles with several patterns are ordered by place, and the first that
succeeds wins. Patterns use no look-around."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How keys are written.
DASH = "[–—−-]"
OLD_POINTS = r"(?m)^[ \t]*Zdający otrzymuje[ \t.…]*(\d+)[ \t]*(?:p\.|pkt)[ \t]*$"
MODERN_PAGE = rf"Egzamin ósmoklasisty z .{{3,40}}?{DASH} termin .{{3,30}}?\d{{4}} r\."
SECONDARY_NAME = "^[EM]M[A-Z]{2}-"

_NOTE_MARK = r"(?:\^\(?[\d,]*\)?)?"
_BY_VERSIONS = rf"(?s)Rozwiązanie\s*{DASH}\s*wersja\s*([A-Z]){_NOTE_MARK}\s*\n\s*Rozwiązanie\s*{DASH}\s*wersja\s*([A-Z]){_NOTE_MARK}\s*\n(.+?)(?:\n\s*\n|\z)"
_BY_TABLE = rf"(?s)Rozwiązanie\s*\n\s*Wersja\s+([A-Z]){_NOTE_MARK}\s*\n\s*Wersja\s+([A-Z]){_NOTE_MARK}\s*\n(.+?)(?:\n\s*\n|\z)"
_ALONE = r"(?sm)^[ \t]*Rozwiązanie[ \t]*()()\n(.+?)(?:\n\s*\n|\z)"

#: points, then what is left of the line
_GIVEN = r"^[ \t]*Zdający otrzymuje[ \t.…]*(\d+)[ \t]*(?:p\.|pkt)[ \t]*()$"
_HEADER = r"^[ \t]*(\d+)[ \t]+punkt(?:y|ów)?((?:[^\pL\pN_\n][^\n]*)?)$"
_LINE = r"^[ \t]*(\d+)[ \t]*pkt((?:[^\pL\pN_\n][^\n]*)?)$"

_PAGE = r"(?m)^\s*(?:Strona\s+\d+\s+z\s+\d+|Zasady oceniania rozwiązań zadań|Egzamin {exam} z .{{3,{wide}}}?[-–—] termin .{{3,30}}?\d{{4}} r\.)\s*$"
_PRIMARY_PAGE = _PAGE.format(exam="ósmoklasisty", wide=40)
_SECONDARY_PAGE = _PAGE.format(exam="maturalny", wide=60)
_LUB = r"\n\s*LUB\s*,?\s*\n"
_ANY_LUB = r"\n\s*(?:LUB|lub)\s*,?\s*\n"
_ALBO = r"\n\s*ALBO\s*,?\s*\n"
_ONLY_ALBO = r"\n\s*albo\s*,?\s*\n|\s{3,}albo\s{3,}"
_EITHER = r"\n\s*(?:albo|lub)\s*,?\s*\n|\s{3,}(?:albo|lub)\s{3,}"
_NOTES = r"\n\s*Uwag[ai][.:]?\s*\n"
_PRIMARY_METHOD = r"(?m)^\s*(I{1,3}V?|VI{0,3})\s+sposób"
_SECONDARY_METHOD = r"(?m)^\s*Sposób\s+(\d+|I{1,3}V?|VI{0,3})\.?"
_PRIMARY_SOLUTIONS = r"Przykładowe rozwiązani\w*[^\n]*"
_SECONDARY_SOLUTIONS = r"Przykładow\w+ (?:pełn\w+ )?rozwiązani\w*[^\n]*"
_PRIMARY_END = r"\n\s*(?:Ogólne zasady oceniania|Ocena prac)"
_GENERAL_NOTES = r"(?m)^\s*Uwagi ogólne:?\s*$"

#: dialect, role, place, pattern
PATTERNS = [
    ("e8-2019", "threshold_label", 1, _HEADER),
    ("e8-2019", "threshold_line", 2, _LINE),
    ("e8-2019", "alternative", 1, _ANY_LUB),
    ("e8-2019", "equivalent", 1, _ONLY_ALBO),
    ("e8-2019", "answers", 1, _ALONE),
    ("e8-2019", "solutions", 1, _PRIMARY_SOLUTIONS),
    ("e8-2019", "method", 1, _PRIMARY_METHOD),
    ("e8-2019", "notes", 1, _NOTES),
    ("e8-2019", "rules", 1, _GENERAL_NOTES),
    ("e8-2019", "rule_mark", 1, "•"),
    ("e8-2019", "task_end", 1, _PRIMARY_END),
    ("e8-2019", "page", 1, _PRIMARY_PAGE),
    ("e8-2020", "threshold_label", 1, _HEADER),
    ("e8-2020", "threshold_line", 2, _LINE),
    ("e8-2020", "alternative", 1, _LUB),
    ("e8-2020", "equivalent", 1, _EITHER),
    ("e8-2020", "answers", 1, _BY_VERSIONS),
    ("e8-2020", "answers", 2, _ALONE),
    ("e8-2020", "solutions", 1, _PRIMARY_SOLUTIONS),
    ("e8-2020", "method", 1, _PRIMARY_METHOD),
    ("e8-2020", "notes", 1, _NOTES),
    ("e8-2020", "rules", 1, _GENERAL_NOTES),
    ("e8-2020", "rule_mark", 1, "•"),
    ("e8-2020", "task_end", 1, _PRIMARY_END),
    ("e8-2020", "page", 1, _PRIMARY_PAGE),
    ("matura", "threshold_line", 1, _LINE),
    ("matura", "alternative", 1, _ALBO),
    ("matura", "equivalent", 1, _EITHER),
    ("matura", "answers", 1, _BY_TABLE),
    ("matura", "answers", 2, _BY_VERSIONS),
    ("matura", "answers", 3, _ALONE),
    ("matura", "solutions", 1, _SECONDARY_SOLUTIONS),
    ("matura", "method", 1, _SECONDARY_METHOD),
    ("matura", "notes", 1, _NOTES),
    ("matura", "rules", 1, _GENERAL_NOTES),
    ("matura", "rule_mark", 1, r"\d+\."),
    ("matura", "task_end", 1, r"\n\s*(?:Ocena prac osób ze stwierdzoną dyskalkulią|I{1,2}\.\s*Dodatkowe szczegółowe zasady oceniania|Ogólne zasady oceniania)"),
    ("matura", "page", 1, _SECONDARY_PAGE),
    ("matura-2015", "threshold_label", 1, _GIVEN),
    ("matura-2015", "threshold_line", 2, _HEADER),
    ("matura-2015", "threshold_line", 3, _LINE),
    ("matura-2015", "alternative", 1, _ALBO),
    ("matura-2015", "equivalent", 1, _EITHER),
    ("matura-2015", "answers", 1, _BY_VERSIONS),
    ("matura-2015", "answers", 2, _BY_TABLE),
    ("matura-2015", "answers", 3, _ALONE),
    ("matura-2015", "solutions", 1, _SECONDARY_SOLUTIONS),
    ("matura-2015", "method", 1, _SECONDARY_METHOD),
    ("matura-2015", "notes", 1, _NOTES),
    ("matura-2015", "rules", 1, r"(?m)^\s*ZADANIA OTWARTE[^\n]*$"),
    ("matura-2015", "rule_mark", 1, r"\d+\."),
    ("matura-2015", "task_end", 1, r"\n\s*(?:Ogólne zasady oceniania zadań otwartych|Kryteria uwzględniające specyficzne trudności|Ocena prac osób ze stwierdzoną dyskalkulią)"),
    ("matura-2015", "page", 1, _SECONDARY_PAGE),
]

DIALECTS = list(dict.fromkeys(d for d, *_ in PATTERNS))
READERS = max(place for _, role, place, _ in PATTERNS if role == "answers")
FORMS = max(place for _, role, place, _ in PATTERNS if role.startswith("threshold"))
SINGLE = ["alternative", "equivalent", "solutions", "method", "notes", "rules", "task_end", "page"]
#: Matches nowhere: the place of a form that a dialect doesn't have.
_NOTHING = r"\z\A.()()"


def _one(dialect: str, role: str, place: int = 1) -> str | None:
    return next((p for d, r, k, p in PATTERNS if (d, r, k) == (dialect, role, place)), None)


def layout(dialect: str) -> dict[str, str | bool | None]:
    """A dialect's patterns by column: single roles, readers of answers, all forms of a threshold as one pattern, rules."""
    forms = [(r == "threshold_line", p) for d, r, _, p in sorted(PATTERNS, key=lambda x: x[2]) if d == dialect and r.startswith("threshold")]
    spare = FORMS - len(forms)
    mark = _one(dialect, "rule_mark")
    row: dict[str, str | bool | None] = {"dialect": dialect} | {role: _one(dialect, role) for role in SINGLE}
    row |= {f"answers_{k}": _one(dialect, "answers", k) for k in range(1, READERS + 1)}
    row["threshold"] = "(?m)(?:" + "|".join([p for _, p in forms] + [_NOTHING] * spare) + ")"
    row |= {f"tail_is_condition_{k + 1}": forms[k][0] if k < len(forms) else None for k in range(FORMS)}
    # a rule reaches to the next mark or blank line, which rule_border finds and rule_item expects as the character 1
    behind = "" if mark == "•" else r"\s"
    row["rule_border"] = rf"\n\s*({mark}{behind}|\n)"
    row["rule_item"] = "(?sm)" + ("" if mark == "•" else r"^\s*") + rf"{mark}\s*(.{{20,600}}?)\x01"
    return row


_PAGE_SAYS = ["Strona", "Zasady oceniania rozwiązań zadań", "Egzamin"]
#: What a text says where a pattern matches, at least one of these; a text without them needs no search. Patterns that aren't named here may match anywhere.
SAYS = {
    OLD_POINTS: ["Zdający otrzymuje"], MODERN_PAGE: ["Egzamin ósmoklasisty z "], _GIVEN: ["Zdający otrzymuje"], _HEADER: ["punkt"], _LINE: ["pkt"],
    _LUB: ["LUB"], _ANY_LUB: ["LUB", "lub"], _ALBO: ["ALBO"], _ONLY_ALBO: ["albo"], _EITHER: ["albo", "lub"],
    _BY_VERSIONS: ["Rozwiązanie"], _BY_TABLE: ["Rozwiązanie"], _ALONE: ["Rozwiązanie"], _PRIMARY_SOLUTIONS: ["Przykładow"], _SECONDARY_SOLUTIONS: ["Przykładow"],
    _PRIMARY_METHOD: ["sposób"], _SECONDARY_METHOD: ["Sposób"], _NOTES: ["Uwag"], _PRIMARY_PAGE: _PAGE_SAYS, _SECONDARY_PAGE: _PAGE_SAYS,
}
SAYS |= {str(layout(d)["threshold"]): [w for one, r, _, p in PATTERNS if one == d and r.startswith("threshold") for w in SAYS[p]] for d in DIALECTS}


def may_match(text: Column, pattern: str) -> Column:
    """False where a text lacks what each match of a pattern says: looking for that costs much less than the pattern."""
    out = F.lit(False) if pattern in SAYS else F.lit(True)
    for said in SAYS.get(pattern, []):
        out = out | text.contains(said)
    return out


LAYOUT_COLUMNS = [c for c in layout(DIALECTS[0]) if c != "dialect"]


def layouts(spark: SparkSession) -> DataFrame:
    """A row for each dialect."""
    schema = "dialect string, " + ", ".join(f"{c} {'boolean' if c.startswith('tail_is') else 'string'}" for c in LAYOUT_COLUMNS)
    return spark.createDataFrame([tuple(layout(d).values()) for d in DIALECTS], schema)


def layouts_sql() -> str:
    """The same rows as SQL."""
    def show(v: object) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"

    rows = ", ".join("(" + ", ".join(show(v) for v in layout(d).values()) + ")" for d in DIALECTS)
    return f"layouts(dialect, {', '.join(LAYOUT_COLUMNS)}) AS (VALUES {rows})"


def dialect(text: Column, name: Column) -> Column:
    """The layout of a key: by what it says, the file's name only tells the exam."""
    t = F.coalesce(text, F.lit(""))
    says = lambda p: may_match(t, p) & t.rlike(p)
    secondary = F.substring(t, 1, 4000).contains("Egzamin maturalny") | F.coalesce(name, F.lit("")).rlike(SECONDARY_NAME)
    return F.when(secondary, F.when(says(OLD_POINTS), "matura-2015").otherwise("matura")).otherwise(F.when(says(MODERN_PAGE), "e8-2020").otherwise("e8-2019"))


def by(role: str, make: Callable[[str], Column]) -> Column:
    """What is made with the pattern that a row's dialect has for a role; null where it has none. Rows have a column dialect."""
    dialects_of: dict[str, list[str]] = {}
    for name in DIALECTS:
        pattern = layout(name)[role]
        if pattern is not None:
            dialects_of.setdefault(str(pattern), []).append(name)
    out = None
    for pattern, names in dialects_of.items():
        chosen = F.col("dialect").isin(*names)
        out = F.when(chosen, make(pattern)) if out is None else out.when(chosen, make(pattern))
    return F.lit(None) if out is None else out


def with_layout(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rows, which have a dialect, with the patterns of their dialect (four rows, broadcast)."""
    wanted = LAYOUT_COLUMNS if columns is None else columns
    return rows.join(F.broadcast(layouts(rows.sparkSession).select("dialect", *wanted)), "dialect")
