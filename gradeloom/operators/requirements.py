"""Requirements of a key: the acts it refers to, the tables that list requirements, and the task each table belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dialects import DASH
from .parsing import one_line

#: Captions that name an act, the special ones before the general ones; without a name the years in them are it.
YEAR = r"(\d{4})"
CAPTIONS = [
    (1, r"Wymagania egzaminacyjne\s+(\d{4})(?:\s+i\s+(\d{4}))?", None),
    (2, r"Podstawa programowa\s*\^?\(?\d*\)?\s*2012", "pp2012"),
    (3, r"Podstawa programowa\s*\^?\(?\d*\)?\s*2017", "pp2017"),
    (4, r"Wymagania określone w podstawie programowej", "pp-akt"),
    (5, r"Podstawa programowa", "pp-akt"),
]
#: Numbers in the gazette and the act they mean, the first that occurs decides what a caption without a year means.
GAZETTE = [(1, r"poz\.\s*996", "pp2024"), (2, r"poz\.\s*1019", "pp2024"), (3, r"poz\.\s*356", "pp2017"), (4, r"poz\.\s*977", "pp2012")]
GENERAL = "pp-akt"
#: Footnotes, places in the gazette, parts of tables of requirements.
REFERENCE = r"(?:\s*\^?\(?(\d{1,2})\)?)?"
NOTE_BORDER = r"(\n|\s\^?\d{1,2}\s*(?:Rozporządzenie|Załącznik))"
NOTE = r"(?s)(?:^|\s)\^?(\d{1,2})\s*((?:Rozporządzenie|Załącznik).{20,600}?)\x01"
PLACE = r"Dz\.\s*U\.[^)]{0,60}poz\.\s*\d+[^)]{0,20}"
HEADER_ROWS = 5
IN_GENERAL = r"^Wymagani[ae]\s+ogóln"
IN_DETAIL = r"^Wymagani[ae]\s+szczegół"
HEADER = "Wymagani"
NO_CONTENT = r"^(?:Podstawa programowa|Zadanie\s+\d)"
GENERAL_PATH = r"\b([IVX]+)\.\s*(.+)"
STAGE = rf"((?:KLASY|Klasy)\s+[IVX]+(?:\s*{DASH}\s*[IVX]+)?(?:\s+[iI]\s+[IVX]+)?|\b(?:IV\s*{DASH}\s*VI|VII\s*{DASH}\s*VIII)\b)"
_EXPLICIT = r"(?:[IVX]+|[GR]?\d+)(?:\.(?:[A-Z]?\d+|R\d+))?"
#: border of an item, then its section, number and content; the character 1 ends an item
ITEMS = {
    "section": (r"\s+(\d+\))", r"(?:([IVX]+|\d+)\.\s+[^:\x01]{3,90}?\.\s*(?:Uczeń|Zdający):)|(?:(\d+)\)\s+(.{5,}?)\x01)"),
    "explicit": (rf"\s+({_EXPLICIT}\))", rf"()\b({_EXPLICIT})\)\s+(.{{5,}}?)\x01"),
}
TOLERANCE = 6.0


def act_of(text: Column) -> Column:
    """The act of the first gazette number, in the table's order, that occurs in a text."""
    return F.coalesce(*[F.when(text.rlike(p), act) for _, p, act in GAZETTE])


def caption_name(match: Column, order: int) -> Column:
    """The name a caption gives: its years, or the name of its act."""
    _, pattern, name = CAPTIONS[order - 1]
    if name is not None:
        return F.lit(name)
    second = F.regexp_extract(match, pattern, 2)
    return F.concat(F.lit("wym"), F.regexp_extract(match, pattern, 1), F.when(second == "", "").otherwise(F.concat(F.lit("-"), second)))


def footnotes(keys: DataFrame, key: str, text: str, footer: str) -> DataFrame:
    """key, number, note: the footnotes of footer and text that name a decree, the last of a number."""
    whole = F.concat(F.coalesce(F.col(footer), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))
    marked = keys.select(key, F.concat(F.regexp_replace(whole, NOTE_BORDER, "\u0001$1"), F.lit("\u0001")).alias("_t"))
    zipped = F.arrays_zip(F.regexp_extract_all("_t", F.lit(NOTE), F.lit(1)).alias("number"), F.regexp_extract_all("_t", F.lit(NOTE), F.lit(2)).alias("note"))
    rows = marked.select(key, F.posexplode(zipped).alias("_k", "_n")).select(key, "_k", "_n.number", one_line(F.translate("_n.note", "\u0001", "")).alias("note"))
    return rows.groupBy(key, "number").agg(F.max_by("note", "_k").alias("note"))


def regimes(keys: DataFrame, key: str, text: str, footer: str, exam: Column) -> DataFrame:
    """key, code, caption, source, place (from 0): the acts that a key's captions name, each once, by the captions' order and then by place.

    A caption without a year means the act whose gazette number the key holds, whatever year it was printed in. source is the gazette's
    place in the caption's footnote, else the footnote's begin."""
    t = F.coalesce(F.col(text), F.lit(""))
    act = F.coalesce(act_of(F.concat(F.coalesce(F.col(footer), F.lit("")), F.lit("\n"), t)), F.lit(GENERAL))
    found = keys.select(key, exam.alias("_exam"), act.alias("_act"), *[
        x for order, pattern, _ in CAPTIONS for x in (F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)).alias(f"c{order}"), F.regexp_extract_all(t, F.lit(f"(?:{pattern}){REFERENCE}"), F.lit(1 + pattern.count(YEAR))).alias(f"r{order}"))
    ])
    every = []
    for order, _, _ in CAPTIONS:
        rows = found.select(key, "_exam", "_act", F.lit(order).alias("_order"), F.posexplode(F.arrays_zip(F.col(f"c{order}").alias("caption"), F.col(f"r{order}").alias("number"))).alias("_k", "_c"))
        every.append(rows.select(key, "_exam", "_act", "_order", "_k", "_c.caption", "_c.number", caption_name(F.col("_c.caption"), order).alias("_name")))
    captions = every[0]
    for more in every[1:]:
        captions = captions.unionByName(more)
    name = F.when(F.col("_name") == GENERAL, F.col("_act")).otherwise(F.col("_name"))
    coded = captions.select(key, F.concat_ws("-", "_exam", name).alias("code"), F.struct("_order", "_k").alias("_at"), one_line(F.col("caption")).alias("caption"), F.nullif("number", F.lit("")).alias("number"))
    first = coded.groupBy(key, "code").agg(F.min_by(F.struct("caption", "number"), "_at").alias("_c"), F.min("_at").alias("_at"))
    noted = first.select(key, "code", "_at", "_c.*").join(footnotes(keys, key, text, footer), [key, "number"], "left")
    place = F.nullif(F.regexp_extract("note", PLACE, 0), F.lit(""))
    ordered = F.row_number().over(Window.partitionBy(key).orderBy("_at")) - 1
    return noted.select(key, "code", "caption", F.coalesce(place, F.substring("note", 1, 200)).alias("source"), ordered.alias("place"))


def tables_of_tasks(headings: DataFrame, tables: DataFrame, tasks: DataFrame, key: str) -> DataFrame:
    """key, task (from 0), table, by_order: the first table behind a heading and before the next one, of which a table's frame may stand up to six points over it.

    headings and tables: key, page, y, tables with table; tasks: key, n. A key with fewer headings than tasks says nothing about
    places; its tables go to its tasks by order."""
    read = Window.partitionBy(key).orderBy("page", "y")
    numbered = headings.select(key, "page", "y").withColumn("task", F.row_number().over(read) - 1)
    counted = tasks.select(key, "n").join(numbered.groupBy(key).agg(F.count(F.lit(1)).alias("_h")), key, "left").withColumn("by_order", F.coalesce("_h", F.lit(0)) < F.col("n")).drop("_h")
    ordered = tables.select(key, "page", "y", "table").withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy("page", "y", "table")) - 1)
    heads = numbered.join(counted, key).where(~F.col("by_order") & (F.col("task") < F.col("n"))).select(key, "page", "y", "task", F.lit(0).alias("_kind"))
    told = ordered.join(counted, key)
    events = heads.unionByName(told.where(~F.col("by_order")).select(key, "page", (F.col("y") + TOLERANCE).alias("y"), "table", "_i", F.lit(1).alias("_kind")), allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy("page", "y", "_kind", "task", "_i").rowsBetween(Window.unboundedPreceding, 0)
    behind = events.withColumn("task", F.last("task", ignorenulls=True).over(upto)).where("_kind = 1 and task is not null")
    first = behind.withColumn("_k", F.row_number().over(Window.partitionBy(key, "task").orderBy("page", "y", "_i"))).where("_k = 1")
    placed = first.select(key, "task", "table", F.lit(False).alias("by_order"))
    return placed.unionByName(told.where(F.col("by_order") & (F.col("_i") < F.col("n"))).select(key, F.col("_i").alias("task"), "table", F.lit(True).alias("by_order")))


def _gathered(cells: DataFrame, key: list[str], *more: Column) -> DataFrame:
    """key, _rows: a table's rows (row, cells) in order, as one array."""
    return cells.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("_rows"), *more)


def _pairs(rows: str) -> Column:
    """The pairs (left, right) of columns of a table's rows."""
    places = lambda cells, pattern: F.filter(F.transform(cells, lambda c, i: F.when(F.trim(c).rlike(pattern), i)), lambda x: x.isNotNull())
    heads = F.filter(rows, lambda r: (r["row"] < HEADER_ROWS) & F.exists(r["cells"], lambda c: c.contains(HEADER)))
    told = F.transform(heads, lambda r: F.struct(places(r["cells"], IN_GENERAL).alias("a"), places(r["cells"], IN_DETAIL).alias("b")))
    named = F.filter(told, lambda x: (F.size(x["a"]) > 0) & (F.size(x["a"]) == F.size(x["b"])))
    first = F.get(F.transform(named, lambda x: F.arrays_zip(x["a"], x["b"]).cast("array<struct<left:int,right:int>>")), F.lit(0))
    wide = F.array_max(F.transform(rows, lambda r: F.size(r["cells"])))
    return F.coalesce(first, F.when(wide > 1, F.array(F.struct(F.lit(0).alias("left"), (wide - 1).alias("right")))))


def column_pairs(cells: DataFrame, key: list[str]) -> DataFrame:
    """key, pair (from 0), left, right: the columns of general and detailed requirements.

    cells: key, row (from 0), cells. The first of five rows that names as many of both tells; without one (a table cut by a page) the first and the last column."""
    return _gathered(cells, key).select(*key, F.posexplode(_pairs("_rows")).alias("pair", "_x")).select(*key, "pair", "_x.left", "_x.right")


def requirements(cells: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """key, table, kind (general, detailed), regime, stage, path, content, place of the tables of requirements, each once.

    cells: key, table, explicit (how paths are written), row, cells; codes: key, codes (of the key's regimes, in order). A pair of columns
    has the regime of its caption, else that of its place among the key's regimes, else the first. A stage holds for all that follows it.

    A table's rows are gathered once and read there; each pattern runs once over a text. Cells dealt out by key aren't shuffled again."""
    own = [key, "table"]
    tables = _gathered(cells.where(F.col(key).isNotNull() & F.col("table").isNotNull()), own, F.first("explicit").alias("explicit"))
    silent = lambda r: F.exists(r["cells"], lambda c: c.contains(HEADER) | F.trim(c).rlike(NO_CONTENT)) | F.forall(r["cells"], lambda c: F.trim(F.coalesce(c, F.lit(""))) == "")
    read = tables.select(*own, "explicit", "_rows", F.filter("_rows", lambda r: ~F.coalesce(silent(r), F.lit(False))).alias("_kept"))
    pairs = read.select(*own, "explicit", F.filter("_rows", lambda r: r["row"] < HEADER_ROWS).alias("_top"), "_kept", F.posexplode(F.when(F.size("_kept") > 0, _pairs("_rows"))).alias("pair", "_x"))
    # the caption over a pair
    caption = lambda cells: F.trim(F.array_join(F.slice(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), F.col("_x.left") + 1, F.col("_x.right") - F.col("_x.left") + 1), " "))
    over = F.filter(F.transform("_top", lambda r: caption(r["cells"])), lambda c: (c != "") & ~c.contains(HEADER))
    name = lambda c: F.coalesce(*[F.when(c.rlike(p), caption_name(F.regexp_extract(c, f"({p})", 1), order)) for order, p, _ in CAPTIONS])
    # what stands in the columns
    column = lambda c, end: F.array_join(F.transform(F.sort_array(F.transform("_kept", lambda r: F.struct(r["row"].alias("row"), F.coalesce(F.trim(F.get(r["cells"], F.col(c))), F.lit("")).alias("x")))), lambda r: r["x"]), end)
    told = pairs.select(*own, "pair", "explicit", F.get(F.filter(F.transform(over, name), lambda n: n.isNotNull()), F.lit(0)).alias("_n"), column("_x.left", " ").alias("_left"), column("_x.right", " \n").alias("_right"))
    named = F.when(F.col("_n") != GENERAL, F.coalesce(F.get(F.filter("codes", lambda c: c.endswith(F.col("_n"))), F.lit(0)), F.col("_n")))
    regime = F.coalesce(named, F.get("codes", F.col("pair")), F.get("codes", F.lit(0)))
    texts = told.join(codes, key, "left").select(*own, "pair", "explicit", regime.alias("regime"), "_left", "_right", F.regexp_extract_all("_right", F.lit(STAGE), F.lit(1)).alias("_stages"))
    # the general text, and the pieces of the detailed one that begin with a stage
    text = F.when(F.size("_stages") == 0, F.array("_right")).otherwise(F.split("_right", STAGE))
    piece = "array<struct<general:boolean,p:int,x:string,s:string>>"
    pieces = F.transform(F.arrays_zip(text.alias("x"), F.concat(F.array(F.lit(None).cast("string")), F.col("_stages")).alias("s")), lambda x, i: F.struct(F.lit(False), i, x["x"], x["s"])).cast(piece)
    general = F.array(F.struct(F.lit(True), F.lit(0), F.col("_left"), F.lit(None).cast("string"))).cast(piece)
    stage = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("_x.s"), "^(?:KLASY|Klasy)\\s+", ""), "\\s+[iI]\\s+", "-"), "\\s", ""), "[–—−]", "-")
    shown = texts.select(*own, "pair", "explicit", "regime", F.explode(F.concat(general, pieces)).alias("_x")).select(*own, "pair", "explicit", "regime", "_x.general", F.col("_x.p").alias("_p"), stage.alias("stage"), one_line(F.col("_x.x")).alias("_t"))
    # items end where the next begins; an item is a section with a colon behind it, or number, bracket, space, content and the mark
    items = F.when(F.col("general"), F.filter(F.array(F.regexp_extract("_t", GENERAL_PATH, 0)), lambda x: x != ""))
    for how, (border, item) in ITEMS.items():
        items = items.when(F.col("explicit") == (how == "explicit"), F.regexp_extract_all(F.concat(F.regexp_replace("_t", border, "\u0001$1"), F.lit("\u0001")), F.lit(item), F.lit(0)))
    found = shown.select(*own, "pair", "explicit", "regime", "general", "_p", "stage", F.posexplode(items).alias("_k", "_i"))
    heading = ~F.col("general") & F.col("_i").endswith(":")
    number = F.when(F.col("general"), F.substring_index("_i", ".", 1)).when(~heading, F.substring_index("_i", ")", 1))
    # a section holds for the points behind it in its piece
    upto = Window.partitionBy(*own, "pair", "general", "_p").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(heading, F.substring_index("_i", ".", 1)), ignorenulls=True).over(upto)
    numbered = found.withColumn("_n", number).withColumn("_section", section).where("_n is not null and (general or explicit or _section is not null)")
    inner = F.substr("_i", F.length("_n") + 3, F.length("_i") - F.length("_n") - 3)
    content = F.when(F.col("general"), F.trim(F.substr("_i", F.length("_n") + 2))).otherwise(one_line(F.translate(inner, "\u0001", " ")))
    path = F.when(F.col("general") | F.col("explicit"), F.col("_n")).otherwise(F.concat_ws(".", "_section", "_n"))
    kind = F.when(F.col("general"), "general").otherwise("detailed")
    both = numbered.select(*own, kind.alias("kind"), "regime", "stage", path.alias("path"), F.substring(content, 1, 400).alias("content"), F.struct("pair", "_p", "_k").alias("_at"))
    first = both.groupBy(*own, "kind", "regime", "stage", "path").agg(F.min_by("content", "_at").alias("content"), F.min("_at").alias("_at"))
    place = F.row_number().over(Window.partitionBy(*own, "kind").orderBy("_at")) - 1
    return first.select(*own, "kind", "regime", "stage", "path", "content", place.alias("place"))
