"""Documents cut into sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_lines(docs: DataFrame, key: str, text: str, is_heading: Callable[[Column], Column]) -> DataFrame:
    """key, section, body: a section begins at each heading; 0 holds what stands before the first."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("_k", "_line"))
    w = Window.partitionBy(key).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("section", F.sum(is_heading(F.col("_line")).cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_line"))), lambda x: x["_line"]), "\n")
    return numbered.groupBy(key, "section").agg(body.alias("body"))


def of_markdown(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, section, level, title, body: headings # to ###, not inside fences; what stands before has level 0."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("_k", "_line"))
    w = Window.partitionBy(key).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.sum(F.col("_line").rlike("^\\s*```").cast("int")).over(w) % 2
    lines = lines.withColumn("_head", (fence == 0) & F.col("_line").rlike("^#{1,3}\\s"))
    lines = lines.withColumn("section", F.sum(F.col("_head").cast("int")).over(w))
    head = F.max(F.when(F.col("_head"), F.col("_line")))
    rest = F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct("_k", "_line"))))
    found = lines.groupBy(key, "section").agg(head.alias("_h"), F.trim(F.array_join(F.transform(rest, lambda x: x["_line"]), "\n")).alias("body"))
    level = F.coalesce(F.length(F.regexp_extract("_h", "^(#+)", 1)), F.lit(0))
    return found.select(key, "section", level.alias("level"), F.coalesce(F.trim(F.regexp_replace("_h", "^#+", "")), F.lit("")).alias("title"), "body")


#: Elements left out, elements that begin a new line, and named characters with what they stand for.
LEFT_OUT = ("script", "style", "nav", "svg")
LINE_TAGS = ("p", "div", "li", "ul", "ol", "br", "tr", "table", "section", "article", "pre", "blockquote", "h4", "h5", "h6")
NAMED = {"nbsp": "\u00a0", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "mdash": "—", "ndash": "–", "hellip": "…", "eacute": "é", "ouml": "ö", "uuml": "ü", "auml": "ä", "szlig": "ß", "ntilde": "ñ", "copy": "©", "amp": "&"}
HEADING = "(?is)<h[1-3](?:\\s[^>]*)?>.*?</h[1-3]\\s*>"


def characters(text: Column, names: tuple[str, ...] | None = None) -> Column:
    """Text with its character references decoded: decimal and hexadecimal numbers and the names above, or only some of the names."""

    def decoded(piece: Column) -> Column:
        out = F.concat(F.lit("&"), piece)
        for pattern, base in (("^#([0-9]{1,7});", 10), ("^#[xX]([0-9a-fA-F]{1,6});", 16)) if names is None else ():
            digits = F.lpad(F.conv(F.regexp_extract(piece, pattern, 1), base, 16), 8, "0")
            out = F.when(piece.rlike(pattern), F.concat(F.decode(F.unhex(digits), "UTF-32"), F.regexp_replace(piece, pattern, ""))).otherwise(out)
        for name, char in ((k, v) for k, v in NAMED.items() if names is None or k in names):
            out = F.when(piece.startswith(f"{name};"), F.concat(F.lit(char), F.substr(piece, F.lit(len(name) + 2)))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, "&"), lambda piece, k: F.when(k == 0, piece).otherwise(decoded(piece))), "")


def _plain(part: Column) -> Column:
    """The lines of a piece of a page without tags, empty ones left out."""
    broken = F.regexp_replace(part, f"(?i)<({'|'.join(LINE_TAGS)})(?=[\\s/>])[^>]*>", "\n")
    lines = F.split(characters(F.regexp_replace(broken, "<[^>]*>", "")), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda line: F.trim(F.regexp_replace(line, "[\\s\u00a0]+", " "))), lambda line: line != ""), "\n")


def of_html(pages: DataFrame, key: str, html: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """key, section, level, title, body: a section for each h1 to h3, section 0 for what stands before, if it has text.

    With names only these character references are decoded in titles, and no numbers. Comments, scripts, styles, menus and drawings go first, headings in them too. Only built-in expressions."""
    bare = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), "(?s)<!--.*?-->", "")
    for tag in LEFT_OUT:
        bare = F.regexp_replace(bare, f"(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>", "")
    cut = pages.select(key, bare.alias("_bare"))
    cut = cut.select(key, F.regexp_extract_all("_bare", F.lit(f"({HEADING})"), F.lit(1)).alias("_heads"), F.split("_bare", HEADING).alias("_parts"))
    rows = cut.select(key, "_heads", F.posexplode("_parts").alias("section", "_part")).withColumn("_head", F.get("_heads", F.col("section") - 1))
    level = F.coalesce(F.substring("_head", 3, 1).cast("int"), F.lit(0))
    title = F.coalesce(F.trim(F.regexp_replace(characters(F.regexp_replace("_head", "<[^>]*>", ""), names), "[\\s\u00a0]+", " ")), F.lit(""))
    found = rows.select(key, "section", level.alias("level"), title.alias("title"), _plain(F.col("_part")).alias("body"))
    return found.where((F.col("level") > 0) | (F.col("body") != ""))
