"""Text functions of the corpus: built-in expressions, with explicit character classes."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = "[ \\t\\n\\x0B\\f\\r]+"
#: Letters and what they fold to.
FOLD_FROM, FOLD_TO = "ąćęłńóśźżäöüàâçèéêëîïôùûÿñáíúß", "acelnoszzaouaaceeeeiiouuynaius"
#: Words that a search leaves out.
STOP_WORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it")


def collapse(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def search_terms(text: Column, prefixes: tuple[int, ...] = (4, 6)) -> Column:
    """Folded words of two characters or more that aren't stop words, each with its beginnings. One pass over the text."""
    words = F.regexp_extract_all(fold(text), F.lit("[a-z0-9]{2,}"), F.lit(0))
    forms = lambda w: F.filter(F.array(w, *[F.when(F.length(w) > n, F.substring(w, 1, n)) for n in prefixes]), lambda x: x.isNotNull())
    return F.flatten(F.transform(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)), forms))


def reason_label(reason: Column) -> Column:
    """A refusal's text before the first bracket or quote."""
    return F.trim(F.regexp_extract(reason, "^([^(\"'„]*)", 1))


def first_match(text: Column, phrases: list[tuple[str, list[str]]], default: str) -> Column:
    """The first label one of whose phrases the lower-cased text contains."""
    low = F.lower(text)
    out = F.when(F.lit(False), F.lit(default))
    for label, found in phrases:
        hit = F.lit(False)
        for p in found:
            hit = hit | low.contains(p)
        out = out.when(hit, label)
    return out.otherwise(default)


def csv_has(column: Column, value: str) -> Column:
    """Membership in a set that is kept as comma separated text."""
    return F.array_contains(F.split(column, ","), value)


def csv_first(column: Column) -> Column:
    return F.get(F.split(column, ","), F.lit(0))


def session_date(token: Column) -> Column:
    """YYMM (years 15-30) becomes 20YY-MM, YYT (terms 1-3 of 15-23) the term's month, anything else ''."""
    year, rest = F.substring(token, 1, 2), F.substring(token, 3, 2)
    month = token.rlike("^(1[5-9]|2[0-9]|30)(0[1-9]|1[0-2])$")
    term = token.rlike("^(1[5-9]|2[0-3])[1-3]$")
    months = F.element_at(F.array(F.lit("01"), F.lit("05"), F.lit("06")), F.when(term, F.substring(token, 3, 1).try_cast("int")).otherwise(1))
    return F.when(month, F.concat(F.lit("20"), year, F.lit("-"), rest)).when(term, F.concat(F.lit("20"), year, F.lit("-"), months)).otherwise("")


def clip(text: Column, most: int) -> Column:
    """At most ``most`` characters, with an ellipsis if some are left out."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def snippet(text: Column, term: Column, width: int = 300) -> Column:
    """``width`` characters around the first place of a term, from a third of the width before it."""
    at = F.position(term, text)
    start = F.greatest(F.lit(1), at - width // 3)
    body = F.substring(text, start, F.lit(width))
    left, right = F.when(start > 1, "…").otherwise(""), F.when(start + width - 1 < F.length(text), "…").otherwise("")
    return F.when(at > 0, F.concat(left, body, right))


def same_text(a: Column, b: Column) -> Column:
    """Whether two texts are equal but for case and white space."""
    return F.lower(collapse(a)).eqNullSafe(F.lower(collapse(b)))


def real_content(text: Column, placeholders: tuple[str, ...] = ("to do", "todo", "tbd", "placeholder")) -> Column:
    """Whether a text says something: neither blank nor a placeholder."""
    return (F.length(F.trim(F.coalesce(text, F.lit("")))) > 0) & ~F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(placeholders))


def from_vocabulary(value: Column, words: dict[str, str]) -> Column:
    """The word's translation; a word that isn't in the vocabulary is an error."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for a, b in words.items():
        out = out.when(value == a, b)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown word: "), value)))


def started_at(given: Column, now: Column) -> Column:
    """When something began: not after now, now if it isn't said or isn't a time; a time without a zone is UTC."""
    return F.least(F.coalesce(F.try_to_timestamp(given), now), now)


#: Signs that stand for a minus.
MINUS = "−–—‒"


def plain_signs(text: Column) -> Column:
    """Dashes as minus, and the letters and digits of mathematical alphabets as plain ones."""
    alphabets = [(0x1D400, 26, 13, "A"), (0x1D41A, 26, 13, "a")]
    t = F.translate(text, MINUS, "-" * len(MINUS))
    # the alphabets follow each other, 26 capitals and 26 small letters each; a letter that has a place of its own elsewhere is missing in one
    source = "".join(chr(first + 52 * k + i) for first, n, times, _ in alphabets for k in range(times) for i in range(n))
    target = "".join(chr(ord(base) + i) for _, n, times, base in alphabets for _ in range(times) for i in range(n))
    digits = "".join(chr(0x1D7CE + i) for i in range(50))
    return F.translate(t, source + digits, target + "0123456789" * 5)


def _merged(text: Column, mark: str) -> Column:
    run = rf"(?:\{mark}[^{mark}]){{2,}}"
    runs = F.transform(F.regexp_extract_all(text, F.lit(f"({run})"), F.lit(1)), lambda r: F.concat(F.lit(f"{mark}("), F.replace(r, F.lit(mark), F.lit("")), F.lit(")")))
    return F.array_join(F.flatten(F.zip_with(F.split(text, run), runs, lambda p, r: F.array(p, F.coalesce(r, F.lit(""))))), "")


def merged_scripts(text: Column) -> Column:
    """Runs of superscripts or subscripts as one: k^-^1^0 becomes k^(-10)."""
    return _merged(_merged(text, "^"), "_")


def canonical_json(values: dict[str, Column]) -> Column:
    """An object's JSON with sorted keys; nulls are kept."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]), {"ignoreNullFields": "false"})


def migration_hash(text: Column) -> Column:
    """SHA-256 of a script without a byte order mark and with plain line ends."""
    return F.sha2(F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n", "\n"), 256)


def page_window(page: Column, next_page: Column, last: Column, most: int = 5) -> Column:
    """The pages from a task's to the next task's, at most ``most`` and none behind the last."""
    return F.sequence(page, F.greatest(page, F.least(F.coalesce(next_page, last), page + (most - 1), last)))


def percent(part: Column, whole: Column) -> Column:
    """part of whole as 12.5%, 0.0% of nothing; of two figures as near the even one.

    The share counts as the double that it is, whatever its shortest decimal form: 20 times it is compared exactly, in two halves of its bits."""
    share = F.when(whole > 0, 100 * part / whole).otherwise(0.0)
    d = F.abs(share)
    wide = d * 134217729.0
    high = wide - (wide - d)
    k = F.floor(d * 10)
    over = (20 * high - (2 * k + 1)) + 20 * (d - high)
    tenths = k + F.when((over > 0) | ((over == 0) & (k % 2 != 0)), 1).otherwise(0)
    return F.concat(F.when(share < 0, "-").otherwise(""), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))


#: Words that are units, signs and what they are written as.
UNIT_WORDS = ("km", "cm", "dm", "mm", "m", "min", "h", "s", "kg", "dag", "g", "t", "l", "ml", "ha", "zl", "zł", "szt", "pkt")
SIGNS = {"⋅": "\\cdot", "∙": "\\cdot", "·": "\\cdot", "×": "\\times", "∶": "\\div", ":": "\\div", "÷": "\\div", "≈": "\\approx", "≤": "\\le", "≥": "\\ge", "≠": "\\ne", "≡": "\\equiv", "π": "\\pi", "∆": "\\Delta", "Δ": "\\Delta"}
TIGHT_SIGNS = {"≪": " < ", "≫": " > ", "∘": "^{\\circ}"}
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
#: Words that lead to an expression, and words that end it.
LEADING = r"(?i)^\s*(?:zapisanie|obliczenie|wyznaczenie|ustalenie|podanie|przedstawienie)\s*:?\s*"
TRAILING = r"(?is)\s*(?:(?:^|[^\p{L}])(?:lub|albo|oraz|bez|gdzie|jeżeli|jeśli|przy|dla|i)(?:[^\p{L}].*)?$|,\s*(?:gdzie|np)(?:[^\p{L}].*)?$)"


def prose_word(text: Column) -> Column:
    """The first word of three letters or more that is neither a unit nor a command; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[\^_]\{[^{}]*\}", " "), r"\\[A-Za-z]+", " ")
    words = F.filter(F.regexp_extract_all(bare, F.lit(r"(\p{L}{3,})"), F.lit(1)), lambda w: ~F.lower(w).isin(*UNIT_WORDS))
    return F.get(words, F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def compatible(text: Column) -> Column:
    """Characters in their compatible, composed form (as NFKC has it): letters with one mark behind them are composed, marks aren't put into order."""
    blocks = [range(0xA0, 0x3400), range(0xF900, 0x10000), range(0x1D400, 0x1D800), range(0x1F100, 0x1F200)]
    forms = {chr(c): unicodedata.normalize("NFKC", chr(c)) for block in blocks for c in block}
    single = {c: f for c, f in forms.items() if c != f and len(f) == 1}
    wide = {c: f for c, f in forms.items() if len(f) > 1}
    marked = {unicodedata.normalize("NFD", c): f for c, f in forms.items() if len(f) == 1 and len(unicodedata.normalize("NFD", c)) == 2}
    table = F.from_json(F.lit(json.dumps(wide | marked)), "map<string,string>")  # a constant
    # only characters of these ranges can be other than they are
    touched = F.lit("[\u00a0-\u33ff\uf900-\uffff\\x{1D400}-\\x{1D7FF}\\x{1F100}-\\x{1F1FF}\\p{M}]")

    def composed(t: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(t, F.lit(r"(?s)(\P{M}\p{M}|.)"), F.lit(1)), lambda x: F.when(F.length(x) > 1, F.coalesce(F.try_element_at(table, x), x)).when(x.rlike("[" + "".join(wide) + "]"), F.coalesce(F.try_element_at(table, x), x)).otherwise(x))
        return F.when(t.rlike("[\\p{M}" + "".join(wide) + "]"), F.array_join(pieces, "")).otherwise(t)

    translated = lambda t: let(F.translate(t, "".join(single), "".join(single.values())), composed)
    return let(text, lambda t: F.when(F.regexp_like(t, touched), translated(t)).otherwise(t))


#: Fixed value: a term of a fraction on one line: a number, a letter by itself, or what is in brackets.
TERM = r"(\d+(?:[.,]\d+)?|(?<![A-Za-z])[A-Za-z](?![A-Za-z])|\([^()]*\)|\[[^\[\]]*\])"


def expression(text: Column) -> Column:
    """Struct (latex, reason) of a key's expression: roots, prose and what has nothing to count are refused.

    Fractions on a line are written as such until nothing changes, brackets within brackets too; a finished fraction is no term of another."""
    t = text
    for digit, sign in enumerate(SUPERSCRIPTS):
        t = F.replace(t, F.lit(sign), F.lit(f"^{{{digit}}}"))
    return let(F.trim(F.regexp_replace(F.regexp_replace(plain_signs(compatible(t)), TRAILING, ""), LEADING, "")), _expression)


def _fractions(t: Column) -> Column:
    # each pass writes a slash or more as a fraction, so that there are no more passes than slashes
    slashes = F.length(t) - F.length(F.replace(t, F.lit("/"), F.lit("")))
    passes = F.when(slashes > 0, F.sequence(F.lit(1), slashes)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(passes, t, lambda made, _: F.regexp_replace(made, rf"{TERM}\s*/\s*{TERM}", r"\\frac{$1}{$2}"))


def _expression(bare: Column) -> Column:
    t = bare
    for sign, command in SIGNS.items():
        t = F.replace(t, F.lit(sign), F.lit(f" {command} "))
    for sign, command in TIGHT_SIGNS.items():
        t = F.replace(t, F.lit(sign), F.lit(command))
    t = F.regexp_replace(F.regexp_replace(t, r"([\^_])\(([^()]*)\)", "$1{$2}"), r"([\^_])(-?[\p{L}\p{N}])", "$1{$2}")
    t = let(F.regexp_replace(t, r"(\d),(?=\d)", "$1."), _fractions)
    t = F.regexp_replace(F.trim(F.regexp_replace(F.replace(t, F.lit("%"), F.lit("\\%")), r"\s+", " ")), "[.;,]+$", "")
    return let(t, lambda t: let(prose_word(t), lambda word: _judged(bare, t, word)))


def _judged(bare: Column, t: Column, word: Column) -> Column:
    reason = F.when(bare == "", "empty").when(bare.contains("√"), "root").when(word.isNotNull(), F.concat(F.lit("prose: "), word)).when(~t.rlike("[0-9A-Za-z]"), "nothing to count")
    return F.struct(F.when(reason.isNull(), t).alias("latex"), reason.alias("reason"))
