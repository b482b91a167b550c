"""Links of pages resolved, and what a file's name tells: kind, code, variants, session, and how it is put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, session_date

#: Beginnings of names, ends of names, parts of folders, and the kinds they mean; earlier rows win.
PREFIXES = [("zasady_oceniania_", "marking_scheme"), ("zasady_", "marking_scheme"), ("arkusz_", "paper"), ("transkrypcja_", "transcript"), ("karta_", "answer_sheet")]
SUFFIXES = [
    (r"zasady[-_. ]oceniania", "marking_scheme"), (r"zasady", "marking_scheme"), (r"model", "marking_scheme"), (r"karta[-_. ]rozwiazan", "answer_sheet"), (r"karta[-_. ]odpowiedzi", "answer_sheet"), (r"karta", "answer_sheet"),
    (r"transkrypcja[-_. ]nagran", "transcript"), (r"transkrypcja", "transcript"), (r"zeszyt[-_. ]zadan", "paper"), (r"arkusz", "paper"), (r"aneks", "annex"), (r"przyk[lł]ady[-_. ]nutowe", "attachment"), (r"nutowe", "attachment"),
    (r"nuty", "attachment"), (r"mapa", "attachment"), (r"zalacznik", "attachment"),
]
FOLDERS = [("zasady_oceniania", "marking_scheme"), ("zasady oceniania", "marking_scheme"), ("odpowiedzi", "marking_scheme"), ("transkrypcje", "transcript"), ("transkrypcja", "transcript"), ("nagrania", "transcript")]
DEFAULT = "paper"
END = "(?i)[-_. ]+(" + "|".join(p for p, _ in SUFFIXES) + ")$"
#: A link to a document, with either quote and among other attributes; characters of a path that stay as they are.
HREF = r"""(?i)\bhref\s*=\s*["']([^"']+\.pdf)["']"""
SAFE = r"[A-Za-z0-9_.~/%:@!$&'()*+,;=-]"


def session(token: Column) -> Column:
    """The session of one part of a name, '' if it is none: YYMM, or YYT with a letter behind it or none."""
    return let(F.regexp_replace(token, "(?i)^([0-9]{2}[1-3])[a-z]$", "$1"), session_date)


def parse(name: Column, folder: Column) -> Column:
    """Struct (kind, kind_source, pattern, code, variants, session) of a file's name in a folder.

    The session is the last part that is one, wherever it stands; the parts around it are variants."""
    first = lambda rows, hit: F.coalesce(*[F.when(hit(p), F.struct(F.lit(k).alias("kind"), F.lit(p).alias("p"))) for p, k in rows])
    ended = lambda stem: let(F.regexp_extract(stem, END, 1), lambda tail: F.when(tail != "", first(SUFFIXES, lambda p: tail.rlike(f"(?i)^(?:{p})$"))))
    within = let(F.split(F.lower(F.coalesce(folder, F.lit(""))), "/"), lambda steps: first(FOLDERS, lambda p: F.exists(steps, lambda s: s.contains(p))))
    found = lambda stem: F.struct(stem.alias("stem"), let(F.lower(stem), lambda low: first(PREFIXES, low.startswith)).alias("begun"), ended(stem).alias("ended"), within.alias("within"))
    return let(let(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\.pdf$", ""), found), _parts)


def _parts(found: Column) -> Column:
    stem, begun, ended, within = (found[x] for x in ("stem", "begun", "ended", "within"))
    rest = F.when(begun.isNotNull(), F.substr(stem, F.length(begun["p"]) + 1)).when(ended.isNotNull(), F.regexp_replace(stem, END, "")).otherwise(stem)
    kind = F.coalesce(begun["kind"], ended["kind"], within["kind"], F.lit(DEFAULT))
    source = F.when(begun.isNotNull(), "prefix").when(ended.isNotNull(), "suffix").when(within.isNotNull(), "directory").otherwise("default")

    def told(parts: Column, sessions: Column, at: Column) -> Column:
        others = F.filter(parts, lambda p, i: (i > 0) & (at.isNull() | (i != at)))
        pattern = F.when(begun.isNotNull(), "prefix").when(ended.isNotNull(), "since-2023").when(at.isNotNull(), "code-variants-session").when(F.size(parts) > 1, "no-session").otherwise("unknown")
        return F.struct(kind.alias("kind"), source.alias("kind_source"), pattern.alias("pattern"), F.get(parts, F.lit(0)).alias("code"), F.array_join(others, ",").alias("variants"), F.coalesce(F.get(sessions, at), F.lit("")).alias("session"))

    sessions = lambda parts: F.transform(parts, lambda p, i: F.when(i > 0, session(p)).otherwise(""))
    last = lambda sessions: F.array_max(F.transform(sessions, lambda s, i: F.when(s != "", i)))
    return let(F.split(rest, "-"), lambda parts: let(sessions(parts), lambda sessions: let(last(sessions), lambda at: told(parts, sessions, at))))


def _without_dots(path: Column) -> Column:
    """A path without . and .. as a browser reads it."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    walked = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    return F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(last.isin(".", "..") & (F.size(walked) > 0), "/").otherwise(""))


def quoted(path: Column) -> Column:
    """A path with every character that isn't safe as its UTF-8 bytes in per cent form, whether or not it was before."""
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    chars = F.regexp_extract_all(plain, F.lit("(?s)(.)"), F.lit(1))
    return F.array_join(F.transform(chars, lambda c: F.when(c.rlike(SAFE), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))), "")


def resolve(href: Column, page: Column, hosts: tuple[str, ...] = ()) -> Column:
    """A link of a page as an https address: relative ones against the page, www. dropped of the given hosts, query kept, fragment dropped."""
    bare = F.regexp_replace(F.trim(href), "#.*$", "")
    part = lambda url, k: F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(\??[^#]*)", k)
    whole = bare.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//")
    own, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"(\?.*)$", 1)
    folder = F.regexp_replace(F.when(part(page, 2) == "", "/").otherwise(part(page, 2)), "[^/]*$", "")
    path = F.when(whole, part(bare, 2)).when(own.startswith("/"), own).when(own == "", part(page, 2)).otherwise(F.concat(folder, own))
    found = F.when(whole, part(bare, 1)).otherwise(part(page, 1))
    host = F.when(found.isin(*[f"www.{h}" for h in hosts]), F.substr(found, F.lit(5))).otherwise(found) if hosts else found
    asked = F.when(whole, part(bare, 3)).when((own == "") & (query == ""), part(page, 3)).otherwise(query)
    return F.concat(F.lit("https://"), host, F.when(path == "", "").otherwise(quoted(_without_dots(path))), F.when(asked == "?", "").otherwise(asked))


def harvest(pages: DataFrame, key: str, url: str, html: str, hosts: tuple[str, ...] = ()) -> DataFrame:
    """key, place, href, url of the documents that pages link to, in page order."""
    found = pages.select(key, F.col(url).alias("_page"), F.posexplode(F.regexp_extract_all(html, F.lit(HREF), F.lit(1))).alias("place", "href"))
    return found.select(key, "place", "href", resolve(F.col("href"), F.col("_page"), hosts).alias("url"))
