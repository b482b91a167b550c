"""Main text of web pages by equivalence-class template deduction.

1. A page is a sequence of tokens: each tag with its path (tags, classes and ids above it) and each line of
   text with the path it begins at. Tokens of a host that occur equally often in every page share an
   occurrence vector; vectors are compared by a fingerprint, the sum of a hash of (page, count) over all
   pages beside the numbers of pages and occurrences, so that a host's pages, however many, are summed up
   in parallel and only tokens meet.
2. The tokens of a vector are a class. It is large enough with ``least_tokens`` tokens and frequent enough
   if it occurs in ``support`` of the host's pages. It is valid if its tokens come in the same order, once
   each before they come again, and nest with the other classes, in all pages but a few (``order``): a
   page is read like brackets, where a class that is open goes on only after those opened within it are
   closed; of two that cross, the smaller is charged. The valid classes are the host's template. A host
   with fewer than ``least_pages`` pages uses the template of all hosts together.
3. Lines between template tokens are slots; lines that are template tokens themselves are not. Slots under
   menus, headers, footers, sidebars, notices, adverts, forms and comments are boilerplate. Of the others
   the main slot is the deepest template token that a page has once and that holds at least ``share`` of
   their text; of several that do, an article or main element goes before.
4. From each page the text of the main slot is taken, without boilerplate inside it. A template line there
   stays, such as a heading or a closing line, unless it is all of a container with a name of its own, which
   then is template itself. A page that lacks the slot gives its article or main element, else
   the whole page without template lines. Where nothing is left, marks and template don't count.

Blocks are joined by line feeds; br counts as white space. A comment, tag or element that never ends runs
to the end of the page.

Defined cases: a null or empty page gives an empty text; a null url is of the host ''; repeated rows are
extracted each and count each for the template; an empty table gives an empty table; extra columns are
not returned.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .url_filter import host_of

ALL_HOSTS = "*"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|math)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*|[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HEAD = re.compile(r"(?:/html[^/]*)?/head(?:[./]|\Z)")
#: Elements that never have an end tag, elements that make a block, elements whose start ends an open p.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Blocks that hold no prose of their own.
CONTAINERS = {"aside", "details", "dialog", "div", "fieldset", "footer", "form", "header", "menu", "nav", "section"}
#: An element of the key ends an open element of the values.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Boilerplate by element and by a word of its class, id or role.
OUT_TAGS = {"head", "title", "nav", "footer", "aside", "button", "select", "input", "textarea", "menu", "dialog"}
OUT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "aside", "cookie",
    "cookies", "consent", "notice", "gdpr", "comment", "comments", "disqus", "reply", "replies", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "popup", "modal", "login", "signup", "search", "complementary", "contentinfo",
}
#: Words that may stand beside those in a name with hyphens, as in site-footer; any other word makes a modifier of it, as in has-sidebar.
PLAIN_WORDS = {"site", "page", "main", "left", "right", "top", "bottom", "box", "list", "bar", "block", "area", "section", "container", "wrapper", "wrap", "inner", "widget", "item", "items", "links", "primary", "secondary", "global", "mobile", "desktop"}
MAIN = ("article", "main")
#: Elements that no name marks as boilerplate.
NEVER_OUT = {"html", "body", *MAIN}
#: A marked element with this share of the page's text is the page's wrapper, whatever its name says.
WRAPPER = 0.9


def out_name(name: str) -> bool:
    """Whether a class, id or role as a whole names boilerplate."""
    parts = [p for p in re.split(r"[^a-z0-9]+", name) if p and not p.isdigit()]
    return any(p in OUT_WORDS for p in parts) and all(p in OUT_WORDS or p in PLAIN_WORDS for p in parts)


class _Open:
    """An element. out: by an element above; marks: the elements above, itself included, that a name or form marks."""

    __slots__ = ("tag", "path", "out", "main", "marks")

    def __init__(self, tag: str, path: str, out: bool, main: bool, marks: tuple[_Open, ...] = ()) -> None:
        self.tag, self.path, self.out, self.main, self.marks = tag, path, out, main, marks


def events(page: str) -> Iterator[tuple[str, _Open, str]]:
    """('open', element, ''), ('text', element above, characters) and ('block', element, '') at each border of a block."""
    stack = [_Open("", "", False, False)]
    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            yield "text", stack[-1], text
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if depth:
                blocks = any(e.tag in BLOCKS for e in stack[depth:])
                del stack[depth:]
                if blocks:
                    yield "block", stack[-1], ""
            continue
        if tag in BLOCKS:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in BLOCKS), 0)
            if k and stack[k].tag == "p":
                del stack[k:]
            yield "block", stack[-1], ""
        ends = ENDS.get(tag)
        if ends:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in ends or stack[k].tag in ("ul", "ol", "dl", "table", "select")), 0)
            if k and stack[k].tag in ends:
                del stack[k:]
        names = sorted({w for a in _NAMES.finditer(m["attrs"]) for w in (a[2] or a[3] or a[4] or "").lower().split()}) if m["attrs"] else []
        top = stack[-1]
        main = top.main or tag in MAIN or "main" in names
        out = top.out or tag in OUT_TAGS or (tag == "header" and not main)
        e = _Open(tag, f"{top.path}/{tag}{''.join('.' + n for n in names)}", out, main, top.marks)
        if tag == "form" or (tag not in NEVER_OUT and any(map(out_name, names))):
            e.marks = (*top.marks, e)
        yield "open", e, ""
        if tag in VOID or (m["attrs"] or "").endswith("/"):
            if tag == "br":
                yield "text", top, " "
            elif tag in BLOCKS:
                yield "block", top, ""
            continue
        stack.append(e)


def parsed(page: str, slot: str | None = None) -> list[tuple[str, _Open, str, bool]]:
    """The page's events, each with whether it is boilerplate by its elements and marks.

    A mark doesn't count on an element that holds the slot or nearly all of the page's text."""
    found = list(events(page))
    total, held = 0, {}
    for kind, e, text in found:
        if kind == "text" and not e.out:
            n = len(text.strip())
            total += n
            for m in e.marks:
                held[m] = held.get(m, 0) + n
    free = {m for m, n in held.items() if n >= total * WRAPPER}
    return [(kind, e, text, e.out or any(m not in free and not (slot and f"{slot}/".startswith(f"{m.path}/")) for m in e.marks)) for kind, e, text in found]


def tokens_of(page: list[tuple[str, _Open, str, bool]]) -> Iterator[tuple[str, str, bool, int]]:
    """The page's tokens in order, each with its path, whether it is boilerplate, and its characters if it is a line."""
    parts: list[str] = []
    first: tuple[_Open, bool] | None = None
    for kind, e, text, out in [*page, ("block", None, "", False)]:
        if kind == "text":
            if first is None and not text.isspace():
                first = e, out
            parts.append(text)
        elif kind == "open":
            yield e.path, e.path, out, 0
        else:
            if first is not None:
                line = " ".join("".join(parts).split())
                yield line_token(first[0].path, line), first[0].path, first[1], len(line)
            first = None
            parts.clear()


def line_token(path: str, line: str) -> str:
    """A token of fixed size; no path begins like it."""
    return f" {xxhash.xxh3_64_hexdigest(f'{path} {line}')}"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, pages, total, vector, most, page, at): summed up over each task's pages; at: the token's first place in the page of the least hash."""
    sums: dict[tuple[str, str], list[int]] = {}
    for batch in batches:
        for key, host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            seen: dict[str, list[int]] = {"": [1, 0]}
            for k, (token, _, _, _) in enumerate(tokens_of(parsed(page or ""))):
                seen.setdefault(token, [0, k])[0] += 1
            own = xxhash.xxh3_64_intdigest(f"{key} {page}")
            for token, (n, at) in seen.items():
                # 38 bits: the sum over 2**25 pages fits
                vector = xxhash.xxh3_64_intdigest(f"{own}/{n}") >> 26
                for h in (host, ALL_HOSTS):
                    s = sums.get((h, token))
                    if s is None:
                        sums[h, token] = [1, n, vector, n, own >> 1, at]
                        continue
                    s[0] += 1
                    s[1] += n
                    s[2] += vector
                    s[3] = max(s[3], n)
                    if own >> 1 < s[4]:
                        s[4:] = own >> 1, at
        if len(sums) > 200_000:
            yield _rows(sums, COUNTS)
            sums = {}
    yield _rows(sums, COUNTS)


COUNTS = ["host", "token", "pages", "total", "vector", "most", "page", "at"]
JUDGED = ["host", "item", "bad", "chars"]


def _rows(sums: dict[tuple[str, str], list[int]], names: list[str]) -> pa.RecordBatch:
    rows = [(h, t, *s) for (h, t), s in sums.items()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(cols)], names)


def disordered(sequence: list[tuple[str, int]], sizes: dict[str, int]) -> set[str]:
    """Classes whose tokens (class, place in it) aren't in order or nested in this page."""
    bad: set[str] = set()
    stack: list[list] = []
    for c, k in sequence:
        if c in bad:
            continue
        if k == 0 and not any(o[0] == c for o in stack):
            stack.append([c, 1])
        else:
            # those that are open within c cross it; the smaller one goes
            while stack and stack[-1][0] != c and any(o == [c, k] for o in stack) and sizes[stack[-1][0]] <= sizes[c]:
                bad.add(stack.pop()[0])
            if not stack or stack[-1] != [c, k]:
                bad.add(c)
                stack = [o for o in stack if o[0] != c]
                continue
            stack[-1][1] += 1
        if stack[-1][1] == sizes[c]:
            stack.pop()
    return bad | {c for c, _ in stack}


def _template(known: dict[str, tuple], host: str, classes: list[dict] | None) -> tuple[dict[str, tuple[str, int]], dict[str, int], set[str]]:
    """Of a host's classes: class and place of each token, size of each class, tokens that a page has once."""
    if host not in known:
        if len(known) > 500:
            known.clear()
        at = {t: (c["class"], k) for c in classes or [] for k, t in enumerate(c["tokens"])}
        known[host] = at, {c["class"]: len(c["tokens"]) for c in classes or []}, {t for c in classes or [] if c["once"] for t in c["tokens"]}
    return known[host]


def _judge(common: list[dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(host, item, bad, chars): of each class the pages where it is disordered; of each tag that a page has once the characters of the slots below."""
        sums: dict[tuple[str, str], list[int]] = {}
        known: dict[str, tuple] = {}
        for batch in batches:
            for host, page, classes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens = list(tokens_of(parsed(page or "")))
                for h, cs in ((host, classes), (ALL_HOSTS, common)):
                    if not cs:
                        continue
                    at, sizes, once = _template(known, h, cs)
                    for c in disordered([at[t[0]] for t in tokens if t[0] in at], sizes):
                        sums.setdefault((h, f"class {c}"), [0, 0])[0] += 1
                    for token, path, out, n in tokens:
                        if n and not out and token not in at:
                            sums.setdefault((h, ""), [0, 0])[1] += n
                            while path:
                                if path in once:
                                    sums.setdefault((h, path), [0, 0])[1] += n
                                path = path.rpartition("/")[0]
            if len(sums) > 200_000:
                yield _rows(sums, JUDGED)
                sums = {}
        yield _rows(sums, JUDGED)

    return run


def templates(pages: DataFrame, page_id: str, url: str, page: str, support: float, share: float, least_pages: int, least_tokens: int, order: float) -> DataFrame:
    """host, slot, lines: the path of each host's main slot, null if it has none, and the lines of its template; the host '*' stands for all."""
    keyed = pages.select(F.coalesce(F.col(page_id).cast("string"), F.lit("")).alias("key"), host_of(F.col(url)).alias("host"), F.col(page).alias("page"))
    counted = keyed.mapInArrow(_counts, "host string, token string, pages long, total long, vector long, most long, page long, at long")
    tokens = counted.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.sum("vector").alias("vector"), F.max("most").alias("most"), F.min(F.struct("page", "at"))["at"].alias("at"))
    # rarer ones are in no template
    tokens = materialize(tokens.where(F.col("pages") >= least_pages * support), "page_tokens")
    whole = tokens.where("token = ''").select("host", F.col("pages").alias("all_pages"))
    frequent = tokens.join(whole, "host").where((F.col("pages") >= F.col("all_pages") * support) & (F.col("token") != "") & (F.col("all_pages") >= least_pages))
    # tokens of a class are in the same pages, so their places are those in one page
    classes = frequent.groupBy("host", "pages", "total", "vector").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("class"), F.max("most").alias("most"))
    classes = classes.where(F.size("class") >= least_tokens).select("host", F.concat_ws("/", "pages", "total", "vector").alias("class"), F.col("class.token").alias("tokens"), (F.col("most") == 1).alias("once"), "pages")
    classes = materialize(classes, "classes")
    hosts = materialize(classes.groupBy("host").agg(F.collect_list(F.struct("class", "tokens", "once")).alias("classes")), "host_classes")
    common = [r.asDict() for c in hosts.where(F.col("host") == ALL_HOSTS).select("classes").collect() for r in c["classes"]]
    read = keyed.select("host", "page").join(hosts, "host", "left").select("host", "page", "classes")
    judged = read.mapInArrow(_judge(common), "host string, item string, bad long, chars long")
    judged = materialize(judged.groupBy("host", "item").agg(F.sum("bad").alias("bad"), F.sum("chars").alias("chars")), "judged")

    marks = judged.where("bad > 0").select("host", F.expr("substr(item, 7)").alias("class"), "bad")
    valid = classes.join(marks, ["host", "class"], "left").where(F.coalesce("bad", F.lit(0)) <= F.col("pages") * (1 - order))
    valid = materialize(valid.select("host", "once", F.explode("tokens").alias("token")), "template_tokens")
    lines = valid.where(F.col("token").startswith(" ")).groupBy("host").agg(F.collect_list("token").alias("lines"))
    chars = judged.where("bad = 0 and item <> ''").select("host", F.col("item").alias("token"), "chars")
    slots = valid.where("once").join(chars, ["host", "token"]).join(judged.where("item = ''").select("host", F.col("chars").alias("all_chars")), "host")
    depth = F.size(F.split("token", "/"))
    named = F.regexp_extract("token", "/(article|main)([.][^/]*)?$", 1) != ""
    # only an element that a page has once holds all of an article; its paragraphs share a path
    good = slots.where(F.col("chars") >= F.col("all_chars") * share)
    best = F.max_by("token", F.struct(named.cast("int"), F.when(named, -depth).otherwise(depth), "chars", "token"))
    return good.groupBy("host").agg(best.alias("slot")).join(lines, "host", "full_outer").select("host", "slot", F.coalesce("lines", F.expr("array()")).alias("lines"))


def _apart(path: str, slot: str) -> bool:
    """Whether text at a path stands in a named container within the slot, and in no heading, paragraph, list or table."""
    block = next((part for part in reversed(path[len(slot) :].split("/")) if part.split(".")[0] in BLOCKS), "")
    return "." in block and block.split(".")[0] in CONTAINERS


def extract_text(page: str, slot: str | None, lines: frozenset[str] = frozenset()) -> str:
    """The text of the main slot, whole; of a page without it, that of its article or main, else of the page without the template's lines."""
    # candidates, the better first: what is in the slot, in article or main, beside template and boilerplate, beside boilerplate, all
    found: list[list[str]] = [[], [], [], [], []]
    parts: list[list[str]] = [[], [], [], []]
    first: str | None = None

    def end() -> None:
        slotted, mained, plain, every = (" ".join(html.unescape("".join(p)).split()) for p in parts)
        fixed = bool(lines) and first is not None and line_token(first, " ".join("".join(parts[3]).split())) in lines
        if fixed and slot and slotted and _apart(first or "", slot):
            slotted = ""
        for blocks, text in zip(found, (slotted, mained, "" if fixed else plain, plain, every), strict=True):
            if text:
                blocks.append(text)
        for p in parts:
            p.clear()

    for kind, e, text, out in parsed(page, slot):
        if kind == "block":
            end()
            first = None
        elif kind != "open" and not _HEAD.match(e.path):
            if first is None and not text.isspace():
                first = e.path
            parts[3].append(text)
            if not out:
                parts[2].append(text)
                if e.main:
                    parts[1].append(text)
                if slot and (e.path == slot or e.path.startswith(slot + "/")):
                    parts[0].append(text)
    end()
    return "\n".join(next((blocks for blocks in found if blocks), []))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", support: float = 0.5, share: float = 0.6, least_pages: int = 5, least_tokens: int = 3, order: float = 0.95) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    found = materialize(templates(pages, page_id, url, page, support, share, least_pages, least_tokens, order), "templates")
    common = found.where(F.col("host") == ALL_HOSTS).select("slot", "lines").first()
    fallback, common_lines = (common["slot"], frozenset(common["lines"] or ())) if common else (None, frozenset())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            texts = [extract_text(p or "", s or fallback, common_lines if n is None else frozenset(n)) for p, s, n in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [page_id, url, "text", "n_chars"])

    hosted = pages.select(page_id, url, page, host_of(F.col(url)).alias("_host"))
    slots = found.select(F.col("host").alias("_host"), F.col("slot").alias("_slot"), F.col("lines").alias("_lines"))
    kind = dict(pages.dtypes)[page_id]
    return hosted.join(slots, "_host", "left").select(page_id, url, page, "_slot", "_lines").mapInArrow(cut, f"`{page_id}` {kind}, `{url}` string, text string, n_chars long")
