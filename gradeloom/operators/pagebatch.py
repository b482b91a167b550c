"""Whole pages of characters, many at once: sizes, fractions, lines and texts as steps over arrays of all their characters.

``pagetext`` says what a fraction, a line and a power are and lets Spark bring each page's parts together; here a batch of
pages is one set of arrays, and no step runs for a page, a line or a character by itself. Only segments whose bars stand
within each other or share characters are folded one by one. Null in a place or a size is nan and is near nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_EVEN, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A row for characters and lines without a place.
NOWHERE = np.iinfo(np.int64).min
_TENTH = Decimal("0.1")


class Pages(NamedTuple):
    """Characters and bars of whole pages: numbers of pages ascend from 0 in both."""

    keys: pa.Array
    page: np.ndarray
    glyphs: pa.StructArray
    n: np.ndarray
    x0: np.ndarray
    x1: np.ndarray
    y: np.ndarray
    size: np.ndarray
    word: np.ndarray
    words: list[str]
    bar_page: np.ndarray
    bars: np.ndarray

    def of_words(self, what: Callable[[str], object], kind: type = bool) -> np.ndarray:
        """What each character's text is, worked out once for each text."""
        return np.array([what(w) for w in self.words] or [what("")], dtype=kind)[self.word]


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)  # null as nan


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows whose pages are complete, and where pages begin; a page's rows follow each other, and each row says how many they are (parts)."""
    held: list[pa.RecordBatch] = []
    begins: list[int] = []
    rows = end = 0  # rows that are held, and where their last page ends
    for batch in batches:
        parts = batch.column("parts").to_pylist()
        while end < rows + len(parts):
            begins.append(end)
            end += parts[end - rows]
        more = end > rows + len(parts)
        cut = begins[-1] if more else end
        if more and cut < rows:  # the page began before this batch
            held.append(batch)
            rows += len(parts)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cut - rows)]).combine_chunks(), np.array(begins[:-1] if more else begins, dtype=np.int64)
        held, begins = [batch.slice(cut - rows)], [0] * more
        rows, end = rows + len(parts) - cut, end - cut
    if end > rows:
        raise ValueError(f"{end - rows} rows of a page are missing")


def _listed(table: pa.Table, name: str, row_page: np.ndarray) -> tuple[np.ndarray, pa.StructArray]:
    """The elements of all rows' lists, with their pages."""
    lists = table.column(name).combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(row_page, sizes), lists.flatten()


def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[Pages]:
    """Batches of rows (page, glyphs, bars, parts) as whole pages."""
    for table, begins in _whole(batches):
        if not table.num_rows:
            continue
        row_page = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, table.num_rows)))
        page, glyphs = _listed(table, "glyphs", row_page)
        bar_page, bars = _listed(table, "bars", row_page)
        if not len(page):
            continue
        text = pc.fill_null(glyphs.field("c"), "").dictionary_encode()
        sides = np.column_stack([_numbers(bars.field(s)) for s in ("x0", "x1", "y")]) if len(bars) else np.empty((0, 3))
        order = np.lexsort((sides[:, 1], sides[:, 0], sides[:, 2], bar_page))
        order = order[~np.isnan(sides[order]).any(axis=1)]
        level = (_numbers(glyphs.field("y0")) + _numbers(glyphs.field("y1"))) / 2
        x0, x1, size = [_numbers(glyphs.field(s)) for s in ("x0", "x1", "size")]
        n = glyphs.field("n").to_numpy(zero_copy_only=False)
        yield Pages(table.column("page").combine_chunks().take(pa.array(begins)), page, glyphs, n, x0, x1, level, size, text.indices.to_numpy(zero_copy_only=False), text.dictionary.to_pylist(), bar_page[order], sides[order])


def _tenths(values: np.ndarray, exact: Callable[[float], float]) -> np.ndarray:
    """values to one digit; halves, and what is so near to one that the product may err, as ``exact`` rounds them."""
    many = values * 10
    out = np.rint(many) / 10
    half = np.abs(many - np.floor(many) - 0.5) < 1e-6
    if half.any():
        found, at = np.unique(values[half], return_inverse=True)
        out[half] = np.array([exact(v) for v in found.tolist()])[at]
    return out


def _half_even(value: float) -> float:
    """As Spark's bround: of the decimal that is shown."""
    return float(Decimal(repr(value)).quantize(_TENTH, ROUND_HALF_EVEN))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    out = np.ones(len(keys[0]), dtype=bool)
    out[1:] = False
    for key in keys:
        out[1:] |= key[1:] != key[:-1]
    return out


def _spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from first up to last of each row, with the row."""
    sizes = np.maximum(last - first, 0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)


def _most_frequent(group: np.ndarray, value: np.ndarray, groups: int, none: float) -> np.ndarray:
    """Each group's most frequent value, the larger of equals."""
    order = np.lexsort((value, group))
    group, value = group[order], value[order]
    head = np.flatnonzero(_starts(group, value)) if len(group) else np.empty(0, dtype=np.int64)
    count = np.diff(np.append(head, len(group)))
    head = head[np.lexsort((value[head], count, group[head]))]
    out = np.full(groups, none)
    out[group[head]] = value[head]  # the last one of a group stays
    return out


def _middle(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """Each group's median, the upper of two; nan counts as smaller than all, but is none."""
    empty = np.isnan(value)
    order = np.lexsort((np.where(empty, -np.inf, value), group))
    count = np.bincount(group, minlength=groups)
    at = np.maximum(count // 2, np.bincount(group[empty], minlength=groups))
    out = np.full(groups, np.nan)
    some = at < count
    out[some] = value[order[(np.cumsum(count) - count + at)[some]]]
    return out


def _nearest(page: np.ndarray, y: np.ndarray, row_page: np.ndarray, rows: np.ndarray, most: np.ndarray) -> np.ndarray:
    """y moved to the nearest of the page's rows, the upper of equals, if it is within ``most``."""
    n = len(rows)
    of, value = np.concatenate([row_page, page]), np.concatenate([rows, y])
    order = np.lexsort((np.arange(n + len(y)) >= n, value, of))
    place = np.arange(len(order))
    is_row = order < n
    before = np.maximum.accumulate(np.where(is_row, place, -1))
    behind = np.minimum.accumulate(np.where(is_row, place, len(order))[::-1])[::-1]
    point = ~is_row
    own, at = order[point], value[order[point]]

    def beside(k: np.ndarray) -> np.ndarray:
        found = order[np.clip(k, 0, len(order) - 1)]
        return np.where((k >= 0) & (k < len(order)) & (of[found] == of[own]), value[found], np.nan)

    over, under = beside(before[point]), beside(behind[point])
    near = np.where(np.isnan(over) | (np.abs(under - at) < np.abs(at - over)), under, over)
    out = y.copy()
    out[own - n] = np.where(np.abs(near - at) <= most[own - n], near, at)
    return out


class Sizes(NamedTuple):
    base: np.ndarray
    middle: np.ndarray
    visible: np.ndarray
    rounded: np.ndarray


def sizes(p: Pages, plain_size: float) -> Sizes:
    """By page the most frequent size of visible characters to one digit and the median of all; by character whether it is visible and its size to one digit."""
    visible = p.of_words(lambda w: w.strip(" ") != "")
    rounded = _tenths(p.size, _half_even)
    told = visible & ~np.isnan(p.size)
    return Sizes(_most_frequent(p.page[told], rounded[told], len(p.keys), plain_size), _middle(p.page, p.size, len(p.keys)), visible, rounded)


class Fractions(NamedTuple):
    """Bars of fractions, in order of page, y, x0 and x1, and the characters of their storeys: bar (its place in ``bars``), character, whether above."""

    bars: np.ndarray
    bar: np.ndarray
    character: np.ndarray
    above: np.ndarray


def fractions(p: Pages, told: Sizes, out: float, storey: float) -> Fractions:
    """The bars that are fractions' on their page; equal bars are one."""
    high = (told.middle * storey)[p.bar_page]
    y = p.bars[:, 2]
    # characters that may be near a bar: a bit more of them than those that are
    order = np.lexsort((p.y, p.page))
    reach = high + 1e-6 * (1 + np.abs(y))
    edge = np.concatenate([p.y[order], y - reach, y + reach])
    of = np.concatenate([p.page[order], p.bar_page, p.bar_page])
    n, k = len(order), len(y)
    by_edge = np.lexsort((np.repeat([1, 0, 2], [n, k, k]), edge, of))
    place = np.empty(len(by_edge), dtype=np.int64)
    place[by_edge] = np.cumsum(by_edge < n)
    bar, at = _spans(place[n : n + k], place[n + k :])
    c = order[at]
    x0, x1, by = p.bars[bar].T
    centre = (p.x0[c] + p.x1[c]) / 2
    near = (centre >= x0 - out) & (centre <= x1 + out) & (np.abs(p.y[c] - by) < high[bar]) & (p.y[c] != by)
    bar, c, x0, x1, by = bar[near], c[near], x0[near], x1[near], by[near]
    one = np.cumsum(_starts(p.bar_page, *p.bars.T)) - 1 if k else np.empty(0, dtype=np.int64)
    kept = np.flatnonzero(_starts(one)) if k else one
    up = p.y[c] < by
    side = 2 * one[bar] + up
    length, letters = p.of_words(len, np.int64), p.of_words(str.isalpha)
    seen = told.visible[c]
    inside = (p.x0[c] >= x0 - out - 1) & (p.x1[c] <= x1 + out + 1)
    count = lambda what: np.bincount(side[what], minlength=2 * len(kept))
    n_seen = count(seen)
    long = np.bincount(side[seen], weights=length[c[seen]], minlength=2 * len(kept)) >= 3
    fits = ((n_seen > 0) & (count(seen & ~inside) == 0) & ~(long & (count(seen & letters[c]) == n_seen))).reshape(-1, 2).all(axis=1)
    has = fits[one[bar]]
    return Fractions(kept[fits], (np.cumsum(fits) - 1)[one[bar[has]]], c[has], up[has])


class Lines(NamedTuple):
    """Characters in order of page, row, segment, x0 and n; head: where segments begin."""

    character: np.ndarray
    row: np.ndarray
    segment: np.ndarray
    head: np.ndarray


def _rows(y: np.ndarray, line: float) -> np.ndarray:
    out = np.full(len(y), NOWHERE)
    there = ~np.isnan(y)
    out[there] = np.rint(y[there] / line).astype(np.int64)
    return out


def lines(p: Pages, told: Sizes, found: Fractions, line: float, smaller: float, gutter: float) -> Lines:
    """Characters in lines and segments; segments without a visible character are left out, unless the line has none."""
    base = told.base[p.page]
    text = told.visible & (told.rounded >= base - 0.1) & ~np.isnan(p.y)
    text_page, text_row = p.page[text], _rows(p.y[text], line)
    order = np.lexsort((text_row, text_page))
    order = order[_starts(text_page[order], text_row[order])] if len(order) else order
    text_page, text_row = text_page[order], text_row[order] * line
    y = p.y.copy()
    anchor = _nearest(p.bar_page[found.bars], p.bars[found.bars, 2], text_page, text_row, np.full(len(found.bars), line))
    held = np.full(len(y), -1)
    np.maximum.at(held, found.character, found.bar)  # of several bars the lowest has a character
    has = held >= 0
    y[has] = anchor[held[has]]
    script = np.flatnonzero(~has & told.visible & (p.size < base * smaller))
    y[script] = _nearest(p.page[script], p.y[script], text_page, text_row, base[script])
    row = _rows(y, line)
    c = np.lexsort((p.n, np.where(np.isnan(p.x0), -np.inf, p.x0), row, p.page))
    page, row = p.page[c], row[c]
    begins = _starts(page, row)
    gap = np.zeros(len(c), dtype=np.int64)
    gap[1:] = ~begins[1:] & (p.x0[c[1:]] - p.x1[c[:-1]] > gutter)
    upto = np.cumsum(gap)
    of_line = np.cumsum(begins) - 1
    segment = upto - upto[begins][of_line]
    of_segment = np.cumsum(begins | (gap > 0)) - 1
    seen = told.visible[c]
    in_segment, in_line = np.bincount(of_segment, weights=seen)[of_segment] > 0, np.bincount(of_line, weights=seen)[of_line] > 0
    kept = in_segment | ~in_line
    c, page, row, segment = c[kept], page[kept], row[kept], np.where(in_line, segment, 0)[kept]
    return Lines(c, row, segment, np.flatnonzero(_starts(page, row, segment)))


def joined(texts: pa.Array, head: np.ndarray) -> pa.Array:
    """texts in a row as one from each head up to the next; null is nothing."""
    if not len(texts):
        return pa.array([], pa.large_string())
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return pa.LargeStringArray.from_buffers(len(head), pa.py_buffer(np.append(ends[head], ends[-1]).tobytes()), texts.buffers()[2])


class Rules(NamedTuple):
    """How segments are folded: see ``pagetext``."""

    out: float
    storey: float
    smaller: float
    shifted: float
    line: float
    gutter: float


def _scripts(group: np.ndarray, groups: int, size: np.ndarray, y: np.ndarray, seen: np.ndarray, r: Rules) -> np.ndarray:
    """1 for a power, 2 for an index, else 0: each character's mark within its group."""
    many = (np.bincount(group[seen], minlength=groups) > 1)[group]
    rounded = _tenths(size, lambda v: round(v, 1))
    told = seen & many & ~np.isnan(size)
    base = _most_frequent(group[told], rounded[told], groups, np.nan)
    usual = told & (rounded == base[group])
    middle = _middle(group[usual], y[usual], groups)
    small = told & (size < base[group] * r.smaller)
    off = (y[small] - middle[group[small]]) / base[group[small]]
    marks = np.zeros(len(group), dtype=np.int64)
    marks[small] = np.where(off < -r.shifted, 1, np.where(off > r.shifted, 2, 0))
    return marks


def _bracketed(texts: pa.Array, brackets: Callable[[str], str]) -> pa.Array:
    """Runs of one mark get brackets in the texts that have one."""
    runs = pc.match_substring_regex(texts, r"\^.\^.|_._.")
    if not pc.any(runs).as_py():
        return texts
    return pc.replace_with_mask(texts, runs, pa.array([brackets(t) for t in texts.filter(runs).to_pylist()], texts.type))


def _beside(p: Pages, found: Lines, r: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Segments and the bars that stand in their line and width, by segment, from the left, wide bars first."""
    first, last = found.character[found.head], found.character[np.append(found.head[1:], len(found.character)) - 1]
    page, row = p.page[first], found.row[found.head]
    rows = np.unique(row)
    start = np.flatnonzero(_starts(page, row))
    lines_ = page[start] * len(rows) + np.searchsorted(rows, row[start])
    near = np.rint(p.bars[:, 2] / r.line).astype(np.int64)
    bar = np.tile(np.arange(len(near)), 3)
    at_row = np.concatenate([near - 1, near, near + 1])
    rank = np.minimum(np.searchsorted(rows, at_row), len(rows) - 1)
    key = p.bar_page[bar] * len(rows) + rank
    at = np.minimum(np.searchsorted(lines_, key), len(lines_) - 1)
    there = (rows[rank] == at_row) & (lines_[at] == key) & (np.abs(p.bars[bar, 2] - at_row * r.line) <= r.line)
    bar, at = bar[there], at[there]
    pair, segment = _spans(start[at], np.append(start[1:], len(page))[at])
    bar = bar[pair]
    wide = (p.bars[bar, 0] >= p.x0[first[segment]] - r.gutter) & (p.bars[bar, 1] <= p.x1[last[segment]] + r.gutter)
    segment, bar = segment[wide], bar[wide]
    order = np.lexsort((p.bars[bar, 2], -p.bars[bar, 1], p.bars[bar, 0], segment))
    return segment[order], bar[order]


def texts(p: Pages, found: Lines, r: Rules, plain: Callable[[str], str], brackets: Callable[[str], str], expression: Callable[[list[tuple], list[tuple]], str]) -> pa.Array:
    """Each segment's text with fractions, powers and indices, as ``expression`` gives it for one segment by itself."""
    c, n = found.character, len(found.head)
    end = np.append(found.head[1:], len(c))
    of = np.repeat(np.arange(n), end - found.head)
    word, x0, x1, y, size = p.word[c], p.x0[c], p.x1[c], p.y[c], p.size[c]
    x = (x0 + x1) / 2
    seen, letters, length = p.of_words(lambda w: bool(w.strip()))[c], p.of_words(str.isalpha)[c], p.of_words(len, np.int64)[c]
    segment, bar = _beside(p, found, r)
    # storeys of all segments' bars
    high = (_middle(of, size, n) * r.storey)[segment]
    pair, k = _spans(found.head[segment], end[segment])
    b0, b1, by = p.bars[bar].T
    over = (x[k] >= (b0 - r.out)[pair]) & (x[k] <= (b1 + r.out)[pair])
    up, down = over & (y[k] < by[pair]) & (y[k] > (by - high)[pair]), over & (y[k] > by[pair]) & (y[k] < (by + high)[pair])
    either = up | down
    pair, k, up = pair[either], k[either], up[either]
    side, sides = 2 * pair + ~up, 2 * len(segment)
    count = lambda what: np.bincount(side[what], minlength=sides)
    inside = (x0[k] >= (b0 - r.out - 1)[pair]) & (x1[k] <= (b1 + r.out + 1)[pair])
    n_seen = count(seen[k])
    long = np.bincount(side[seen[k]], weights=length[k[seen[k]]], minlength=sides) >= 3
    fits = ((n_seen > 0) & (count(seen[k] & ~inside) == 0) & ~(long & (count(seen[k] & letters[k]) == n_seen))).reshape(-1, 2).all(axis=1)
    has = fits[pair]
    pair, k, side = pair[has], k[has], side[has]
    # segments whose bars stand within each other or share characters are folded one by one
    many = np.bincount(segment, minlength=n)
    folded = np.flatnonzero(fits)
    at, other = _spans((np.cumsum(many) - many)[segment[folded]], np.cumsum(many)[segment[folded]])
    outer = folded[at]
    within = (other != outer) & (b0[outer] - r.out <= b0[other]) & (b1[other] <= b1[outer] + r.out)
    hard = np.zeros(n, dtype=bool)
    hard[segment[outer[within]]] = True
    hard[of[np.flatnonzero(np.bincount(k, minlength=len(c)) > 1)]] = True
    easy = ~hard[segment[pair]]
    pair, k, side = pair[easy], k[easy], side[easy]
    folded = folded[~hard[segment[folded]]]
    # a group is a segment, or a storey of one of its bars; storeys come behind all segments
    number = np.full(len(segment), -1)
    number[folded] = np.arange(len(folded))
    group = of.copy()
    group[k] = n + 2 * number[pair] + side % 2
    groups = n + 2 * len(folded)
    marks = _scripts(group, groups, size, y, seen, r)
    shown = [plain(w) for w in p.words]
    pool = pa.array([*shown, *["^" + w for w in shown], *["_" + w for w in shown]], pa.large_string())
    piece = word + len(shown) * marks
    ends = np.array([-1 if not w else w[-1].isdigit() for w in shown], dtype=np.int64)  # -1: nothing that could end in a digit
    ends = np.concatenate([ends, np.maximum(ends, 0), np.maximum(ends, 0)])
    storey = np.flatnonzero(group >= n)
    storey = storey[np.lexsort((x[storey], group[storey]))]
    parts = _bracketed(joined(pool.take(pa.array(piece[storey])), np.flatnonzero(_starts(group[storey])) if len(storey) else storey), brackets).to_pylist()
    parts = [t.strip() or "?" for t in parts]
    fraction = [f"{a}/{b}" for a, b in zip(parts[::2], parts[1::2], strict=True)]
    # the segments' own characters and fractions from the left, a fraction before a character at its place
    main = np.flatnonzero(group < n)
    at_x, in_group = np.concatenate([b0[folded], x[main]]), np.concatenate([segment[folded], group[main]])
    order = np.lexsort((at_x, in_group))
    f, own = len(folded), len(pool)
    pieces = np.concatenate([own + np.arange(f), piece[main]])[order]
    digit = np.concatenate([ends, [t[-1].isdigit() for t in fraction]]).astype(np.int64)[pieces]
    place, starts = np.arange(len(pieces)), _starts(in_group[order]) if len(order) else np.empty(0, dtype=bool)
    told = np.maximum.accumulate(np.where(starts | (digit >= 0), place, 0)) if len(order) else place
    behind = np.zeros(len(pieces), dtype=bool)
    behind[1:] = ~starts[1:] & (digit[told[:-1]] == 1)
    pieces = np.where(behind & (pieces >= own), pieces + f, pieces)
    pool = pa.concat_arrays([pool, pa.array(fraction, pool.type), pa.array([" " + t for t in fraction], pool.type)])
    out = _bracketed(joined(pool.take(pa.array(pieces)), np.flatnonzero(starts)), brackets)
    one_by_one = np.flatnonzero(hard)
    if len(one_by_one):
        low, upto = np.searchsorted(segment, one_by_one), np.searchsorted(segment, one_by_one, side="right")
        alone = [expression([(p.words[word[j]], x0[j], x1[j], y[j], size[j]) for j in range(found.head[s], end[s])], [tuple(p.bars[b]) for b in bar[i:j]]) for s, i, j in zip(one_by_one, low, upto, strict=True)]
        out = pc.replace_with_mask(out, pa.array(hard), pa.array(alone, out.type))
    return out
