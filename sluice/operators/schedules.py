"""Schedules of pages, a batch of pages at a time: what a task does with the items that Spark has put together page by page.

Numbers stand in SQL's order: nulls first, what is not a number above all numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Kinds = Mapping[str, tuple[Sequence[str], int, Sequence[str], int]]
#: What a batch gives for each page: its rows, in order.
ROWS = "array<struct<kind string, row long, cells array<struct<label string, cell string>>>>"
#: Items that are worked on at a time, or one page.
ITEMS = 1 << 16
NONE = np.iinfo(np.int64).min


def _ordered(v: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Whole numbers that are ordered as the doubles v are in SQL."""
    bits = np.where(np.isnan(v), np.nan, v + 0.0).view(np.int64)
    return np.where(null, NONE, np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits))


def _doubles(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    a = a.cast(pa.float64())
    return a.fill_null(0.0).to_numpy(zero_copy_only=False), a.is_null().to_numpy(zero_copy_only=False)


def _ranks(texts: pa.Array) -> np.ndarray:
    """Places of texts among the distinct ones, by bytes; nulls before all."""
    found = texts.dictionary_encode()
    place = np.empty(len(found.dictionary) + 1, np.int64)
    place[pc.sort_indices(found.dictionary).to_numpy()] = np.arange(len(found.dictionary))
    place[-1] = -1
    return place[found.indices.fill_null(-1).to_numpy()]


def _labels(texts: pa.Array) -> pa.Array:
    """Lower case, without spaces around."""
    texts = pc.utf8_trim(texts, characters=" ")
    low, odd = pc.ascii_lower(texts), pc.invert(pc.string_is_ascii(texts)).fill_null(False)
    if pc.any(odd).as_py():
        low = pc.replace_with_mask(low, odd, pa.array([s.lower() for s in texts.filter(odd).to_pylist()], low.type))
    return low


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def _runs(at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs one after the other, and the run of each."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(own)) + (at - _starts(sizes)[:-1])[own], own


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_starts(sizes), pa.int32()), values)


def _joined(texts: pa.Array, group: np.ndarray, groups: int, by: str) -> pa.Array:
    """The texts of each group in one; texts are in order of their groups, nulls are left out."""
    there = texts.is_valid().to_numpy(zero_copy_only=False)
    return pc.binary_join(_lists(np.bincount(group[there], minlength=groups), texts.drop_null()), by)


def _kinds(labels: pa.Array, own: np.ndarray, sizes: np.ndarray, kinds: Kinds, share: float) -> np.ndarray:
    """The number of the first kind whose header each row is, or -1."""
    # no label that is looked for has the line end that parts the items
    said = _joined(labels, own, len(sizes), "\n")
    may = np.arange(len(sizes))
    if all(some > 0 for *_, some in kinds.values()):
        # only rows with a label that some kind needs can be headers
        any_needed = "|".join(sorted({re.escape(want) for _, _, needed, _ in kinds.values() for want in needed}))
        may = np.flatnonzero(pc.match_substring_regex(said, any_needed).to_numpy(zero_copy_only=False))
    texts = said.take(pa.array(may)).dictionary_encode()
    at, sizes = texts.indices.to_numpy(), sizes[may]
    has = {want: pc.match_substring(texts.dictionary, want).to_numpy(zero_copy_only=False).astype(int)[at] for labels, _, needed, _ in kinds.values() for want in (*labels, *needed)}
    hits = lambda wants: sum((has[want] for want in wants), np.zeros(len(may), int))
    kind, first = np.full(len(said), -1), np.full(len(may), -1)
    for k, (wants, least, needed, some) in reversed(list(enumerate(kinds.values()))):
        found = hits(wants)
        first[(found >= least) & (hits(needed) >= some) & (found / sizes >= share)] = k
    kind[may] = first
    return kind


def _table(values: np.ndarray, own: np.ndarray, sizes: np.ndarray, fill) -> np.ndarray:
    """Runs of values as rows of one width."""
    table = np.full((len(sizes), int(sizes.max(initial=0)) or 1), fill, values.dtype)
    table[own, np.arange(len(own)) - _starts(sizes)[own]] = values
    return table


def _nearest(x: np.ndarray, null: np.ndarray, own: np.ndarray, columns: np.ndarray, no_column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest columns of each x, -1 where there is none, and how far it is."""
    with np.errstate(invalid="ignore"):
        far = np.abs(columns[own] - x[:, None])
    order = np.where(no_column[own] | null[:, None], np.iinfo(np.int64).max, _ordered(far, np.False_))
    first = order.argmin(axis=1)
    at = np.arange(len(x))
    return np.where(order[at, first] == np.iinfo(np.int64).max, -1, first), far[at, first]


def _cut(pages: pa.ListArray) -> Iterator[pa.ListArray]:
    ends = np.cumsum(pages.value_lengths().fill_null(0).to_numpy())
    at = 0
    while at < len(pages):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ITEMS, "right")))
        yield pages.slice(at, to - at)
        at = to


def rows_of_schedules(pages: pa.ListArray, kinds: Kinds, gap: float, under: float, margin: float, share: float) -> pa.Array:
    """ROWS of pages, each an array of struct<y, x, item_idx, str> in that order; see layout.page_schedules."""
    found = [_rows(part, kinds, gap, under, margin, share) for part in _cut(pages)]
    return pa.concat_arrays(found or [_rows(pages, kinds, gap, under, margin, share)])


def _rows(pages: pa.ListArray, kinds: Kinds, gap: float, under: float, margin: float, share: float) -> pa.Array:
    flat = pages.flatten()
    fields = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
    (y, no_y), (x, no_x), texts = _doubles(fields["y"]), _doubles(fields["x"]), fields["str"]
    x_order, idx = _ordered(x, no_x), fields["item_idx"].cast(pa.int64()).fill_null(NONE).to_numpy()
    counts = pages.value_lengths().fill_null(0).to_numpy()
    page = np.repeat(np.arange(len(pages)), counts)

    # rows: one begins where an item is more than gap below the one before it
    begins = np.ones(len(page), bool)
    with np.errstate(invalid="ignore"):
        below = y[1:] - y[:-1]
    begins[1:] = (page[1:] != page[:-1]) | (((below > gap) | np.isnan(below)) & ~no_y[1:] & ~no_y[:-1])
    row, starts = np.cumsum(begins) - 1, np.flatnonzero(begins)
    sizes, of = np.diff(np.append(starts, len(page))), page[starts]
    first_row = np.searchsorted(of, np.arange(len(pages)))

    # headers: the first row of a page that is some kind's
    may = np.flatnonzero((sizes >= 4) & (sizes <= 25))
    items, own = _runs(starts[may], sizes[may])
    kind = _kinds(_labels(texts.take(pa.array(items))), own, sizes[may], kinds, share)
    headed, first = np.unique(of[may[kind >= 0]], return_index=True)
    header, kind = may[kind >= 0][first], kind[kind >= 0][first]
    width = sizes[header]

    def in_order(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        items, own = _runs(starts[rows], sizes)
        labels = _labels(texts.take(pa.array(items)))
        order = np.lexsort((_ranks(labels), x_order[items], own))
        return items[order], own, labels.take(pa.array(order))

    columns, own, labels = in_order(header, width)
    at = _starts(width)
    table, no_column = _table(x[columns], own, width, 0.0), _table(no_x[columns], own, width, True)

    # short words of the next row go to the label above them
    there = np.append(of, -1)[header + 1] == headed
    next_row = np.where(there, header + 1, header)
    size = np.where(there, sizes[next_row], 0)
    words, word_of, said = in_order(next_row, np.where((size >= 2) & (size <= width + 4), size, 0))
    short = pc.and_(pc.less_equal(pc.utf8_length(said), 6), pc.invert(pc.match_substring_regex(said, "[0-9]"))).fill_null(False).to_numpy(zero_copy_only=False)
    words, word_of, said = words[short], word_of[short], said.filter(pa.array(short))
    merged = np.bincount(word_of, minlength=len(header)) >= 2
    near, far = _nearest(x[words], no_x[words], word_of, table, no_column)
    stays = np.flatnonzero(merged[word_of] & (near >= 0) & (far <= under))
    slot = (at[word_of] + near)[stays]
    order = np.argsort(slot, kind="stable")
    added = _joined(said.take(pa.array(stays[order])), slot[order], len(columns), " ")
    longer = pc.utf8_trim(pc.binary_join_element_wise(labels, added, " ", null_handling="skip"), characters=" ")
    labels = pc.if_else(pa.array(merged[own]), longer, labels)

    # the body: items between the outermost columns, with a margin
    low_at, high_at = np.where(no_column, np.iinfo(np.int64).max, _ordered(table, np.False_)).argmin(axis=1), _ordered(table, no_column).argmax(axis=1)
    pick, none = np.arange(len(header)), no_column.all(axis=1)
    low, high = _ordered(table[pick, low_at] - margin, np.False_), _ordered(table[pick, high_at] + margin, np.False_)
    body = header + 1
    last = np.append(first_row[1:], len(starts))[headed]
    begin = np.append(starts, len(page))
    items, page_of = _runs(begin[body], begin[last] - begin[body])
    near = (x_order[items] >= low[page_of]) & (x_order[items] <= high[page_of]) & ~no_x[items] & ~none[page_of]
    items, page_of = items[near], page_of[near]
    n = np.bincount(row[items], minlength=len(starts))
    whole = (width[page_of] <= 4) | (n[row[items]] >= 3)
    items, page_of = items[whole], page_of[whole]

    slot = at[page_of] + _nearest(x[items], no_x[items], page_of, table, no_column)[0]
    name = _ranks(labels)[slot]
    order = np.lexsort((_ranks(texts.take(pa.array(items))), idx[items], x_order[items], name, row[items]))
    items, slot, name = items[order], slot[order], name[order]
    new_row = np.append(True, row[items][1:] != row[items][:-1])[: len(items)]
    new_cell = new_row | np.append(True, name[1:] != name[:-1])[: len(items)]
    cell_of, first = np.cumsum(new_cell) - 1, np.flatnonzero(new_cell)
    cells = _joined(texts.take(pa.array(items)), cell_of, len(first), " ")
    out = row[items[new_row]]
    per_row = np.diff(np.append(cell_of[new_row], len(first)))
    kind_of = np.full(len(pages), -1)
    kind_of[headed] = kind
    named = pa.array(list(kinds), pa.string()).take(pa.array(kind_of[of[out]]))
    cells = pa.StructArray.from_arrays([labels.take(pa.array(slot[first])).cast(pa.string()), cells.cast(pa.string())], names=["label", "cell"])
    found = pa.StructArray.from_arrays([named, pa.array(out - first_row[of[out]], pa.int64()), _lists(per_row, cells)], names=["kind", "row", "cells"])
    return _lists(np.bincount(of[out], minlength=len(pages)), found)
