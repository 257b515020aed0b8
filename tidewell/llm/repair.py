"""Re-Pair grammar compression of id sequences, with random access.

Frequent adjacent pairs become nonterminals, round by round, until no pair occurs ``MIN_COUNT`` times. A round takes
pairs by falling count, leaving out those that could overlap a pair taken before, and replaces every occurrence at once.
Counts are kept from round to round: a pair of known symbols can only lose occurrences, and every new pair holds a
symbol of the round, so only the surroundings of replaced places are counted again (all of the sequence while a round
still replaces a large part of it). Stored are the rules, each rule's expansion length and sampled positions, so any
range of ids decodes without expanding what precedes it.
"""

from __future__ import annotations

import numpy as np

#: Occurrences that make a pair frequent.
MIN_COUNT = 24
#: Symbols between two stored positions.
SAMPLE = 1024
#: Cells of a dense table of pairs at most; larger ones are searched by key.
_DENSE = 1 << 22
_LOW = (1 << 32) - 1


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def _frequent(seq: np.ndarray, symbols: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``first << 32 | second`` that occur ``least`` times in ``seq``, and their counts."""
    if len(seq) < 2:
        return seq[:0], seq[:0]
    if symbols > 1 << 16:
        keys, counts = _tally((seq[:-1] << 32) | seq[1:])
        return keys[counts >= least], counts[counts >= least]
    keys, counts = _tally(((seq[:-1] << 16) | seq[1:]).astype(np.uint32))
    keys, counts = keys[counts >= least].astype(np.int64), counts[counts >= least]
    return (keys >> 16 << 32) | (keys & 0xFFFF), counts


def _choose(pairs: np.ndarray, counts: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second symbols of the pairs to replace: by falling count, each pair unless one taken before it ends
    with its first symbol or begins with its second.

    Pairs that no better one stands against are taken together, until none is left to decide.
    """
    pairs = pairs[np.lexsort((pairs, -counts))]
    a, b = pairs >> 32, pairs & _LOW
    begun, ended = np.zeros(symbols, bool), np.zeros(symbols, bool)
    begins, ends = np.empty(symbols, np.int64), np.empty(symbols, np.int64)
    taken, live = [], np.arange(len(pairs))
    while len(live):
        x, y = a[live], b[live]
        begins.fill(len(pairs)), ends.fill(len(pairs))
        begins[x[::-1]], ends[y[::-1]] = live[::-1], live[::-1]  # the best pair stays
        ok = (ends[x] >= live) & (begins[y] >= live)
        taken.append(live[ok])
        begun[x[ok]], ended[y[ok]] = True, True
        live = live[~ok & ~ended[x] & ~begun[y]]
        live = live[(a[live] != b[live]) | ~(begun[a[live]] | ended[a[live]])]
    taken = np.sort(np.concatenate(taken))
    return a[taken], b[taken]


def _places(seq: np.ndarray, a: np.ndarray, b: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the pairs ``(a, b)`` occur in ``seq`` without overlap, and which pair it is."""
    rows, row_of = np.unique(a, return_inverse=True)
    columns, column_of = np.unique(b, return_inverse=True)
    row, column = np.zeros(symbols, np.int64), np.zeros(symbols, np.int64)
    row[rows], column[columns] = np.arange(1, len(rows) + 1), np.arange(1, len(columns) + 1)
    at = np.flatnonzero((row > 0)[seq[:-1]] & (column > 0)[seq[1:]])
    width = len(columns) + 1
    keys, own = row[seq[at]] * width + column[seq[at + 1]], (row_of + 1) * width + column_of + 1
    if len(rows) * len(columns) <= _DENSE:
        cells = np.full((len(rows) + 1) * width, -1, np.int32)
        cells[own] = np.arange(len(own))
        which = cells[keys]
    else:
        order = np.argsort(own)
        near = order[np.minimum(np.searchsorted(own[order], keys), len(own) - 1)]
        which = np.where(own[near] == keys, near, -1)
    at, which = at[which >= 0], which[which >= 0]
    # only a pair of equal symbols can overlap itself: of each run of adjacent places every other one counts
    fresh = np.concatenate(([True], np.diff(at) != 1))
    if not fresh.all():
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        even = (np.arange(len(at)) - start) % 2 == 0
        at, which = at[even], which[even]
    return at, which


def _around(at: np.ndarray, offsets: tuple[int, ...], stop: int) -> np.ndarray:
    """The distinct places ``at + offset`` below ``stop``, in order."""
    near = np.sort(np.concatenate([at + o for o in offsets]))
    near = near[(near >= 0) & (near < stop)]
    return near[np.concatenate((near[1:] != near[:-1], [True]))] if len(near) else near


def compress(ids: np.ndarray, base: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """``(rules [k, 2], sequence)``; symbol ``base + i`` stands for rule i. All ids are below ``base``."""
    seq, symbols = ids.astype(np.int64), base
    rules: list[np.ndarray] = []
    keys, counts = _frequent(seq, symbols, min_count)
    while len(keys):
        a, b = _choose(keys, counts, symbols)
        at, which = _places(seq, a, b, symbols)
        many = 8 * len(at) > len(seq)
        if not many:
            gone = _around(at, (-1, 0, 1), len(seq) - 1)
            lost = (seq[gone] << 32) | seq[gone + 1]
            place = np.minimum(np.searchsorted(keys, lost), len(keys) - 1)
            counts = counts - np.bincount(place[keys[place] == lost], minlength=len(keys))
        seq[at] = symbols + which
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        symbols += len(a)
        rules.append(np.column_stack((a, b)))
        if many:
            keys, counts = _frequent(seq, symbols, min_count)
            continue
        near = _around(at - np.arange(len(at)), (-1, 0), len(seq) - 1)
        new, often = _tally((seq[near] << 32) | seq[near + 1]) if len(near) else (near, near)
        keys = np.concatenate((keys[counts >= min_count], new[often >= min_count]))
        counts = np.concatenate((counts[counts >= min_count], often[often >= min_count]))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    grammar = np.concatenate(rules).astype(np.uint32) if rules else np.zeros((0, 2), np.uint32)
    return grammar, seq.astype(np.uint16 if symbols <= 1 << 16 else np.uint32)


def sizes_of(rules: np.ndarray, base: int) -> np.ndarray:
    """The length of every rule's full expansion."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1))
    return np.array(out, np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i]`` one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def expand_all(seq: np.ndarray, rules: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
    """The ids that the whole of ``seq`` stands for: each rule is expanded once, and its ids are copied to where it stands."""
    full: list[list[int]] = []
    for a, b in rules.tolist():
        full.append((full[a - base] if a >= base else [a]) + (full[b - base] if b >= base else [b]))
    seq = seq.astype(np.int64)
    inner = seq >= base
    source = np.concatenate((np.array([i for x in full for i in x], np.uint32), seq[~inner].astype(np.uint32)))
    each, starts = _lengths(seq, sizes, base), np.empty(len(seq), np.int64)
    starts[~inner] = len(source) - int((~inner).sum()) + np.arange(int((~inner).sum()))
    starts[inner] = (np.cumsum(sizes, dtype=np.int64) - sizes)[seq[inner] - base]
    return source[ragged(starts, each)]


def expand(seq: np.ndarray, rules: np.ndarray, sizes: np.ndarray, base: int, skip: int = 0, take: int | None = None, touched: set[int] | None = None) -> np.ndarray:
    """The ids that ``seq`` stands for, or of these ``take`` after the first ``skip``.

    All symbols are replaced by their pairs level by level. Symbols whose ids, by the lengths in ``sizes``, lie outside of
    what is wanted are dropped before each level, so only rules that hold wanted ids are read; ``touched`` collects them.
    """
    symbols = seq.astype(np.int64)
    each = _lengths(symbols, sizes, base)
    total = int(each.sum())
    take = max(0, total - skip if take is None else min(take, total - skip))
    while True:
        if skip or take < total:
            ends = np.cumsum(each)
            keep = slice(int(np.searchsorted(ends, skip, "right")), int(np.searchsorted(ends, skip + take, "left")) + 1)
            skip -= int(ends[keep.start - 1]) if keep.start else 0
            symbols, each = symbols[keep], each[keep]
            total = int(each.sum())
        inner = symbols >= base
        if not take or not inner.any():
            return symbols[skip : skip + take].astype(np.uint32)
        which = symbols[inner] - base
        if touched is not None:
            touched.update(which.tolist())
        width = 1 + inner
        at = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int64)
        out[at[~inner]] = symbols[~inner]
        pairs = rules[which].astype(np.int64)
        out[at[inner]], out[at[inner] + 1] = pairs[:, 0], pairs[:, 1]
        symbols, each = out, _lengths(out, sizes, base)


def _lengths(symbols: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
    each = np.ones(len(symbols), np.int64)
    inner = symbols >= base
    each[inner] = sizes[symbols[inner] - base]
    return each
