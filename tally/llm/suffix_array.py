"""External induced sorting of suffixes with common-prefix values, in numpy.

Suffixes are S or L by whether they are below or above their successor; S* suffixes are S after L. S* suffixes
are sorted by naming the substrings between them and sorting the string of names: by the same induction again
while it is longer than `base`, else in memory by doubling. From their order all L suffixes are induced in
ascending order of symbols, and from those all S suffixes in descending order.

Each induction is a monotone priority queue of tuples (first symbol, order of arrival; position, common prefix):
whoever is taken pushes its left neighbour, so within a first symbol tuples arrive in order, and a queue is one
spool for each symbol, taken by the batch. Spools go to disk beyond `memory` bytes. The common prefix of two
tuples of a spool is one more than the least of those between the suffixes that pushed them.

Prefixes are compared up to `limit` symbols: suffixes that agree so far may stand in any order.
"""

from __future__ import annotations

import os
import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

BATCH = 1 << 16
MEMORY = 8 << 20
BASE = 1 << 23


def _spill_folder() -> str | None:
    """Where Spark itself spills on this executor; the system's choice outside a task."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None


class Spools:
    """For each symbol a sequence of (position, common prefix), kept in memory up to a budget and else on disk."""

    def __init__(self, memory: int):
        self.memory, self.held = memory, 0
        self.parts: dict[int, deque] = {}
        self.file = None

    def add(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts.setdefault(symbol, deque()).append((pos, lcp))
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(prefix="suffix-spool-", dir=_spill_folder())  # noqa: SIM115
        for parts in self.parts.values():
            live = [p for p in parts if isinstance(p[0], np.ndarray)]
            if not live:
                continue
            merged, run = deque(), []
            for p in [*parts, None]:
                if p is not None and isinstance(p[0], np.ndarray):
                    run.append(p)
                    continue
                if run:
                    pos, lcp = (np.concatenate(x) for x in zip(*run))
                    at = self.file.seek(0, 2)
                    self.file.write(pos.astype(np.int64).tobytes())
                    self.file.write(lcp.astype(np.int32).tobytes())
                    merged.append((at, len(pos)))
                    run = []
                if p is not None:
                    merged.append(p)
            parts.clear()
            parts.extend(merged)
        self.held = 0

    def _load(self, part) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(part[0], np.ndarray):
            self.held -= part[0].nbytes + part[1].nbytes
            return part
        at, n = part
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(4 * n), np.int32)

    def take(self, symbol: int, last: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """The next parts of the symbol, about a batch, from the front or (last) from the back, in order."""
        parts, got, n = self.parts.get(symbol), [], 0
        while parts and n < BATCH:
            part = self._load(parts.pop() if last else parts.popleft())
            got.append(part)
            n += len(part[0])
        if not got:
            return None
        if last:
            got.reverse()
        return got[0] if len(got) == 1 else tuple(np.concatenate(x) for x in zip(*got))

    def close(self) -> None:
        if self.file:
            self.file.close()


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last] for each pair, first <= last."""
    span = (last - first + 1).astype(np.int64)
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(first), values.dtype)
    table, width = values, 1
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            table = np.minimum(table[: len(table) - width], table[width:])
            width *= 2
        mine = np.flatnonzero(level == k)
        if len(mine):
            out[mine] = np.minimum(table[first[mine]], table[last[mine] - width + 1])
    return out


class _Pushes:
    """Pushes left neighbours, with the common prefix between each and the one before it in its spool."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, limit: int, spools: Spools):
        self.text, self.wanted, self.limit, self.spools = text, wanted, limit, spools
        self.open: dict[int, int] = {}  # the least common prefix since the last push to the symbol, by symbol

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        """pos, in order of being taken; lcp[k]: with the one taken before."""
        before = pos - 1
        takes = np.flatnonzero((pos > 0) & self.wanted[before])
        least = int(lcp.min())
        if len(takes):
            symbols = self.text[before[takes]]
            order = np.argsort(symbols, kind="stable")
            takes, symbols = takes[order], symbols[order]
            first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
            start = np.empty(len(takes), np.int64)
            start[1:] = takes[:-1] + 1
            start[first] = 0
            common = _range_min(lcp, start, takes)
            names = symbols[first].tolist()
            for k, s in zip(first.tolist(), names):
                common[k] = min(int(common[k]), self.open.get(s, 0))
            common = np.minimum(common + 1, self.limit).astype(np.int32)
            rest = np.minimum.accumulate(lcp[::-1])[::-1]
            ends = [*first[1:].tolist(), len(takes)]
            pushed = before[takes]
            for s in self.open:
                if self.open[s] > least:
                    self.open[s] = least
            for s, a, b in zip(names, first.tolist(), ends):
                tail = int(takes[b - 1]) + 1
                self.open[s] = int(rest[tail]) if tail < len(lcp) else self.limit
                self.spools.add(s, pushed[a:b], common[a:b])
        else:
            for s in self.open:
                if self.open[s] > least:
                    self.open[s] = least


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is S; the last symbol is the only smallest one, and S."""
    n = len(text)
    below = np.empty(n, bool)
    below[-1] = True
    step = np.ones(n, bool)  # where the next symbol differs
    below[:-1] = text[:-1] < text[1:]
    step[:-1] = text[:-1] != text[1:]
    places = np.arange(n, dtype=np.int32)  # a shard is below 2**31 symbols
    nearest = np.minimum.accumulate(np.where(step, places, np.int32(n))[::-1])[::-1]
    return below[nearest]


def _runs(text: np.ndarray, limit: int) -> np.ndarray:
    """How often each symbol is repeated from its place on, up to limit."""
    n = len(text)
    last = np.ones(n, bool)
    last[:-1] = text[:-1] != text[1:]
    places = np.arange(n, dtype=np.int32)
    nearest = np.minimum.accumulate(np.where(last, places, np.int32(n))[::-1])[::-1]
    return np.minimum(nearest - places + 1, limit)


def _packed(text: np.ndarray, at: np.ndarray, end: np.ndarray, bits: int, per: int) -> np.ndarray:
    """`per` symbols from `at` on in one number; places after `end` count as above all symbols."""
    above = (1 << bits) - 1
    key = np.zeros(len(at), np.int64)
    for t in range(per):
        i = at + t
        inside = i <= end
        key = key << bits | np.where(inside, text[np.minimum(i, end)], above)
    return key


def _bits(text: np.ndarray) -> tuple[int, int]:
    bits = int(text.max()).bit_length() + 1
    return bits, max(1, 63 // bits)


def _names(text: np.ndarray, star: np.ndarray) -> np.ndarray:
    """Ranks, from 0 and without gaps, of the substrings from each S* place to the next, both included.
    A substring that another one begins with is above it: at its end it is S where the other is L."""
    bits, per = _bits(text)
    end = np.r_[star[1:], star[-1]]
    rank = np.zeros(len(star), np.int64)
    active, done = np.arange(len(star)), 0
    while len(active):
        key = _packed(text, star[active] + done, end[active], bits, per)
        old = rank[active]
        order = np.argsort(key, kind="stable") if not done else np.lexsort((key, old))
        key, old, active = key[order], old[order], active[order]
        group = np.r_[True, old[1:] != old[:-1]]
        part = group | np.r_[True, key[1:] != key[:-1]]
        index = np.arange(len(active))
        group_at = np.maximum.accumulate(np.where(group, index, 0))
        part_at = np.maximum.accumulate(np.where(part, index, 0))
        rank[active] = old + part_at - group_at
        sizes = np.diff(np.r_[np.flatnonzero(part), len(active)])
        done += per
        more = (np.repeat(sizes, sizes) > 1) & (end[active] - star[active] + 1 >= done)
        active = active[more]
    return np.unique(rank, return_inverse=True)[1]


def _doubled(names: np.ndarray, star: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of names, and how many names neighbours in it share, by doubling in memory."""
    m = len(names)
    level = names.astype(np.int64) + 1
    levels, h = [level.astype(np.int32)], 1
    while level.max() < m and h < m and (star[h:] - star[:-h]).min() < limit:
        key = level * (m + 1)
        key[:-h] += level[h:]
        order = np.argsort(key)
        part = np.r_[True, np.diff(key[order]) != 0]
        level = np.empty(m, np.int64)
        level[order] = np.cumsum(part)
        levels.append(level.astype(np.int32))
        h *= 2
    order = np.argsort(level, kind="stable")
    shared = np.zeros(m, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero((a < m) & (b < m))
        same = same[levels[k][a[same]] == levels[k][b[same]]]
        for x in (a, b):
            x[same] = np.minimum(x[same] + (1 << k), m)
        shared[1:][same] += 1 << k
    return order, shared


def _sorted_stars(text: np.ndarray, star: np.ndarray, limit: int, memory: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The S* places in order of their suffixes, and the common prefix of each with the one before."""
    names = _names(text, star)
    if len(names) > base and int(names.max()) + 1 < len(names):
        parts = [(p, c) for p, c in _descending(names, limit, memory, base)]
        down, common = (np.concatenate(x) for x in zip(*parts))
        order, shared = down[::-1], np.r_[0, common[::-1][:-1]]
    else:
        order, shared = _doubled(names, star, limit)
    places = star[order]
    lcp = np.zeros(len(order), np.int64)
    ends = np.r_[star, star[-1]]
    skip = lambda o: ends[np.minimum(o + shared[1:], len(star))]
    lcp[1:] = np.minimum(skip(order[1:]) - places[1:], limit)
    # the names after the shared ones differ; their symbols are compared, several at once
    bits, per = _bits(text)
    last = len(text) - 1
    open_ = np.flatnonzero(lcp[1:] < limit) + 1
    while len(open_):
        x = _packed(text, places[open_] + lcp[open_], np.full(len(open_), last), bits, per)
        y = _packed(text, places[open_ - 1] + lcp[open_], np.full(len(open_), last), bits, per)
        differ = x ^ y
        high = np.where(differ > 0, np.frexp(differ.astype(np.float64))[1] - 1, -1)
        # frexp may round up to the next power of two
        high = np.where((high >= 0) & (differ >> np.maximum(high, 0) == 0), high - 1, high)
        same = np.where(differ == 0, per, per - 1 - high // bits)
        lcp[open_] = np.minimum(lcp[open_] + same, limit)
        open_ = open_[(differ == 0) & (lcp[open_] < limit)]
    return places, lcp.astype(np.int32)


def _descending(text: np.ndarray, limit: int, memory: int = MEMORY, base: int = BASE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from the greatest to the least, in batches of (places, common prefix with the one before)."""
    n = len(text)
    if n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.int32)
        return
    is_s = _types(text)
    star = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    runs = _runs(text, limit)
    places, prefix = _sorted_stars(text, star, limit, memory, base)
    symbols = np.unique(text).tolist()
    heads = text[places]
    bounds = dict(zip(symbols, zip(np.searchsorted(heads, symbols, "left").tolist(), np.searchsorted(heads, symbols, "right").tolist())))

    queue, sorted_l = Spools(memory), Spools(memory)
    pushes = _Pushes(text, ~is_s, limit, queue)
    for c in symbols:
        tail = -1  # the last suffix taken with this first symbol
        while (got := queue.take(c)) is not None:
            pos, lcp = got
            if tail < 0:
                lcp = lcp.copy()
                lcp[0] = 0
            sorted_l.add(c, pos, lcp)
            pushes.push(pos, lcp)
            tail = int(pos[-1])
        a, b = bounds[c]
        for x in range(a, b, BATCH):
            pos, lcp = places[x : min(x + BATCH, b)], prefix[x : min(x + BATCH, b)].copy()
            if x == a:
                lcp[0] = min(runs[tail], runs[pos[0]]) if tail >= 0 else 0
            pushes.push(pos, lcp)
    queue.close()
    del places, prefix, heads

    queue = Spools(memory)
    pushes = _Pushes(text, is_s, limit, queue)
    # the last symbol pushes nothing as S and stands last of all; nothing pushes it
    for c in reversed(symbols):
        tail = -1
        while (got := queue.take(c)) is not None:
            pos, lcp = got
            if tail < 0:
                lcp = lcp.copy()
                lcp[0] = 0
            pushes.push(pos, lcp)
            yield pos, lcp
            tail = int(pos[-1])
        later = None  # the common prefix of the L suffix taken last with the one before it in ascending order
        while (got := sorted_l.take(c, last=True)) is not None:
            pos, up = got[0][::-1], got[1][::-1]
            lcp = np.empty(len(pos), np.int32)
            lcp[1:] = up[:-1]
            if later is not None:
                lcp[0] = later
            else:
                lcp[0] = min(runs[tail], runs[pos[0]]) if tail >= 0 else 0
            later = up[-1]
            pushes.push(pos, lcp)
            yield pos, lcp
    queue.close()
    sorted_l.close()
    yield np.array([n - 1]), np.zeros(1, np.int32)


def suffix_array(text: np.ndarray, limit: int, memory: int = MEMORY, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a text that ends in its only least symbol, in ascending order of their first `limit`
    symbols, and the common prefix, up to limit, of each with the one before."""
    down, common = (np.concatenate(x) for x in zip(*_descending(text, limit, memory, base)))
    return down[::-1], np.r_[0, common[::-1][:-1]]


def repeated(strings: list[bytes], copies: np.ndarray, length: int, owner: np.ndarray | None = None, place: np.ndarray | None = None, memory: int = MEMORY, base: int = BASE) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each string, where substrings of `length` bytes start that also start elsewhere, in it or in another
    string; a string that stands for several copies is repeated as a whole. And, if owner (the rank of the text in
    which the string's first copy stands) and place (where) are given, whether each such start is the first of all
    that are equal to it, in order of text and place."""
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.r_[0, np.cumsum(sizes + 1)]
    text = np.empty(int(starts[-1]) + 1, np.uint16)
    text[:-1] = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
    text[:-1] += 2
    text[starts[1:] - 1] = 1  # ends a string
    text[-1] = 0
    found = np.zeros(len(text), bool)
    for k in np.flatnonzero(copies > 1):
        found[starts[k] : starts[k + 1]] = True
    alike = np.zeros(len(text) if owner is not None else 0, np.int32)  # equal starts have the same number
    before, classes = -1, 0
    for pos, lcp in _descending(text, length, memory, base):
        same = np.flatnonzero(lcp >= length)
        found[pos[same]] = True
        found[pos[same[same > 0] - 1]] = True
        if len(same) and same[0] == 0:
            found[before] = True
        if owner is not None:
            number = classes + np.cumsum(lcp < length)
            alike[pos] = number
            classes = int(number[-1])
        before = int(pos[-1])
    each = [np.flatnonzero(found[a : a + max(0, n - length + 1)]) for a, n in zip(starts.tolist(), sizes.tolist())]
    if owner is None:
        return each, []
    counts = [len(x) for x in each]
    string = np.repeat(np.arange(len(strings)), counts)
    at = np.concatenate([*each, np.zeros(0, np.int64)]).astype(np.int64)
    number = alike[starts[string] + at]
    order = np.lexsort((place[string] + at, owner[string], number))
    first = np.zeros(len(at), bool)
    first[order] = np.r_[True, np.diff(number[order]) != 0][: len(at)]
    return each, np.split(first, np.cumsum(counts)[:-1])
