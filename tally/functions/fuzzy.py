"""Similarity of strings, where no built-in function has it.

Ratios count what two strings have in common in order, the longest common subsequence: 200 * common / (both lengths), from 0 to 100.
The partial ratio is that of the shorter string with its best window in the longer one; windows are as long as the shorter string, or
shorter at the ends. For many pairs at once, numpy keeps the subsequences of all windows of all pairs as bits of a word and moves
them on by one character a step."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Bits of a word; longer strings take whole numbers of any length, one pair after another.
WORD = 64
#: Windows that are worked on at once: few enough for their arrays to stay in a core's own memory.
CELLS = 1 << 16


def common_of(a: str, b: str) -> int:
    """The length of the longest common subsequence: bit i of `open_` is cleared where a[:i + 1] gains one."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & places.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def ratio_of(a: str, b: str) -> float:
    return 200.0 * common_of(a, b) / (len(a) + len(b)) if a or b else 100.0


def _windows(short: str, long: str) -> list[str]:
    m, n = len(short), len(long)
    return [long[max(0, s) : s + m] for s in range(1 - m, n)]


def partial_ratio_of(a: str, b: str) -> float:
    """The plain form, window by window."""
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    found = [ratio_of(short, w) for w in _windows(short, long)]
    if len(a) == len(b):
        found += [ratio_of(long, w) for w in _windows(long, short)]
    return max(found)


def _codes(texts: list[str], before: int, width: int) -> np.ndarray:
    """The texts' characters by number, each text from place `before` on; -1 stands for no character."""
    out = np.full((len(texts), width), -1, np.int64)
    for row, text in zip(out, texts, strict=True):
        row[before : before + len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _one_way(shorts: list[str], longs: list[str]) -> np.ndarray:
    """Partial ratios of pairs, each of a string of WORD characters at most in a window of the other."""
    sizes, lengths = (np.array([len(s) for s in strings]) for strings in (shorts, longs))
    most, longest = int(sizes.max()), int(lengths.max())
    letters = np.unique(_codes(shorts, 0, most))  # what is none of these has no place
    places = np.zeros((len(shorts), len(letters) + 1), np.uint64)
    index = {chr(c): i for i, c in enumerate(letters.tolist()) if c >= 0}
    for row, s in zip(places, shorts, strict=True):
        for i, c in enumerate(s):
            row[index[c]] |= np.uint64(1 << i)
    padded = _codes(longs, most, longest + 2 * most)
    at = np.minimum(np.searchsorted(letters, padded), len(letters) - 1)
    at[letters[at] != padded] = len(letters)
    # the bits of each character of a long string in its short one, once for all windows that it is in
    bits = np.take_along_axis(places, at, axis=1)
    starts = np.arange(longest + most)[None, :]  # of windows, in padded; they begin at most - size + 1 and end before most + length
    used = (starts > (most - sizes)[:, None]) & (starts < (most + lengths)[:, None])
    open_ = np.full(used.shape, ~np.uint64(0))
    alike = int(sizes.min())
    for step in range(most):
        here = bits[:, step : step + used.shape[1]]
        hit = open_ & (here if step < alike else np.where((step < sizes)[:, None], here, np.uint64(0)))
        open_ = (open_ + hit) | (open_ - hit)
    low = np.where(sizes == WORD, ~np.uint64(0), (np.uint64(1) << (sizes % WORD).astype(np.uint64)) - np.uint64(1))
    common = np.bitwise_count(~open_ & low[:, None])
    ends = np.minimum(starts + sizes[:, None], (most + lengths)[:, None]) - np.maximum(starts, most)  # characters of the window
    return np.where(used, 200.0 * common / (sizes[:, None] + np.maximum(ends, 1)), 0.0).max(axis=1)


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The partial ratio of each pair."""
    out = np.zeros(len(a))
    easy = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if min(len(x), len(y)) > WORD:
            out[i] = partial_ratio_of(x, y)
        elif x and y:
            easy.append(i)
    easy.sort(key=lambda i: (min(len(a[i]), len(b[i])), max(len(a[i]), len(b[i]))))  # pairs of like sizes share arrays
    at = 0
    while at < len(easy):
        wide, end = 1, at
        while end < len(easy) and (end - at + 1) * (wide := max(wide, len(a[easy[end]]) + len(b[easy[end]]))) <= max(CELLS, wide):
            end += 1
        part = easy[at:end]
        short, long = zip(*((a[i], b[i]) if len(a[i]) <= len(b[i]) else (b[i], a[i]) for i in part))
        out[part] = _one_way(list(short), list(long))
        if same := [k for k, i in enumerate(part) if len(a[i]) == len(b[i])]:
            both = _one_way([long[k] for k in same], [short[k] for k in same])
            where = [part[k] for k in same]
            out[where] = np.maximum(out[where], both)
        at = end
    return out


def least_common(size: int, least: float) -> int:
    """How many characters, in order, a string of this size has in common with every window that gives the ratio `least`. A window
    is no longer than the string."""
    return -int(-least * size // (200 - least))


def least_grams(size: int, least: float, q: int) -> int:
    """How many runs of q characters the string shares at least with such a window: what is common lies in runs, of which each but
    the first follows a character that one side has for itself, and a run of n characters has n - q + 1 of them."""
    counts = []
    for window in range(1, size + 1):
        for common in range(int(-(-least * (size + window) // 200)), min(size, window) + 1):
            counts.append(common - (q - 1) * min(common, 1 + size + window - 2 * common))
    return min(counts, default=size)


def token_set_ratio_of(a: str, b: str) -> float:
    """The best ratio between the common words and each side's words, from 0 to 100."""
    x, y = set(a.lower().split()), set(b.lower().split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    sizes = [len(both) + bool(both) + len(s) for s in (left, right)]
    apart = len(left) + len(right) - 2 * common_of(left, right)
    best = 100.0 * (1 - apart / sum(sizes))
    if both:
        best = max(best, *(100.0 * (1 - (s - len(both)) / (s + len(both))) for s in sizes))
    return best


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(partial_ratios(list(a.fillna("")), list(b.fillna(""))), dtype="float64")


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio_of(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")
