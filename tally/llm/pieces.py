"""Encoding a text match by match, with stores of what a worker has encoded lately.

A tokenizer's pattern cuts a text into matches that are encoded by themselves. The common byte-level pattern
takes a single space with what follows it, so a text may be cut before every space that has no white space
beside it, and the parts be cut by the pattern one by one. Parts recur, and so their ids are kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: The pattern of byte-level tokenizers, a fixed value of their files.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space other than the space and the line feed.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
#: Letters of the Latin alphabets, and marks of ASCII after them: a space, letters and marks are two matches of the pattern.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)")
KEPT = 300_000
KEPT_CHARS = 48


class Recent(dict):
    """A store that makes what it lacks. When it is full, it starts anew, and takes over what is asked for again."""

    def __init__(self, make: Callable[[str], bytes], kept: int = KEPT):
        super().__init__()
        self.make, self.kept, self.old = make, kept, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > KEPT_CHARS:
                return value
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Texts to the ids' bytes, by a pattern and a function that encodes one match."""

    def __init__(self, pattern: str, match_ids: Callable[[str], bytes], kept: int = KEPT):
        self.find = regex.compile(pattern).findall
        self.parts_at_spaces = pattern == BYTE_LEVEL
        self.matches = Recent(match_ids, kept)
        self.after_space = Recent(self._after_space, kept)

    def _after_space(self, part: str) -> bytes:
        plain = _PLAIN.fullmatch(part)
        if plain is None:
            return self.by_match(" " + part)
        letters, marks = plain.groups()
        return self.after_space[letters] + self.matches[marks] if marks else self.matches.make(" " + letters)

    def by_match(self, text: str) -> bytes:
        return b"".join(map(self.matches.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        if not self.parts_at_spaces or "  " in text or "\n " in text or " \n" in text or _OTHER_SPACE.search(text):
            return self.by_match(text)
        first, *rest = text.split(" ")
        return self.by_match(first) + b"".join(map(self.after_space.__getitem__, rest))
