"""Splitting texts for byte-level BPE, and a bounded memory of words already encoded."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import islice
from sys import getsizeof

import regex

#: The byte-level pattern for texts of ASCII and letters alone, in the standard library's
#: dialect, where \w, digits and blanks then mean the same. Branches that start with unlike
#: characters stand in the order of their frequency.
_PLAIN = re.compile(r""" ?[^\W\d_]++| ?[0-9]++|'s|'t|'re|'ve|'m|'ll|'d| ?(?:[^\w\s]|_)++|\s+(?!\S)|\s+""")
#: Words that are split off and held at once.
MATCHES = 200_000
_SAFE = {chr(i) for i in (9, 10, 13, *range(32, 127))}
_UNSAFE: set[str] = set()

#: The pattern for which _PLAIN stands.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _plain(text: str) -> bool:
    new = set(text) - _SAFE
    if not new:
        return True
    if not new.isdisjoint(_UNSAFE):
        return False
    letters = {c for c in new if unicodedata.category(c)[0] == "L"}
    _SAFE.update(letters)
    _UNSAFE.update(new - letters)
    return len(letters) == len(new)


def splitter(pattern: str) -> Callable[[str], Iterator[list[str]]]:
    """All matches of the pattern in a text, MATCHES at a time. White space is Unicode's property, as in the
    tokenizer libraries; Python's own also counts four separators among the controls."""
    exact = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))

    def split(text: str) -> Iterator[list[str]]:
        use = _PLAIN if pattern == BYTE_LEVEL and _plain(text) else exact
        if len(text) <= MATCHES:
            yield use.findall(text)
            return
        found = (m[0] for m in use.finditer(text))
        while part := list(islice(found, MATCHES)):
            yield part

    return split


class WordMemory:
    """Encodes texts word by word with `merge`, which is asked once for a word as long as
    the word is remembered. The words remembered, their ids and what Python adds take `most`
    bytes at most, besides those of the last MATCHES words; a word that takes a quarter of that isn't remembered."""

    def __init__(self, split: Callable[[str], Iterator[list[str]]], merge: Callable[[list[str]], list[bytes]], most: int = 48 << 20):
        self.split, self.merge, self.half = split, merge, most // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def _ids(self, parts: list[list[str]]) -> list[bytes]:
        words = set().union(*parts)
        found = {w: self.old.get(w) for w in words.difference(self.young)}
        new = [w for w, b in found.items() if b is None]
        if new:
            found.update(zip(new, self.merge(new)))
        self.young.update(found)
        get = self.young.__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        for w, b in found.items():
            cost = getsizeof(w) + getsizeof(b) + 100
            if cost > self.half // 2:
                del self.young[w]
            else:
                self.size += cost
        if self.size > self.half:
            self.old, self.young, self.size = self.young, {}, 0
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, owners, n = [], [], 0
        for i, text in enumerate(texts):
            for part in self.split(text):
                held.append(part)
                owners.append(i)
                n += len(part)
                if n >= MATCHES:
                    for k, b in zip(owners, self._ids(held)):
                        out[k].append(b)
                    held, owners, n = [], [], 0
        for k, b in zip(owners, self._ids(held)):
            out[k].append(b)
        return [b"".join(parts) for parts in out]
