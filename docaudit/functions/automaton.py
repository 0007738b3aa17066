"""A suffix automaton of a pool of strings: how much of a text the pool has, by one walk."""

from __future__ import annotations

import re
from collections.abc import Iterable

_CJK_PAIR, _PERCENT, _CAPITALS, _CJK = (re.compile(p) for p in ("[㐀-鿿]{2}", r"\d+(?:\.\d+)?%", "[A-Z]{4,}", "[㐀-鿿]"))


class Pool:
    """All substrings of some strings. States and steps are linear in the strings' lengths."""

    def __init__(self, strings: Iterable[str]):
        self.step: list[dict[str, int]] = [{}]
        self.back, self.size = [-1], [0]
        #: Pairs of characters that a string has one character apart.
        self.apart: set[tuple[str, str]] = set()
        for s in set(strings):
            at = 0
            for c in s:
                at = self._add(at, c)
            self.apart.update(zip(s, s[2:], strict=False))

    def _state(self, step: dict[str, int], size: int) -> int:
        self.step.append(step)
        self.back.append(0)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, at: int, c: str, to: int) -> int:
        """The state of the strings that end in at's with c; parted from `to` if that also has longer ones."""
        if self.size[to] == self.size[at] + 1:
            return to
        new = self._state(dict(self.step[to]), self.size[at] + 1)
        self.back[new], self.back[to] = self.back[to], new
        while at >= 0 and self.step[at].get(c) == to:
            self.step[at][c] = new
            at = self.back[at]
        return new

    def _add(self, last: int, c: str) -> int:
        if c in self.step[last]:
            return self._split(last, c, self.step[last][c])
        new, at = self._state({}, self.size[last] + 1), last
        while at >= 0 and c not in self.step[at]:
            self.step[at][c] = new
            at = self.back[at]
        if at >= 0:
            self.back[new] = self._split(at, c, self.step[at][c])
        return new

    def begins(self, text: str) -> list[int]:
        """For each place of a text, where the longest stretch begins that ends there and is in the pool."""
        at, held, out = 0, 0, []
        for i, c in enumerate(text):
            while at and c not in self.step[at]:
                at = self.back[at]
                held = self.size[at]
            if c in self.step[at]:
                at, held = self.step[at][c], held + 1
            out.append(i + 1 - held)
        return out

    def covered(self, text: str) -> list[bool]:
        """Which characters are in stretches of two or more that the pool has, the longest first from the left; a single
        one between two such is covered if the pool has its neighbours one character apart."""
        begins, out = self.begins(text), [False] * len(text)
        at = end = 0
        while at < len(text) - 1:
            end = max(end, at)
            while end < len(text) and begins[end] <= at:
                end += 1  # begins only grow, so the end of the longest stretch from `at` does too
            if end - at >= 2:
                out[at:end] = [True] * (end - at)
            at = end if end - at >= 2 else at + 1
        for i in range(1, len(text) - 1):
            if out[i - 1] and not out[i] and (text[i - 1], text[i + 1]) in self.apart:
                out[i] = out[i + 1] = True
        return out

    def lacks(self, text: str) -> bool:
        """Whether a normalised line has text that no string of the pool has."""
        if len(text) < 2:
            return False
        seen = self.covered(text)
        runs = "".join(" " if c else ch for ch, c in zip(text, seen, strict=True)).split()
        if any(_CJK_PAIR.search("".join(_CJK.findall(r))) or _PERCENT.search(r) or _CAPITALS.search(r) for r in runs):
            return True
        return len(text) >= 3 and len(_CJK.findall(text)) >= 2 and any(_CJK.search(r) for r in runs) and seen.count(False) >= 0.3 * len(text)
