"""Texts to pre-token values through the distinct pre-tokens of a block of texts.

A single space between two characters that are not white space always starts a pre-token of the
pattern, so a text splits there without changing any match. Each distinct piece is matched once
per block; texts with other runs of white space next to a space are matched as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import regex

#: Distinct pieces kept between the blocks of a task; beyond it the block starts afresh. Results don't depend on it.
KEEP = 100_000
#: Characters of text that are matched at once.
SLICE = 4_000_000
#: The white space of the pattern. No pre-token pattern here tells its members apart.
WHITE = frozenset(c for c in map(chr, range(0x3100)) if regex.match(r"\s", c))


class PretokenValues:
    """Values of pre-tokens, each computed once per block of texts.

    ``learn`` maps a list of distinct pre-tokens to their values; ``join`` combines the values of
    consecutive pre-tokens.
    """

    def __init__(self, pattern: str, learn: Callable[[list[str]], Sequence], join: Callable[[Iterable], object], keep: int = KEEP):
        self.find = regex.compile(pattern).findall
        self.learn, self.join, self.keep = learn, join, keep
        self._forget()

    def _forget(self) -> None:
        self.pre: dict[str, object] = {}
        self.led: dict[str, object] = {}  # a piece, with the space before it -> value

    def of_block(self, texts: Sequence[str]) -> Iterator:
        """The joined value of each text, in slices of bounded length (a single text is never cut)."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
                size += len(texts[end])
                end += 1
            yield from self._of_slice(texts[at:end])
            at = end

    def _of_slice(self, texts: Sequence[str]) -> Iterator:
        if len(self.led) > self.keep or len(self.pre) > self.keep:
            self._forget()
        pieces: set[str] = set()
        for t in texts:
            pieces.update(t.split(" ")[1:])
        matched: dict[str, list[str]] = {}
        bound = set()  # pieces that touch other white space, besides the empty one
        for piece in pieces.difference(self.led, ("",)):
            if piece[0] in WHITE or piece[-1] in WHITE:
                bound.add(piece)
            elif piece.isalpha():  # letters only: one pre-token
                matched[piece] = [" " + piece]
            else:
                matched[piece] = self.find(" " + piece)
        # What is matched directly: the first piece, or the whole text where white space meets a space.
        alone, whole = [], set()
        for i, t in enumerate(texts):
            head, space, _ = t.partition(" ")
            if space and (head and head[-1] in WHITE or "  " in t or t[-1] == " " or bound and not bound.isdisjoint(t.split(" ")[1:])):
                whole.add(i)
                head = t
            alone.append(self.find(head))
        new: set[str] = set()
        for found in (*matched.values(), *alone):
            new.update(found)
        names = sorted(new.difference(self.pre))
        self.pre.update(zip(names, self.learn(names)))
        get = self.pre.__getitem__
        for piece, found in matched.items():
            self.led[piece] = self.join(map(get, found))
        led, join = self.led.__getitem__, self.join
        for i, t in enumerate(texts):
            first = join(map(get, alone[i]))
            yield first if i in whole else join((first, *map(led, t.split(" ")[1:])))
