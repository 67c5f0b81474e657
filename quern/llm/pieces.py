"""Splits text into the pieces that byte-pair merges stay within, and remembers what each piece became."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: Characters in which letters, digits and spaces are told apart by these classes alone, and normal form C changes nothing.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ"
_DIGIT = "0-9"
_SPACE = "\t-\r \x85\xa0"
_ODD = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ‐-‧‰-⁞₠-₿]")
_CLITIC = "'s|'t|'re|'ve|'m|'ll|'d"

BYTE_PIECES = re.compile(f"{_CLITIC}| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
WORD_PIECES = re.compile(f"{_CLITIC}|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+")


def is_plain(text: str) -> bool:
    """Whether the patterns above split this text as the Unicode classes do."""
    return not _ODD.search(text)


class PieceMemory:
    """What each piece became, for a bounded number of pieces: those met since the last turn, and those of the turn before."""

    def __init__(self, learn: Callable[[list[str]], Iterable], most: int = 200_000):
        self.learn, self.most, self.known, self.before = learn, most // 2, {}, {}

    def learn_all(self, pieces: Iterable[str]) -> None:
        """Learns what isn't known of these pieces, all at once."""
        if len(self.known) > self.most:
            self.known, self.before = {}, self.known
        known, before, new = self.known, self.before, []
        for piece in set(pieces).difference(known):
            found = before.get(piece)
            if found is None:
                new.append(piece)
            else:
                known[piece] = found
        known.update(zip(new, self.learn(new)))

    def __call__(self, pieces: list[str]) -> list:
        try:
            return list(map(self.known.__getitem__, pieces))
        except KeyError:
            self.learn_all(pieces)
            return list(map(self.known.__getitem__, pieces))

    def clear(self) -> None:
        self.known, self.before = {}, {}
