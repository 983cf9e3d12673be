"""Splitting a text as the byte-level tokenizer does, before any merges."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import regex
from tokenizers.pre_tokenizers import ByteLevel

# The pattern by which the byte-level tokenizer splits a text, and
# the same for ASCII alone, where a simpler engine is faster.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
)

_split = regex.compile(PATTERN).findall
_split_ascii = re.compile(ASCII_PATTERN).findall

# The same again for Latin letters and general punctuation, whose classes are the
# same in all Unicode versions: the classes are spelt out for the simpler engine.
_LATIN = [*range(0x378), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in _LATIN if unicodedata.category(chr(c))[0] == kind)


_L, _N, _S = _class("L"), _class("N"), " \\t-\\r\\x85\\xa0"
_split_latin = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
).findall
_not_latin = re.compile("[^\0-\u0377\u2010-\u2027\u2030-\u205e]").search


def _unassigned() -> Iterator[str]:
    """Ranges of code points without a meaning in Python's Unicode tables."""
    start = None
    for point in range(0x80, 0x110001):
        free = point < 0x110000 and unicodedata.category(chr(point)) == "Cn"
        if free and start is None:
            start = point
        elif not free and start is not None:
            yield f"{chr(start)}-{chr(point - 1)}"
            start = None


# Later Unicode versions give these a class; each library knows another version.
_new_letter = re.compile(f"[{''.join(_unassigned())}]").search
_library = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str


def pieces(text: str) -> list[str]:
    """The words whose merges are independent of each other; joined, the text."""
    if text.isascii():
        return _split_ascii(text)
    if not _not_latin(text):
        return _split_latin(text)
    if _new_letter(text):
        return [text[a:b] for _, (a, b) in _library(text)]
    return _split(text)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of the vocabulary file stands for.

    Printable bytes stand for themselves, the rest for letters from U+0100 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Memo(dict):
    """Results of ``make`` by word, the latest LIMIT to twice as many of them."""

    LIMIT = 1 << 18

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> object:
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        self.keep(word, found)
        return found

    def all(self, words: list[str]) -> list:
        """Results for the words; those that are new are made together, see ``fill``."""
        found = list(map(self.get, words))
        if None in found:
            places = [i for i, v in enumerate(found) if v is None]
            new = dict.fromkeys([words[i] for i in places])
            made = {w: self.old[w] for w in new if w in self.old}
            rest = [w for w in new if w not in made]
            made.update(zip(rest, self.fill(rest), strict=True))
            for i in places:
                found[i] = made[words[i]]
            for word, value in made.items():
                self.keep(word, value)
        return found

    def fill(self, words: list[str]) -> list:
        return list(map(self.make, words))

    def keep(self, word: str, found: object) -> None:
        if len(self) >= self.LIMIT:
            self.old = dict(self)
            self.clear()
        self[word] = found
