"""Cleaning of note text, exact for any Unicode input."""

from __future__ import annotations

import json
import string
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import ABBREVIATIONS, REDACTED, SECRET_PATTERNS

# Whitespace here means what Unicode and the ASCII separators \x1c-\x1f call
# whitespace. Java's \s knows ASCII only, so the classes are spelled out. Java
# tests single characters below U+0100 by one table lookup but walks through
# all other members of a class, so text of ASCII alone takes a shorter class.
ASCII_SPACES = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20"
LATIN_SPACES = ASCII_SPACES + r"\x85\xa0"
WIDE_SPACES = r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CLASS = LATIN_SPACES + WIDE_SPACES
SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
KEPT_CHARS = string.ascii_letters + string.digits + ".,!?'"


def lookup_table(values: dict[str, str]) -> Column:
    """A literal map; one call, however many entries."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable."""
    return F.transform(F.array(value), body)[0]


def py_strip(text: Column) -> Column:
    """Cut whitespace from both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def is_blank(text: Column) -> Column:
    """True for null, empty and all-whitespace text."""
    return text.isNull() | (py_strip(text) == "")


def is_ascii(text: Column) -> Column:
    """True if every character takes one byte."""
    return F.octet_length(text) == F.char_length(text)


def _by_script(text: Column, clean) -> Column:
    """``clean(ascii_only)`` for the kind of characters in ``text``."""
    return F.when(is_ascii(text), clean(True)).otherwise(clean(False))


def _single_spaced(text: Column, ascii_only: bool) -> Column:
    spaces = ASCII_SPACES if ascii_only else SPACE_CLASS
    return F.trim(F.regexp_replace(text, f"[{spaces}]+", " "))


def _plain_marks(text: Column, ascii_only: bool) -> Column:
    collapsed = F.regexp_replace(text, r"([!?.,])\1+", "$1")
    special = f"[^{KEPT_CHARS}{LATIN_SPACES}]+"
    if not ascii_only:
        special = (
            rf"[^{KEPT_CHARS}{LATIN_SPACES}\u0100-\x{{10ffff}}]+"
            rf"|[\u0100-\x{{10ffff}}&&[^{WIDE_SPACES}]]+"
        )
    return F.regexp_replace(collapsed, special, "")


def _expanded(
    text: Column, ascii_only: bool, abbreviations: dict[str, str]
) -> Column:
    full = lookup_table(abbreviations)

    def joined(norm: Column) -> Column:
        # Deleting the non-letters keeps every space, so both splits line up.
        words = F.split(norm, " ")
        keys = F.split(F.regexp_replace(F.lower(norm), "[^a-z ]+", ""), " ")
        # The set test is a hash lookup; only hits pay for the map's linear one.
        return F.array_join(
            F.zip_with(
                words,
                keys,
                lambda w, k: F.when(k.isin(*abbreviations), full[k]).otherwise(w),
            ),
            " ",
        )

    return bind(_single_spaced(text, ascii_only), joined)


def clean_whitespace(text: Column) -> Column:
    """Whitespace runs become one space; none is left at the ends."""
    return _by_script(text, lambda ascii_only: _single_spaced(text, ascii_only))


def clean_punctuation(text: Column) -> Column:
    """Collapse repeated ``! ? . ,`` and delete all other special characters."""
    return _by_script(text, lambda ascii_only: _plain_marks(text, ascii_only))


def expand_abbreviations(
    text: Column, abbreviations: dict[str, str] = ABBREVIATIONS
) -> Column:
    """Replace each shorthand word by its full form.

    A word is looked up by its lower-cased letters alone; a hit replaces the
    whole word, digits and punctuation included.
    """
    if not abbreviations:
        return clean_whitespace(text)
    return _by_script(
        text, lambda ascii_only: _expanded(text, ascii_only, abbreviations)
    )


def clean_note(
    text: Column, abbreviations: dict[str, str] = ABBREVIATIONS
) -> Column:
    """Full cleaning; NULL where the note is blank."""

    def cleaned(ascii_only: bool) -> Column:
        plain = _plain_marks(F.lower(text), ascii_only)
        if not abbreviations:
            return _single_spaced(plain, ascii_only)
        expanded = _expanded(plain, ascii_only, abbreviations)
        # Joined words are single-spaced already unless a replacement is not.
        if all(v and v == " ".join(v.split()) for v in abbreviations.values()):
            return expanded
        return _single_spaced(expanded, False)

    return F.when(~is_blank(text), _by_script(text, cleaned))


def redact_secrets(
    text: Column, patterns: list[str] = SECRET_PATTERNS, mark: str = REDACTED
) -> Column:
    """Replace the value of every secret by ``mark``, keeping its name."""
    for pattern in patterns:
        unicode_pattern = pattern.replace(r"\s", f"[{SPACE_CLASS}]").replace(
            r"\S", f"[^{SPACE_CLASS}]"
        )
        text = F.regexp_replace(
            text, "(?iu)" + unicode_pattern, "$1" + mark.replace("$", r"\$")
        )
    return text


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str, dict[str, str]]:
    """(characters, their replacements, multi-character replacements).

    Derived from compatibility decomposition without combining marks. In the
    first pair, characters past the end of the replacements are deleted.
    """
    source, target, deleted, longer = [], [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        # Surrogates are no characters; Hangul is split by rule below.
        if 0xD800 <= point <= 0xDFFF or 0xAC00 <= point <= 0xD7A3:
            continue
        char = chr(point)
        if not (unicodedata.decomposition(char) or unicodedata.combining(char)):
            continue
        plain = "".join(
            c for c in unicodedata.normalize("NFKD", char)
            if not unicodedata.combining(c)
        )
        if plain == char:
            continue
        if not plain:
            deleted.append(char)
        elif len(plain) == 1:
            source.append(char)
            target.append(plain)
        else:
            longer[char] = plain
    return "".join(source + deleted), "".join(target), longer


def _hangul_letters(syllable: Column) -> Column:
    """The two or three letters of a Hangul syllable, by the Unicode formula."""
    leads = "".join(chr(0x1100 + i) for i in range(19))
    vowels = "".join(chr(0x1161 + i) for i in range(21))
    tails = "".join(chr(0x11A8 + i) for i in range(27))
    index = F.ascii(syllable) - 0xAC00
    return F.concat(
        F.substring(F.lit(leads), F.floor(index / 588).cast("int") + 1, F.lit(1)),
        F.substring(F.lit(vowels), F.floor(index % 588 / 28).cast("int") + 1, F.lit(1)),
        F.when(index % 28 == 0, "").otherwise(
            F.substring(F.lit(tails), index % 28, F.lit(1))
        ),
    )


def strip_accents(text: Column) -> Column:
    """Plain base characters: decomposed for compatibility, marks removed."""
    source, target, longer = _accent_tables()
    expansions = lookup_table(longer)
    hangul = "".join(map(chr, range(0xAC00, 0xD7A4)))

    def expand(char: Column) -> Column:
        return (
            F.when(char.between(hangul[0], hangul[-1]), _hangul_letters(char))
            .when(char > "\xbb", F.coalesce(expansions[char], char))
            .otherwise(char)
        )

    def expand_rare(plain: Column) -> Column:
        # Up to U+00FF only the three fractions have longer replacements, so
        # most text is done here. Other text is tested by hashed lookups.
        latin = ~plain.rlike(r"[^\x00-\xbb\xbf-\xff]")
        kept = F.translate(plain, "".join(longer) + hangul, "")
        per_char = F.array_join(F.transform(F.split(plain, ""), expand), "")
        return F.when(
            latin | (F.char_length(kept) == F.char_length(plain)), plain
        ).otherwise(per_char)

    return F.when(is_ascii(text), text).otherwise(
        bind(F.translate(text, source, target), expand_rare)
    )
