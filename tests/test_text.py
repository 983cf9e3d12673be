import random
import re
import string
import unicodedata

import pytest
from pyspark.sql import functions as F

from fieldsift.fixed_values import ABBREVIATIONS
from fieldsift.functions import text as T


def unaccented(t):
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


RULES = [T.py_strip, T.clean_whitespace, T.clean_punctuation, T.expand_abbreviations, T.clean_note, T.strip_accents]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    chars = "abzAZ09 \t\n\r\x0b\x1c\x1f\x85\xa0\u2003\u3000éİßΣçñ!!??..,,-'#$%\\\U0001f600\u212aﬁ½한각"
    words = ["stk!!", "nt", "OT", "rt2", "x", "supply-chain", "it's", "$1", "100%"]
    return [
        "".join(
            rng.choice([rng.choice(chars), rng.choice(words)])
            for _ in range(rng.randrange(25))
        )
        for _ in range(1500)
    ] + ["", "   ", "\u00a0\u2003", "".join(map(chr, range(0x3100)))]


def test_white_space_is_that_of_python(apply, texts):
    assert apply(T.py_strip, texts) == [t.strip() for t in texts]
    joined = [" ".join(re.split(r"\s+", t)).strip() for t in texts]
    assert apply(T.clean_whitespace, texts) == joined
    assert apply(T.strip_accents, texts) == [unaccented(t) for t in texts]


def test_punctuation_properties(apply, texts):
    kept = set(string.ascii_letters + string.digits + ".,!?'")
    found = apply(T.clean_punctuation, texts)
    for text, out in zip(texts, found, strict=True):
        assert all(c in kept or c.isspace() for c in out)
        assert [c for c in out if c.isalnum()] == [c for c in text if c in kept and c.isalnum()]
        assert [c for c in out if c.isspace()] == [c for c in text if c.isspace()]
    cases = {"a!!b??c..d,,e": "a!b?c.d,e", "!?!?": "!?!?", "#a$": "a", ".#.": "..", "it''s": "it''s", "é-1": "1"}
    assert apply(T.clean_punctuation, list(cases)) == list(cases.values())


def test_abbreviation_properties(apply, texts):
    words = {w: full for w, full in ABBREVIATIONS.items() if w.isalpha()}
    assert apply(T.expand_abbreviations, list(words)) == list(words.values())
    assert apply(T.expand_abbreviations, [f" {w.upper()}!1 zz" for w in words]) == [f"{f} zz" for f in words.values()]
    for text, out in zip(texts, apply(T.expand_abbreviations, texts), strict=True):
        for word in text.split():
            if not any(c in string.ascii_letters for c in word):
                assert word in out


def test_clean_note_properties(apply, texts):
    kept = set(string.ascii_lowercase + string.digits + ".,!?' ")
    found = apply(T.clean_note, texts)
    steps = T.clean_whitespace, T.expand_abbreviations, T.clean_punctuation
    lowered = apply(lambda c: steps[0](steps[1](steps[2](F.lower(c)))), [t for t in texts if t.isascii()])
    assert [o for t, o in zip(texts, found, strict=True) if t.isascii() and o is not None] == [
        o for t, o in zip([t for t in texts if t.isascii()], lowered, strict=True) if t.strip()
    ]
    for text, out in zip(texts, found, strict=True):
        assert (out is None) == (not text.strip())
        if out is not None:
            assert set(out) <= kept and out == " ".join(out.split())


@pytest.mark.parametrize("rule", RULES, ids=lambda f: f.__name__)
def test_null_stays_null(apply, rule):
    assert apply(rule, [None]) == [None]


def test_clean_note_examples(apply):
    notes = [
        "  STK!!! nt cmng frm 5-LOW... rt2 #899,, ot?? supply-chain dlvry P  ",
        "supply\u00a0chain",
        "non\u2003stop\x1cgo",
        "it's 50% off",
        "!!",
        "NA",
    ]
    assert apply(T.clean_note, notes) == [
        "stock not coming from 5low. rate 899, out of supplychain delivery p",
        "supply chain",
        "non stop go",
        "it's 50 off",
        "!",
        "na",
    ]


def test_cleaning_twice_changes_nothing(apply):
    once = apply(T.clean_note, ["STK!!  low?? from dlvry...", "a  b\tc", "Retailer's ot"])
    assert apply(T.clean_note, once) == once


def test_own_abbreviations(apply):
    double = {"ab": "two  words", "cost": "$1 \\1"}
    assert apply(lambda c: T.clean_note(c, double), ["AB! cost"]) == ["two words $1 \\1"]
    assert apply(lambda c: T.clean_note(c, {}), ["A  stk"]) == ["a stk"]


def test_blank(apply):
    assert apply(T.is_blank, [None, "", " \t", "\u00a0", "\x1c", "a"]) == [True] * 5 + [False]


def test_every_accented_character(apply):
    chars = [
        chr(p) for p in range(0x80, 0x2FA20)
        if not 0xD800 <= p <= 0xDFFF
        and (unicodedata.decomposition(chr(p)) or unicodedata.combining(chr(p)) or p % 97 == 0)
    ]
    assert apply(T.strip_accents, chars) == [unaccented(c) for c in chars]


def test_redaction(apply):
    lines = [
        "api_key = abc rest",
        "X-API-Key:zz",
        "my PASSWORD: hunter2, then token=1",
        "Authorization: Bearer abc.def end",
        "token\u00a0=\u00a0secret",
        "nothing here",
    ]
    assert apply(T.redact_secrets, lines) == [
        "api_key=***REDACTED*** rest",
        "X-API-Key=***REDACTED***",
        "my PASSWORD=***REDACTED*** then token=***REDACTED***",
        "Authorization: Bearer=***REDACTED*** end",
        "token=***REDACTED***",
        "nothing here",
    ]
