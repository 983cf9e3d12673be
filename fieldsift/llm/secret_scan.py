"""Secrets in texts: fixed patterns, and strings that look random.

A string over an alphabet of codes (hex, base32, base36, base62, base64) is
tested for uniform use of the alphabet (chi-squared), for runs above and below
the middle of the alphabet, and for correlation of neighbours. The three p-values
are combined (Fisher). A find must pass as random, and its combined value must
be too small for ordinary text of that length.

What is ordinary is taken from the corpus: for each string that is tested, a
decoy of the same length, case, signs and number of digits is made up of the
words around it, and goes through the same tests. For each alphabet and length
class, the decoys give mean and deviation of the logarithm of the combined
value, and so a p-value for every string tested; the level for finds is set so
that the share of false ones stays below Q (Benjamini-Hochberg over all strings
tested in the class).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.shared import col, stage

# The kinds of the contract, in order, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

# Strings that are tested: this long or longer, of letters and digits.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
ENCODINGS = (
    ("hex", re.compile(r"[0-9A-F]+|[0-9a-f]+"), "0123456789abcdef"),
    ("base32", re.compile(r"[A-Z2-7]+=*"), "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36", re.compile(r"[0-9a-z]+|[0-9A-Z]+"), "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", re.compile(r"[0-9A-Za-z]+"), "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", re.compile(r"[0-9A-Za-z+/]+=*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", re.compile(r"[0-9A-Za-z_-]+=*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
# A random string passes the battery with a probability of 1 - RANDOM.
RANDOM = 0.001
# Share of false finds that is allowed in a class.
Q = 0.01
# Buckets of a decade of the combined value, its least decade, and the last bucket.
DECADE, LOW, LAST = 25, -2, 150
# What ordinary strings of n signs are taken to give before decoys are counted:
# mean and deviation are linear in log10(n), and weigh as so many decoys.
MEAN, DEVIATION, WEIGHT = (-1.72, 2.13, 2.84), (0.56, -0.215, 0.05), 30
# Room for tails that are heavier than normal.
TAIL = 1.2
# Words that decoys are made of, and signs on both sides of a string to find them.
WORD = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z]{2,12}(?![A-Za-z0-9+/_-])")
AROUND = 2000


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _digit_values(text: str, alphabet: str) -> np.ndarray:
    place = {c: i for i, c in enumerate(alphabet)}
    body = text.rstrip("=")
    if len(alphabet) < 62:
        body = body.lower()
    return np.array([place[c] for c in body])


def battery(values: np.ndarray, size: int) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation for a random string."""
    n = len(values)
    counts = np.bincount(values, minlength=size)
    chi = size / n * float((counts * counts).sum()) - n
    uniform = _upper((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))
    high = values >= size // 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        mean = 2 * a * b / n + 1
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        runs = 2 * _upper(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var))
    else:
        runs = 2.0 ** (1 - n)
    centred = values - values.mean()
    power = float((centred * centred).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    serial = 2 * _upper(abs(r + 1 / n) * math.sqrt(n))
    return uniform, min(runs, 1.0), min(serial, 1.0)


def fisher(*values: float) -> float:
    """Fisher's combination of p-values: the less, the more random."""
    return -sum(math.log(max(p, 1e-300)) for p in values)


def combined(values: np.ndarray, size: int) -> float:
    return fisher(*battery(values, size))


def p_random(value: float) -> float:
    """Chance of a random string to have so large a combined value."""
    return math.exp(-value) * (1 + value + value * value / 2)


def looks_random(uniform: float, runs: float, serial: float) -> bool:
    """Whether a random string would give such values, at level RANDOM."""
    return p_random(fisher(uniform, runs, serial)) > RANDOM


def bucket_of(value: float) -> int:
    return min(LAST, max(0, int(DECADE * (math.log10(max(value, 1e-9)) - LOW))))


def decoy(body: str, words: list[str]) -> str:
    """An ordinary string that looks like ``body``: words in its case, its signs and digits."""
    padding = len(body) - len(body.rstrip("="))
    size = len(body) - padding
    digits = "".join(c for c in body if c.isdigit())
    signs = [c for c in body[:size] if c in "+/_-"]
    joint = max(sorted(set(signs)), key=signs.count) if signs else ""
    letters = "".join(c for c in body if c.isalpha())
    case = str.lower if letters.islower() else str.upper if letters.isupper() else str.capitalize
    at, out, total = sum(map(ord, body)), [], 0
    while total < size:
        word = case(words[at % len(words)])
        out.append(word)
        total += len(word) + len(joint)
        at += 1
    stem = joint.join(out)[: size - len(digits)]
    return stem + digits[: size - len(stem)] + "=" * padding


def length_class(n: int) -> int:
    """Half octaves of length."""
    return int(2 * math.log2(n))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def tested_strings(
    text: str, base: list[tuple[int, int, int]]
) -> Iterator[tuple[int, int, int, int, int | None]]:
    """(start, end, class, bucket of the string, bucket of its decoy) of all that is tested.

    Strings that overlap a fixed pattern, and strings without a digit or without
    a letter, are not tested. A string without words around it has no decoy.
    """
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        body = m.group()
        if not re.search("[0-9]", body) or not re.search("[A-Za-z]", body):
            continue
        if any(s < end and start < e for s, _, e in base):
            continue
        found = next(((i, a) for i, (_, pattern, a) in enumerate(ENCODINGS) if pattern.fullmatch(body)), None)
        if found is None:
            continue
        number, alphabet = found
        values = _digit_values(body, alphabet)
        if len(values) < 20:
            continue
        words = WORD.findall(text[max(0, start - AROUND) : start]) + WORD.findall(text[end : end + AROUND])
        other = None
        if words:
            made = decoy(body, words)
            # Words leave an alphabet of few letters: their letters are folded into it.
            places = {c: i for i, c in enumerate(alphabet)}
            fold = str.lower if len(alphabet) < 62 else str
            low = np.array([places.get(c, ord(c) % len(alphabet)) for c in fold(made.rstrip("="))])
            other = bucket_of(combined(low, len(alphabet)))
        group = number * 100 + length_class(len(values))
        yield start, end, group, bucket_of(combined(values, len(alphabet))), other


def _prior(group: int) -> tuple[float, float]:
    """Mean and deviation of log10 of the combined value for ordinary strings."""
    size = math.log10(2 ** (group % 100 / 2))
    mean = min(MEAN[0] + MEAN[1] * size, MEAN[2])
    return mean, max(DEVIATION[0] + DEVIATION[1] * size, DEVIATION[2])


def thresholds(
    strings: dict[tuple[int, int], int], decoys: dict[tuple[int, int], int], q: float = Q
) -> dict[int, int]:
    """Largest bucket that counts as a find, for each class.

    ``strings`` and ``decoys``: numbers by (class, bucket).
    """
    # All of a bucket at or below this one may pass as random.
    random_enough = max(b for b in range(LAST) if p_random(10 ** ((b + 1) / DECADE + LOW)) > RANDOM)
    out = {}
    for group in {g for g, _ in strings}:
        mean, deviation = _prior(group)
        own = [((b + 0.5) / DECADE + LOW, n) for (g, b), n in decoys.items() if g == group]
        total = WEIGHT + sum(n for _, n in own)
        centre = (WEIGHT * mean + sum(n * x for x, n in own)) / total
        square = WEIGHT * (deviation**2 + (mean - centre) ** 2) + sum(n * (x - centre) ** 2 for x, n in own)
        spread = TAIL * math.sqrt(square / total)
        tested = sum(n for (g, _), n in strings.items() if g == group)
        finds = 0
        for bucket in range(random_enough + 1):
            finds += strings.get((group, bucket), 0)
            p = _upper((centre - ((bucket + 1) / DECADE + LOW)) / spread)
            if finds and tested * p / finds <= q:
                out[group] = bucket
    return out


_FIELDS = "array<struct<start: int, kind: int, end: int>>"
_RANDOM = "array<struct<start: int, kind: int, end: int, group: int, bucket: int, decoy: int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([(f, pa.int32()) for f in ("start", "kind", "end")])
    tried = pa.struct([(f, pa.int32()) for f in ("start", "kind", "end", "group", "bucket", "decoy")])
    for batch in batches:
        counts, digests, bases, randoms = [], [], [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            base = base_spans(text)
            n = Counter(k for _, k, _ in base)
            counts.append([n[i] for i in range(3)])
            joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
            digests.append(sha256(joined.encode()).hexdigest())
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            randoms.append(
                [
                    {"start": s, "kind": 3, "end": e, "group": g, "bucket": b, "decoy": d}
                    for s, e, g, b, d in tested_strings(text, base)
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)),
                pa.array(digests, pa.string()),
                pa.array(bases, pa.list_(span)),
                pa.array(randoms, pa.list_(tried)),
            ],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "tried"],
        )


def find_secrets(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of secrets of every row, whole texts.

    (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random); spans are
    ``kind:start:end`` in code points. Null and empty texts have none. Repeated
    rows and null ids pass through; an empty table gives no rows.
    """
    rows = docs.select(col(row_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
        f"base {_FIELDS}, tried {_RANDOM}"
    )
    found = stage(rows.mapInArrow(_scan, schema), "secrets")
    tried = found.select(F.explode("tried").alias("t")).select("t.group", "t.bucket", "t.decoy")
    # At most one row for each class and pair of buckets.
    counted = tried.groupBy("group", "bucket", "decoy").agg(F.count(F.lit(1)).alias("n")).collect()
    strings: Counter[tuple[int, int]] = Counter()
    decoys: Counter[tuple[int, int]] = Counter()
    for r in counted:
        strings[r["group"], r["bucket"]] += r["n"]
        if r["decoy"] is not None:
            decoys[r["group"], r["decoy"]] += r["n"]
    most = thresholds(strings, decoys)
    hit = F.lit(False)

    def is_hit(t: F.Column) -> F.Column:
        test = hit
        for group, bucket in sorted(most.items()):
            test = test | ((t.group == group) & (t.bucket <= bucket))
        return test

    extra = F.transform(
        F.filter("tried", is_hit), lambda t: F.struct(t.start.alias("start"), t.kind.alias("kind"), t.end.alias("end"))
    )
    every = F.array_sort(F.concat("base", extra))
    names = F.array(*map(F.lit, KINDS))
    shown = F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.end))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.array_join(shown, ",").alias("spans"),
        F.size(extra).cast("long").alias("n_random"),
    )
