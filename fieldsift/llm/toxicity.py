"""Toxicity by a weighted finite-state grammar over clauses.

Each word of a clause becomes a symbol: insult (with the weight of its stem),
threat, target, negation, reporting word or other. Five transducers are tables
over these symbols: negation marks the words within its reach; insults count by
their weight, less if marked; a threat that is not marked counts if a target
follows; a target in the clause and reported speech weigh all of it. They are
composed once, by product construction, into one table, and a clause is a walk
through it. A document's matched clauses are summed up in four numbers, and a
logistic curve gives the score.

The insult stems are beginnings of words, and whole words, that training labels
show to mark toxic documents. The fit uses at most SAMPLE labelled rows,
three quarters for the stems and the rest for the curve. The other lists are short and fixed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fieldsift.llm.shared import col, fresh, stage

# Labelled rows, by least hash of the id, that a model is fitted on.
SAMPLE = 20_000
# Texts whose stems are held at a time.
TEXTS = 256
# Beginnings of words that can be stems; longer words are stems as a whole too.
STEMS = range(3, 9)
LONGEST = 32
# A stem must be this much likelier in toxic documents, beyond this likelihood ratio.
LIFT, RATIO = 4.0, 30.0

# Words of the small transducers.
THREATS = frozenset("kill hurt destroy beat burn shoot stab smash crush hang drown punch attack hunt".split())
TARGETS = frozenset("you your yours u he him his she her hers they them their this those these".split())
NEGATIONS = frozenset("not never no none nobody isn't aren't wasn't don't doesn't didn't won't can't cannot without".split())
REPORTS = frozenset("said says say told wrote writes claimed claims quoted quote reported called asked according".split())
# A negation reaches this many words; weights of the composition.
REACH = 3
NEGATED, REPORTED, AIMED, THREAT = 0.25, 0.5, 1.25, 6.0

_word = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?").findall
_clauses = re.compile(r"[.!?;:,\n]+").split


def _stems(words: set[str]) -> set[str]:
    """All stems of the words; a whole word ends with a blank."""
    out = {w[:k] for w in words for k in STEMS if len(w) >= k}
    return out | {w + " " for w in words if 2 <= len(w) <= LONGEST}


# Symbols of a clause, and those that the negation transducer adds.
OTHER, INSULT, THREATEN, TARGET, NEGATION, REPORT, DENIED_INSULT, DENIED_THREAT = range(8)
SYMBOLS = range(6)
LISTED = (
    {w: REPORT for w in REPORTS}
    | {w: TARGET for w in TARGETS}
    | {w: THREATEN for w in THREATS}
    | {w: NEGATION for w in NEGATIONS}
)


@dataclass(frozen=True)
class Machine:
    """A transducer as a table; states are numbered from 0, where it starts.

    ``arcs[state][symbol]`` is (next state, symbol handed on, factor of the
    symbol's weight, weight of its own); ``final[state]`` weighs the clause.
    """

    arcs: tuple[tuple[tuple[int, int, float, float], ...], ...]
    final: tuple[float, ...]


def machine(states: int, arc, final=lambda state: 1.0) -> Machine:
    symbols = range(8)
    return Machine(tuple(tuple(arc(q, s) for s in symbols) for q in range(states)), tuple(map(final, range(states))))


def _negation(state: int, symbol: int) -> tuple[int, int, float, float]:
    """The state is the number of words that the last negation still reaches."""
    left = max(0, state - 1)
    if symbol == NEGATION:
        return REACH + 1, symbol, 1.0, 0.0
    marked = {INSULT: DENIED_INSULT, THREATEN: DENIED_THREAT}.get(symbol, symbol)
    return left, marked if left else symbol, 1.0, 0.0


def _insult(state: int, symbol: int) -> tuple[int, int, float, float]:
    return 0, symbol, {INSULT: 1.0, DENIED_INSULT: NEGATED}.get(symbol, 0.0), 0.0


def _threat(state: int, symbol: int) -> tuple[int, int, float, float]:
    """State 1 waits for the target of a threat."""
    if symbol == TARGET and state:
        return 0, symbol, 1.0, THREAT
    return {THREATEN: 1, DENIED_THREAT: 0}.get(symbol, state), symbol, 1.0, 0.0


def _seen(wanted: int):
    """State 1: the symbol has been met."""
    return lambda state, symbol: (int(state or symbol == wanted), symbol, 1.0, 0.0)


MACHINES = (
    machine(REACH + 2, _negation),
    machine(1, _insult),
    machine(2, _threat),
    machine(2, _seen(TARGET), lambda state: AIMED if state else 1.0),
    machine(2, _seen(REPORT), lambda state: REPORTED if state else 1.0),
)


def compose(first: Machine, second: Machine) -> Machine:
    """What ``first`` hands on is read by ``second``; only states that are reached."""
    places, open_, arcs, final = {(0, 0): 0}, [(0, 0)], [], []
    for a, b in open_:
        row = []
        for symbol in range(8):
            to_a, handed, factor_a, own_a = first.arcs[a][symbol]
            to_b, out, factor_b, own_b = second.arcs[b][handed]
            if (to_a, to_b) not in places:
                places[to_a, to_b] = len(places)
                open_.append((to_a, to_b))
            row.append((places[to_a, to_b], out, factor_a * factor_b, own_a + own_b))
        arcs.append(tuple(row))
        final.append(first.final[a] * second.final[b])
    return Machine(tuple(arcs), tuple(final))


# The composed grammar: next state, factor and own weight by state and symbol.
COMPOSED = reduce(compose, MACHINES)
ARCS = [[(q, factor, own) for q, _, factor, own in row[: len(SYMBOLS)]] for row in COMPOSED.arcs]


@dataclass
class Grammar:
    """Weights of insult stems, and the curve over the four clause sums."""

    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (-30.0, 0.0, 0.0, 0.0, 0.0)

    def finder(self) -> ahocorasick.Automaton | None:
        """All stems and threats, to pass over documents without any."""
        if not self.weights:
            return None
        found = ahocorasick.Automaton()
        for s in {s.rstrip() for s in self.weights} | THREATS:
            found.add_word(s, len(s))
        found.make_automaton()
        return found

    def insult(self, word: str) -> float:
        best = self.weights.get(word + " ", 0.0)
        for k in STEMS:
            if k > len(word):
                break
            best = max(best, self.weights.get(word[:k], 0.0))
        return best

    def clause(self, words: list[str]) -> float:
        """Weight of one clause: a walk through the composed table."""
        total, state = 0.0, 0
        for word in words:
            weight = self.insult(word)
            state, factor, own = ARCS[state][INSULT if weight else LISTED.get(word, OTHER)]
            total += weight * factor + own
        return total * COMPOSED.final[state]

    def features(self, text: str, finder: ahocorasick.Automaton | None) -> tuple[float, ...]:
        """Log of the clause sum, largest clause, logs of matched clauses and of the sum by words."""
        lowered = text.lower()
        if finder is None or not any(
            end < size or not lowered[end - size].isalpha() for end, size in finder.iter(lowered)
        ):
            return 0.0, 0.0, 0.0, 0.0
        clauses = [_word(c) for c in _clauses(lowered)]
        found = [w for w in map(self.clause, clauses) if w > 0]
        density = 100.0 * sum(found) / max(1, sum(map(len, clauses)))
        return math.log1p(sum(found)), max(found, default=0.0), math.log1p(len(found)), math.log1p(density)

    def score(self, features: tuple[float, ...]) -> float:
        z = self.curve[0] + sum(w * x for w, x in zip(self.curve[1:], features, strict=True))
        return 1.0 / (1.0 + math.exp(-min(max(z, -500.0), 500.0)))


def held_out(row_id: F.Column) -> F.Column:
    """Rows that no label is learned from; rows without an id are among them."""
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Staged (text, toxic, part) of at most SAMPLE labelled rows outside the held-out part."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isNotNull() & ~held_out(F.col("label_id")))
        .groupBy("label_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(SAMPLE)
    )
    # At most SAMPLE rows of two numbers.
    rows = docs.join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    part = (F.pmod(F.xxhash64(F.col("label_id"), F.lit("part")), F.lit(4)) == 0).cast("int")
    return stage(rows.select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), part.alias("part")), "toxic_sample")


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class by stem; the empty stem counts them all.

    ``kin`` parts near copies, which count once: the least hash of five words.
    A text has many stems, so a few hundred texts are gathered at a time.
    """
    for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
        rows: dict[tuple[str, int], list[int]] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = _word((text or "").lower())
            spans = zip(*(words[i:] for i in range(5)), strict=False)
            kin = min((xxh64_intdigest(" ".join(s)) for s in spans), default=xxh64_intdigest(" ".join(words)))
            for stem in _stems(set(words)) | {""}:
                rows.setdefault((stem, toxic), []).append(kin >> 1)
        flat = [(s, t, k) for (s, t), kins in rows.items() for k in set(kins)]
        columns = list(zip(*flat, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())],
            ["stem", "toxic", "kin"],
        )


def _ratio(a: F.Column, b: F.Column, toxic: int, clean: int) -> F.Column:
    """Likelihood ratio of a stem's share in toxic and clean documents."""
    share = toxic / (toxic + clean)
    n = a + b
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    return 2 * (term(a, n * share) + term(b, n * (1 - share)))


def _strongest(found: list[tuple[str, float]]) -> dict[str, float]:
    """Of a stem and its beginnings, the one with the largest weight, the shortest if equal."""
    kept: dict[str, float] = {}
    for stem, weight in sorted(found, key=lambda f: (len(f[0]), f[0])):
        before = max((kept.get(stem[:k], 0.0) for k in range(1, len(stem))), default=0.0)
        if weight > before + 0.5:
            kept[stem] = weight
    return kept


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        size = np.abs(step).max()
        w += step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """A grammar from (doc_id, text) and (doc_id, toxic).

    Without labels of both classes it rejects nothing: all scores are near 0, or
    near 1 if every label is toxic.
    """
    sample = _sample(docs, labels)
    sizes = {(r["part"], r["toxic"]): r["n"] for r in sample.groupBy("part", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = lambda y: sizes.get((0, y), 0) + sizes.get((1, y), 0)
    if not of(0) or not of(1):
        return Grammar(curve=(30.0 if of(1) else -30.0, 0.0, 0.0, 0.0, 0.0))
    first = sample.filter("part = 0") if sizes.get((0, 0)) and sizes.get((0, 1)) else sample
    counts = (
        first.select("text", "toxic")
        .mapInArrow(_stem_counts, "stem string, toxic int, kin long")
        .groupBy("stem", "toxic")
        .agg(F.count_distinct("kin").alias("n"))
        .groupBy("stem")
        .agg(
            F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).cast("double").alias("a"),
            F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).cast("double").alias("b"),
        )
    )
    counts = stage(counts, "toxic_stems")
    total = counts.filter("stem = ''").first()
    toxic, clean = int(total["a"]), int(total["b"])
    lift = ((F.col("a") + 0.5) / (toxic + 1)) / ((F.col("b") + 0.5) / (clean + 1))
    chosen = (
        counts.filter("stem <> '' and a > 0")
        .withColumn("lift", lift)
        .filter((F.col("lift") >= LIFT) & (_ratio(F.col("a"), F.col("b"), toxic, clean) >= RATIO))
        .select("stem", F.log("lift").alias("weight"))
        .collect()
    )
    grammar = Grammar(_strongest([(r["stem"], r["weight"]) for r in chosen]))
    second = sample.filter("part = 1") if first is not sample and sizes.get((1, 0)) and sizes.get((1, 1)) else sample

    names = [f"x{i}" for i in range(4)]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = grammar.finder()
        for batch in batches:
            found = [grammar.features(t.as_py() or "", finder) for t in batch.column(0)]
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.float64()) for c in columns), batch.column(1)], [*names, "toxic"]
            )

    rows = second.select("text", "toxic").mapInArrow(measured, ", ".join(f"{n} double" for n in names) + ", toxic int")
    data = np.array([tuple(r) for r in rows.groupBy(*names, "toxic").count().collect()], float).reshape(-1, 6)
    times = data[:, 5].astype(int)
    grammar.curve = _fit_curve(np.repeat(data[:, :4], times, axis=0), np.repeat(data[:, 4], times))
    return grammar


def apply(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = grammar.finder()
        for batch in batches:
            scores = [grammar.score(grammar.features(t.as_py() or "", finder)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _texts(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    return docs.select(col(row_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))


def score_toxicity(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts get the score of a text without matches. Repeated rows
    and null ids pass through. Of several labels of a document, toxic counts.
    """
    rows = _texts(docs, row_id, text)
    return apply(rows, fit(rows, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, with all their columns."""
    grammar = fit(_texts(docs, row_id, text), labels)
    mark = fresh(docs, "toxic_score")
    schema = docs.withColumn(mark, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = grammar.finder()
        for batch in batches:
            at = batch.schema.names.index(text)
            scores = [grammar.score(grammar.features(t.as_py() or "", finder)) for t in batch.column(at)]
            yield batch.append_column(mark, pa.array(scores, pa.float64()))

    return docs.mapInArrow(run, schema).filter(F.col(mark) < 0.5).drop(mark)
