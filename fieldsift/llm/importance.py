"""Resampling documents towards a target: hashed word runs, weights, Gumbel draws.

A dictionary of distinct words, each bounded by delimiters, is an Aho-Corasick
automaton whose words carry a payload: CRC-32 and length. Scanning a text emits
the payload of each word; the CRC of a run of words is composed of neighbouring
payloads, without reading its bytes again (appending n bytes is a linear map of
a CRC). A CRC modulo BUCKETS is a feature's bucket; buckets are counted over all
texts and the target, and each text is scored by its buckets' gains.

The dictionary grows with the text: words that the automaton does not know get
their payload computed once and join it when it is built anew, so results never
depend on what it holds. Its size is bounded. Buckets are kept by document in
staged files, so texts are scanned once; only a number per bucket and the keys
of the ranking are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.shared import col, fresh, stage

BUCKETS = 10_000
SHARE, LEAST_WORDS, SEED = 25, 20, 7
# Words that the dictionary holds at most, and bytes of the longest among them.
LIMIT, LONGEST = 1 << 18, 64
# Bytes that are scanned at a time.
PIECE = 1 << 20
# Reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320

# Letters A-Z are lowered; ASCII other than letters and digits delimits.
FOLD = bytes(
    c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def _moved(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """A linear map of CRCs, given by the images of each byte's values."""
    return (
        tables[0][crcs & 255] ^ tables[1][crcs >> 8 & 255] ^ tables[2][crcs >> 16 & 255] ^ tables[3][crcs >> 24]
    )


@lru_cache(maxsize=64)
def _shift(power: int) -> np.ndarray:
    """The map of a CRC when 2 ** power bytes are appended, before their own CRC."""
    if power:
        half = _shift(power - 1)
        return np.stack([_moved(half, row) for row in half])
    crcs = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(8):
        crcs = (crcs >> 1) ^ np.where(crcs & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return crcs


def compose(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings from that of both parts and the size of the right one."""
    out = left.astype(np.uint32)
    for power in range(int(sizes.max(initial=0)).bit_length()):
        at = np.flatnonzero(sizes >> power & 1)
        out[at] = _moved(_shift(power), out[at])
    return out ^ right


class Dictionary:
    """Payloads of delimiter-bounded words, looked up by one scan of a text."""

    def __init__(self, limit: int = LIMIT):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.crcs, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.automaton, self.built = None, 0

    def _build(self) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for word, place in self.places.items():
            self.automaton.add_word(" " + word.decode("latin-1") + " ", place)
        self.automaton.make_automaton()
        self.built = len(self.places)

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Payloads of words that the scan has not emitted."""
        new = [w for w in dict.fromkeys(words) if w not in self.places and len(w) <= LONGEST]
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
        self.crcs = np.append(self.crcs, np.fromiter(map(crc32, new), np.uint32, len(new)))
        self.sizes = np.append(self.sizes, np.fromiter(map(len, new), np.int64, len(new)))
        return np.fromiter(map(crc32, words), np.uint32, len(words)), np.fromiter(map(len, words), np.int64, len(words))

    def payloads(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, CRC, size) of each word of a folded text that begins and ends with a delimiter."""
        gap = np.frombuffer(text, np.uint8) == 32
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        crcs, sizes = np.zeros(len(starts), np.uint32), ends - starts
        unknown = np.ones(len(starts), bool)
        if self.automaton is not None:
            emitted = np.fromiter(chain.from_iterable(self.automaton.iter(text.decode("latin-1"))), np.int64)
            at, place = emitted[::2], emitted[1::2]
            words = np.searchsorted(ends, at)
            crcs[words], sizes[words] = self.crcs[place], self.sizes[place]
            unknown[words] = False
        rest = np.flatnonzero(unknown)
        if len(rest):
            words = [text[a:b] for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            crcs[rest], sizes[rest] = self._learn(words)
            if len(self.places) > self.limit:
                self._clear()
            elif len(self.places) >= 2 * self.built:
                self._build()
        return starts, crcs, sizes


@lru_cache(maxsize=1)
def _dictionary() -> Dictionary:
    """One for each Python worker."""
    return Dictionary()


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Folded bytes of bounded size, cut between words: (bytes, starts of parts, their texts)."""
    held: list[bytes] = []
    starts: list[int] = []
    owners: list[int] = []
    size = 0
    for number, text in enumerate(texts):
        text = text.translate(FOLD)
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE:
                end = text.rfind(b" ", at, at + PIECE)
                if end < 0:
                    end = text.find(b" ", at + PIECE)
                end = len(text) if end < 0 else end + 1
            starts.append(size)
            owners.append(number)
            held.append(text[at:end])
            size += end - at + 1
            at = end
            if size >= PIECE:
                yield b" " + b" ".join(held) + b" ", starts, owners
                held, starts, owners, size = [], [], [], 0
    if held:
        yield b" " + b" ".join(held) + b" ", starts, owners


def runs(texts: list[bytes], dictionary: Dictionary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, CRC) of each word and of each pair of neighbouring words, by text."""
    owners, crcs, sizes = [], [], []
    for data, starts, numbers in _pieces(texts):
        where, crc, size = dictionary.payloads(data)
        part = np.searchsorted(np.array(starts), where - 1, side="right") - 1
        owners.append(np.array(numbers, np.int64)[part])
        crcs.append(crc)
        sizes.append(size)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    crc = np.concatenate(crcs) if crcs else np.zeros(0, np.uint32)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    pairs = np.flatnonzero(owner[1:] == owner[:-1])
    space = np.full(len(pairs), crc32(b" "), np.uint32)
    after = compose(space, crc[pairs + 1], size[pairs + 1])
    return owner, crc, owner[pairs], compose(crc[pairs], after, size[pairs + 1] + 1)


def _features(rows: DataFrame, buckets: int) -> DataFrame:
    """Staged features of (doc_id, text).

    A row for each text (doc_id, place, words, features: buckets as packed
    numbers; place is unique), and one for each task (totals: a count per
    bucket).
    """
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    names = ["doc_id", "place", "words", "features", "totals"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = _dictionary()
        place = TaskContext.get().partitionId() << 33
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            n = batch.num_rows
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            own, words, own2, pairs = runs(texts, dictionary)
            words, pairs = words % buckets, pairs % buckets
            totals += np.bincount(words, minlength=buckets) + np.bincount(pairs, minlength=buckets)
            counts = np.bincount(own, minlength=n)
            words, pairs = words.astype(kind), pairs.astype(kind)
            edge, edge2 = np.searchsorted(own, np.arange(n + 1)), np.searchsorted(own2, np.arange(n + 1))
            packed = [words[edge[i] : edge[i + 1]].tobytes() + pairs[edge2[i] : edge2[i + 1]].tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.arange(place, place + n)),
                    pa.array(counts),
                    pa.array(packed, pa.binary()),
                    pa.nulls(n, pa.binary()),
                ],
                names,
            )
            place += n
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(1, pa.int64()),
                pa.nulls(1, pa.int64()),
                pa.nulls(1, pa.int64()),
                pa.nulls(1, pa.binary()),
                pa.array([totals.astype("<i8").tobytes()], pa.binary()),
            ],
            names,
        )

    schema = "doc_id long, place long, words long, features binary, totals binary"
    return stage(rows.mapInArrow(run, schema), "features")


def _totals(features: DataFrame, buckets: int) -> np.ndarray:
    """Counts of all buckets, a bounded number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += np.frombuffer(data, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    own = features.filter(F.col("totals").isNotNull()).select("totals").mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in own.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """What a feature of each bucket is worth, in thousandths of a natural logarithm."""
    size = len(have)
    all_have, all_want = int(have.sum()), int(want.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (all_have + size) / ((s + 1) * (all_want + size))))
            for s, t in zip(have.tolist(), want.tolist(), strict=True)
        ],
        np.int64,
    )


def _weighted(features: DataFrame, worth: np.ndarray) -> DataFrame:
    kind = "<u2" if len(worth) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(3).to_pylist()
            found = worth[np.frombuffer(b"".join(data), kind)]
            counts = np.array([len(d) for d in data], np.int64) // np.dtype(kind).itemsize
            upto = np.concatenate([[0], np.cumsum(found)])
            ends = np.cumsum(counts)
            sums = upto[ends] - upto[ends - counts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(counts), pa.array(sums // np.maximum(counts, 1))],
                ["doc_id", "place", "words", "n_features", "weight"],
            )

    rows = features.filter(F.col("place").isNotNull()).select("doc_id", "place", "words", "features")
    return rows.mapInArrow(run, "doc_id long, place long, words long, n_features long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``.

    Features are the words and pairs of neighbouring words, repeats included;
    ``weight`` is the floored mean of their buckets' gains towards ``target``,
    ``score`` adds a Gumbel number from ``seed`` and the id. Of the rows with at
    least ``least_words`` words, ``share`` percent (rounded down) are drawn by
    score, ties to the smaller id; ``rank`` counts them from 1 and is null for
    the rest. Null texts hold no words, null ids come last in ties and hash as
    an empty text; repeated rows are rows of their own. Other columns are not
    read. Without documents there are no rows; without a target all gains follow
    from counts of 0.
    """
    named = docs.select(col(row_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), col(target_text).cast("string").alias("text"))
    features = _features(named, buckets)
    worth = gains(_totals(features, buckets), _totals(_features(wanted, buckets), buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    part = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(part)))
    scored = stage(_weighted(features, worth).withColumn("score", F.col("weight") + noise), "scores")

    able = F.col("words") >= least_words
    keys = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("place")]
    ordered = stage(
        scored.filter(able)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("doc_id", "n_features", "weight", "score", F.monotonically_increasing_id().alias("at")),
        "ranking",
    )
    # A row for each task of the sort.
    slices = ordered.groupBy(F.shiftright("at", 33).alias("slice")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sorted((r["slice"], r["n"]) for r in slices.collect())
    before, total = [], 0
    for number, n in sizes:
        before.append((number, total))
        total += n
    offsets = docs.sparkSession.createDataFrame(before, "slice long, base long")
    rank = F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = ordered.join(F.broadcast(offsets), F.shiftright("at", 33) == F.col("slice")).select(
        "doc_id", "n_features", "weight", "score", F.when(rank <= share * total // 100, rank).alias("rank")
    )
    rest = scored.filter(~able).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)


def draw(docs: DataFrame, target: DataFrame, row_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` draws, with their columns.

    Rows with one id are one document; rows without an id are left out.
    """
    ranks = resample(docs, target, row_id, **options).filter(F.col("rank").isNotNull())
    own = fresh(docs, "drawn")
    drawn = ranks.select(F.col("doc_id").alias(own)).distinct()
    return docs.join(drawn, col(row_id).cast("long") == F.col(own), "left_semi")
