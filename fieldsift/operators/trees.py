"""Trees of a random forest, grown from the terms that notes have.

A note has few of the terms of a vocabulary. It is kept as these terms with the
place of their weight among the thresholds of the term, three bytes each, in
chunks of a bounded number of terms that all tasks read from the shared folder.
Each task grows some trees, level by level, and holds one number for a note and
tree. A node looks at its own draw of terms only. Large nodes walk through the
notes that have these terms, all others through the terms of their notes; what
a node counts is made of the notes that have a term, the rest is the difference
to the node. Scored are notes where they are, by the trees of one file after the
other, and the driver holds no more than the bytes of the files.

As in Spark's forests, thresholds come from a sample of notes, each tree draws
notes by a Poisson distribution, impurity is Gini's, and two leaves that predict
the same become one.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import Broadcast
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from ..session import scratch, scratch_path, stage
from ..sources.files import copy_folder, full_path, store

# Intervals of a term's weights, and notes that their thresholds are taken from.
BINS, SAMPLE = 32, 10_000
# Terms of the notes of a chunk, and its notes; a number of 16 bits tells them apart.
CHUNK_TERMS, CHUNK_NOTES = 1 << 22, (1 << 16) - 1
# Bytes of the places and drawn terms of notes in the trees that are grown together.
PLACE_BYTES = 64 << 20
# Bytes of the counts of a tree's large nodes, and counts that are looked at at a time.
LARGE_BYTES, COUNTS = 8 << 20, 1 << 21
# Terms of notes that are walked through at a time, and bits of the number of marks.
WALK, MARKS = 1 << 18, 25
# Bytes of notes that are scored by a file of trees, and numbers of a dense table of notes.
SCORED_BYTES, DENSE = 32 << 20, 1 << 21
# Gains below are errors of rounding.
LEAST_GAIN = 1e-12

NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, "
    "rawCount: bigint, gain: double, leftChild: int, rightChild: int, "
    "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


def thresholds(term: np.ndarray, weight: np.ndarray, notes: int, n_terms: int) -> list[np.ndarray]:
    """At most BINS - 1 thresholds of each term, from its weights in some notes.

    They lie between neighbouring weights, 0 for the notes without the term being
    one of them; of many weights, between those at even ranks.
    """
    order = np.lexsort((weight, term))
    term, weight = term[order], weight[order]
    ends = np.searchsorted(term, np.arange(n_terms + 1))
    found = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        values = np.unique(weight[a:b])
        zero = 0 < b - a < notes
        at = np.arange(1, len(values))
        if len(at) + zero > BINS - 1:
            ranks = a + np.arange(1, BINS - 1) * (b - a) // (BINS - 1)
            at = np.unique(np.searchsorted(values, weight[ranks]))
            at = at[at > 0]
        middle = (values[at - 1] + values[at]) / 2
        found.append(np.append(values[0] / 2, middle) if zero else middle)
    return found


def _cells(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of lists, and their values one after the other."""
    return lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)


def sampled_thresholds(notes: DataFrame, n_notes: int, n_terms: int, seed: int) -> list[np.ndarray]:
    """:func:`thresholds` of about SAMPLE of the notes, found in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, parts = 0, [(np.zeros(0, np.int64), np.zeros(0))]
        for batch in batches:
            n += len(batch)
            parts.append(tuple(_cells(c)[1] for c in batch.columns))
        found = thresholds(*(np.concatenate(x) for x in zip(*parts, strict=True)), n, n_terms)
        ends = pa.array(np.append(0, np.cumsum([len(f) for f in found])), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*found, np.zeros(0)])))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_terms), pa.int32()), lists], ["term", "edges"])

    part = notes.select("term_ids", "weights")
    if n_notes > SAMPLE:
        part = part.sample(False, SAMPLE / n_notes, seed)
    rows = part.repartition(1).mapInArrow(run, "term int, edges array<double>").collect()
    found = {r["term"]: np.array(r["edges"]) for r in rows}
    return [found.get(i, np.zeros(0)) for i in range(n_terms)]


def _write(folder: str, edges: list[np.ndarray]):
    """Chunks of (label, term_ids, weights), each in a file; rows of (file)."""
    kind = np.uint16 if len(edges) <= 1 << 16 else np.uint32

    def write(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        labels, sizes, terms, weights = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(terms.astype(kind), kind="stable")
        owner = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)[order]
        ends = np.searchsorted(terms[order], np.arange(len(edges) + 1))
        weights = weights[order]
        by_term = np.zeros(len(terms), np.uint8)
        for own, a, b in zip(edges, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if a < b:
                by_term[a:b] = np.searchsorted(own, weights[a:b])
        bins = np.empty(len(terms), np.uint8)
        bins[order] = by_term
        columns = {
            "starts": np.append(0, np.cumsum(sizes)).astype("<i8"), "terms": terms.astype(kind), "bins": bins,
            "labels": labels.astype("<u2"), "ends": ends.astype("<i8"), "owner": owner, "by_term": by_term,
        }
        rows = pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.large_binary()) for c in columns.values()], list(columns))
        file = f"{folder}/{uuid.uuid4().hex}.arrow"
        fs, path = store(file)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path, compression=None) as out, pa.ipc.new_file(out, rows.schema) as table:
            table.write_batch(rows)
        return pa.RecordBatch.from_arrays([pa.array([file])], ["file"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, notes, cells = [], 0, 0
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            sizes, terms = _cells(batch.column(1))
            weights = _cells(batch.column(2))[1]
            ends = np.cumsum(sizes)
            at = 0
            while at < len(sizes):
                base = int(ends[at] - sizes[at])
                # As many notes as the chunk has room for, one at least.
                end = int(np.searchsorted(ends, base + CHUNK_TERMS - cells, "right"))
                end = min(max(end, at if parts else at + 1), at + CHUNK_NOTES - notes, len(sizes))
                if end > at:
                    own = slice(base, int(ends[end - 1]))
                    parts.append((labels[at:end], sizes[at:end], terms[own], weights[own]))
                    notes, cells = notes + end - at, cells + own.stop - own.start
                if end < len(sizes):
                    yield write(parts)
                    parts, notes, cells = [], 0, 0
                at = end
        if parts:
            yield write(parts)

    return run


class Chunk:
    """Notes by their terms, in rows and in columns."""

    def __init__(self, file: str, n_terms: int):
        fs, path = store(file)
        # Files that can be mapped into memory take none of the task's own.
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        rows = pa.ipc.open_file(source).get_batch(0)
        kind = np.uint16 if n_terms <= 1 << 16 else np.uint32

        def read(name: str, kind) -> np.ndarray:
            # The bytes of the only row, not a copy.
            return np.frombuffer(rows.column(name).buffers()[2], kind)

        self.starts, self.terms, self.bins = read("starts", "<i8"), read("terms", kind), read("bins", np.uint8)
        self.labels, self.ends = read("labels", "<u2"), read("ends", "<i8")
        self.owner, self.by_term = read("owner", "<u2"), read("by_term", np.uint8)

    def having(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the term, note, bin) of all notes that have one of the terms."""
        begin, end = self.ends[terms], self.ends[terms + 1]
        runs = list(zip(begin.tolist(), end.tolist(), strict=True))
        slot = np.repeat(np.arange(len(terms)), end - begin)
        return slot, np.concatenate([self.owner[a:b] for a, b in runs]), np.concatenate([self.by_term[a:b] for a, b in runs])


class Notes:
    """The chunks of some files, in order."""

    def __init__(self, files: list[str], n_terms: int):
        self.files, self.n_terms = files, n_terms

    def __iter__(self) -> Iterator[Chunk]:
        for file in self.files:
            yield Chunk(file, self.n_terms)


def draw(rng: np.random.Generator, rows: int, below: int, n: int) -> np.ndarray:
    """Rows of ``n`` different numbers, every set of them as likely."""
    found = rng.integers(0, below, (rows, n))
    while True:
        found.sort(axis=1)
        again = found[:, 1:] == found[:, :-1]
        if not again.any():
            return found
        found[:, 1:][again] = rng.integers(0, below, np.count_nonzero(again))


@dataclass(frozen=True)
class Rules:
    """What a forest is grown by; ``weights`` are those of the classes."""

    n_terms: int
    weights: np.ndarray
    depth: int
    least_leaf: int
    least_split: int
    seed: int

    @property
    def drawn(self) -> int:
        return math.ceil(math.sqrt(self.n_terms))

    @property
    def classes(self) -> int:
        return len(self.weights)

    def gains(self, whole: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Gain in Gini impurity where notes are split off, -1 where it is not allowed."""
        left = whole - right
        sums, squares = [], []
        for part in (whole, left, right):
            weighted = part * self.weights
            total = weighted.sum(axis=-1)
            sums.append(total)
            squares.append((weighted * weighted).sum(axis=-1) / np.maximum(total, 1e-300))
        gain = (squares[1] + squares[2] - squares[0]) / np.maximum(sums[0], 1e-300)
        fits = np.minimum(left.sum(axis=-1), right.sum(axis=-1)) >= self.least_leaf
        return np.where(fits & (gain > LEAST_GAIN), gain, -1.0)


class Tree:
    """A tree that grows by one level at a time."""

    def __init__(self, number: int, rules: Rules):
        self.rules = rules
        self.number = number
        self.rng = np.random.default_rng([rules.seed & 0xFFFFFFFF, number])
        # All nodes in the order of levels: classes, split, gain, left child (the right one follows).
        self.counts = [np.zeros((1, rules.classes), np.int64)]
        self.splits: list[tuple[np.ndarray, ...]] = []
        self.size, self.level = 1, 0
        # Of each chunk: times a note is drawn, and its open node, -1 for none.
        self.times: list[np.ndarray] = []
        self.at: list[np.ndarray] = []

    def root(self, chunk: Chunk) -> None:
        times = np.minimum(self.rng.poisson(1.0, len(chunk.labels)), 255).astype(np.uint8)
        self.times.append(times)
        self.at.append(np.where(times > 0, 0, -1).astype(np.int32))
        self.counts[0] += np.bincount(chunk.labels, times, self.rules.classes).astype(np.int64)

    def start(self, frequency: np.ndarray, mean: float) -> bool:
        """Draws the terms of the nodes of the newest level; False if none is open."""
        rules, counts = self.rules, self.counts[-1]
        size = counts.sum(axis=1)
        is_open = (size >= rules.least_split) & (counts.max(axis=1) < size) & (self.level < rules.depth) & (rules.n_terms > 0)
        self.open = np.flatnonzero(is_open)
        # Open nodes of the children, by their place in the level.
        self.place = np.where(is_open, np.cumsum(is_open) - 1, -1)
        if not len(self.open):
            return False
        self.whole = counts[self.open]
        self.terms = draw(self.rng, len(self.open), rules.n_terms, rules.drawn)
        # About as many notes as terms are cheaper to walk through.
        cost = frequency[self.terms].sum(axis=1) / np.maximum(size[self.open] * mean, 1)
        large = np.argsort(cost, kind="stable")
        room = LARGE_BYTES // (8 * rules.drawn * BINS * rules.classes)
        self.large = large[: np.count_nonzero(cost < 1)][:room]
        self.small = np.ones(len(self.open), bool)
        self.small[self.large] = False
        self.sums = np.zeros((len(self.large), rules.drawn * BINS * rules.classes), np.int64)
        self.hits: list[list[np.ndarray]] = []
        return True

    def settle(self, i: int, chunk: Chunk) -> None:
        """Moves the notes of a chunk to the newest level."""
        if not self.level:
            return
        at, right = self.at[i], np.zeros(len(self.at[i]), bool)
        right[self.moved[i]] = True
        for node, term, bin_ in self.cuts:
            _, note, bins = chunk.having(np.array([term]))
            note = note[bins > bin_]
            right[note[at[note] == node]] = True
        inside = np.flatnonzero(at >= 0)
        # Children of split nodes stand in pairs; those of nodes without a split are none.
        child = self.child[at[inside]]
        child = np.where(child >= 0, child + right[inside], -1)
        at[inside] = np.where(child >= 0, self.place[child], -1)

    def count(self, i: int, chunk: Chunk) -> None:
        """Counts the classes of the notes of a chunk that have a drawn term."""
        rules, at, times = self.rules, self.at[i], self.times[i]
        for row, node in enumerate(self.large.tolist()):
            slot, note, bins = chunk.having(self.terms[node])
            own = np.flatnonzero(at[note] == node)
            note = note[own]
            key = (slot[own] * BINS + bins[own]) * rules.classes + chunk.labels[note]
            self.sums[row] += np.bincount(key, times[note], self.sums.shape[1]).astype(np.int64)
        inside = np.flatnonzero(at >= 0)
        inside = inside[self.small[at[inside]]]
        inside = inside[np.argsort(at[inside], kind="stable")]
        node, sizes = at[inside].astype(np.int64), np.diff(chunk.starts)[inside]
        found: list[list[np.ndarray]] = [[], []]
        # A batch marks the drawn terms of its nodes in a table of bounded size.
        ends = np.cumsum(np.maximum(sizes, WALK * rules.n_terms >> MARKS))
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(WALK, ends[-1] + WALK, WALK)) + 1, 0)) if len(ends) else []
        marks = np.zeros(0, bool)
        for a, b in zip(cuts[:-1], np.minimum(cuts[1:], len(inside)), strict=True):
            own, n = node[a:b], sizes[a:b]
            nodes, local = np.unique(own, return_inverse=True)
            if len(marks) < len(nodes) * rules.n_terms:
                marks = np.zeros(len(nodes) * rules.n_terms, bool)
            marked = (np.arange(len(nodes))[:, None] * rules.n_terms + self.terms[nodes]).ravel()
            marks[marked] = True
            index = np.arange(n.sum()) + np.repeat(chunk.starts[inside[a:b]] - np.cumsum(n) + n, n)
            hit = np.flatnonzero(marks[np.repeat(local * rules.n_terms, n) + chunk.terms[index]])
            marks[marked] = False
            who = np.searchsorted(np.cumsum(n), hit, "right")
            index = index[hit]
            key = (own[who] * rules.n_terms + chunk.terms[index]) * BINS + (BINS - 1 - chunk.bins[index])
            found[0].append(key)
            found[1].append(inside[a:b][who].astype(np.uint16))
        key, note = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(found, (np.int64, np.uint16), strict=True))
        self.hits.append([key, note, chunk.labels[note].astype(np.uint16), times[note]])

    def _small_splits(self) -> tuple[np.ndarray, ...]:
        """(gain, term, bin, classes of the notes above) of the best split of each small node."""
        rules, n = self.rules, len(self.open)
        gain, term, bin_ = np.full(n, -1.0), np.zeros(n, np.int64), np.zeros(n, np.int64)
        above = np.zeros((n, rules.classes), np.int64)
        key = np.concatenate([h[0] for h in self.hits])
        label, times = (np.concatenate([h[i] for h in self.hits]) for i in (2, 3))
        order = np.argsort(key)
        key, label, times = key[order], label[order], times[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        cell = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
        key = key[starts]
        owner = key // (BINS * rules.n_terms)
        # Cells of whole nodes, about COUNTS numbers at a time.
        ends = np.append(np.flatnonzero(owner[1:] != owner[:-1]) + 1, len(key)) if len(key) else np.zeros(0, np.int64)
        a = 0
        while a < len(key):
            b = int(ends[min(np.searchsorted(ends, a + max(1, COUNTS // rules.classes)), len(ends) - 1)])
            low, high = starts[a], starts[b] if b < len(key) else len(cell)
            own = slice(low, high)
            sums = np.bincount((cell[own] - a) * rules.classes + label[own], times[own], (b - a) * rules.classes)
            right = np.cumsum(sums.astype(np.int64).reshape(-1, rules.classes), axis=0)
            group = key[a:b] // BINS
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            before = np.concatenate([np.zeros((1, rules.classes), np.int64), right])[first]
            right = right - np.repeat(before, np.diff(np.append(first, b - a)), axis=0)
            # A bin of 0 holds notes below all thresholds, like those without the term.
            gains = np.where(key[a:b] % BINS < BINS - 1, rules.gains(self.whole[owner[a:b]], right), -1.0)
            first = np.flatnonzero(np.append(True, owner[a + 1 : b] != owner[a : b - 1]))
            most = np.repeat(np.maximum.reduceat(gains, first), np.diff(np.append(first, b - a)))
            best = np.flatnonzero(gains == most)[::-1]
            which = owner[a:b][best]  # the first of several stays
            gain[which], term[which] = gains[best], group[best] % rules.n_terms
            bin_[which], above[which] = BINS - 2 - key[a:b][best] % BINS, right[best]
            a = b
        return gain, term, bin_, above

    def split(self) -> None:
        """Takes the best split of each open node; their children are the next level."""
        rules, n = self.rules, len(self.open)
        gain, term, bin_, above = self._small_splits()
        for row, node in enumerate(self.large.tolist()):
            sums = self.sums[row].reshape(rules.drawn, BINS, rules.classes)
            right = np.cumsum(sums[:, ::-1], axis=1)[:, ::-1][:, 1:]
            gains = rules.gains(self.whole[node], right)
            slot, at = np.unravel_index(np.argmax(gains), gains.shape)
            gain[node], term[node], bin_[node], above[node] = gains[slot, at], self.terms[node, slot], at, right[slot, at]
        parted = gain > 0
        every = len(self.counts[-1])
        left = np.full(every, -1)
        self.child = np.where(parted, 2 * (np.cumsum(parted) - 1), -1)
        left[self.open[parted]] = self.size + self.child[parted]
        columns = []
        for values, none in ((gain, -1.0), (term, -1), (bin_, -1)):
            column = np.full(every, none)
            column[self.open[parted]] = values[parted]
            columns.append(column)
        self.splits.append((*columns, left))
        children = np.empty((2 * np.count_nonzero(parted), rules.classes), np.int64)
        children[0::2], children[1::2] = (self.whole - above)[parted], above[parted]
        self.counts.append(children)
        # Notes that move to the right: known ones of small nodes, to be looked up of large ones.
        wanted = np.where(parted & self.small, term, -1)
        self.moved = []
        for key, note, _, _ in self.hits:
            node = key // (BINS * rules.n_terms)
            over = (key // BINS % rules.n_terms == wanted[node]) & (BINS - 1 - key % BINS > bin_[node])
            self.moved.append(note[over])
        self.cuts = [(x, int(term[x]), int(bin_[x])) for x in self.large.tolist() if parted[x]]
        self.size += len(children)
        self.level += 1
        self.hits, self.sums = [], None

    def nodes(self, edges: list[np.ndarray]) -> pa.RecordBatch:
        """Rows of NODES; two leaves that predict the same become one."""
        counts = np.concatenate(self.counts)
        empty = len(counts) - sum(len(s[0]) for s in self.splits)
        none = np.full(empty, -1.0), np.full(empty, -1), np.full(empty, -1), np.full(empty, -1)
        gain, term, bin_, left = (np.concatenate(x) for x in zip(*self.splits, none, strict=True))
        stats = counts * self.rules.weights
        predicted = stats.argmax(axis=1)
        for own in reversed(np.split(np.arange(len(counts)), np.cumsum([len(c) for c in self.counts])[:-1])):
            own = own[left[own] >= 0]
            child = left[own]
            same = (left[child] < 0) & (left[child + 1] < 0) & (predicted[child] == predicted[child + 1])
            left[own[same]] = -1
        kept = np.zeros(len(counts), bool)
        kept[0] = True
        for own in np.split(np.arange(len(counts)), np.cumsum([len(c) for c in self.counts])[:-1]):
            own = own[kept[own] & (left[own] >= 0)]
            kept[left[own]] = kept[left[own] + 1] = True
        place = np.cumsum(kept) - 1
        inner = (left >= 0)[kept]
        counts, stats, predicted, gain, term, bin_, left = (x[kept] for x in (counts, stats, predicted, gain, term, bin_, left))
        first, second = (np.where(inner, place[np.maximum(left + i, 0)], -1) for i in (0, 1))
        total = np.maximum(stats.sum(axis=1), 1e-300)
        n, at = len(counts), np.flatnonzero(inner)
        # Thresholds of all terms one after the other.
        base = np.append(0, np.cumsum([len(e) for e in edges]))
        cut = np.concatenate([*edges, [0.0]])[base[term[at]] + bin_[at]]
        split = pa.StructArray.from_arrays(
            [
                pa.array(np.where(inner, term, -1), pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(inner)), pa.int32()), pa.array(cut)),
                pa.array(np.full(n, -1), pa.int32()),
            ],
            ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
        )
        data = pa.StructArray.from_arrays(
            [
                pa.array(np.arange(n), pa.int32()),
                pa.array(predicted.astype(float)),
                pa.array(1 - ((stats / total[:, None]) ** 2).sum(axis=1)),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.rules.classes, pa.int32()), pa.array(stats.ravel())),
                pa.array(counts.sum(axis=1)),
                pa.array(np.where(inner, gain, -1.0)),
                pa.array(first, pa.int32()),
                pa.array(second, pa.int32()),
                split,
            ],
            ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"],
        )
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, self.number), pa.int32()), data], ["treeID", "nodeData"])


def _grow_together(notes: Notes, trees: list[Tree], frequency: np.ndarray, mean: float) -> None:
    for chunk in notes:
        for tree in trees:
            tree.root(chunk)
    growing = [t for t in trees if t.start(frequency, mean)]
    while growing:
        for i, chunk in enumerate(notes):
            for tree in growing:
                tree.settle(i, chunk)
                tree.count(i, chunk)
        for tree in growing:
            tree.split()
        growing = [t for t in growing if t.start(frequency, mean)]


def _grown(files: list[str], edges: list[np.ndarray], rules: Rules):
    """Rows of NODES for the numbers of trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes = Notes(files, rules.n_terms)
        numbers = [n for batch in batches for n in batch.column(0).to_pylist()]
        frequency, n = np.zeros(rules.n_terms, np.int64), 0
        for chunk in notes:
            frequency += np.diff(chunk.ends)
            n += len(chunk.labels)
        mean = frequency.sum() / max(n, 1)
        # A place takes 5 bytes, a drawn term of a note 13.
        together = max(1, int(PLACE_BYTES / (max(n, 1) * (5 + 13 * mean * rules.drawn / max(rules.n_terms, 1)))))
        for at in range(0, len(numbers), together):
            trees = [Tree(number, rules) for number in numbers[at : at + together]]
            _grow_together(notes, trees, frequency, mean)
            for tree in trees:
                yield tree.nodes(edges)

    return run


def _about(spark: SparkSession, kind: str, params: dict, **more) -> str:
    """Metadata of a saved model, as Spark's reader of models wants it."""
    name = f"org.apache.spark.ml.classification.{kind}ClassificationModel"
    about = {
        "class": name,
        "timestamp": int(time.time() * 1000),
        "sparkVersion": spark.version,
        "uid": f"{kind}_{uuid.uuid4().hex[:12]}",
        "paramMap": params,
        "defaultParamMap": {},
    }
    return json.dumps({**about, **more})


def _open(file: str | bytes) -> pa.NativeFile:
    """A file of the shared folder, or one that is held."""
    if isinstance(file, bytes):
        return pa.BufferReader(file)
    fs, path = store(file)
    return fs.open_input_file(path)


def _parts_of(files: list[str | bytes]) -> list[list[str | bytes]]:
    """Files with all nodes of their trees; those that share a tree stay together."""
    parts: list[tuple[set, list[str | bytes]]] = []
    for file in files:
        with _open(file) as source:
            found = pq.read_table(source, columns=["treeID"])["treeID"].unique().to_pylist()
        own, names = set(found), [file]
        for part in [p for p in parts if p[0] & own]:
            parts.remove(part)
            own, names = own | part[0], part[1] + names
        parts.append((own, names))
    return [names for own, names in parts if own]


class _Nodes:
    """The nodes of some trees: split, children, and shares of the classes."""

    def __init__(self, files: list[str | bytes]):
        tables = []
        for file in files:
            with _open(file) as source:
                rows = pq.read_table(source).combine_chunks()
            for batch in rows.to_batches():
                data, split = batch.column(1), batch.column(1).field("split")
                cut = split.field("leftCategoriesOrThreshold")
                tables.append(
                    (
                        batch.column(0).to_numpy(), data.field("id").to_numpy(), split.field("featureIndex").to_numpy(),
                        data.field("leftChild").to_numpy(), data.field("rightChild").to_numpy(),
                        cut.value_lengths().to_numpy(), cut.flatten().to_numpy(),
                        data.field("impurityStats").flatten().to_numpy().reshape(len(batch), -1),
                    )
                )
        tree, number, term, left, right, cuts, cut, stats = (np.concatenate(x) for x in zip(*tables, strict=True))
        value = np.zeros(len(tree))
        value[cuts > 0] = cut
        order = np.lexsort((number, tree))
        tree = tree[order]
        # Trees one after the other, their nodes by number.
        self.roots = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
        base = np.repeat(self.roots, np.diff(np.append(self.roots, len(tree))))
        self.term, self.value, left, right = term[order], value[order], left[order], right[order]
        self.leaf = left < 0
        self.left, self.right = left + base, right + base
        total = stats[order].sum(axis=1, keepdims=True)
        self.shares = np.divide(stats[order], total, out=np.zeros_like(stats), where=total > 0)

    def add(self, dense: np.ndarray, sums: np.ndarray) -> None:
        """Adds the shares of the leaves that the notes of a dense table reach, tree by tree."""
        at = np.repeat(self.roots[:, None], len(dense), axis=1).ravel()
        note = np.tile(np.arange(len(dense)), len(self.roots))
        going = np.flatnonzero(~self.leaf[at])
        while len(going):
            here = at[going]
            low = dense[note[going], self.term[here]] <= self.value[here]
            at[going] = here = np.where(low, self.left[here], self.right[here])
            going = going[~self.leaf[here]]
        for reached in at.reshape(len(self.roots), -1):
            sums += self.shares[reached]


def _scored(files: list[str] | Broadcast, n_terms: int, n_classes: int):
    """(columns..., class, confidence) of notes by (columns..., term_ids, weights)."""

    def score(held: list[pa.RecordBatch], parts: list[list[str | bytes]]) -> Iterator[pa.RecordBatch]:
        sizes = np.concatenate([_cells(h.column("term_ids"))[0] for h in held])
        terms, values = (np.concatenate([_cells(h.column(c))[1] for h in held]) for c in ("term_ids", "weights"))
        starts = np.append(0, np.cumsum(sizes))
        sums = np.zeros((len(sizes), n_classes))
        some = max(1, DENSE // max(n_terms, 1))
        for part in parts:
            nodes = _Nodes(part)
            for at in range(0, len(sizes), some):
                own = slice(starts[at], starts[min(at + some, len(sizes))])
                n = sizes[at : at + some]
                dense = np.zeros((len(n), max(n_terms, 1)))
                dense[np.repeat(np.arange(len(n)), n), terms[own]] = values[own]
                nodes.add(dense, sums[at : at + some])
        total = sums.sum(axis=1, keepdims=True)
        sums = np.divide(sums, total, out=np.zeros_like(sums), where=total > 0)
        best, most = sums.argmax(axis=1), sums.max(axis=1, initial=0.0)
        ends = np.cumsum([len(h) for h in held])
        for batch, own in zip(held, np.split(np.arange(len(sizes)), ends[:-1]), strict=True):
            kept = [c for c in batch.schema.names if c not in ("term_ids", "weights")]
            columns = [*(batch.column(c) for c in kept), pa.array(best[own], pa.int32()), pa.array(most[own])]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "class", "confidence"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, size = None, [], 0
        for batch in batches:
            parts = parts or _parts_of(files.value if isinstance(files, Broadcast) else files)
            held.append(batch)
            size += batch.nbytes
            if size >= SCORED_BYTES:
                yield from score(held, parts)
                held, size = [], 0
        if held:
            yield from score(held, parts)

    return run


class Forest:
    """A saved forest in Spark's format, whose trees are read where notes are scored.

    Its files stay where they are, or are held as the bytes that they have.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.held: dict[str, bytes] = {}
        about = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        self.n_terms, self.n_classes, self.getNumTrees = (about[k] for k in ("numFeatures", "numClasses", "numTrees"))

    def hold(self) -> "Forest":
        """Takes the files into memory, about 25 bytes a node, so that their folder can go."""
        fs, path = store(full_path(self.spark, self.path))
        for info in fs.get_file_info(pafs.FileSelector(path, recursive=True)):
            if info.is_file and not info.base_name.startswith("."):
                with fs.open_input_file(info.path) as source:
                    self.held[info.path.removeprefix(path).lstrip("/")] = source.read()
        return self

    @cached_property
    def model(self) -> RandomForestClassificationModel:
        """The forest in the driver's memory, as Spark has it."""
        if not self.held:
            return RandomForestClassificationModel.load(self.path)
        with scratch(self.spark):
            path = scratch_path(self.spark, "forest")
            self.save(path)
            return RandomForestClassificationModel.load(path)

    @property
    def trees(self) -> list:
        return self.model.trees

    def write(self) -> "Forest":
        return self

    def save(self, path: str) -> None:
        if not self.held:
            return copy_folder(self.spark, self.path, path)
        fs, folder = store(full_path(self.spark, path))
        # The metadata come last, as the mark of a complete forest.
        for name in sorted(self.held, key=lambda n: n.startswith("metadata/")):
            fs.create_dir(f"{folder}/{name}".rpartition("/")[0], recursive=True)
            with fs.open_output_stream(f"{folder}/{name}", compression=None) as file:
                file.write(self.held[name])

    def score(self, rows: DataFrame) -> DataFrame:
        """``class`` and ``confidence`` in place of ``term_ids`` and ``weights``: the highest mean share of the trees."""
        if self.held:
            names = sorted(n for n in self.held if n.startswith("data/") and n.endswith(".parquet"))
            files = self.spark.sparkContext.broadcast([self.held[n] for n in names])
        else:
            files = sorted(self.spark.read.parquet(f"{self.path}/data").inputFiles())
        schema = StructType([f for f in rows.schema if f.name not in ("term_ids", "weights")])
        schema = schema.add("class", IntegerType()).add("confidence", DoubleType())
        return rows.mapInArrow(_scored(files, self.n_terms, self.n_classes), schema)


def grow_forest(
    notes: DataFrame, n_terms: int, parts: int, n_trees: int, depth: int, least_leaf: int, least_split: int, seed: int
) -> Forest:
    """A forest of staged (label, weight, term_ids, weights), notes kept in ``parts`` or more chunks.

    ``weight`` is that of the label. Nodes of fewer than ``least_split`` notes are not split.
    """
    spark = notes.sparkSession
    n_notes = notes.count()
    if not n_notes:
        raise ValueError("a forest needs notes")
    found = dict(notes.groupBy("label").agg(F.max("weight")).collect())
    weights = np.array([found.get(float(i), 1.0) for i in range(int(max(found, default=0)) + 1)])
    rules = Rules(n_terms, weights, depth, least_leaf, least_split, seed)
    edges = sampled_thresholds(notes, n_notes, n_terms, seed)
    cores = spark.sparkContext.defaultParallelism
    params = {"numTrees": n_trees, "maxDepth": depth, "minInstancesPerNode": least_leaf, "featureSubsetStrategy": "sqrt",
              "maxBins": BINS, "impurity": "gini", "weightCol": "weight", "seed": seed}
    with scratch(spark):
        folder = full_path(spark, scratch_path(spark, "chunks"))
        dealt = notes.select("label", "term_ids", "weights").repartition(parts)
        listed = stage(dealt.mapInArrow(_write(folder, edges), "file string"), "chunk_files")
        # A few hundred notes at least stand in a file.
        files = sorted(r["file"] for r in listed.collect())
        path = scratch_path(spark, "forest")
        numbers = spark.range(0, n_trees, 1, min(n_trees, 2 * cores))
        grown = numbers.mapInArrow(_grown(files, edges, rules), NODES)
        grown.write.parquet(f"{path}/data")
        size = {"numFeatures": n_terms, "numClasses": rules.classes}
        own = {k: v for k, v in params.items() if k not in ("numTrees", "featureSubsetStrategy")}
        trees = [(i, _about(spark, "DecisionTree", own, **size), 1.0) for i in range(n_trees)]
        trees = spark.createDataFrame(trees, "treeID int, metadata string, weights double")
        trees.coalesce(1).write.parquet(f"{path}/treesMetadata")
        line = spark.createDataFrame([(_about(spark, "RandomForest", params, **size, numTrees=n_trees),)], "value string")
        line.coalesce(1).write.text(f"{path}/metadata")
        return Forest(spark, path).hold()
