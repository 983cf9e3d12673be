"""TF-IDF features, computed inside each row.

Tokens, counts, weights and the row norm never leave their row, so neither the
texts nor the term lists are shuffled. Only the vocabulary fit shuffles: sums by
slot of a hash bound the occurrences of every term, and what cannot be among the
most frequent is dropped before terms are counted, on the map side first. Counts
by fold give the vocabularies of all folds of a cross-validation at once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from ..fixed_values import MAX_DF, MAX_FEATURES, MIN_DF
from ..functions.text import bind, is_ascii, strip_accents
from ..session import stage
from .gram_filter import SUMS, keep_met_twice, met_twice, pair_slots, slots_of, word_hashes

# The vocabulary is held by the driver and shipped to every task.
LARGEST_VOCABULARY = 100_000
# Folds that terms are counted by.
MOST_FOLDS = 100
# Words that grams are counted of at a time; a longer note is taken alone.
PART = 1 << 18
# Slots that terms are counted in, for each term that is wanted, and at most.
SLOTS_A_TERM, MOST_SLOTS = 2, 1 << 17
# Distinct labels that a classifier may have.
LARGEST_LABEL_SET = 1_000


def tokens(text: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores, no accents."""
    plain = F.when(is_ascii(text), F.lower(text)).otherwise(
        bind(F.lower(text), strip_accents)
    )
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def ngrams(text: Column) -> Column:
    """All words and all pairs of neighbouring words, repeats included."""

    def with_pairs(words: Column) -> Column:
        pairs = F.greatest(F.size(words) - 1, F.lit(0))
        return F.concat(
            words,
            F.zip_with(
                F.slice(words, F.lit(1), pairs),
                F.slice(words, F.lit(2), pairs),
                lambda left, right: F.concat(left, F.lit(" "), right),
            ),
        )

    return bind(tokens(F.coalesce(text, F.lit(""))), with_pairs)


@dataclass(frozen=True)
class _Runs:
    """Distinct grams of a batch of notes: note, first word, second word (0 for none, else from 1), number.

    They are in the order of note and gram: a space is below all characters of
    words, so grams are in the order of their two words.
    """

    notes: int
    words: pa.Array
    own: np.ndarray
    first: np.ndarray
    second: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, lists: pa.ListArray) -> "_Runs":
        sizes = pc.list_value_length(lists).to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        coded = lists.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        ids = rank[coded.indices.to_numpy()]
        base = len(order) + 1
        single = (owner * base + ids) * base
        pairs = (single[:-1] + ids[1:] + 1)[owner[1:] == owner[:-1]]
        found, times = np.unique(np.concatenate([single, pairs]), return_counts=True)
        rest, second = np.divmod(found, base)
        return cls(len(sizes), coded.dictionary.take(order), *np.divmod(rest, base), second, times)

    def slots(self) -> np.ndarray:
        hashes = word_hashes(self.words)
        return pair_slots(hashes[self.first], np.append(hashes, np.uint64(0))[self.second - 1])

    def where(self, kept: np.ndarray) -> "_Runs":
        return _Runs(self.notes, self.words, self.own[kept], self.first[kept], self.second[kept], self.times[kept])

    def terms(self) -> pa.Array:
        after = self.words.take(pa.array(self.second - 1, mask=self.second == 0))
        return pc.binary_join_element_wise(self.words.take(pa.array(self.first)), after, " ", null_handling="skip")

    def ends(self) -> pa.Array:
        return pa.array(np.searchsorted(self.own, np.arange(self.notes + 1)), pa.int32())


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], _Runs]]:
    """(other columns, runs) of parts of about PART words; the last column has lists of words."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(batch.num_columns - 1)).to_numpy()
        part, long = (np.cumsum(sizes) - sizes) // PART, sizes > PART
        cuts = 1 + np.flatnonzero((part[1:] != part[:-1]) | long[1:] | long[:-1])
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
            *kept, lists = batch.slice(start, end - start).columns
            yield kept, _Runs.of(lists)


@F.arrow_udf(ArrayType(StructType().add("term", StringType()).add("tf", IntegerType())))
def gram_runs(lists: pa.Array) -> pa.Array:
    """Each distinct gram of a list of words once, with its number, in order."""
    found = []
    for _, runs in _parts([pa.RecordBatch.from_arrays([pa.array(range(len(lists))), lists], ["at", "words"])]):
        cells = pa.StructArray.from_arrays([runs.terms(), pa.array(runs.times, pa.int32())], ["term", "tf"])
        found.append(pa.ListArray.from_arrays(runs.ends(), cells))
    return pa.concat_arrays(found)


def run_grams(runs: str) -> Column:
    """The grams of their runs, repeats next to each other."""
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["term"], r["tf"])))


def gram_table(df: DataFrame, text: str = "input", *keep: str) -> DataFrame:
    """(keep..., words, runs): the notes' words, staged, so that texts are tokenised once.

    ``runs`` is an array<struct<term, tf>> of the words' grams. It is made when
    it is read; counts and weights are made from the words.
    """
    # The first half of the grams, and one more, are the words.
    words = bind(ngrams(F.col(text)), lambda g: F.slice(g, F.lit(1), F.ceil(F.size(g) / 2).cast("int")))
    staged = stage(df.select(*keep, words.alias("words")), "grams")
    return staged.withColumn("runs", gram_runs("words"))


def corpus_frequencies(grams: DataFrame, min_df: int = 1, fold: str | None = None) -> DataFrame:
    """Notes with the term and occurrences over all notes of a :func:`gram_table`.

    (term, df, cf); with the name of a ``fold`` column, numbered from 0, arrays
    ``dfs`` and ``cfs`` hold the same by fold. With a ``min_df`` of 2 or more,
    most terms of one note only are dropped before the shuffle; the rest are
    still to be tested.
    """
    rows = grams.select(*([fold] if fold else []), F.explode("runs").alias("run"))
    rows = rows.select(*([fold] if fold else []), "run.term", "run.tf")
    if min_df >= 2:
        rows = keep_met_twice(rows, "term", met_twice(grams, "runs.term"))
    return _counted(rows, grams, fold)


def _counted(rows: DataFrame, grams: DataFrame, fold: str | None) -> DataFrame:
    """Frequencies of the terms of exploded runs."""
    if not fold:
        return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    own = [F.col(fold) == i for i in range(_fold_count(grams, fold))]
    return rows.groupBy("term").agg(
        F.array(*[F.count_if(x) for x in own]).alias("dfs"),
        F.array(*[F.coalesce(F.sum(F.when(x, F.col("tf"))), F.lit(0)) for x in own]).alias("cfs"),
    )


def slot_sums(grams: DataFrame) -> DataFrame:
    """(slot, n): occurrences of all terms of a slot, at most SUMS rows.

    No term of a slot exceeds them. The table has as many slots whatever the
    number of notes; the sums grow with the notes as those of frequent terms do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SUMS, np.int64)
        for _, runs in _parts(batches):
            sums += np.bincount(runs.slots(), runs.times, SUMS).astype(np.int64)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used])], ["slot", "n"])

    parts = grams.select("words").mapInArrow(run, "slot int, n long")
    return parts.groupBy("slot").agg(F.sum("n").alias("n"))


def _rows_of_slots(grams: DataFrame, wanted: np.ndarray, *keep: str) -> DataFrame:
    """(keep..., term, tf) of the runs whose slots are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, runs in _parts(batches):
            runs = runs.where(wanted[runs.slots()])
            own = pa.array(runs.own)
            columns = [*(c.take(own) for c in kept), runs.terms(), pa.array(runs.times)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "term", "tf"])

    rows = grams.select(*keep, "words")
    schema = StructType(rows.schema.fields[:-1]).add("term", StringType()).add("tf", LongType())
    return rows.mapInArrow(run, schema)


def frequent_terms(
    grams: DataFrame,
    least: Callable[[DataFrame], int],
    max_features: int,
    min_df: int,
    fold: str | None = None,
) -> DataFrame:
    """Staged :func:`corpus_frequencies` of the terms that can be wanted, and of others.

    ``least`` gives, from such a table, a number of occurrences that all wanted
    terms of the whole corpus have, 0 if the table does not tell. A term occurs
    at most as often as all terms of its slot, so slots below are left out. The
    fullest slots give a first such number; if it is below theirs, more slots
    are counted.
    """
    sums = stage(slot_sums(grams), "slot_sums")
    low = sums.orderBy(F.desc("n")).limit(SLOTS_A_TERM * max_features).agg(F.min("n")).first()[0] or 0
    most = max(MOST_SLOTS, 2 * SLOTS_A_TERM * max_features)
    while True:
        slots = [r["slot"] for r in sums.where(F.col("n") >= low).select("slot").limit(most + 1).collect()]
        if len(slots) > most:
            return stage(corpus_frequencies(grams, min_df, fold), "frequencies")
        wanted = np.zeros(SUMS, bool)
        wanted[slots] = True
        rows = _rows_of_slots(grams, wanted, *([fold] if fold else []))
        found = stage(_counted(rows, grams, fold), "frequencies")
        needed = least(found)
        if needed >= low:
            return found
        # Without a number all slots are counted, if they are not too many.
        low = needed


def _fold_count(grams: DataFrame, fold: str) -> int:
    """Folds are numbered from 0; each of them adds two sums to a row."""
    last = grams.agg(F.max(fold)).first()[0]
    if last is not None and last >= MOST_FOLDS:
        raise ValueError(f"folds must be numbered from 0 to {MOST_FOLDS - 1}")
    return 0 if last is None else last + 1


def _check_size(max_features: int) -> None:
    if not 0 < max_features <= LARGEST_VOCABULARY:
        raise ValueError(f"max_features must be from 1 to {LARGEST_VOCABULARY}")


def _eligible(frequencies: DataFrame, n_notes: int, min_df: int, max_df: float) -> DataFrame:
    return frequencies.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_notes))


def _least_wanted(
    frequencies: DataFrame, n_notes: int, max_features: int, min_df: int, max_df: float
) -> int:
    """Occurrences of the last of the wanted terms, 0 if there are fewer."""
    top = _eligible(frequencies, n_notes, min_df, max_df).orderBy(F.desc("cf")).limit(max_features)
    n, cf = top.agg(F.count("*"), F.min("cf")).first()
    return cf if n == max_features else 0


def _most_frequent(
    frequencies: DataFrame,
    n_notes: int,
    max_features: int = MAX_FEATURES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
) -> DataFrame:
    top = (
        _eligible(frequencies, n_notes, min_df, max_df)
        .orderBy(F.desc("cf"), "term")
        .limit(max_features)
    )
    # At most max_features rows reach this unpartitioned window.
    return top.select(
        (F.row_number().over(Window.orderBy("term")) - 1).alias("term_id"),
        "term",
        "df",
        "cf",
        (F.log((F.lit(n_notes) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"),
    )


def vocabulary(
    grams: DataFrame,
    max_features: int = MAX_FEATURES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
) -> DataFrame:
    """(term_id, term, df, cf, idf) of the most frequent eligible terms.

    ``grams`` is a :func:`gram_table`. A term needs at least ``min_df`` notes
    and at most the share ``max_df`` of them; of equally frequent terms the
    alphabetically first wins. Ids follow the alphabet.
    """
    _check_size(max_features)
    # The staged files know their number of rows.
    options = grams.count(), max_features, min_df, max_df
    found = frequent_terms(grams, lambda t: _least_wanted(t, *options), max_features, min_df)
    return _most_frequent(found, *options)


def fold_vocabularies(
    grams: DataFrame,
    fold: str = "fold",
    max_features: int = MAX_FEATURES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
) -> dict[int, DataFrame]:
    """For each fold the :func:`vocabulary` of all notes outside it.

    Terms are counted by fold in one pass; what is outside a fold is the sum
    over all folds less its own.
    """
    _check_size(max_features)
    sizes = {r[fold]: r["count"] for r in grams.groupBy(fold).count().collect()}
    n_notes = sum(sizes.values())

    def outside(values: str, i: int) -> Column:
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x) - F.get(values, F.lit(i))

    def without(counted: DataFrame, i: int) -> DataFrame:
        return counted.select("term", outside("dfs", i).alias("df"), outside("cfs", i).alias("cf"))

    def least(counted: DataFrame) -> int:
        return min(
            (_least_wanted(without(counted, i), n_notes - n, max_features, min_df, max_df) for i, n in sizes.items()),
            default=0,
        )

    counted = frequent_terms(grams, least, max_features, min_df, fold)
    return {
        i: _most_frequent(without(counted, i), n_notes - n, max_features, min_df, max_df)
        for i, n in sorted(sizes.items())
    }


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary; ``terms`` and ``idf`` are indexed by term id."""

    terms: list[str]
    idf: list[float]

    @classmethod
    def fit(cls, df: DataFrame, text: str = "input", **options) -> "TfidfModel":
        """Fit on the notes of ``df``; options as for :func:`vocabulary`."""
        return cls.fit_grams(gram_table(df, text), **options)

    @classmethod
    def fit_grams(cls, grams: DataFrame, **options) -> "TfidfModel":
        """Fit on a :func:`gram_table`."""
        return cls.from_table(vocabulary(grams, **options))

    @classmethod
    def from_table(cls, table: DataFrame) -> "TfidfModel":
        """Take over a vocabulary table; its size is limited by its maker."""
        rows = table.orderBy("term_id").limit(LARGEST_VOCABULARY + 1).collect()
        if len(rows) > LARGEST_VOCABULARY:
            raise ValueError(f"a vocabulary has at most {LARGEST_VOCABULARY} terms")
        return cls([r["term"] for r in rows], [r["idf"] for r in rows])

    @cached_property
    def _counter(self) -> CountVectorizerModel:
        return CountVectorizerModel.from_vocabulary(
            self.terms, inputCol="_grams", outputCol="_counts"
        )

    def to_table(self, spark) -> DataFrame:
        rows = list(zip(range(len(self.terms)), self.terms, self.idf))
        return spark.createDataFrame(rows, "term_id int, term string, idf double")

    def transform(self, df: DataFrame, text: str = "input") -> DataFrame:
        """Add ``term_ids`` and ``weights``, parallel arrays in id order.

        Unknown terms are left out; a note without known terms has empty arrays.
        """
        return self._weighted(df, ngrams(F.col(text)))

    def transform_grams(self, grams: DataFrame) -> DataFrame:
        """The same on a :func:`gram_table`, in place of its ``words`` and ``runs``."""
        return self.weigh(self.count_runs(grams))

    def count_runs(self, grams: DataFrame) -> DataFrame:
        """``words`` and ``runs`` of a :func:`gram_table` become ``term_ids`` and ``tfs``."""
        terms = list(self.terms)
        kept = [c for c in grams.columns if c not in ("words", "runs")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, wanted = pa.array(terms, pa.string()), slots_of(terms)
            for columns, runs in _parts(batches):
                # What stands in other slots is not made into strings.
                runs = runs.where(wanted[runs.slots()])
                ids = pc.index_in(runs.terms(), known)
                found = ids.is_valid().to_numpy(zero_copy_only=False)
                ids, runs = ids.drop_null().to_numpy(), runs.where(found)
                order = np.lexsort((ids, runs.own))
                cells = pa.array(ids[order], pa.int32()), pa.array(runs.times[order].astype(float))
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(pa.ListArray.from_arrays(runs.ends(), x) for x in cells)],
                    [*kept, "term_ids", "tfs"],
                )

        rows = grams.select(*kept, "words")
        schema = StructType(rows.schema.fields[:-1])
        schema = schema.add("term_ids", ArrayType(IntegerType())).add("tfs", ArrayType(DoubleType()))
        return rows.mapInArrow(run, schema)

    def count_grams(self, df: DataFrame, grams: Column) -> DataFrame:
        """Add ``term_ids`` and ``tfs``, parallel arrays in id order."""
        if not self.terms:
            empty = F.array()
            return df.withColumns(
                {"term_ids": empty.cast("array<int>"), "tfs": empty.cast("array<double>")}
            )
        return (
            self._counter.transform(df.withColumn("_grams", grams))
            .withColumn("_sparse", F.unwrap_udt("_counts"))
            .withColumns({"term_ids": F.col("_sparse.indices"), "tfs": F.col("_sparse.values")})
            .drop("_grams", "_counts", "_sparse")
        )

    def narrow(self, counted: DataFrame, wide: "TfidfModel") -> DataFrame:
        """Counts by the ids of a ``wide`` vocabulary as counts by this one's.

        Terms that are not in this vocabulary are left out.
        """
        place = {term: i for i, term in enumerate(self.terms)}
        ids = _literal([place.get(term, -1) for term in wide.terms], "array<int>")
        kept = F.filter(
            F.arrays_zip("term_ids", "tfs"), lambda cell: F.get(ids, cell["term_ids"]) >= 0
        )
        return counted.withColumn("_kept", kept).withColumns(
            {
                "term_ids": F.transform("_kept", lambda cell: F.get(ids, cell["term_ids"])),
                "tfs": F.transform("_kept", lambda cell: cell["tfs"]),
            }
        ).drop("_kept")

    def weigh(self, counted: DataFrame) -> DataFrame:
        """``tfs`` become ``weights``: (1 + ln tf) * idf over the row's norm."""
        idf = _literal(self.idf, "array<double>")
        raw = F.zip_with("term_ids", "tfs", lambda i, tf: (F.log(tf) + 1.0) * F.get(idf, i))
        norm = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda acc, w: acc + w * w))
        # Bound first, so the norm is not computed again for every weight.
        weights = bind(norm, lambda n: F.transform("_raw", lambda w: w / n))
        return counted.withColumn("_raw", raw).withColumn("weights", weights).drop("_raw", "tfs")

    def _weighted(self, df: DataFrame, grams: Column) -> DataFrame:
        return self.weigh(self.count_grams(df, grams))

    def vector(self) -> Column:
        """The arrays of :meth:`transform` as a sparse ML vector."""
        value = F.struct(
            F.struct(
                F.lit(0).alias("type"),
                F.lit(len(self.terms)).alias("size"),
                F.col("term_ids").alias("indices"),
                F.col("weights").alias("values"),
            ).alias("v")
        )
        # The JSON reader is the built-in that makes a vector out of arrays.
        schema = StructType([StructField("v", VectorUDT())])
        return F.from_json(F.to_json(value), schema)["v"]


def _literal(values: list, kind: str) -> Column:
    """An array as one literal instead of a call per entry."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def joint_vocabulary(models: list[TfidfModel]) -> TfidfModel:
    """All terms of some vocabularies, without weights, for counting."""
    terms = sorted({term for model in models for term in model.terms})
    return TfidfModel(terms, [1.0] * len(terms))


def weight_rows(features: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Long table (note_id, term_id, weight) of transformed notes.

    With ``keep_empty``, a note without known terms gives one row of NULLs.
    """
    explode = F.explode_outer if keep_empty else F.explode
    return features.select(
        "note_id", explode(F.arrays_zip("term_ids", "weights")).alias("cell")
    ).select(
        "note_id",
        F.col("cell.term_ids").alias("term_id"),
        F.col("cell.weights").alias("weight"),
    )


def label_classes(df: DataFrame, label: str = "output") -> list[str]:
    """Distinct labels in alphabetical order; their number is checked."""
    found = (
        df.where(F.col(label).isNotNull())
        .select(label)
        .distinct()
        .limit(LARGEST_LABEL_SET + 1)
        .collect()
    )
    if len(found) > LARGEST_LABEL_SET:
        raise ValueError(f"more than {LARGEST_LABEL_SET} labels in {label!r}")
    return sorted(row[0] for row in found)


def encode_label(label: Column, classes: list[str]) -> Column:
    """0-based place of the label in ``classes``, NULL if it is not there."""
    names = F.array(*[F.lit(c) for c in classes])
    place = F.array_position(names, label) - 1
    return F.when(place >= 0, place).cast("int")


def decode_label(index: Column, classes: list[str]) -> Column:
    """The class at a 0-based place, NULL outside."""
    return F.get(F.array(*[F.lit(c) for c in classes]), index.cast("int"))


__all__ = [
    "TfidfModel",
    "corpus_frequencies",
    "fold_vocabularies",
    "frequent_terms",
    "gram_runs",
    "gram_table",
    "joint_vocabulary",
    "decode_label",
    "encode_label",
    "label_classes",
    "ngrams",
    "run_grams",
    "slot_sums",
    "tokens",
    "vocabulary",
    "weight_rows",
]
