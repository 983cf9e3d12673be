import math
import random

import pytest
from pyspark.sql import functions as F

from fieldsift.operators import ranking as R
from fieldsift.operators import sampling as S


@pytest.fixture(scope="module")
def notes(spark):
    # One class holds most rows, and one length half of them; ids are uneven.
    rng = random.Random(11)
    rows = []
    for i in range(2500):
        category = "big" if i % 5 < 3 else ("mid" if i % 5 == 3 else "small")
        if i % 400 == 0:
            category = "tiny"
        note_id = i if i < 2000 else i * 10**12
        rows.append((note_id, "x" * (7 if i % 2 else rng.randrange(1, 90)), category))
    return spark.createDataFrame(rows, "note_id long, input string, output string")


@pytest.fixture(scope="module")
def by_class(notes):
    groups = {}
    for r in notes.collect():
        groups.setdefault(r.output, []).append(r)
    return groups


@pytest.fixture(scope="module")
def seeded(notes):
    value = R.seeded_value(42, F.col("note_id")).alias("v")
    return {r.note_id: r.v for r in notes.select("note_id", value).collect()}


LIMITS = [10**6, 7]


@pytest.mark.parametrize("sort_limit", LIMITS)
def test_ranks_equal_a_full_sort(notes, by_class, spark, sort_limit):
    keys = R.rank_keys(notes, "output", F.char_length("input"))
    wanted = [
        (c, slot, rank)
        for c, rows in by_class.items()
        for slot, rank in enumerate([1, 2, len(rows) // 2, len(rows) // 2, len(rows), len(rows) + 1])
    ]
    table = spark.createDataFrame(wanted, "stratum string, slot int, rank long")
    found = {
        (r.stratum, r.slot): (r.value, r.note_id)
        for r in R.keys_at_ranks(keys, R.stratum_ranges(keys), table, sort_limit).collect()
    }
    for c, slot, rank in wanted:
        ordered = sorted((len(r.input), r.note_id) for r in by_class[c])
        expected = ordered[rank - 1] if rank <= len(ordered) else None
        assert found.get((c, slot)) == expected


def quotas(sizes, test_size=0.2):
    total = sum(sizes.values())
    drawn = math.ceil(total * test_size)
    whole = {c: n * drawn // total for c, n in sizes.items()}
    order = sorted(sizes, key=lambda c: (-(sizes[c] * drawn % total), c))
    for c in order[: drawn - sum(whole.values())]:
        whole[c] += 1
    return whole


@pytest.mark.parametrize("sort_limit", LIMITS)
def test_split(notes, by_class, seeded, sort_limit):
    found = S.stratified_split(notes, sort_limit=sort_limit)
    test = {r.note_id for r in found.where("split = 'test'").collect()}
    assert found.count() == notes.count()
    expected = set()
    for c, quota in quotas({c: len(rows) for c, rows in by_class.items()}).items():
        ids = sorted((r.note_id for r in by_class[c]), key=lambda i: (seeded[i], i))
        expected |= set(ids[:quota])
    assert test == expected


def test_split_does_not_depend_on_partitions(notes):
    one, many = (
        {(r.note_id, r.split) for r in S.stratified_split(notes.repartition(n)).collect()}
        for n in (1, 13)
    )
    assert one == many


def test_split_depends_on_seed(notes):
    a, b = (
        {r.note_id for r in S.stratified_split(notes, seed=s).where("split = 'test'").collect()}
        for s in (1, 2)
    )
    assert len(a) == len(b) and a != b


@pytest.mark.parametrize("size", [0.0, 1.0, -1, 2])
def test_split_size_is_checked(notes, size):
    with pytest.raises(ValueError):
        S.stratified_split(notes, test_size=size)


def test_complement(notes):
    split = S.stratified_split(notes)
    rest = S.complement(notes, split.where("split = 'test'"))
    assert rest.count() == split.where("split = 'train'").count()


@pytest.mark.parametrize("sort_limit", LIMITS)
@pytest.mark.parametrize("n_folds", [2, 5, 12])
def test_folds(notes, by_class, n_folds, sort_limit):
    found = S.stratified_folds(notes, n_folds, sort_limit=sort_limit).collect()
    # Deal out all rows in turn, class after class in order of appearance.
    order = sorted(by_class, key=lambda c: min(r.note_id for r in by_class[c]))
    expected, place = {}, 0
    for c in order:
        for _ in by_class[c]:
            expected[c, place % n_folds] = expected.get((c, place % n_folds), 0) + 1
            place += 1
    sizes = {}
    for r in found:
        sizes[r.output, r.fold] = sizes.get((r.output, r.fold), 0) + 1
    assert sizes == expected
    assert len({r.note_id for r in found}) == len(found) == place


@pytest.mark.parametrize("sort_limit", LIMITS)
def test_fewshot_by_stride(notes, by_class, sort_limit):
    found = {}
    for r in S.fewshot_by_stride(notes, 10, sort_limit=sort_limit).collect():
        found.setdefault(r.output, []).append((r.position, r.note_id, r.input))
    for c, rows in by_class.items():
        if len(rows) <= 10:
            picked = sorted(rows, key=lambda r: r.note_id)
        else:
            ordered = sorted(rows, key=lambda r: (len(r.input), r.note_id))
            step = len(rows) // 10
            picked = [ordered[i * step] for i in range(10)]
        assert sorted(found[c]) == [(i + 1, r.note_id, r.input) for i, r in enumerate(picked)]


@pytest.mark.parametrize("sort_limit", LIMITS)
def test_fewshot_by_bucket(notes, by_class, seeded, sort_limit):
    found = {}
    for r in S.fewshot_by_bucket(notes, 10, sort_limit=sort_limit).collect():
        found.setdefault(r.output, []).append((r.position, r.note_id))
    for c, rows in by_class.items():
        ordered = sorted(rows, key=lambda r: (len(r.input), r.note_id))
        size = len(rows) // 10
        if len(rows) <= 10:
            picked = sorted(r.note_id for r in rows)
        else:
            picked = [
                min((r.note_id for r in ordered[i * size:(i + 1) * size]), key=seeded.get)
                for i in range(10)
            ]
        assert sorted(found[c]) == [(i + 1, n) for i, n in enumerate(picked)]


def test_ranks_of_ids_over_the_whole_range(spark):
    from fieldsift.operators.sampling import stratified_split

    notes = spark.range(400).select(
        F.expr("CASE id WHEN 0 THEN -9223372036854775808 WHEN 1 THEN 9223372036854775807 ELSE xxhash64(id) END").alias("note_id"),
        F.lit("x").alias("output"),
    )
    few, many = (stratified_split(notes, 0.25, sort_limit=n) for n in (10, 10_000))
    rows = lambda df: {r.note_id for r in df.where("split = 'test'").collect()}
    assert rows(few) == rows(many) and len(rows(few)) == 100


def test_null_stratum_is_refused(spark):
    from fieldsift.operators.sampling import stratified_split

    notes = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(20)], "note_id long, output string")
    with pytest.raises(Exception, match="output is NULL"):
        stratified_split(notes).collect()
