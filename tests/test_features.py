import math
import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldsift.fixed_values import CATEGORIES, CATEGORY_KEYWORDS, MIN_LEAF, MIN_SPLIT
from fieldsift.operators import features as X
from fieldsift.operators import forest, gram_filter
from fieldsift.operators import model as M
from fieldsift.operators import scoring as S
from fieldsift.plans.train import cross_validation, train_and_evaluate
from fieldsift.sources.artifacts import (
    ArtifactNotFoundError,
    current_version,
    load_classifier,
    save_classifier,
)

NOTES = [
    "Stock is low, stock IS low!", "Café stock délai", "a b c", "", None,
    "low_stock 42 x9", "ﬁne stock ½", "delivery delay delivery delay delivery",
    "delivery stock low", "Ström stock",
]


def grams(text):
    plain = "".join(
        c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.combining(c)
    )
    words = re.findall(r"\b\w\w+\b", plain)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.fixture
def notes(spark):
    return spark.createDataFrame(list(enumerate(NOTES)), "note_id long, input string")


def fitted(texts, max_features=5000, min_df=2, max_df=0.95):
    lists = [grams(t) for t in texts]
    df, cf = {}, {}
    for terms in lists:
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
        for t in terms:
            cf[t] = cf.get(t, 0) + 1
    able = [t for t in df if min_df <= df[t] <= max_df * len(texts)]
    top = sorted(sorted(able, key=lambda t: (-cf[t], t))[:max_features])
    return top, [math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in top]


def weights(text, terms, idf):
    counts = {}
    for t in grams(text):
        counts[t] = counts.get(t, 0) + 1
    raw = {i: (1 + math.log(counts[t])) * idf[i] for i, t in enumerate(terms) if t in counts}
    norm = math.sqrt(sum(w * w for w in raw.values()))
    return {i: w / norm for i, w in raw.items()}


def test_ngrams(apply):
    assert apply(X.ngrams, NOTES) == [grams(t) for t in NOTES]


def test_gram_table(notes):
    table = X.gram_table(notes, "input", "note_id")
    found = {r.note_id: [tuple(x) for x in r.runs] for r in table.collect()}
    assert found == {i: sorted((t, grams(n).count(t)) for t in set(grams(n))) for i, n in enumerate(NOTES)}
    back = table.select("note_id", X.run_grams("runs").alias("g")).collect()
    assert {r.note_id: r.g for r in back} == {i: sorted(grams(n)) for i, n in enumerate(NOTES)}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(120)]
    rows = [(i, t, "ab"[i % 2], i % 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "note_id long, input string, output string, fold int").repartition(6)


def test_filter_keeps_all_terms_of_two_notes(corpus):
    table = X.gram_table(corpus, "input")
    every = {r.term: (r.df, r.cf) for r in X.corpus_frequencies(table).collect()}
    kept = {r.term: (r.df, r.cf) for r in X.corpus_frequencies(table, 2).collect()}
    twice = {t: n for t, n in every.items() if n[0] >= 2}
    assert twice.items() <= kept.items() <= every.items()
    assert len(kept) < len(twice) + 0.01 * len(every) and len(every) > 2 * len(kept)


def test_tables_add_up_to_two():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 3, (7, gram_filter.CHUNK)) * (rng.random((7, gram_filter.CHUNK)) < 0.2)
    pack = lambda bits: np.packbits(bits, bitorder="little").tobytes()

    def table(rows):
        return pa.table(
            {
                "chunk": pa.array([3] * len(rows), pa.int32()),
                "part": pa.array([0] * len(rows), pa.int32()),
                "once": [pack(r >= 1) for r in rows],
                "twice": [pack(r >= 2) for r in rows],
            }
        )

    whole = gram_filter._added(table(counts))
    parts = pa.concat_tables([gram_filter._added(table(counts[i : i + 3])) for i in (0, 3, 6)])
    assert gram_filter._added(parts).equals(whole)
    assert whole["twice"][0].as_py() == pack(counts.sum(axis=0) >= 2)


def test_only_terms_that_can_be_wanted_are_counted(corpus, spark):
    table = X.gram_table(corpus, "input")
    least = lambda t: X._least_wanted(t, 120, 20, 2, 0.95)
    found = {r.term: (r.df, r.cf) for r in X.frequent_terms(table, least, 20, 2).collect()}
    every = {r.term: (r.df, r.cf) for r in X.corpus_frequencies(table).collect()}
    assert found.items() <= every.items() and 20 <= len(found) < len(every) / 10
    sums = {r.slot: r.n for r in X.slot_sums(table).collect()}
    assert sum(sums.values()) == sum(cf for _, cf in every.values())
    assert all(sums[X.slots_of([t]).argmax()] >= cf for t, (_, cf) in every.items())


@pytest.mark.parametrize("options", [{"max_features": 9}, {"max_features": 9, "max_df": 0.04}, {"max_features": 400}])
def test_more_slots_are_counted_where_the_first_do_not_tell(corpus, options):
    texts = [r.input for r in corpus.collect()]
    terms, idf = fitted(texts, **options)
    model = X.TfidfModel.fit(corpus, **options)
    assert model.terms == terms and model.idf == pytest.approx(idf)


def test_runs_of_parts(monkeypatch):
    rng = random.Random(8)
    notes = [[rng.choice("ab ac a_ b cé zz".split()) for _ in range(rng.choice([0, 1, 2, 5, 30]))] for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(notes, pa.list_(pa.string()))], ["i", "words"])
    for part in (1, 7, 1000):
        monkeypatch.setattr(X, "PART", part)
        found = {}
        for (ids,), runs in X._parts([batch]):
            cells = list(zip(runs.own.tolist(), runs.terms().to_pylist(), runs.times.tolist()))
            found |= {i: [(t, n) for own, t, n in cells if own == at] for at, i in enumerate(ids.to_pylist())}
        for i, words in enumerate(notes):
            every = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
            assert found[i] == sorted((t, every.count(t)) for t in set(every))


def test_counts_of_runs_equal_counts_of_grams(corpus):
    table = X.gram_table(corpus, "input", "note_id")
    terms = [r.term for r in X.vocabulary(table, max_features=40).collect()]
    for some in (terms, terms[::-1], []):
        model = X.TfidfModel(some, [1.0] * len(some))
        found = {r.note_id: (r.term_ids, r.tfs) for r in model.count_runs(table).collect()}
        plain = model.count_grams(table, X.run_grams("runs")).collect()
        assert found == {r.note_id: (r.term_ids, r.tfs) for r in plain}


def test_terms_are_dropped_before_the_shuffle(corpus):
    table = X.gram_table(corpus, "input")
    found = X.corpus_frequencies(table, 2)._jdf.queryExecution().executedPlan().toString()
    assert found.count("Exchange hashpartitioning") == 1
    above, _, below = found.partition("Exchange hashpartitioning")
    assert "BroadcastHashJoin" in below and "BroadcastHashJoin" not in above


@pytest.mark.parametrize("options", [{}, {"max_features": 20}, {"min_df": 1, "max_df": 0.05}])
def test_fold_vocabularies_equal_separate_fits(corpus, options):
    table = X.gram_table(corpus, "input", "note_id", "fold")
    found = X.fold_vocabularies(table, **options)
    assert sorted(found) == [0, 1, 2]
    for fold, vocabulary in found.items():
        alone = X.vocabulary(X.gram_table(corpus.where(F.col("fold") != fold)), **options)
        assert sorted(vocabulary.collect()) == sorted(alone.collect())


def test_narrowed_counts_equal_counts_of_the_narrow_vocabulary(corpus):
    table = X.gram_table(corpus, "input", "note_id", "fold")
    models = [X.TfidfModel.from_table(v) for v in X.fold_vocabularies(table, max_features=30).values()]
    joint = X.joint_vocabulary(models)
    counted = joint.count_grams(table, X.run_grams("runs"))
    for m in models:
        narrow = {r.note_id: (r.term_ids, r.weights) for r in m.weigh(m.narrow(counted, joint)).collect()}
        assert narrow == {r.note_id: (r.term_ids, r.weights) for r in m.transform(corpus).collect()}


def test_folds_are_numbered(corpus):
    with pytest.raises(ValueError, match="folds"):
        X.corpus_frequencies(X.gram_table(corpus.withColumn("fold", F.lit(1000)), "input", "fold"), 1, "fold")


@pytest.mark.parametrize("options", [{}, {"max_features": 3}, {"min_df": 1, "max_df": 0.3}])
def test_fit_and_transform(notes, options):
    terms, idf = fitted(NOTES, **options)
    model = X.TfidfModel.fit(notes, **options)
    assert model.terms == terms
    assert model.idf == pytest.approx(idf)
    for r in model.transform(notes).collect():
        assert dict(zip(r.term_ids, r.weights)) == pytest.approx(weights(r.input, terms, idf))
        assert r.term_ids == sorted(r.term_ids)
    vectors = model.transform(notes).select("note_id", model.vector().alias("v")).collect()
    assert all(r.v.size == len(terms) for r in vectors)
    assert vectors[3].v.numNonzeros() == 0


def test_unknown_notes_are_kept(notes, spark):
    model = X.TfidfModel.fit(notes)
    new = model.transform(spark.createDataFrame([(1, "zzz")], "note_id long, input string"))
    assert X.weight_rows(new).count() == 0
    assert tuple(X.weight_rows(new, keep_empty=True).first()) == (1, None, None)


def test_empty_vocabulary(notes):
    model = X.TfidfModel.fit(notes, min_df=1000)
    assert model.terms == [] and model.transform(notes).count() == len(NOTES)


def test_max_features_is_checked(notes):
    with pytest.raises(ValueError):
        X.TfidfModel.fit(notes, max_features=10**9)


def test_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "output string")
    classes = X.label_classes(df)
    code = X.encode_label(F.col("output"), classes)
    rows = df.select(code.alias("i"), X.decode_label(code, classes).alias("back"), "output").collect()
    assert classes == ["a", "b"]
    assert [r.i for r in rows] == [1, 0, 1, None]
    assert all(r.back == r.output for r in rows)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for i in range(100):
        words = CATEGORY_KEYWORDS[CATEGORIES[i % 5]]
        note = " ".join(words[(i + k) % len(words)] for k in range(6)) + f" store {i}"
        rows.append((i, note, CATEGORIES[i % 5], "test" if i % 4 == 0 else "train"))
    return spark.createDataFrame(rows, "note_id long, input string, output string, split string")


FOREST = {"n_trees": 20, "tree_depth": 5}


def test_train_save_load(labelled, spark, tmp_path):
    path = str(tmp_path / "model")
    scored = train_and_evaluate(labelled, path, **FOREST).collect()
    assert len(scored) == 25
    assert sum(r.true == r.predicted for r in scored) >= 23
    assert all(0 < r.confidence <= 1 for r in scored)
    model = load_classifier(spark, path)
    assert model.classes == sorted(CATEGORIES)
    again = {r.note_id: r.predicted for r in M.evaluate(model, labelled).collect()}
    assert all(again[r.note_id] == r.predicted for r in scored)
    save_classifier(spark, model, path)
    lines = [r.value for r in spark.read.text(f"{path}/evaluation/report").collect()]
    assert len(lines) == 11


def test_missing_model(spark, tmp_path):
    with pytest.raises(ArtifactNotFoundError):
        load_classifier(spark, str(tmp_path / "none"))


def test_no_small_node_is_split(labelled, spark, tmp_path):
    model = M.NoteClassifier.fit(labelled.where("split = 'train'").drop("split"), n_trees=8, tree_depth=12)
    model.forest.write().save(str(tmp_path / "forest"))
    nodes = [r.nodeData for r in spark.read.parquet(str(tmp_path / "forest" / "data")).collect()]
    assert all(n.rawCount >= MIN_SPLIT for n in nodes if n.leftChild >= 0)
    assert all(n.rawCount >= MIN_LEAF for n in nodes) and any(n.rawCount < 10 for n in nodes)


def test_pruned_tree():
    leaf = {"prediction": 0.0, "impurity": 0.0, "impurityStats": [1.0], "gain": -1.0, "leftChild": -1, "rightChild": -1, "split": forest.NO_SPLIT}
    split = {**leaf, "gain": 0.5, "split": {"featureIndex": 3, "leftCategoriesOrThreshold": [0.5], "numCategories": -1}}
    rows = [
        {**split, "id": 0, "rawCount": 9, "leftChild": 1, "rightChild": 4},
        {**split, "id": 1, "rawCount": 4, "leftChild": 2, "rightChild": 3},
        {**leaf, "id": 2, "rawCount": 2},
        {**leaf, "id": 3, "rawCount": 2},
        {**split, "id": 4, "rawCount": 5, "leftChild": 5, "rightChild": 6},
        {**leaf, "id": 5, "rawCount": 3},
        {**leaf, "id": 6, "rawCount": 2},
    ]
    found = forest._prune_tree(pd.DataFrame(rows[::-1]), 5)
    assert found["rawCount"].tolist() == [9, 4, 5, 3, 2] and found["id"].tolist() == [0, 1, 2, 3, 4]
    assert found["leftChild"].tolist() == [1, -1, 3, -1, -1] and found["rightChild"].tolist() == [2, -1, 4, -1, -1]
    assert [s["featureIndex"] for s in found["split"]] == [3, -1, 3, -1, -1]
    assert len(forest._prune_tree(pd.DataFrame(rows), 100)) == 1


def test_a_save_that_fails_leaves_the_old_model(labelled, spark, tmp_path, monkeypatch):
    path = str(tmp_path / "model")
    train = labelled.where("split = 'train'").drop("split")
    first = M.NoteClassifier.fit(train, n_trees=3, tree_depth=3)
    save_classifier(spark, first, path)
    second = M.NoteClassifier.fit(train.where("output <> 'demand_spike'"), n_trees=3, tree_depth=3)
    with monkeypatch.context() as patch:
        patch.setattr(type(second.forest), "write", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            save_classifier(spark, second, path)
    assert load_classifier(spark, path).classes == first.classes
    save_classifier(spark, second, path)
    assert load_classifier(spark, path).classes == second.classes
    assert load_classifier(spark, path, 1).tfidf.terms == first.tfidf.terms
    assert current_version(spark, path) == 2
    for folder in (tmp_path / "model" / "versions").iterdir():
        if (folder / "vocabulary" / "_SUCCESS").exists():
            (folder / "vocabulary" / "_SUCCESS").unlink()
    with pytest.raises(ArtifactNotFoundError, match="vocabulary"):
        load_classifier(spark, path)


def test_cross_validation_tokenises_once(labelled, monkeypatch):
    calls = []
    ngrams = X.ngrams
    monkeypatch.setattr(X, "ngrams", lambda text: calls.append(text) or ngrams(text))
    folded = labelled.withColumn("fold", (F.col("note_id") % 3).cast("int"))
    lost = folded.withColumn("fold", F.lit(None).cast("int")).withColumn("input", F.lit("other words"))
    scores = M.cross_validate(folded.unionByName(lost), n_trees=5, tree_depth=5).collect()
    assert sorted(r.fold for r in scores) == [0, 1, 2] and all(r.f1_weighted > 0.6 for r in scores)
    assert len(calls) == 1
    assert M.cross_validate(folded.limit(0)).count() == 0


def test_cross_validation(labelled):
    summary = cross_validation(labelled.drop("split"), n_trees=5, tree_depth=5).first()
    assert 0.6 < summary.cv_f1_mean <= 1 and summary.cv_f1_std >= 0


def test_tiers(spark):
    notes = spark.range(4).withColumnRenamed("id", "note_id")
    outputs = "note_id long, raw_output string, latency_seconds double"
    primary = spark.createDataFrame([(0, "demand_spike", 0.5), (1, None, 0.1)], outputs)
    fallback = spark.createDataFrame([(0, "price", 0.2), (1, "price", 0.2), (2, "", 0.1)], outputs)
    scores = S.primary_then_fallback(notes, S.parsed_results(primary), S.parsed_results(fallback))
    rows = {r.note_id: r for r in S.explain_scores(scores).collect()}
    assert [(rows[i].method, rows[i].issue_category, rows[i].scored) for i in range(4)] == [
        ("qlora_direct", "demand_spike", True),
        ("sklearn_tfidf", "pricing_conflict", True),
        ("sklearn_tfidf", "supply_chain_delay", True),
        (None, None, False),
    ]
    assert rows[0].latency_text == "0.50" and rows[3].reasoning is None


def test_model_hook(spark):
    def generate(prompts):
        if any("break" in p for p in prompts):
            raise RuntimeError
        return [f"Category: {'demand_spike' if 'rush' in p else 'none'}." for p in prompts]

    prompts = spark.createDataFrame(
        [(1, "a rush"), (2, "quiet"), (3, "break")], "note_id long, prompt string"
    ).repartition(3, "note_id")
    outputs = {r.note_id: r for r in S.generate_outputs(prompts, generate).collect()}
    assert outputs[1].raw_output == "Category: demand_spike."
    assert all(r.latency_seconds >= 0 for r in outputs.values())
    parsed = {r.note_id for r in S.parsed_results(S.generate_outputs(prompts, generate)).collect()}
    assert 1 in parsed and 3 not in parsed
