"""Every operator as a query on the driver's tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import CATEGORIES, CATEGORY_KEYWORDS, LEAKAGE_F1, PRIMARY_METHOD
from ..functions import labels, prompts, text
from ..operators import (
    chat,
    contracts,
    dataset,
    features,
    history,
    metrics,
    model,
    sampling,
    scoring,
)
from ..session import shared_path, stage
from ..sources import artifacts, notes, prediction_log, reports
from ..streaming import classify
from . import predict, train
from .inputs import table, view, view_stream
from .prepare import prepare_dataset

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_notes")


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.valid_notes(_raw(spark, sf_dir))


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_noisy_notes")


def _outputs(spark: SparkSession, sf_dir: str, source: str = "v_raw_outputs") -> DataFrame:
    return view(spark, sf_dir, source)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_log").withColumnRenamed("ts", "timestamp")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and parsed prediction of every raw output, joined by note."""
    outputs = _outputs(spark, sf_dir)
    truth = outputs.select("note_id", F.col("true_category").alias("true"))
    predicted = scoring.parsed_results(outputs).withColumnRenamed(
        "issue_category", "predicted"
    )
    return metrics.pair_outcomes(truth, predicted)


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_dataset(_raw(spark, sf_dir))


def _iso(column: str):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


# --- sources and sinks --------------------------------------------------------


@query
def scan_notes(spark, sf_dir):
    path = shared_path(spark, "notes-csv")
    _raw(spark, sf_dir).write.options(**notes.CSV_OPTIONS).csv(path)
    return notes.scan_notes(spark, path)


@query
def jsonl_roundtrip(spark, sf_dir):
    path = notes.write_labelled_jsonl(
        _valid(spark, sf_dir), shared_path(spark, "labelled-jsonl")
    )
    return notes.read_labelled_jsonl(spark, path)


@query
def log_write_read(spark, sf_dir):
    csv_path, jsonl_path = shared_path(spark, "log-csv"), shared_path(spark, "log-jsonl")
    rows = prediction_log.log_rows(_log(spark, sf_dir), at=F.col("timestamp"))
    prediction_log.save_predictions(rows, csv_path, jsonl_path)
    both = metrics.union_methods(
        {
            "csv": prediction_log.read_csv(spark, csv_path),
            "jsonl": prediction_log.read_jsonl(spark, jsonl_path),
        }
    )
    return both.select(
        F.col("method").alias("log"),
        _iso("timestamp").alias("timestamp"),
        "input_note",
        "issue_category",
        F.date_format("log_date", "yyyy-MM-dd").alias("log_date"),
    )


@query
def metrics_report(spark, sf_dir):
    return reports.report_lines(_scored(spark, sf_dir))


@query
def metrics_json(spark, sf_dir):
    path = reports.write_report(_scored(spark, sf_dir), shared_path(spark, "evaluation"))
    written = reports.read_metrics(spark, path)
    overall = ["accuracy", *(f"{m}_weighted" for m in ("precision", "recall", "f1"))]
    place = F.array_position(F.array(*[F.lit(c) for c in sorted(CATEGORIES)]), F.col("label"))
    return written.select(
        "*", F.explode("classification_report").alias("label", "own")
    ).select(
        "label",
        "own.support",
        *[F.round(F.col("own")[m], 6).alias(m) for m in ("precision", "recall", "f1")],
        *[F.round(m, 6).alias(m) for m in overall],
        F.array_join(F.get("confusion_matrix", place.cast("int") - 1).cast("array<string>"), ",").alias("counts"),
    )


@query
def log_stamped(spark, sf_dir):
    csv_path, jsonl_path = shared_path(spark, "log-csv"), shared_path(spark, "log-jsonl")
    before = F.lit(datetime.now(UTC).replace(tzinfo=None)).cast("timestamp_ntz")
    rows = prediction_log.log_rows(_log(spark, sf_dir))
    prediction_log.save_predictions(rows, csv_path, jsonl_path)
    after = before + F.expr("INTERVAL 1 DAY")
    stamped = F.convert_timezone(None, F.lit("UTC"), F.col("timestamp")).between(before, after)
    return prediction_log.read_jsonl(spark, jsonl_path).select(
        "input_note", "issue_category", stamped.alias("stamped")
    )


# --- validity, mapping, counts ------------------------------------------------


@query
def valid_notes(spark, sf_dir):
    return _valid(spark, sf_dir)


@query
def rejected_notes(spark, sf_dir):
    return dataset.rejected_notes(_raw(spark, sf_dir)).select(
        "note_id", "issue_category", "reject_reason"
    )


@query
def strict_notes(spark, sf_dir):
    return dataset.strict_notes(_raw(spark, sf_dir))


@query
def map_category(spark, sf_dir):
    return _raw(spark, sf_dir).select(
        "note_id", labels.map_category(F.col("issue_category")).alias("category")
    )


@query
def category_display(spark, sf_dir):
    return _valid(spark, sf_dir).select(
        "note_id",
        "output",
        labels.display_name(F.col("output")).alias("display_name"),
        labels.title_from_code(F.col("output")).alias("title"),
    )


@query
def load_stats(spark, sf_dir):
    return dataset.load_stats(_raw(spark, sf_dir))


@query
def category_distribution(spark, sf_dir):
    return dataset.distribution(_valid(spark, sf_dir))


@query
def duplicate_count(spark, sf_dir):
    return dataset.duplicate_count(_valid(spark, sf_dir))


@query
def dedup_first(spark, sf_dir):
    return dataset.dedup_first(_valid(spark, sf_dir))


@query
def class_weights(spark, sf_dir):
    return dataset.class_weights(_valid(spark, sf_dir)).select(
        "output", "n", F.round("weight", 6).alias("weight")
    )


# --- split, folds, few-shot picks ---------------------------------------------


@query
def stratified_split(spark, sf_dir):
    return _prepared(spark, sf_dir).select("note_id", "output", "split")


@query
def split_antijoin(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    held_out = prepared.where(F.col("split") == "test")
    return sampling.complement(prepared.drop("split"), held_out)


@query
def split_counts(spark, sf_dir):
    return dataset.split_counts(_prepared(spark, sf_dir))


@query
def stratified_folds(spark, sf_dir):
    return sampling.stratified_folds(_valid(spark, sf_dir)).select(
        "note_id", "output", "fold"
    )


@query
def fewshot_bucket(spark, sf_dir):
    return sampling.fewshot_by_bucket(_valid(spark, sf_dir))


@query
def fewshot_stride(spark, sf_dir):
    return sampling.fewshot_by_stride(_valid(spark, sf_dir))


@query
def fewshot_blocks(spark, sf_dir):
    return chat.fewshot_blocks(sampling.fewshot_by_stride(_valid(spark, sf_dir)))


@query
def fewshot_prompt(spark, sf_dir):
    return chat.fewshot_prompt(
        sampling.fewshot_by_stride(dataset.strict_notes(_raw(spark, sf_dir)))
    )


# --- text cleaning ------------------------------------------------------------


def _cleaned(spark, sf_dir, fn, name) -> DataFrame:
    return _noisy(spark, sf_dir).select("note_id", fn(F.col("rep_note")).alias(name))


@query
def clean_whitespace(spark, sf_dir):
    return _cleaned(spark, sf_dir, text.clean_whitespace, "cleaned")


@query
def clean_punctuation(spark, sf_dir):
    return _cleaned(spark, sf_dir, text.clean_punctuation, "cleaned")


@query
def expand_abbreviations(spark, sf_dir):
    return _cleaned(spark, sf_dir, text.expand_abbreviations, "expanded")


@query
def clean_note(spark, sf_dir):
    return _cleaned(spark, sf_dir, text.clean_note, "cleaned")


@query
def clean_documents(spark, sf_dir):
    return _raw(spark, sf_dir).select(
        "note_id", text.clean_note(F.col("rep_note")).alias("cleaned")
    )


@query
def redact_secrets(spark, sf_dir):
    return _raw(spark, sf_dir).select(
        "note_id", text.redact_secrets(F.col("rep_note")).alias("redacted")
    )


# --- contracts ----------------------------------------------------------------


@query
def note_contract(spark, sf_dir):
    return contracts.note_contract(_noisy(spark, sf_dir)).drop("rep_note")


@query
def document_contract(spark, sf_dir):
    return contracts.note_contract(_raw(spark, sf_dir)).drop(
        "rep_note", "issue_category"
    )


@query
def batch_contract(spark, sf_dir):
    return contracts.batch_contract(view(spark, sf_dir, "v_batches"))


@query
def batch_totals(spark, sf_dir):
    batches = view(spark, sf_dir, "v_batches").withColumn(
        "latency_seconds", F.char_length("rep_note").cast("double") / 1000.0
    )
    return contracts.batch_totals(batches).withColumn(
        "total_latency_seconds", F.round("total_latency_seconds", 6)
    )


@query
def prediction_contract(spark, sf_dir):
    # Latency stands in for a confidence, so some values are out of range.
    rows = _outputs(spark, sf_dir).select(
        "note_id",
        labels.extract_category(F.col("raw_output")).alias("issue_category"),
        F.col("latency_seconds").alias("confidence"),
        "method",
    )
    return contracts.prediction_contract(rows)


# --- labels from model output -------------------------------------------------


@query
def clean_output(spark, sf_dir, source="v_raw_outputs"):
    return _outputs(spark, sf_dir, source).select(
        "note_id", labels.clean_output(F.col("raw_output")).alias("cleaned")
    )


@query
def extract_category(spark, sf_dir, source="v_raw_outputs"):
    return _outputs(spark, sf_dir, source).select(
        "note_id", labels.extract_category(F.col("raw_output")).alias("category")
    )


@query
def keyword_score(spark, sf_dir, source="v_raw_outputs"):
    cleaned = labels.clean_output(F.col("raw_output"))
    return (
        _outputs(spark, sf_dir, source)
        .select(
            "note_id",
            labels.keyword_scores(cleaned).alias("scores"),
            labels.keyword_match(cleaned).alias("category"),
        )
        .select(
            "note_id",
            *[
                F.col("scores")[i].cast("bigint").alias(c)
                for i, c in enumerate(CATEGORY_KEYWORDS)
            ],
            "category",
        )
    )


@query
def parse_category(spark, sf_dir, source="v_raw_outputs"):
    return (
        _outputs(spark, sf_dir, source)
        .select("note_id", labels.parse_category(F.col("raw_output")).alias("parsed"))
        .select("note_id", "parsed.*")
    )


@query
def eval_label(spark, sf_dir, source="v_raw_outputs"):
    return _outputs(spark, sf_dir, source).select(
        "note_id", labels.eval_label(F.col("raw_output")).alias("label")
    )


def _on_documents(name, fn):
    """The same query with whole documents as model output."""

    def run(spark, sf_dir):
        return fn(spark, sf_dir, "v_text_outputs")

    QUERIES[f"{name}_documents"] = run


for _name in ("clean_output", "extract_category", "keyword_score", "parse_category", "eval_label"):
    _on_documents(_name, QUERIES[_name])


@query
def eval_predictions(spark, sf_dir):
    outputs = _outputs(spark, sf_dir).select(
        F.col("note_id"),
        F.col("true_category").alias("true"),
        labels.eval_label(F.col("raw_output")).alias("predicted"),
    )
    texts = _raw(spark, sf_dir).select("note_id", F.col("rep_note").alias("note"))
    return metrics.eval_predictions(outputs.join(texts, "note_id", "left"))


# --- evaluation ---------------------------------------------------------------


@query
def accuracy(spark, sf_dir):
    return metrics.accuracy(_scored(spark, sf_dir))


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_scored(spark, sf_dir), CATEGORIES)


def _evaluated(spark, sf_dir):
    """Truth and the first word of the output, which can be any word."""
    return _outputs(spark, sf_dir).select(
        F.col("true_category").alias("true"),
        labels.eval_label(F.col("raw_output")).alias("predicted"),
    )


@query
def confusion_matrix_open(spark, sf_dir):
    return metrics.confusion_matrix(_evaluated(spark, sf_dir))


@query
def classification_report_open(spark, sf_dir):
    report = metrics.classification_report(_evaluated(spark, sf_dir))
    return report.withColumns(
        {m: F.round(m, 6) for m in ("precision", "recall", "f1")}
    )


@query
def classification_report(spark, sf_dir):
    report = metrics.classification_report(_scored(spark, sf_dir), CATEGORIES)
    return report.withColumns(
        {m: F.round(m, 6) for m in ("precision", "recall", "f1")}
    )


@query
def weighted_metrics(spark, sf_dir):
    report = metrics.classification_report(_scored(spark, sf_dir), CATEGORIES)
    return metrics.average_metrics(report).withColumns(
        {m: F.round(m, 6) for m in ("precision", "recall", "f1")}
    )


@query
def method_comparison(spark, sf_dir):
    outputs = _outputs(spark, sf_dir).select(
        "method",
        F.col("true_category").alias("true"),
        labels.parse_category(F.col("raw_output"))["category"].alias("predicted"),
        "latency_seconds",
    )
    by_method = {
        name: outputs.where(F.col("method") == name).drop("method")
        for name in ("primary", "fallback")
    }
    return metrics.method_comparison(metrics.union_methods(by_method)).withColumn(
        "accuracy", F.round("accuracy", 6)
    )


@query
def unmatched_pairs(spark, sf_dir):
    outputs = _outputs(spark, sf_dir)
    truth = outputs.where(F.col("method") == "primary")
    predicted = outputs.where(F.col("raw_output") != "")
    return metrics.unmatched_count(truth, predicted)


@query
def cv_summary(spark, sf_dir):
    folded = _scored(spark, sf_dir).withColumn("fold", F.col("note_id") % 5)
    scores = metrics.weighted_f1_by(folded, "fold")
    return metrics.cv_summary(scores).select(
        F.round("cv_f1_mean", 6).alias("cv_f1_mean"),
        F.round("cv_f1_std", 6).alias("cv_f1_std"),
        "leakage_risk",
    )


# --- scoring ------------------------------------------------------------------


def _tiered(spark, sf_dir) -> DataFrame:
    outputs = _outputs(spark, sf_dir)
    primary = outputs.where((F.col("method") == "primary") & (F.col("raw_output") != ""))
    fallback = outputs.where(F.col("note_id") % 3 != 0)
    return scoring.primary_then_fallback(
        outputs, scoring.parsed_results(primary), scoring.parsed_results(fallback)
    )


@query
def tiered_scoring(spark, sf_dir):
    return _tiered(spark, sf_dir)


@query
def reasoning(spark, sf_dir):
    return scoring.explain_scores(_tiered(spark, sf_dir)).select(
        "note_id", "latency_text", "reasoning"
    )


@query
def predict_notes(spark, sf_dir):
    return predict.predict_notes(_noisy(spark, sf_dir))


@query
def predict_documents(spark, sf_dir):
    return predict.predict_notes(_outputs(spark, sf_dir, "v_text_outputs"))


# --- prompts and messages -----------------------------------------------------


@query
def prompt_zero_shot(spark, sf_dir):
    return _cleaned(spark, sf_dir, prompts.zero_shot_prompt, "prompt")


@query
def prompt_short(spark, sf_dir):
    return _cleaned(spark, sf_dir, prompts.short_prompt, "prompt")


@query
def prompt_eval(spark, sf_dir):
    return _cleaned(spark, sf_dir, prompts.evaluation_prompt, "prompt")


@query
def sft_text(spark, sf_dir):
    return dataset.strict_notes(_raw(spark, sf_dir)).select(
        "note_id", prompts.training_text(F.col("input"), F.col("output")).alias("text")
    )


@query
def chat_messages(spark, sf_dir):
    return chat.message_rows(_noisy(spark, sf_dir), F.col("rep_note"))


@query
def conversation_checks(spark, sf_dir):
    return chat.conversation_checks(table(spark, sf_dir, "conversations"))


@query
def chat_render(spark, sf_dir):
    return chat.render_conversations(table(spark, sf_dir, "conversations"))


# --- features and model -------------------------------------------------------


@query
def ngrams(spark, sf_dir):
    return _valid(spark, sf_dir).select(
        "note_id", F.array_join(features.ngrams(F.col("input")), "|").alias("grams")
    )


@query
def tfidf_vocab(spark, sf_dir):
    grams = features.gram_table(_valid(spark, sf_dir))
    return features.vocabulary(grams).withColumns(
        {"idf": F.round("idf", 6), "term_id": F.col("term_id").cast("bigint")}
    )


@query
def tfidf(spark, sf_dir):
    grams = features.gram_table(_valid(spark, sf_dir), "input", "note_id")
    fitted = features.TfidfModel.fit_grams(grams)
    return features.weight_rows(fitted.transform_grams(grams)).select(
        "note_id",
        F.col("term_id").cast("bigint").alias("term_id"),
        F.round("weight", 6).alias("weight"),
    )


@query
def tfidf_transform(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    fitted = features.TfidfModel.fit(prepared.where(F.col("split") == "train"))
    new = fitted.transform(prepared.where(F.col("split") == "test"))
    return features.weight_rows(new, keep_empty=True).select(
        "note_id",
        F.col("term_id").cast("bigint").alias("term_id"),
        F.round("weight", 6).alias("weight"),
    )


@query
def label_encode(spark, sf_dir):
    valid = _valid(spark, sf_dir)
    classes = features.label_classes(valid)
    code = features.encode_label(F.col("output"), classes)
    return valid.select(
        "note_id",
        "output",
        code.cast("bigint").alias("label"),
        features.decode_label(code, classes).alias("decoded"),
    )


@query
def rf_train_score(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    fitted = model.NoteClassifier.fit(prepared.where(F.col("split") == "train"))
    scored = model.evaluate(fitted, prepared.where(F.col("split") == "test"))
    return scored.select(
        "note_id",
        "true",
        F.col("predicted").isin(fitted.classes).alias("known"),
        F.col("confidence").between(1.0 / len(fitted.classes), 1.0).alias("in_range"),
    )


@query
def model_evaluation(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("note_id"), text.py_strip(F.col("text")).alias("input"), F.col("lang").alias("output")
    )
    notes = dataset.dedup_first(documents.where("input IS NOT NULL AND output IS NOT NULL"))
    split = stage(sampling.stratified_split(notes), "languages")
    path = shared_path(spark, "model")
    train.train_and_evaluate(split, path, clean=False, n_trees=30, tree_depth=12)
    report = reports.read_metrics(spark, f"{path}/evaluation")
    return report.select(F.explode("classification_report").alias("label", "own")).select(
        "label", "own.support", (F.col("own.f1") >= 0.8).alias("learned")
    )


@query
def model_roundtrip(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    test = prepared.where(F.col("split") == "test").drop("split")
    fitted = model.NoteClassifier.fit(prepared.where(F.col("split") == "train"))
    path = shared_path(spark, "model")
    artifacts.save_classifier(spark, fitted, path)
    loaded = artifacts.load_classifier(spark, path)
    before, after = model.evaluate(fitted, test), model.evaluate(loaded, test)
    answer = F.struct("predicted", "confidence")
    return before.select("note_id", "true", answer.alias("fresh")).join(
        after.select("note_id", answer.alias("saved")), "note_id"
    ).select("note_id", "true", F.col("fresh").eqNullSafe(F.col("saved")).alias("same"))


@query
def predict_tiered(spark, sf_dir):
    train = _prepared(spark, sf_dir).where(F.col("split") == "train")
    fitted = model.NoteClassifier.fit(train)
    outputs = _outputs(spark, sf_dir).where("method = 'primary' AND raw_output <> ''")
    found = predict.predict_tiered(_raw(spark, sf_dir), fitted, outputs)
    category, confidence = F.col("issue_category"), F.col("confidence")
    told = F.col("reasoning").isNotNull() & confidence.between(0.0, 1.0)
    return found.select(
        "note_id",
        "status",
        "method",
        F.when(F.col("method") == PRIMARY_METHOD, category).alias("primary_category"),
        F.coalesce(category.isin(fitted.classes) & told, F.lit(False)).alias("answered"),
    )


@query
def cv_train(spark, sf_dir):
    folded = stage(
        sampling.stratified_folds(dataset.dedup_first(_valid(spark, sf_dir))), "folded"
    )
    sizes = folded.groupBy("fold").agg(F.count("*").alias("n"))
    scores = stage(model.cross_validate(folded), "fold_scores")
    # One row; the mean over the folds and what is made of it.
    summary = metrics.cv_summary(scores)
    mean, flag = (summary.select(c).scalar() for c in ("cv_f1_mean", "leakage_risk"))
    return sizes.join(scores, "fold").select(
        "fold",
        "n",
        F.col("f1_weighted").between(0.0, 1.0).alias("in_range"),
        (flag == (mean > LEAKAGE_F1)).alias("flagged"),
    )


@query
def cv_vocabularies(spark, sf_dir):
    folded = sampling.stratified_folds(dataset.dedup_first(_valid(spark, sf_dir)))
    grams = features.gram_table(folded, "input", "fold")
    parts = [
        table.withColumn("fold", F.lit(fold))
        for fold, table in features.fold_vocabularies(grams).items()
    ]
    return metrics.union_methods(dict(enumerate(parts))).select(
        "fold",
        F.col("term_id").cast("bigint").alias("term_id"),
        "term",
        "df",
        "cf",
        F.round("idf", 6).alias("idf"),
    )


# --- log reports and streams --------------------------------------------------


@query
def log_category_counts(spark, sf_dir):
    return history.category_counts(_log(spark, sf_dir))


@query
def recent_history(spark, sf_dir):
    return history.history(_log(spark, sf_dir), 25, "id").withColumn(
        "timestamp", _iso("timestamp")
    )


@query
def log_recent(spark, sf_dir):
    path = shared_path(spark, "log-recent")
    rows = prediction_log.log_rows(_log(spark, sf_dir), at=F.col("timestamp"))
    prediction_log.append_jsonl(rows, path)
    newest = prediction_log.read_newest(spark, path, 25)
    return history.history(newest, 25, "input_note").select(_iso("timestamp").alias("timestamp"))


@query
def recent_predictions(spark, sf_dir):
    recent = history.recent_predictions(_log(spark, sf_dir), tie_break="id")
    return recent.withColumn("timestamp", _iso("timestamp"))


@query
def stream_predict(spark, sf_dir):
    csv_path, jsonl_path = shared_path(spark, "log-csv"), shared_path(spark, "log-jsonl")
    classify.classify_stream(
        view_stream(spark, sf_dir, "v_noisy_notes"),
        csv_path,
        jsonl_path,
        shared_path(spark, "stream"),
    ).awaitTermination()
    both = metrics.union_methods(
        {
            "csv": prediction_log.read_csv(spark, csv_path),
            "jsonl": prediction_log.read_jsonl(spark, jsonl_path),
        }
    )
    return both.select(F.col("method").alias("log"), "input_note", "issue_category")


@query
def stream_rejects(spark, sf_dir):
    path = shared_path(spark, "rejects")
    classify.classify_stream(
        view_stream(spark, sf_dir, "v_noisy_notes"),
        shared_path(spark, "log-csv"),
        shared_path(spark, "log-jsonl"),
        shared_path(spark, "stream"),
        rejects_path=path,
    ).awaitTermination()
    rows = spark.read.schema("note_id long, input_note string, status string").json(path)
    return rows.select("note_id", "input_note", "status")


@query
def stream_predict_tiered(spark, sf_dir):
    train = _prepared(spark, sf_dir).where(F.col("split") == "train")
    fitted = model.NoteClassifier.fit(train, n_trees=20, tree_depth=8)
    store = artifacts.save_classifier(spark, fitted, shared_path(spark, "model"))
    outputs = stage(
        _outputs(spark, sf_dir).where("method = 'primary' AND raw_output <> ''"), "outputs"
    )
    results, csv_path = shared_path(spark, "results"), shared_path(spark, "log-csv")
    classify.classify_stream_tiered(
        view_stream(spark, sf_dir, "v_notes"),
        store,
        csv_path,
        shared_path(spark, "log-jsonl"),
        results,
        shared_path(spark, "stream"),
        lambda notes: outputs.join(notes.select("note_id"), "note_id", "left_semi"),
    ).awaitTermination()
    logged = prediction_log.read_csv(spark, csv_path).select("input_note", "issue_category").distinct()
    logged = logged.withColumn("logged", F.lit(True))
    found = classify.read_results(spark, results)
    category, confidence = F.col("issue_category"), F.col("confidence")
    told = F.col("reasoning").isNotNull() & confidence.between(0.0, 1.0)
    return found.join(logged, ["input_note", "issue_category"], "left").select(
        "note_id",
        "status",
        "method",
        "model_version",
        F.when(F.col("method") == PRIMARY_METHOD, category).alias("primary_category"),
        F.coalesce(category.isin(fitted.classes) & told, F.lit(False)).alias("answered"),
        F.coalesce("logged", F.lit(False)).alias("logged"),
    )


@query
def stream_counts(spark, sf_dir):
    path = shared_path(spark, "counts")
    classify.count_stream(
        view_stream(spark, sf_dir, "v_log"), path, shared_path(spark, "stream")
    ).awaitTermination()
    return classify.read_counts(spark, path)
