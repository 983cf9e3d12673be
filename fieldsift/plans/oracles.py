"""The queries' results in SQL for DuckDB: name -> statement.

Written from the rules, with plain windows and joins, to check the Spark
operators against.
"""

from __future__ import annotations

from ..fixed_values import (
    ABBREVIATIONS,
    CATEGORIES,
    CATEGORY_DEFINITIONS,
    CATEGORY_KEYWORDS,
    CATEGORY_MAP,
    CHAT_USER_PROMPT,
    DISPLAY_NAMES,
    EVALUATION_PROMPT,
    FALLBACK_METHOD,
    FALLBACK_REASONING,
    FEWSHOT_EXAMPLES_HEADING,
    FEWSHOT_INTRO,
    FEWSHOT_RULES,
    NA_VALUES,
    OUTPUT_PREFIXES,
    PRIMARY_METHOD,
    PRIMARY_REASONING,
    REDACTED,
    SECRET_PATTERNS,
    SHORT_PROMPT,
    SYSTEM_PROMPT,
    TRAINING_TEXT,
    ZERO_SHOT_PROMPT,
)
from .inputs import view_sql

ORACLES = {}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case(key: str, pairs: dict[str, str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in pairs.items())
    return f"CASE {key} {whens} ELSE {default} END"


def in_list(values) -> str:
    return "(" + ", ".join(map(lit, values)) + ")"


def fill(template: str, **values: str) -> str:
    """Template as SQL: concatenated literals and expressions."""
    for name, expression in values.items():
        template = template.replace("{" + name + "}", f"\0{expression}\0")
    parts = template.split("\0")
    return " || ".join(
        f"({p})" if i % 2 else lit(p) for i, p in enumerate(parts) if p
    )


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g')"


def blank(text: str) -> str:
    return f"({text} IS NULL OR {strip(text)} = '')"


RAW_KEY = f"upper({strip('issue_category')})"
KNOWN = f"coalesce({RAW_KEY} IN {in_list(CATEGORY_MAP)}, false)"
MAPPED = f"coalesce({case(RAW_KEY, CATEGORY_MAP)}, lower(issue_category))"

VALID = (
    view_sql("v_notes")
    + f""", valid AS (
        SELECT note_id, {strip('rep_note')} AS input, {MAPPED} AS output
        FROM v_notes WHERE NOT {blank('rep_note')} AND {KNOWN})"""
)
STRICT = (
    view_sql("v_notes")
    + f""", strict AS (
        SELECT note_id, {strip('rep_note')} AS input,
               {case('issue_category', CATEGORY_MAP)} AS output
        FROM v_notes
        WHERE rep_note IS NOT NULL AND issue_category IN {in_list(CATEGORY_MAP)})"""
)
DEDUP = (
    VALID
    + """, dedup AS (
        SELECT * FROM valid
        QUALIFY row_number() OVER (PARTITION BY input ORDER BY note_id) = 1)"""
)
SHUFFLED = "substr(md5('42:' || note_id::VARCHAR), 1, 15), note_id"
SPLIT = (
    DEDUP
    + f""", sizes AS (SELECT output, count(*) AS n FROM dedup GROUP BY output),
    shares AS (
        SELECT output, n, sum(n) OVER () AS total,
               ceil(sum(n) OVER () * CAST(0.2 AS DOUBLE))::HUGEINT AS drawn FROM sizes),
    quotas AS (
        SELECT output, (n * drawn) // total + CASE WHEN row_number() OVER (
                   ORDER BY (n * drawn) % total DESC, output)
                   <= drawn - sum((n * drawn) // total) OVER () THEN 1 ELSE 0 END AS quota
        FROM shares),
    prepared AS (
        SELECT note_id, input, output, CASE WHEN row_number() OVER (
                   PARTITION BY output ORDER BY {SHUFFLED}) <= quota
                   THEN 'test' ELSE 'train' END AS split
        FROM dedup JOIN quotas USING (output))"""
)


def status(text: str) -> str:
    return f"""CASE WHEN {text} IS NULL THEN 'missing' WHEN length({text}) < 1 THEN 'too_short'
        WHEN length({text}) > 1000 THEN 'too_long' WHEN {blank(text)} THEN 'blank' ELSE 'ok' END"""


def oracle(name: str, select: str, *ctes: str) -> None:
    ORACLES[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + select


# --- sources and sinks --------------------------------------------------------

NA = in_list(NA_VALUES)
oracle(
    "scan_notes",
    f"""SELECT note_id,
        CASE WHEN rep_note NOT IN {NA} THEN rep_note END AS rep_note,
        CASE WHEN issue_category NOT IN {NA} THEN issue_category END AS issue_category
        FROM v_notes""",
    view_sql("v_notes"),
)
oracle("jsonl_roundtrip", "SELECT input, output FROM valid", VALID)
ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"
oracle(
    "log_write_read",
    f"""SELECT log, {ISO} AS timestamp, input_note, issue_category,
        strftime(ts, '%Y-%m-%d') AS log_date
        FROM v_log CROSS JOIN (VALUES ('csv'), ('jsonl')) AS logs(log)""",
    view_sql("v_log"),
)
oracle(
    "log_stamped",
    "SELECT input_note, issue_category, true AS stamped FROM v_log",
    view_sql("v_log"),
)

# --- validity, mapping, counts ------------------------------------------------

oracle("valid_notes", "SELECT * FROM valid", VALID)
oracle(
    "rejected_notes",
    f"""SELECT note_id, issue_category,
        CASE WHEN {blank('rep_note')} THEN 'missing_note'
             ELSE 'unknown_category' END AS reject_reason
        FROM v_notes WHERE {blank('rep_note')} OR NOT {KNOWN}""",
    view_sql("v_notes"),
)
oracle("strict_notes", "SELECT * FROM strict", STRICT)
oracle(
    "map_category", f"SELECT note_id, {MAPPED} AS category FROM v_notes", view_sql("v_notes")
)
oracle(
    "category_display",
    f"""SELECT note_id, output, {case('output', DISPLAY_NAMES)} AS display_name,
        array_to_string([upper(w[1]) || w[2:] for w in string_split(output, '_')], ' ') AS title
        FROM valid""",
    VALID,
)
oracle(
    "load_stats",
    """SELECT count(*) AS total, count(v.note_id) AS valid,
        count(*) - count(v.note_id) AS skipped
        FROM v_notes n LEFT JOIN valid v USING (note_id)""",
    VALID,
)
oracle(
    "category_distribution", "SELECT output, count(*) AS n FROM valid GROUP BY output", VALID
)
oracle(
    "duplicate_count",
    """SELECT CAST(count(*) - count(DISTINCT input) AS BIGINT) AS duplicates,
        count(*) > count(DISTINCT input) AS leakage_risk FROM valid""",
    VALID,
)
oracle("dedup_first", "SELECT * FROM dedup", DEDUP)
oracle(
    "class_weights",
    """SELECT output, count(*) AS n, round(sum(count(*)) OVER ()::DOUBLE
        / (count(*) OVER () * count(*)), 6) AS weight FROM valid GROUP BY output""",
    VALID,
)

# --- split, folds, few-shot picks ---------------------------------------------

oracle("stratified_split", "SELECT note_id, output, split FROM prepared", SPLIT)
oracle(
    "split_antijoin",
    "SELECT note_id, input, output FROM prepared WHERE split = 'train'",
    SPLIT,
)
oracle(
    "split_counts",
    "SELECT split, output, count(*) AS n FROM prepared GROUP BY split, output",
    SPLIT,
)


def folds(notes: str) -> str:
    return f"""sizes AS (SELECT output, count(*) AS n, min(note_id) AS first_id
        FROM {notes} GROUP BY output),
    placed AS (SELECT output, n, coalesce(sum(n) OVER (ORDER BY first_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sizes),
    dealt AS (SELECT output, fold, count(*) AS dealt FROM (
        SELECT output, unnest(generate_series(start::BIGINT, (start + n - 1)::BIGINT)) % 5
            AS fold FROM placed) GROUP BY output, fold),
    ends AS (SELECT output, fold, dealt,
        sum(dealt) OVER (PARTITION BY output ORDER BY fold) AS upto FROM dealt),
    folded AS (SELECT note_id, output, input, CAST(fold AS INTEGER) AS fold FROM (
            SELECT note_id, output, input, row_number() OVER (
                PARTITION BY output ORDER BY {SHUFFLED}) AS r FROM {notes})
        JOIN ends USING (output) WHERE r <= upto AND r > upto - dealt)"""


oracle("stratified_folds", "SELECT note_id, output, fold FROM folded", VALID, folds("valid"))
BY_LENGTH = """ranked AS (
        SELECT note_id, input, output, count(*) OVER (PARTITION BY output) AS n,
               row_number() OVER (PARTITION BY output ORDER BY length(input), note_id) AS r
        FROM {notes})"""
STRIDE = """picked AS (
        SELECT output, note_id, input, row_number() OVER (PARTITION BY output ORDER BY
                   CASE WHEN n > 6 THEN r END, note_id) AS position
        FROM ranked WHERE n <= 6 OR ((r - 1) % (n // 6) = 0 AND (r - 1) // (n // 6) < 6))"""
oracle(
    "fewshot_bucket",
    """SELECT output, note_id, input, CAST(row_number() OVER (
            PARTITION BY output ORDER BY bucket, note_id) AS INTEGER) AS position
        FROM drawn""",
    VALID,
    BY_LENGTH.format(notes="valid"),
    f"""bucketed AS (
        SELECT *, CASE WHEN n > 6 THEN (r - 1) // (n // 6) ELSE note_id END AS bucket
        FROM ranked),
    drawn AS (
        SELECT * FROM bucketed WHERE n <= 6 OR bucket < 6
        QUALIFY n <= 6 OR row_number() OVER (
            PARTITION BY output, bucket ORDER BY {SHUFFLED}) = 1)""",
)
oracle(
    "fewshot_stride",
    "SELECT output, note_id, input, CAST(position AS INTEGER) AS position FROM picked",
    VALID,
    BY_LENGTH.format(notes="valid"),
    STRIDE,
)
BLOCKS = """blocks AS (
        SELECT output, count(*) AS n_examples, string_agg('Input: "' || input ||
                   '"' || chr(10) || 'Output: ' || output || chr(10) || '---',
                   chr(10) ORDER BY position) AS block
        FROM picked GROUP BY output)"""
oracle(
    "fewshot_blocks",
    "SELECT * FROM blocks",
    VALID,
    BY_LENGTH.format(notes="valid"),
    STRIDE,
    BLOCKS,
)
_definitions = "\n".join(
    f"{c} — {DISPLAY_NAMES[c]}: {CATEGORY_DEFINITIONS[c]}" for c in CATEGORIES
)
_head = "\n".join([FEWSHOT_INTRO, _definitions, FEWSHOT_EXAMPLES_HEADING, "---"])
_order = " ".join(f"WHEN {lit(c)} THEN {i}" for i, c in enumerate(CATEGORIES))
oracle(
    "fewshot_prompt",
    f"""SELECT {lit(_head)} || chr(10) || string_agg(block, chr(10) ORDER BY
            CASE output {_order} END) || chr(10) || {lit(FEWSHOT_RULES)} AS system_prompt
        FROM blocks""",
    STRICT,
    BY_LENGTH.format(notes="strict"),
    STRIDE,
    BLOCKS,
)

# --- text cleaning ------------------------------------------------------------


def squeeze(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def punctuation(text: str) -> str:
    for mark in "!?.,":
        text = f"regexp_replace({text}, '[{mark}]{{2,}}', '{mark}', 'g')"
    return rf"regexp_replace({text}, '[^a-zA-Z0-9\s.,!?'']', '', 'g')"


_abbreviations = (
    f"abbreviations AS (SELECT MAP([{', '.join(map(lit, ABBREVIATIONS))}], "
    f"[{', '.join(map(lit, ABBREVIATIONS.values()))}]) AS full_words)"
)


def expand(text: str) -> str:
    key = "regexp_replace(lower(w), '[^a-zA-Z]', '', 'g')"
    return (
        f"array_to_string([coalesce(map_extract(full_words, {key})[1], w)"
        rf" for w in string_split_regex({text}, '\s+') if w <> ''], ' ')"
    )


def clean(text: str) -> str:
    return f"CASE WHEN NOT {blank(text)} THEN {expand(punctuation(f'lower({text})'))} END"


NOISY = view_sql("v_noisy_notes")
NOTE = "rep_note"
for name, column, expression in [
    ("clean_whitespace", "cleaned", squeeze(NOTE)),
    ("clean_punctuation", "cleaned", punctuation(NOTE)),
    ("prompt_zero_shot", "prompt", fill(ZERO_SHOT_PROMPT, note=NOTE)),
    ("prompt_short", "prompt", fill(SHORT_PROMPT, note=NOTE)),
    ("prompt_eval", "prompt", fill(EVALUATION_PROMPT, note=NOTE)),
]:
    oracle(name, f"SELECT note_id, {expression} AS {column} FROM v_noisy_notes", NOISY)
oracle(
    "expand_abbreviations",
    f"SELECT note_id, {expand(NOTE)} AS expanded FROM v_noisy_notes, abbreviations",
    NOISY,
    _abbreviations,
)
oracle(
    "clean_note",
    f"SELECT note_id, {clean(NOTE)} AS cleaned FROM v_noisy_notes, abbreviations",
    NOISY,
    _abbreviations,
)
oracle(
    "clean_documents",
    f"SELECT note_id, {clean(NOTE)} AS cleaned FROM v_notes, abbreviations",
    view_sql("v_notes"),
    _abbreviations,
)
_redacted = NOTE
for _pattern in SECRET_PATTERNS:
    _redacted = f"regexp_replace({_redacted}, {lit(_pattern)}, {lit(chr(92) + '1' + REDACTED)}, 'gi')"
oracle(
    "redact_secrets",
    f"SELECT note_id, {_redacted} AS redacted FROM v_notes",
    view_sql("v_notes"),
)
oracle(
    "sft_text",
    f"SELECT note_id, {fill(TRAINING_TEXT, input='input', output='output')} AS text FROM strict",
    STRICT,
)
oracle(
    "chat_messages",
    f"""SELECT note_id, 0 AS position, 'system' AS role, {lit(SYSTEM_PROMPT)} AS content
        FROM v_noisy_notes
        UNION ALL SELECT note_id, 1, 'user', {fill(CHAT_USER_PROMPT, note=NOTE)}
        FROM v_noisy_notes""",
    NOISY,
)
_checked = """checked AS (SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn,
        bool_and((role = 'user') = (place % 2 = 0)) AS valid
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place
              FROM conversations)
        GROUP BY conv_id)"""
oracle("conversation_checks", "SELECT * FROM checked", _checked)
oracle(
    "chat_render",
    f"""SELECT conv_id, turn, valid,
        '<start_of_turn>' || CASE role WHEN 'assistant' THEN 'model' ELSE role END
            || chr(10) || {strip('text')} || '<end_of_turn>' || chr(10) AS rendered
        FROM conversations JOIN checked USING (conv_id)""",
    _checked,
)

# --- contracts ----------------------------------------------------------------

for name, source in [("note_contract", "v_noisy_notes"), ("document_contract", "v_notes")]:
    oracle(
        name,
        f"""SELECT note_id, length(rep_note) AS n_chars,
            coalesce(length(rep_note) BETWEEN 1 AND 1000, false) AS within_length,
            {blank(NOTE)} AS blank,
            {status(NOTE)} AS status
            FROM {source}""",
        view_sql(source),
    )
oracle(
    "batch_contract",
    f"""SELECT batch_id, n_notes,
        CASE WHEN n_notes <= 50 THEN idx END AS first_bad_index,
        CASE WHEN n_notes > 50 THEN 'too_many_notes' ELSE why END AS reason,
        n_notes <= 50 AND idx IS NULL AS accepted
        FROM (SELECT batch_id, count(*) AS n_notes, min(idx) FILTER (why IS NOT NULL) AS idx,
                     arg_min(why, idx) FILTER (why IS NOT NULL) AS why
              FROM (SELECT *, CASE WHEN length(rep_note) > 1000 THEN 'too_long'
                               WHEN {blank(NOTE)} THEN 'blank' END AS why FROM v_batches)
              GROUP BY batch_id)""",
    view_sql("v_batches"),
)
oracle(
    "batch_totals",
    """SELECT batch_id, count(*) AS total_notes,
        round(sum(length(rep_note)::DOUBLE / 1000), 6) AS total_latency_seconds
        FROM v_batches GROUP BY batch_id""",
    view_sql("v_batches"),
)

# --- labels from model output -------------------------------------------------

_stages = ["text0 AS (SELECT *, rtrim(" + strip("lower(raw_output)") + ", '.!?' || chr(10)) AS t FROM v_raw_outputs)"]
for _i, _prefix in enumerate(OUTPUT_PREFIXES):
    _stages.append(
        f"text{_i + 1} AS (SELECT * REPLACE (CASE WHEN starts_with(t, {lit(_prefix)}) THEN "
        + strip(f"t[{len(_prefix) + 1}:]")
        + f" ELSE t END AS t) FROM text{_i})"
    )


def score(category: str) -> str:
    words = "list_distinct(string_split_regex(t, '\\s+'))"
    keywords = "[" + ", ".join(map(lit, CATEGORY_KEYWORDS[category])) + "]"
    return f"len(list_intersect({words}, {keywords}))"


def contained(text: str, spaced: bool = False) -> str:
    whens = " ".join(
        f"WHEN contains({text}, {lit(c.replace('_', ' ') if spaced else c)}) THEN {lit(c)}"
        for c in CATEGORIES
    )
    return f"CASE {whens} END"


_all = in_list(CATEGORIES)
_best = f"greatest({', '.join(CATEGORIES)})"
_keyword = (
    f"CASE WHEN {_best} = 0 THEN NULL "
    + " ".join(f"WHEN {c} = {_best} THEN {lit(c)}" for c in CATEGORIES)
    + " END"
)
PARSED = (
    view_sql("v_raw_outputs")
    + ", "
    + ", ".join(_stages)
    + f""", scored AS (SELECT *, {', '.join(f'{score(c)} AS {c}' for c in CATEGORIES)}
        FROM text{len(OUTPUT_PREFIXES)}),
    found AS (SELECT *, CASE WHEN t IN {_all} THEN t END AS exact,
        {contained('t')} AS substring, {contained('t', True)} AS spaced,
        {_keyword} AS keyword FROM scored),
    parsed AS (SELECT *, coalesce(exact, substring, spaced, keyword, {lit(CATEGORIES[0])})
            AS category,
        CAST(CASE WHEN exact IS NOT NULL THEN 0.97 WHEN substring IS NOT NULL THEN 0.80
             WHEN spaced IS NOT NULL THEN 0.90 WHEN keyword IS NOT NULL THEN 0.65
             ELSE 0.30 END AS DOUBLE) AS confidence,
        CASE WHEN exact IS NOT NULL THEN 'exact' WHEN substring IS NOT NULL THEN 'substring'
             WHEN spaced IS NOT NULL THEN 'spaced' WHEN keyword IS NOT NULL THEN 'keyword'
             ELSE 'fallback' END AS match_tier FROM found)"""
)
oracle("clean_output", "SELECT note_id, t AS cleaned FROM parsed", PARSED)
oracle(
    "extract_category",
    "SELECT note_id, coalesce(exact, substring, keyword) AS category FROM parsed",
    PARSED,
)
oracle(
    "keyword_score",
    f"""SELECT note_id, {', '.join(f'{c}::BIGINT AS {c}' for c in CATEGORIES)},
        keyword AS category FROM parsed""",
    PARSED,
)
oracle(
    "parse_category", "SELECT note_id, category, confidence, match_tier FROM parsed", PARSED
)
oracle(
    "prediction_contract",
    """SELECT note_id, coalesce(exact, substring, keyword) AS issue_category,
        latency_seconds AS confidence, method,
        latency_seconds BETWEEN 0 AND 1 AS in_range,
        latency_seconds BETWEEN 0 AND 1
            AND coalesce(exact, substring, keyword) IS NOT NULL AS valid
        FROM parsed""",
    PARSED,
)
EVAL = (
    view_sql("v_raw_outputs")
    + f""", words AS (SELECT *, rtrim(string_split_regex(lower({strip('raw_output')}), '\\s+')[1],
            '.!?,;:') AS w FROM v_raw_outputs),
    evaluated AS (SELECT *, coalesce(CASE WHEN w IN {_all} THEN w END, {contained('w')}, w)
        AS label FROM words)"""
)
oracle("eval_label", "SELECT note_id, label FROM evaluated", EVAL)
oracle(
    "eval_predictions",
    """SELECT note_id, substr(rep_note, 1, 100) AS note, true_category AS "true",
        label AS predicted, true_category = label AS correct
        FROM evaluated LEFT JOIN v_notes USING (note_id)""",
    view_sql("v_notes"),
    EVAL,
)

# --- evaluation ---------------------------------------------------------------

REPORT = (
    PARSED
    + f""", labels AS (SELECT unnest([{', '.join(map(lit, CATEGORIES))}]) AS label),
    counts AS (SELECT label,
            count(*) FILTER (true_category = label AND category = label) AS tp,
            count(*) FILTER (category = label) AS chosen,
            count(*) FILTER (true_category = label) AS support
        FROM labels CROSS JOIN parsed GROUP BY label),
    report AS (SELECT label, support,
            CASE WHEN chosen = 0 THEN 0 ELSE tp / chosen END AS "precision",
            CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
            CASE WHEN chosen + support = 0 THEN 0 ELSE 2 * tp / (chosen + support) END AS f1
        FROM counts)"""
)
_measures = ["precision", "recall", "f1"]
oracle(
    "accuracy",
    """SELECT count(*) FILTER (true_category = category) / count(*) AS accuracy,
        count(*) FILTER (true_category = category) AS correct, count(*) AS total
        FROM parsed""",
    PARSED,
)
oracle(
    "confusion_matrix",
    """SELECT t.label AS "true", p.label AS predicted, count(note_id) AS n
        FROM labels t CROSS JOIN labels p LEFT JOIN parsed
            ON true_category = t.label AND category = p.label
        GROUP BY t.label, p.label""",
    REPORT,
)
OPEN = (
    EVAL
    + """, labels AS (SELECT DISTINCT unnest([true_category, label]) AS label FROM evaluated),
    counts AS (SELECT l.label,
            count(*) FILTER (true_category = l.label AND e.label = l.label) AS tp,
            count(*) FILTER (e.label = l.label) AS chosen,
            count(*) FILTER (true_category = l.label) AS support
        FROM labels l CROSS JOIN evaluated e GROUP BY l.label)"""
)
oracle(
    "confusion_matrix_open",
    """SELECT t.label AS "true", p.label AS predicted, count(note_id) AS n
        FROM labels t CROSS JOIN labels p LEFT JOIN evaluated e
            ON true_category = t.label AND e.label = p.label
        GROUP BY t.label, p.label""",
    OPEN,
)
oracle(
    "classification_report_open",
    """SELECT label, support,
            round(CASE WHEN chosen = 0 THEN 0 ELSE tp / chosen END, 6) AS "precision",
            round(CASE WHEN support = 0 THEN 0 ELSE tp / support END, 6) AS recall,
            round(CASE WHEN chosen + support = 0 THEN 0 ELSE 2 * tp / (chosen + support) END, 6) AS f1
        FROM counts""",
    OPEN,
)
oracle(
    "classification_report",
    f"""SELECT label, support,
        {', '.join(f'round("{m}", 6) AS "{m}"' for m in _measures)} FROM report""",
    REPORT,
)
AVERAGES = (
    "averages AS (SELECT 'macro' AS average, "
    + ", ".join(f'avg("{m}") AS "{m}"' for m in _measures)
    + ", sum(support)::BIGINT AS support FROM report UNION ALL SELECT 'weighted', "
    + ", ".join(f'sum("{m}" * support) / sum(support)' for m in _measures)
    + ", sum(support)::BIGINT FROM report)"
)
oracle(
    "weighted_metrics",
    f"""SELECT average, support,
        {', '.join(f'round("{m}", 6) AS "{m}"' for m in _measures)} FROM averages""",
    REPORT,
    AVERAGES,
)
_width = max(len(c) for c in CATEGORIES)
_cells = " || ".join(f"""' ' || lpad(printf('%.2f', "{m}"), 9, ' ')""" for m in _measures)
_heads = "".join(" " + h.rjust(9) for h in ("precision", "recall", "f1-score", "support"))
oracle(
    "metrics_report",
    f"""SELECT CAST(row_number() OVER (ORDER BY label) + 1 AS INTEGER) AS line_no,
            lpad(label, {_width}, ' ') || ' ' || {_cells} || ' '
            || lpad(support::VARCHAR, 9, ' ') AS line FROM report
        UNION ALL SELECT CASE average WHEN 'macro' THEN 9 ELSE 10 END,
            lpad(average || ' avg', {_width}, ' ') || ' ' || {_cells} || ' '
            || lpad(support::VARCHAR, 9, ' ') FROM averages
        UNION ALL SELECT 8, lpad('accuracy', {_width}, ' ') || ' ' || repeat(' ', 21)
            || lpad(printf('%.2f', count(*) FILTER (true_category = category) / count(*)), 9, ' ')
            || ' ' || lpad(count(*)::VARCHAR, 9, ' ') FROM parsed
        UNION ALL SELECT 0, repeat(' ', {_width + 1}) || {lit(_heads)}
        UNION ALL SELECT 1, '' UNION ALL SELECT 7, ''""",
    REPORT,
    AVERAGES,
)
oracle(
    "metrics_json",
    f"""SELECT label, support, {', '.join(f'round("{m}", 6) AS "{m}"' for m in _measures)},
        round((SELECT count(*) FILTER (true_category = category) / count(*) FROM parsed), 6) AS accuracy,
        {', '.join(f"""round((SELECT "{m}" FROM averages WHERE average = 'weighted'), 6) AS {m}_weighted""" for m in _measures)},
        (SELECT array_to_string(list(n ORDER BY p), ',') FROM (
            SELECT p.label AS p, count(note_id) AS n FROM labels p LEFT JOIN parsed
                ON category = p.label AND true_category = report.label GROUP BY p.label)) AS counts
        FROM report""",
    REPORT,
    AVERAGES,
)
oracle(
    "method_comparison",
    """SELECT method, round(count(*) FILTER (true_category = category) / count(*), 6)
            AS accuracy,
        count(*) FILTER (true_category = category) AS correct, count(*) AS total,
        printf('%.3f', avg(latency_seconds))::DOUBLE AS avg_latency_seconds
        FROM parsed GROUP BY method""",
    PARSED,
)
oracle(
    "unmatched_pairs",
    """SELECT count(*) FILTER (method = 'primary' AND raw_output = '') AS without_prediction,
        count(*) FILTER (method <> 'primary' AND raw_output <> '') AS without_truth
        FROM v_raw_outputs""",
    view_sql("v_raw_outputs"),
)
oracle(
    "cv_summary",
    """SELECT round(avg(f1_weighted), 6) AS cv_f1_mean,
        round(stddev_pop(f1_weighted), 6) AS cv_f1_std,
        avg(f1_weighted) > 0.99 AS leakage_risk
        FROM (SELECT fold, sum(f1 * support) / sum(support) AS f1_weighted
              FROM (SELECT fold, label, count(*) FILTER (true_category = label) AS support,
                      2 * count(*) FILTER (true_category = label AND category = label)
                        / (count(*) FILTER (true_category = label)
                           + count(*) FILTER (category = label)) AS f1
                    FROM (SELECT *, note_id % 5 AS fold FROM parsed) CROSS JOIN labels
                    WHERE true_category = label OR category = label
                    GROUP BY fold, label)
              GROUP BY fold)""",
    REPORT,
)

# --- scoring ------------------------------------------------------------------

TIERED = (
    PARSED
    + f""", tiers AS (SELECT *, CASE WHEN method = 'primary' AND raw_output <> ''
            THEN {lit(PRIMARY_METHOD)} WHEN note_id % 3 <> 0 THEN {lit(FALLBACK_METHOD)}
            END AS winner FROM parsed),
    tiered AS (SELECT note_id, winner AS method,
        CASE WHEN winner IS NOT NULL THEN category END AS issue_category,
        CASE WHEN winner IS NOT NULL THEN confidence END AS confidence,
        CASE WHEN winner IS NOT NULL THEN latency_seconds END AS latency_seconds,
        winner IS NOT NULL AS scored FROM tiers)"""
)
oracle("tiered_scoring", "SELECT * FROM tiered", TIERED)
_primary = fill(
    PRIMARY_REASONING,
    category="issue_category",
    latency="printf('%.2f', latency_seconds)",
    confidence="printf('%.0f', confidence * 100) || '%'",
)
_fallback = fill(
    FALLBACK_REASONING,
    category="issue_category",
    confidence="printf('%.1f', confidence * 100) || '%'",
)
oracle(
    "reasoning",
    f"""SELECT note_id, CASE WHEN method = {lit(PRIMARY_METHOD)}
            THEN printf('%.2f', latency_seconds)
            ELSE printf('%.4f', latency_seconds) END AS latency_text,
        CASE WHEN method = {lit(PRIMARY_METHOD)} THEN {_primary} ELSE {_fallback} END
            AS reasoning
        FROM tiered""",
    TIERED,
)
# Cleaned noisy notes take the place of raw outputs.
PREDICTED = (
    NOISY
    + ", "
    + _abbreviations
    + f""", v_raw_outputs AS (
        SELECT note_id, rep_note, {status(NOTE)} AS status, {clean(NOTE)} AS raw_output
        FROM v_noisy_notes, abbreviations)"""
    + PARSED[len(view_sql("v_raw_outputs")):]
)
# Whole documents as model output and as notes.
def on_documents(ctes: str) -> str:
    texts = view_sql("v_text_outputs").removeprefix("v_text_outputs AS ")
    return f"v_raw_outputs AS {texts}" + ctes[len(view_sql("v_raw_outputs")):]


for _name in ("clean_output", "extract_category", "keyword_score", "parse_category", "eval_label"):
    ORACLES[f"{_name}_documents"] = ORACLES[_name].replace(
        view_sql("v_raw_outputs"), on_documents(view_sql("v_raw_outputs"))
    )
_answer = ", ".join(
    f"CASE WHEN status = 'ok' THEN {value} END AS {name}"
    for name, value in [
        ("cleaned_note", "raw_output"),
        ("issue_category", "category"),
        ("confidence", "confidence"),
        ("method", "'keyword'"),
    ]
)
oracle(
    "predict_notes",
    f"SELECT note_id, rep_note AS input_note, status, {_answer} FROM parsed",
    PREDICTED,
)
oracle(
    "predict_documents",
    f"SELECT note_id, rep_note AS input_note, status, {_answer} FROM parsed",
    PREDICTED.replace(NOISY, NOISY[: NOISY.index("v_noisy_notes AS")] + "v_noisy_notes AS "
                      + view_sql("v_text_outputs").removeprefix("v_text_outputs AS "), 1),
)
oracle(
    "stream_predict",
    """SELECT log, rep_note AS input_note, category AS issue_category
        FROM parsed CROSS JOIN (VALUES ('csv'), ('jsonl')) AS logs(log)
        WHERE status = 'ok'""",
    PREDICTED,
)
oracle(
    "stream_rejects",
    """SELECT note_id, input_note, status FROM (
        SELECT note_id, rep_note AS input_note, """
    + status(NOTE)
    + """ AS status FROM v_noisy_notes) WHERE status <> 'ok'""",
    NOISY,
)
# The forest's answers are checked for being answers, the primary method's in full.
TIERED_ROWS = f"""SELECT note_id, status,
        CASE WHEN status = 'ok' AND given THEN {lit(PRIMARY_METHOD)}
             WHEN status = 'ok' THEN {lit(FALLBACK_METHOD)} END AS method,
        CASE WHEN status = 'ok' AND given THEN category END AS primary_category,
        status = 'ok' AS answered
        FROM (SELECT n.note_id, {status("n.rep_note")} AS status, category,
                  coalesce(method = 'primary' AND raw_output <> '', false) AS given
              FROM v_notes AS n LEFT JOIN parsed ON parsed.note_id = n.note_id)"""
oracle("predict_tiered", TIERED_ROWS, view_sql("v_notes"), PARSED)
oracle(
    "stream_predict_tiered",
    f"SELECT *, 1::BIGINT AS model_version, status = 'ok' AS logged FROM ({TIERED_ROWS})",
    view_sql("v_notes"),
    PARSED,
)
oracle(
    "rf_train_score",
    """SELECT note_id, output AS "true", true AS known, true AS in_range
        FROM prepared WHERE split = 'test'""",
    SPLIT,
)
oracle(
    "model_roundtrip",
    """SELECT note_id, output AS "true", true AS same FROM prepared WHERE split = 'test'""",
    SPLIT,
)
# Languages can be told apart, so the forest has to be right.
BY_LANGUAGE = SPLIT.replace(
    VALID,
    f"""valid AS (SELECT doc_id AS note_id, {strip('text')} AS input, lang AS output
        FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)""",
    1,
)
oracle(
    "model_evaluation",
    """SELECT output AS label, count(*) AS support, true AS learned
        FROM prepared WHERE split = 'test' GROUP BY output""",
    BY_LANGUAGE,
)
oracle(
    "cv_train",
    """SELECT fold, count(*) AS n, true AS in_range, true AS flagged FROM (
        SELECT CAST(generate_series AS INTEGER) % 5 AS fold
        FROM generate_series(0, (SELECT count(*) - 1 FROM dedup))) GROUP BY fold""",
    DEDUP,
)

# --- features -----------------------------------------------------------------


def grams(source: str) -> str:
    return f"""tokenized AS (
        SELECT note_id, regexp_extract_all(strip_accents(lower(input)), '[\\p{{L}}\\p{{N}}_]{{2,}}')
            AS words FROM {source}),
    grams AS (
        SELECT note_id, list_concat(words,
            [words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) AS grams
        FROM tokenized)"""


def fitted(where: str) -> str:
    return f"""occurrences AS (SELECT note_id, unnest(grams) AS term FROM grams),
    terms AS (SELECT note_id, term, count(*) AS tf FROM occurrences GROUP BY note_id, term),
    frequencies AS (
        SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM terms {where} GROUP BY term),
    size AS (SELECT count(*) AS n FROM grams {where}),
    top AS (
        SELECT term, df, cf, n FROM frequencies, size
        WHERE df >= 2 AND df <= CAST(0.95 AS DOUBLE) * n ORDER BY cf DESC, term LIMIT 5000),
    vocabulary AS (
        SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, df, cf,
            ln((n + 1) / (df + 1)) + 1 AS idf FROM top),
    raw_weights AS (
        SELECT note_id, term_id, (1 + ln(tf)) * idf AS w
        FROM terms JOIN vocabulary USING (term)),
    norms AS (SELECT note_id, sqrt(sum(w * w)) AS norm FROM raw_weights GROUP BY note_id),
    weights AS (
        SELECT note_id, term_id, round(w / norm, 6) AS weight
        FROM raw_weights JOIN norms USING (note_id))"""


oracle(
    "ngrams",
    "SELECT note_id, array_to_string(grams, '|') AS grams FROM grams",
    VALID,
    grams("valid"),
)
oracle(
    "tfidf_vocab",
    "SELECT term_id, term, df, cf, round(idf, 6) AS idf FROM vocabulary",
    VALID,
    grams("valid"),
    fitted(""),
)
oracle("tfidf", "SELECT * FROM weights", VALID, grams("valid"), fitted(""))
_train = "WHERE note_id IN (SELECT note_id FROM prepared WHERE split = 'train')"
oracle(
    "tfidf_transform",
    """SELECT note_id, term_id, weight FROM prepared LEFT JOIN weights USING (note_id)
        WHERE split = 'test'""",
    SPLIT,
    grams("prepared"),
    fitted(_train),
)
# The vocabulary of all notes outside each fold, fitted on those notes.
oracle(
    "cv_vocabularies",
    """SELECT fold, row_number() OVER (PARTITION BY fold ORDER BY term) - 1 AS term_id, term, df, cf,
        round(ln((n + 1) / (df + 1)) + 1, 6) AS idf
        FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY cf DESC, term) AS place
              FROM outside WHERE df >= 2 AND df <= CAST(0.95 AS DOUBLE) * n)
        WHERE place <= 5000""",
    DEDUP,
    folds("dedup"),
    grams("folded"),
    """occurrences AS (SELECT note_id, unnest(grams) AS term FROM grams),
    terms AS (SELECT note_id, term, count(*) AS tf FROM occurrences GROUP BY note_id, term),
    left_out AS (SELECT DISTINCT fold AS out FROM folded),
    outside_size AS (SELECT out, count(*) AS n FROM folded JOIN left_out ON fold <> out GROUP BY out),
    outside AS (
        SELECT s.out AS fold, term, count(*) AS df, sum(tf)::BIGINT AS cf, any_value(n) AS n
        FROM terms JOIN folded USING (note_id) JOIN outside_size AS s ON fold <> s.out
        GROUP BY s.out, term)""",
)
oracle(
    "label_encode",
    """SELECT note_id, output, dense_rank() OVER (ORDER BY output) - 1 AS label,
        output AS decoded FROM valid""",
    VALID,
)

# --- log reports and streams --------------------------------------------------

for name in ("log_category_counts", "stream_counts"):
    oracle(
        name,
        """SELECT coalesce(issue_category, 'unknown') AS issue_category, count(*) AS n
            FROM v_log GROUP BY 1""",
        view_sql("v_log"),
    )
oracle(
    "recent_history",
    f"""SELECT id, {ISO} AS timestamp, input_note, issue_category
        FROM v_log ORDER BY ts DESC, id DESC LIMIT 25""",
    view_sql("v_log"),
)
oracle(
    "log_recent",
    f"SELECT {ISO} AS timestamp FROM v_log ORDER BY ts DESC LIMIT 25",
    view_sql("v_log"),
)
oracle(
    "recent_predictions",
    f"""SELECT {ISO} AS timestamp, issue_category
        FROM v_log ORDER BY ts DESC, id DESC LIMIT 10""",
    view_sql("v_log"),
)
