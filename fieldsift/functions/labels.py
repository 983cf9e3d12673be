"""Issue categories from raw labels and from raw model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import (
    CATEGORIES,
    CATEGORY_KEYWORDS,
    CATEGORY_MAP,
    DISPLAY_NAMES,
    EXACT_CONFIDENCE,
    FALLBACK_CONFIDENCE,
    KEYWORD_CONFIDENCE,
    OUTPUT_PREFIXES,
    SPACED_CONFIDENCE,
    SUBSTRING_CONFIDENCE,
)
from .text import (
    ASCII_SPACES,
    SPACE_CHARS,
    SPACE_CLASS,
    bind,
    is_ascii,
    lookup_table,
    py_strip,
)


def lookup(key: Column, values: dict[str, str]) -> Column:
    """``values[key]``, NULL where missing."""
    return lookup_table(values)[key]


def raw_label_key(label: Column) -> Column:
    """A raw label without outer whitespace, in upper case."""
    return F.upper(py_strip(label))


def map_category(label: Column, mapping: dict[str, str] = CATEGORY_MAP) -> Column:
    """Category of a raw label; an unknown label is only lower-cased."""
    return F.coalesce(lookup(raw_label_key(label), mapping), F.lower(label))


def display_name(category: Column, names: dict[str, str] = DISPLAY_NAMES) -> Column:
    """Display name from the table of names."""
    return lookup(category, names)


def title_from_code(category: Column) -> Column:
    """Display name from the code: words in title case."""
    return F.initcap(F.replace(category, F.lit("_"), F.lit(" ")))


def clean_output(raw: Column, prefixes: list[str] = OUTPUT_PREFIXES) -> Column:
    """Raw model output in lower case, without end marks and known lead-ins.

    Each lead-in is tried once, in list order; cutting one also cuts the
    whitespace around what is left.
    """
    lead_ins = "".join(rf"(?:\Q{p}\E[{SPACE_CLASS}]*)?" for p in prefixes)

    def without_lead_ins(text: Column) -> Column:
        return bind(
            F.regexp_replace(text, "^" + lead_ins, ""),
            lambda rest: F.when(
                F.length(rest) < F.length(text), F.rtrim(rest, F.lit(SPACE_CHARS))
            ).otherwise(rest),
        )

    return bind(
        F.rtrim(py_strip(F.lower(raw)), F.lit(".!?\n")), without_lead_ins
    )


def first_contained(
    text: Column,
    categories: list[str] = CATEGORIES,
    spaced: bool = False,
) -> Column:
    """The first category, in list order, whose code occurs in ``text``."""
    return F.coalesce(
        *[
            F.when(text.contains(c.replace("_", " ") if spaced else c), c)
            for c in categories
        ]
    )


def _distinct_words(text: Column, keep: list[str]) -> Column:
    def words(t: Column) -> Column:
        return F.when(is_ascii(t), F.split(t, f"[{ASCII_SPACES}]+")).otherwise(
            F.split(t, f"[{SPACE_CLASS}]+")
        )

    return F.array_distinct(F.filter(bind(text, words), lambda w: w.isin(*keep)))


def keyword_scores(
    text: Column, keywords: dict[str, list[str]] = CATEGORY_KEYWORDS
) -> Column:
    """Array of distinct keyword hits, one number per category in order."""
    every = sorted({w for words in keywords.values() for w in words})

    def count_in(hits: Column, words: list[str]) -> Column:
        return F.size(F.filter(hits, lambda w: w.isin(*words)))

    return bind(
        _distinct_words(text, every),
        lambda hits: F.array(*[count_in(hits, ws) for ws in keywords.values()]),
    )


def keyword_match(
    text: Column, keywords: dict[str, list[str]] = CATEGORY_KEYWORDS
) -> Column:
    """The category with most keyword hits; the earlier one on a tie, NULL on none."""
    names = F.array(*[F.lit(c) for c in keywords])
    return bind(
        keyword_scores(text, keywords),
        lambda scores: F.when(
            F.array_max(scores) > 0,
            F.get(names, (F.array_position(scores, F.array_max(scores)) - 1).cast("int")),
        ),
    )


def extract_category(
    raw: Column,
    categories: list[str] = CATEGORIES,
    keywords: dict[str, list[str]] = CATEGORY_KEYWORDS,
) -> Column:
    """Category by exact, then substring, then keyword match; else NULL."""
    return bind(
        clean_output(raw),
        lambda text: F.coalesce(
            F.when(text.isin(*categories), text),
            first_contained(text, categories),
            keyword_match(text, keywords),
        ),
    )


def parse_category(
    raw: Column,
    categories: list[str] = CATEGORIES,
    keywords: dict[str, list[str]] = CATEGORY_KEYWORDS,
) -> Column:
    """Struct of category, confidence and the tier that matched.

    The tiers are tried in the order exact, substring, spaced, keyword,
    fallback. NULL output counts as empty output.
    """

    def tier(found: Column, confidence: float, name: str) -> Column:
        return bind(
            found,
            lambda category: F.when(
                category.isNotNull(),
                F.struct(
                    category.alias("category"),
                    F.lit(confidence).alias("confidence"),
                    F.lit(name).alias("match_tier"),
                ),
            ),
        )

    def tiers(text: Column) -> Column:
        exact = F.when(text.isin(*categories), text)
        substring = first_contained(text, categories)
        spaced = first_contained(text, categories, spaced=True)
        keyword = keyword_match(text, keywords)
        return F.coalesce(
            tier(exact, EXACT_CONFIDENCE, "exact"),
            tier(substring, SUBSTRING_CONFIDENCE, "substring"),
            tier(spaced, SPACED_CONFIDENCE, "spaced"),
            tier(keyword, KEYWORD_CONFIDENCE, "keyword"),
            tier(F.lit(categories[0]), FALLBACK_CONFIDENCE, "fallback"),
        )

    return bind(clean_output(F.coalesce(raw, F.lit(""))), tiers)


def eval_label(raw: Column, categories: list[str] = CATEGORIES) -> Column:
    """Evaluation label: the first word of the output, or the category in it."""
    first_word = F.regexp_extract(
        F.lower(py_strip(F.coalesce(raw, F.lit("")))), f"^[^{SPACE_CLASS}]*", 0
    )
    return bind(
        F.rtrim(first_word, F.lit(".!?,;:")),
        lambda word: F.coalesce(
            F.when(word.isin(*categories), word),
            first_contained(word, categories),
            word,
        ),
    )
