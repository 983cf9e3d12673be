"""Prompt and message text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import (
    CHAT_USER_PROMPT,
    EVALUATION_PROMPT,
    FALLBACK_REASONING,
    PRIMARY_METHOD,
    PRIMARY_REASONING,
    SHORT_PROMPT,
    SYSTEM_PROMPT,
    TRAINING_TEXT,
    ZERO_SHOT_PROMPT,
)
from .numbers import fixed_point, percent


def fill(template: str, **values: Column) -> Column:
    """``template`` with each ``{name}`` replaced by a column.

    The rest of the text stays literal, so ``%`` and ``$`` in notes are safe.
    """
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(
        *[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p]
    )


def zero_shot_prompt(note: Column) -> Column:
    """Classification prompt that lists the categories."""
    return fill(ZERO_SHOT_PROMPT, note=note)


def short_prompt(note: Column) -> Column:
    """Classification prompt for a model that knows the categories."""
    return fill(SHORT_PROMPT, note=note)


def training_text(note: Column, category: Column) -> Column:
    """Instruction text of one labelled note."""
    return fill(TRAINING_TEXT, input=note, output=category)


def evaluation_prompt(note: Column) -> Column:
    """Instruction prompt whose response is left open."""
    return fill(EVALUATION_PROMPT, note=note)


def chat_messages(note: Column) -> Column:
    """System and user message as an array of (role, content)."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(
        message("system", F.lit(SYSTEM_PROMPT)),
        message("user", fill(CHAT_USER_PROMPT, note=note)),
    )


def latency_text(method: Column, latency: Column) -> Column:
    """Latency with 2 decimals for the primary method, else 4."""
    return F.when(method == PRIMARY_METHOD, fixed_point(latency, 2)).otherwise(
        fixed_point(latency, 4)
    )


def reasoning(
    method: Column, category: Column, confidence: Column, latency: Column
) -> Column:
    """Sentence that explains a prediction."""
    return F.when(
        method == PRIMARY_METHOD,
        fill(
            PRIMARY_REASONING,
            category=category,
            latency=fixed_point(latency, 2),
            confidence=percent(confidence, 0),
        ),
    ).otherwise(
        fill(
            FALLBACK_REASONING,
            category=category,
            confidence=percent(confidence, 1),
        )
    )
