"""From raw labelled notes to a train and test set."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..fixed_values import CATEGORY_MAP, SEED, TEST_SIZE
from ..operators.dataset import dedup_first, require_records, strict_notes, valid_notes
from ..operators.sampling import stratified_split
from ..session import stage


def prepare_dataset(
    raw: DataFrame,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    dedup: bool = True,
    strict: bool = False,
    mapping: dict[str, str] = CATEGORY_MAP,
) -> DataFrame:
    """(note_id, input, output, split), staged.

    ``strict`` takes labels to the letter; ``dedup`` keeps the first of equal
    notes, so that none is in both sets.
    """
    notes = strict_notes(raw, mapping) if strict else valid_notes(raw, mapping)
    if dedup:
        notes = dedup_first(notes)
    # The split looks at the notes twice; clean and dedup them once.
    notes = require_records(stage(notes, "notes"))
    return stratified_split(notes, test_size, seed)
