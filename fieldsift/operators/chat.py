"""Few-shot prompt blocks and chat rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import (
    CATEGORIES,
    CATEGORY_DEFINITIONS,
    FEWSHOT_EXAMPLES_HEADING,
    FEWSHOT_INTRO,
    FEWSHOT_RULES,
    FEWSHOT_SEPARATOR,
    TURN_END,
    TURN_START,
)
from ..functions.labels import title_from_code
from ..functions.prompts import chat_messages
from ..functions.text import py_strip

# Turn numbers whose roles are checked together.
TURNS_PER_CHECK = 1000


def category_definitions(
    df: DataFrame,
    categories: list[str] = CATEGORIES,
    definitions: dict[str, str] = CATEGORY_DEFINITIONS,
) -> DataFrame:
    """One row per category: (position, category, display_name, definition).

    ``df`` only lends its session.
    """
    rows = [(i, c, definitions.get(c, "")) for i, c in enumerate(categories)]
    return df.sparkSession.createDataFrame(
        rows, "position int, category string, definition string"
    ).withColumn("display_name", title_from_code(F.col("category")))


def fewshot_blocks(examples: DataFrame, stratum: str = "output") -> DataFrame:
    """Example lines per category: (output, n_examples, block).

    ``examples`` comes from a few-shot pick, so a category has a handful of rows.
    """
    entry = F.concat(
        F.lit('Input: "'), F.col("input"), F.lit('"\nOutput: '), F.col(stratum),
        F.lit("\n" + FEWSHOT_SEPARATOR),
    )
    entries = F.array_sort(F.collect_list(F.struct("position", entry.alias("entry"))))
    return examples.groupBy(stratum).agg(
        F.count("*").alias("n_examples"),
        F.array_join(F.transform(entries, lambda e: e["entry"]), "\n").alias("block"),
    )


def fewshot_prompt(
    examples: DataFrame,
    stratum: str = "output",
    categories: list[str] = CATEGORIES,
    definitions: dict[str, str] = CATEGORY_DEFINITIONS,
) -> DataFrame:
    """One row with the system prompt: definitions, examples, rules."""
    blocks = fewshot_blocks(examples, stratum)
    by_category = F.map_from_entries(F.collect_list(F.struct(stratum, "block")))
    lines: list[Column] = [F.lit(FEWSHOT_INTRO)]
    for category in categories:
        title = title_from_code(F.lit(category))
        lines.append(
            F.concat(
                F.lit(f"{category} — "), title, F.lit(": " + definitions.get(category, ""))
            )
        )
    lines += [F.lit(FEWSHOT_EXAMPLES_HEADING), F.lit(FEWSHOT_SEPARATOR)]
    lines += [F.col("blocks")[category] for category in categories]
    lines.append(F.lit(FEWSHOT_RULES))
    # concat_ws leaves out a category without examples.
    return blocks.agg(by_category.alias("blocks")).select(
        F.concat_ws("\n", *lines).alias("system_prompt")
    )


def message_rows(df: DataFrame, note: Column) -> DataFrame:
    """Chat messages of each note as rows: (note_id, position, role, content)."""
    return df.select("note_id", F.posexplode(chat_messages(note))).select(
        "note_id", F.col("pos").alias("position"), "col.role", "col.content"
    )


def conversation_checks(
    turns: DataFrame, turns_per_check: int = TURNS_PER_CHECK
) -> DataFrame:
    """(conv_id, n_turns, last_turn, valid), one row per conversation.

    ``valid`` is false for a conversation that starts with a system role or does
    not alternate, beginning with the user. A turn is a user turn where its place
    is even. Roles are checked in stretches of ``turns_per_check`` turn numbers;
    whether one starts at an even place follows from the sizes of the earlier
    ones, so no conversation is gathered in one row.
    """
    stretch = F.floor(F.col("turn") / turns_per_check).alias("stretch")
    roles = F.array_sort(F.collect_list(F.struct("turn", "role")))
    parts = turns.groupBy("conv_id", stretch).agg(
        F.count("*").alias("n"), F.max("turn").alias("last"), roles.alias("roles")
    )

    def users_at(parity: int) -> Column:
        return F.forall(
            F.transform(
                "roles", lambda t, i: (t["role"] == "user") == (i % 2 == parity)
            ),
            lambda fits: F.coalesce(fits, F.lit(False)),
        )

    in_order = Window.partitionBy("conv_id").orderBy("stretch")
    before = F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        parts.select(
            "conv_id", "stretch", "n", "last",
            users_at(0).alias("fits_even"),
            users_at(1).alias("fits_odd"),
        )
        .withColumn("before", F.coalesce(before, F.lit(0)))
        .groupBy("conv_id")
        .agg(
            F.sum("n").alias("n_turns"),
            F.max("last").alias("last_turn"),
            F.bool_and(
                F.when(F.col("before") % 2 == 0, F.col("fits_even")).otherwise(
                    F.col("fits_odd")
                )
            ).alias("valid"),
        )
    )


def render_turns(turns: DataFrame) -> DataFrame:
    """Turns with their chat markup as ``rendered``, each within its row.

    The pieces of a conversation in turn order make up its text.
    """
    name = F.when(F.col("role") == "assistant", "model").otherwise(F.col("role"))
    return turns.withColumn(
        "rendered",
        F.concat(
            F.lit(TURN_START), name, F.lit("\n"), py_strip(F.col("text")), F.lit(TURN_END)
        ),
    )


def render_conversations(
    turns: DataFrame,
    generation_prompt: bool = False,
    turns_per_check: int = TURNS_PER_CHECK,
) -> DataFrame:
    """Conversations in chat markup, a row per turn: (conv_id, turn, valid, rendered).

    Expects (conv_id, turn, role, text) with unique turn numbers. ``valid`` is
    that of :func:`conversation_checks`; with ``generation_prompt`` the last
    piece of a conversation opens the model's turn.
    """
    checks = conversation_checks(turns, turns_per_check)
    tail = F.when(
        F.lit(generation_prompt) & (F.col("turn") == F.col("last_turn")),
        TURN_START + "model\n",
    ).otherwise("")
    return (
        render_turns(turns)
        .join(checks, "conv_id")
        .select("conv_id", "turn", "valid", F.concat("rendered", tail).alias("rendered"))
    )
