import pytest

from fieldsift.fixed_values import CATEGORIES
from fieldsift.operators import chat as C

TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture
def turns(spark):
    rows = []
    for turn in range(25):
        rows.append((1, turn * 3, "user" if turn % 2 == 0 else "assistant", f" t{turn}\n"))
    rows += [(2, 0, "system", "s"), (2, 1, "user", "u")]
    rows += [(3, 0, "user", "u"), (3, 1, "user", "u")]
    rows += [(4, 0, "user", "u"), (4, 1, "tool", "x")]
    rows += [(5, i, "user" if (i % 2 == 0) != (i >= 17) else "assistant", "t") for i in range(20)]
    return spark.createDataFrame(rows, TURNS).repartition(5)


@pytest.mark.parametrize("per_check", [1000, 10, 4, 1])
def test_render(turns, per_check):
    texts, verdicts = {}, {}
    rendered = C.render_conversations(turns, turns_per_check=per_check)
    for r in rendered.orderBy("conv_id", "turn").collect():
        texts[r.conv_id] = texts.get(r.conv_id, "") + r.rendered
        verdicts.setdefault(r.conv_id, set()).add(r.valid)
    assert verdicts == {1: {True}, 2: {False}, 3: {False}, 4: {True}, 5: {False}}
    assert texts[1] == "".join(
        f"<start_of_turn>{'user' if t % 2 == 0 else 'model'}\nt{t}<end_of_turn>\n" for t in range(25)
    )
    assert texts[4] == (
        "<start_of_turn>user\nu<end_of_turn>\n<start_of_turn>tool\nx<end_of_turn>\n"
    )


def test_one_row_per_turn_whatever_the_turn_numbers(spark):
    rows = [(1, 0, "user", "a"), (1, 5000, "assistant", "b"), (1, 9000, "user", "c"), (2, 0, None, "d")]
    turns = spark.createDataFrame(rows, TURNS)
    assert C.render_conversations(turns).count() == 4
    found = {r.conv_id: r for r in C.conversation_checks(turns).collect()}
    assert (found[1].n_turns, found[1].last_turn, found[1].valid) == (3, 9000, True)
    assert found[2].valid is False


def test_generation_prompt_comes_last(turns):
    found = C.render_conversations(turns.where("conv_id = 1"), True, 10)
    pieces = [r.rendered for r in found.orderBy("turn").collect()]
    assert [p.endswith("<start_of_turn>model\n") for p in pieces] == [False] * (len(pieces) - 1) + [True]


def test_fewshot_prompt(spark):
    examples = spark.createDataFrame(
        [("demand_spike", 2, 9, "b"), ("demand_spike", 1, 8, "a"), ("supply_chain_delay", 1, 7, "c")],
        "output string, position int, note_id long, input string",
    )
    blocks = {r.output: r for r in C.fewshot_blocks(examples).collect()}
    assert blocks["demand_spike"].block == (
        'Input: "a"\nOutput: demand_spike\n---\nInput: "b"\nOutput: demand_spike\n---'
    )
    prompt = C.fewshot_prompt(examples).first().system_prompt
    assert prompt.count("Input: ") == 3
    assert prompt.index('"c"') < prompt.index('"a"') < prompt.index('"b"')
    assert "\n---\nInput" in prompt and "None" not in prompt
    for category in CATEGORIES:
        assert f"\n{category} — " in prompt


def test_definitions(spark):
    rows = C.category_definitions(spark.range(1)).collect()
    assert [r.category for r in rows] == CATEGORIES
    assert rows[0].display_name == "Supply Chain Delay"
