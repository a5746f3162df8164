import pytest
from pyspark.sql import functions as F

from scriptloom.operators import chat
from scriptloom.plans.assistant import answer_pending
from scriptloom.schema import CHAT_SCHEMA

HISTORY = [
    (1, 1, "assistant", "hello"),
    (1, 0, "user", "hi there"),
    (1, 2, "user", "why "),
    (2, 0, "system", "be nice"),
    (3, 0, "user", "a\nb"),
    (3, 1, "assistant", ""),
]


@pytest.fixture
def history(spark):
    return spark.createDataFrame(HISTORY, CHAT_SCHEMA)


def assembled(rows):
    """The prompt format, written out the plain way."""
    parts = []
    for _, _, role, text in sorted(rows, key=lambda r: r[1]):
        who = "user" if role == "user" else "assistant"
        parts.append(f"<|im_start|>{who}\n{text}<|im_end|>")
    return "\n".join([*parts, "<|im_start|>assistant", ""])


def test_prompt_and_length(history):
    for row in chat.chat_prompt(history).collect():
        expected = assembled([h for h in HISTORY if h[0] == row.conv_id])
        assert row.prompt == expected
        assert row.n_units == len(expected.split())
        assert not row.refused


@pytest.mark.parametrize("budget", [1, 5, 6, 7, 8, 9, 10, 11, 100])
def test_budget_refuses_at_the_limit(history, budget):
    for row in chat.chat_prompt(history, budget).collect():
        length = len(assembled([h for h in HISTORY if h[0] == row.conv_id]).split())
        assert row.refused == (length >= budget)
        assert (row.prompt is None) == row.refused


def test_own_unit_counter(history):
    rows = chat.chat_budget(history, 3072, lambda c: F.length(c).cast("bigint")).collect()
    for row in rows:
        text = assembled([h for h in HISTORY if h[0] == row.conv_id])
        # Characters add up except for the line breaks between the pieces.
        assert row.n_units == len(text) - sum(h[0] == row.conv_id for h in HISTORY)


def test_one_conversation_with_most_of_the_history(spark):
    hot = spark.range(20_000).select(
        F.lit(0).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.lit("user").alias("role"),
        F.lit("again").alias("text"),
    )
    small = spark.range(100).select(
        (F.col("id") + 1).alias("conv_id"),
        F.lit(0).cast("bigint").alias("turn"),
        F.lit("user").alias("role"),
        F.lit("hi").alias("text"),
    )
    result = chat.chat_prompt(hot.unionByName(small))
    rows = {r.conv_id: r for r in result.collect()}
    assert len(rows) == 101
    assert rows[0].refused and rows[0].prompt is None and rows[0].n_turns == 20_000
    assert all(rows[i].prompt == assembled([(i, 0, "user", "hi")]) for i in range(1, 101))


def test_pending(history):
    assert sorted(map(tuple, chat.chat_pending(history).collect())) == [(1, 2), (2, 0)]


def test_append(spark, history):
    messages = spark.createDataFrame(
        [(1, "assistant", "because"), (9, "user", "first")], "conv_id long, role string, text string"
    )
    result = chat.chat_append(history, messages)
    assert result.schema.simpleString() == CHAT_SCHEMA.simpleString()
    assert sorted(map(tuple, result.collect())) == sorted(
        [*HISTORY, (1, 3, "assistant", "because"), (9, 0, "user", "first")]
    )


def test_seed(spark, history):
    ids = spark.createDataFrame([(1,), (7,), (7,), (8,)], "conv_id long")
    seeded = chat.chat_seed(history, ids)
    assert sorted(map(tuple, seeded.collect())) == [
        (7, 0, "assistant", chat.GREETING),
        (8, 0, "assistant", chat.GREETING),
    ]
    assert chat.chat_pending(seeded).count() == 0


def test_answer_pending(spark, history, tmp_path):
    def backend():
        def answer(prompts):
            if any("be nice" in p for p in prompts):
                raise ValueError("refuses")
            return [f"{len(p)} characters" for p in prompts]

        return answer

    result = answer_pending(history, backend, str(tmp_path / "ledger"))
    new = [r for r in map(tuple, result.history.collect()) if r not in HISTORY]
    length = len(assembled([h for h in HISTORY if h[0] == 1]))
    assert new == [(1, 3, "assistant", f"{length} characters")]
    assert [tuple(r) for r in result.failed.collect()] == [(2, "ValueError: refuses")]
    assert result.refused.count() == 0
    short = answer_pending(history, backend, str(tmp_path / "ledger"), budget=8)
    assert [r.conv_id for r in short.refused.collect()] == [1]


def test_null_texts_and_ids(spark):
    history = spark.createDataFrame(
        [(1, 0, "user", None), (2, 0, "user", "a"), (2, 1, "user", None), (None, 0, "user", "x")],
        "conv_id long, turn long, role string, text string",
    )
    assert {r.conv_id: (r.n_turns, r.refused) for r in chat.chat_budget(history).collect()} == {1: (1, False), 2: (2, False)}
    prompts = {r.conv_id: r.prompt for r in chat.chat_prompt(history).collect()}
    assert prompts[1].count(chat.START) == 2 and prompts[2].count(chat.START) == 3
    assert sorted(r.conv_id for r in chat.chat_pending(history).collect()) == [1, 2]


def test_conversations_of_very_many_messages(spark, monkeypatch):
    monkeypatch.setattr(chat, "_MANY_TURNS", 20)
    history = spark.range(300).selectExpr("if(id < 200, 7, id) conv_id", "id turn", "'user' role", "'a b' text")
    found = {r.conv_id: r.prompt for r in chat.chat_prompt(history, budget=50).collect()}
    assert found[7] is None and len(found) == 101
    assert sum(p is not None for p in found.values()) == 100
