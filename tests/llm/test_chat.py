import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, queries


def given(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", *([f"1 AS {extra}"] if extra else []))


def formatted(df):
    out = chat.format_conversations(df).withColumn("back", chat.read_back(F.col("formatted")))
    out = out.withColumn("trained", chat.loss_text(F.col("segments")))
    return {r.conv_id: r for r in out.collect()}


def test_texts_come_back_whatever_they_hold(spark):
    random.seed(5)
    parts = ["\\", "#", "##", "###", "### User: ", "</turn>", "</turn>\n", "<", "/turn>", "a",
             "\n", ": ", "\\n", "é", ""]
    rows = []
    for conv in range(60):
        for turn in range(random.randint(1, 6)):
            role = random.choice(["system", "user", "assistant", "tool: ###", "?", ""])
            rows.append((conv, turn, role, "".join(random.choices(parts, k=8))))
    for conv, row in formatted(given(spark, rows)).items():
        wanted = [(role, text) for c, _, role, text in rows if c == conv]
        assert [(t.role, t.text) for t in row.back] == wanted
        assert row.trained == "".join(text for role, text in wanted if role == "assistant")
        assert "".join(s.text for s in row.segments) == row.formatted


def machine(roles):
    """Brute force: the number of the first turn out of order, and whether the end is one."""
    table = {"start": {"system": 1, "user": 2}, 1: {"user": 2}, 2: {"assistant": 3}, 3: {"user": 2}}
    state = "start"
    for n, role in enumerate(roles):
        if role not in table[state]:
            return n, False
        state = table[state][role]
    return None, state == 3


def test_turn_order(spark):
    random.seed(6)
    cases = {c: random.choices(["system", "user", "assistant"], [1, 3, 3], k=random.randint(1, 5))
             for c in range(80)}
    rows = [(c, n, role, "t") for c, roles in cases.items() for n, role in enumerate(roles)]
    for conv, row in formatted(given(spark, rows)).items():
        assert (row.failed_turn, row.valid) == machine(cases[conv])


def test_edges(spark):
    rows = [(1, None, "user", None), (1, 0, "assistant", "b" * 300_000), (2, 0, None, "x"),
            (3, 1, "user", "same"), (3, 1, "user", "same"), (None, 0, "user", "q")]
    out = formatted(given(spark, rows, "segments"))
    assert out[1].valid and out[1].trained == "b" * 300_000
    assert [(t.role, t.text) for t in out[2].back] == [("", "x")] and not out[2].valid
    assert out[3].n_turns == 2 and out[3].failed_turn == 1
    assert out[None].n_turns == 1
    assert formatted(given(spark, [])) == {}


def test_markers_stand_only_where_turns_do(spark):
    out = formatted(given(spark, [(1, 0, "user", queries.TRICKY)]))[1]
    assert out.formatted.count("###") == out.formatted.count("</turn>") == 1


def test_query_digests(spark, folder):
    row = queries.op1_chat_format(spark, folder).filter("conv_id = -7").first()
    text = queries.TRICKY
    turns = f"user\n{text}\nassistant\n{text}\n"
    assert row.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert (row.n_turns, row.loss_chars) == (2, len(text))


@pytest.mark.parametrize("name", ["op1_chat_format", "op4_mix_sources"])
def test_native(spark, folder, name):
    plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
