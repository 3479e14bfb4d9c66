"""A conversation is one row however many turns it has, and comes in parts by the size of its rendering only."""

import random

from waymark.llm import chat

R = random.Random(4)
TURNS = "conv_id long, turn long, role string, text string"


def test_long_conversations_are_one_row(spark, monkeypatch):
    rows = [(c, i, R.choice(["user", "assistant", None]), f"turn {i}") for c, n in ((1, 1500), (2, 3), (None, 700)) for i in range(n)]
    df = spark.createDataFrame(rows, TURNS)
    got = {r.conv_id: r for r in chat.render_chats(df).collect()}
    assert {c: (r.part, r.n_turns) for c, r in got.items()} == {1: (0, 1500), 2: (0, 3), None: (0, 700)}
    pieces = chat.format_chats(df).orderBy("place").collect()
    assert all(got[c].text == "".join(r.piece for r in pieces if r.conv_id == c) for c in got)
    assert got[1].n_kept == sum(r.action == "keep" for r in pieces if r.conv_id == 1) and got[1].n_inserted == sum(r.n_inserted for r in pieces if r.conv_id == 1)


def test_parts_by_size(spark):
    df = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", "x" * 100) for i in range(2048)] + [(2, 0, "user", "short")], TURNS)
    whole = {r.conv_id: r.text for r in chat.render_chats(df).collect()}
    parts = sorted(chat.render_chats(df, row=100_000).where("conv_id = 1").collect(), key=lambda r: r.part)
    assert len(parts) > 1 and "".join(p.text for p in parts) == whole[1] and sum(p.n_turns for p in parts) == 2048
    assert chat.render_chats(df.limit(0)).collect() == []
