import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loomgraph.llm import chat

FORM = chat.Formatter(chat.Template())
BITS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<", ">>", "\\", "\n", " ", "<<:>>", "<</ROLE>>", "[", "/", "é", "x", "<"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "", "tool", "<<:>>", "a\\"]), BITS), max_size=5))
def test_round_trip(turns):
    segments = FORM.segments(turns)
    text = "".join(s for s, _ in segments)
    assert [(r, t) for r, t, _ in FORM.parse(text)] == turns
    for s, _ in [x for x in segments[1::3]]:
        assert not any(c in s for c in chat.Template().controls())


def test_machine():
    assert FORM.check(["system", "user", "assistant"]) is None
    assert FORM.check(["user", "user"]) == "turn 1: user after user"
    assert FORM.check(["user"]) == "ends after user"
    assert FORM.check(["assistant"]).startswith("turn 0")
    assert FORM.check([]) == "ends after start"


def test_tables(spark):
    rows = [(1, 1, "assistant", "b", "z"), (1, 0, "user", "a", "z"), (2, 0, None, None, "z"), (None, 0, "user", "é" * 5000, "z"), (3, 0, "user", "t", "z"), (3, 0, "user", "t", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    assert got[1].loss_chars == 1 and got[1].valid and got[1].n_turns == 2
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"b").hexdigest()
    assert got[2].n_turns == 1 and not got[2].valid
    assert got[3].n_turns == 2 and got[None].n_turns == 1
    assert chat.digests(df.limit(0)).count() == 0
    full = chat.format_conversations(df).filter("conv_id = 1").first()
    assert "".join(s.text for s in full.segments) == full.formatted
    assert [s.text for s in full.segments if s.loss] == ["b"]


@pytest.mark.parametrize("sf", ["0.001"])
def test_whole_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/conversations.parquet")
    want: dict = {}
    for r in sorted(chat.with_hostile(spark, df).collect(), key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in chat.digests(chat.with_hostile(spark, df)).collect()}
    assert got.keys() == want.keys()
    for k, turns in want.items():
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_rows_without_conv_id_stand_alone(spark):
    rows = [(None, t, "user" if t % 2 == 0 else "assistant", f"text {t % 3}") for t in range(40)] + [(None, 0, "user", "text 0")] * 3 + [(5, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat.digests(df).collect()
    assert len(got) == 44 and all(r.n_turns == 1 for r in got) and sum(r.conv_id is None for r in got) == 43
