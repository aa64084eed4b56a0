import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gleanery.llm import chat

COLUMNS = "conv_id long, turn long, role string, text string, position string, segments int"
ALPHABET = ["\\", "<", ">", "/", "s", "[", "]", "INST", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>", "|", "é", "\n", "a"]
texts = st.lists(st.sampled_from(ALPHABET)).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant", "", "tool"]), texts), texts)))
def test_any_turns_parse_back(turns):
    splitter = chat.INSTRUCT.splitter()
    parts = [p for role, text in turns for p in chat.segments(role, text, chat.INSTRUCT, splitter)]
    parser = chat.Parser(chat.INSTRUCT)
    assert list(parser.feed("".join(t for t, _ in parts))) == turns
    assert [chat.unescape(t) for t, loss in parts if loss] == [t for r, t in turns if r == "assistant"]
    pattern = chat.INSTRUCT.pattern()
    assert not any(pattern.search(t) for t, loss in parts if loss)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        every = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def run(spark, rows):
    conversations = spark.createDataFrame([(*r, "clash", 1) for r in rows], COLUMNS)
    return chat.round_trip(conversations).collect()


def test_round_trip(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool", None]), "".join(rng.choices(ALPHABET, k=rng.randint(0, 30)))) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "null conversation"), (None, 1, "assistant", None), (100, None, "user", ""), (100, 3, "assistant", "x\n" * 200_000)]
    rows += [(101, 1, "user", "b"), (101, 1, "user", "a"), (101, 1, "assistant", "c"), (101, 1, "assistant", "c")]
    rows += [(102, t, "user" if t % 2 == 0 else "assistant", f"turn {t} \U0001f600") for t in range(25_000)]
    got = run(spark, rows)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows)
    assert len(got) == len(brute(rows))


@pytest.mark.parametrize(
    ("roles", "sound", "closed"),
    [
        ("user assistant", True, True), ("system user assistant user", True, False), ("assistant", False, True), ("user user assistant", False, True),
        ("system system user", False, False), ("user tool assistant", False, True), ("user assistant system", False, False), ("system", True, False),
    ],
)
def test_turn_order(spark, roles, sound, closed):
    (r,) = run(spark, [(1, i, role, "t") for i, role in enumerate(roles.split())])
    assert (r.sound, r.closed) == (sound, closed)


def test_bad_turns_are_marked(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("position").collect()
    assert [t.sound for t in turns] == [True, False, True]
    assert ["".join(s.text for s in t.segments) for t in turns] == ["[INST]a[/INST]", "[INST]b[/INST]", "<s>c</s>"]


def test_loss_text_and_empty_table(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "x</s>\\y\nz")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in chat.loss_text(chat.format_turns(conversations)).collect()] == [(1, 1, "x</s>\\y\nz")]
    assert chat.round_trip(conversations.limit(0)).count() == 0


def test_templates_are_checked():
    with pytest.raises(ValueError):
        chat.Template(marks={"user": ("<a>", "<a>")}, other=("<b>", "<c>", "<d>"), loss=frozenset(), order={})
    with pytest.raises(ValueError):
        chat.Template(marks={"user": ("<a>", "x<a>")}, other=("<b>", "<c>", "<d>"), loss=frozenset(), order={})
