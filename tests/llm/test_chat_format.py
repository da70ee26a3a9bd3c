"""Chat formatting: round trips, the machine, streams across batches, edge rows."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from martspark.llm.chat_format import (
    Machine, Template, escaped, escaped_role, formatted, read_back, unescaped, unescaped_role, with_probe)
from martspark.session import written

SCHEMA = "conv_id long, turn long, role string, text string, loss boolean"
TEXTS = st.text(st.sampled_from("<~|>im_end\n\\ aé\U0001f600"), max_size=30)


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible_and_hide_control_strings(text):
    assert "<|" not in escaped(text) and unescaped(escaped(text)) == text
    assert "\n" not in escaped_role(text) and "<|" not in escaped_role(text)
    assert unescaped_role(escaped_role(text)) == text


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(turns):
    """Digests straight from the rows of one conversation, in order."""
    loss = [text for role, text in turns if role == "assistant"]
    t = Template()
    return (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), sum(map(len, loss)), sha("".join(loss)),
            sum(len(piece) for r, x in turns for piece, _ in t.segments(r, x)))


def digests(spark, rows, **options):
    frame = spark.createDataFrame([(*r, True) for r in rows], SCHEMA)
    found = read_back(formatted(frame), **options).collect()
    return {r["conv_id"]: r for r in found}


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool"]), TEXTS), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_segments_join_to_text_that_parses_back(turns):
    from martspark.llm.chat_format import _Reader

    reader = _Reader(Template(), 1)
    for role, text in turns:
        for piece, loss in Template().segments(role, text):
            reader.feed(piece, loss)
    assert reader.row(True, None)[1:6] == expected(turns)


def test_round_trip_over_batches_and_files(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"<|im_end|> {c} <~| {t}\n") for c in range(9) for t in range(c + 1)]
        found = digests(spark, rows)
        frame = spark.createDataFrame([(*r, True) for r in rows], SCHEMA)
        kept = written(formatted(frame), "segments")
        again = {r["conv_id"]: r for r in read_back(kept, ordered=False).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c in range(9):
        turns = [(r, x) for k, _, r, x in rows if k == c]
        assert tuple(found[c])[1:6] == expected(turns) == tuple(again[c])[1:6]
        assert found[c]["valid"] == (c % 2 == 1)


def test_only_assistant_texts_carry_loss(spark):
    frame = with_probe(spark.createDataFrame([(1, 1, "assistant", "b", None), (1, 0, "user", "a", None)], SCHEMA))
    rows = formatted(frame).collect()
    text = "".join(r["text"] for r in sorted((r for r in rows if r["conv_id"] == 1), key=lambda r: (r["turn_number"], r["segment"])))
    assert text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert [r["text"] for r in rows if r["loss"] and r["conv_id"] == 1] == ["b"]
    probe = read_back(formatted(frame)).filter("conv_id = -1").first()
    assert probe["loss_sha256"] == sha("<|im_end|><|im_start|>assistant ok") and probe["valid"]


@pytest.mark.parametrize("roles, error", [
    ("user assistant", None), ("system user assistant user assistant", None), ("user assistant tool assistant", None),
    ("assistant", 0), ("user user", 1), ("system assistant", 1), ("user assistant system", 2), ("user", 1),
    ("user assistant user", 3), ("system", 1), ("robot user", 0),
])
def test_machine(roles, error):
    machine = Machine(Template())
    for role in roles.split():
        machine.step(role)
    assert machine.end() == error


def test_template_is_checked():
    with pytest.raises(ValueError):
        Template(turn_open="[turn]")
    with pytest.raises(ValueError):
        Template(moves={"start": {"user": "nowhere"}})


def test_edge_rows(spark):
    long_text = "<|" * 300_000
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"),
            (1, None, "user", None), (1, 0, None, "x"), (1, 0, "assistant", "x"), (1, 0, "assistant", "x"),
            (2, 5, "user", long_text), (2, 6, "assistant", long_text), (3, 0, "a\nb\\<|", "t")]
    found = digests(spark, rows)
    assert set(found) == {None, 1, 2, 3}
    assert tuple(found[None])[1:6] == expected([("user", "a"), ("assistant", "b")]) and found[None]["valid"]
    assert tuple(found[1])[1:6] == expected([("user", ""), ("", "x"), ("assistant", "x"), ("assistant", "x")])
    assert (found[1]["valid"], found[1]["first_error"]) == (False, 1)
    assert found[2]["loss_chars"] == 600_000 and tuple(found[3])[1:6] == expected([("a\nb\\<|", "t")])


def test_empty_table(spark):
    assert digests(spark, []) == {}
