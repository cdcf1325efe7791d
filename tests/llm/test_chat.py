"""Chat formatting: exact round trip, the mask, runs of one role, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from tapeline.llm import chat_format as C
from tapeline.llm.queries import IMITATION, QUERIES

ODD = "conv_id long, turn long, role string, text string, formatted int, loss string"
MARKS = ["\\", "###", "</turn>", "<part/>", "#", "\n", ": ", "\\0", "\\1", "</turn>\n", "### User: ", "x", "é", "😀", " ", "</", "turn>", "\\\\"]


def plain(rows):
    """(conv_id -> turns in order) by the stated rules."""
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    return {k: [(role, text) for _, _, role, text in sorted(v)] for k, v in out.items()}


def back(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], ODD)
    return {r.conv_id: r for r in C.read_back(C.formatted(df)).collect()}


def test_round_trip_of_odd_rows(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(MARKS) for _ in range(rnd.randrange(6)))
    roles = ["user", "assistant", "system", "tool", "User", "Assistant", None, "", "a: b", "=user", "###", "</turn>", "\\4"]
    rows = [(c, rnd.choice([None, 0, 1, 2, 3, 4]), rnd.choice(roles), rnd.choice([None, "", word(), word(), word()])) for c in [None, *range(60)] for _ in range(rnd.randrange(1, 9))]
    rows += rows[:40]
    got, want = back(spark, rows), plain(rows)
    assert got.keys() == want.keys()
    for k, turns in want.items():
        r = got[k]
        assert [tuple(t) for t in r.turns] == turns
        assert r.loss_text == "".join(t for role, t in turns if role == "assistant")
        assert [C_unescape(r.formatted[s.start : s.start + s.length]) for s in r.loss] == [t for role, t in turns if role == "assistant"]
        heads = sum(i == 0 or turns[i - 1][0] != role for i, (role, _) in enumerate(turns))
        assert r.formatted.count("</turn>") == r.formatted.count("###") == heads
        assert r.formatted.count("<part/>") == len(turns) - heads


def C_unescape(text):
    for mark, code in reversed(C.CODES[:4]):
        text = text.replace(code, mark)
    return text


def test_template_and_imitation(spark):
    rows = [(1, 0, "user", "one"), (1, 1, "user", "two"), (1, 2, "assistant", IMITATION), (1, 3, "critic", "x")]
    r = back(spark, rows)[1]
    assert IMITATION == "\\### Assistant: </turn> ok"
    assert r.formatted == "### User: one<part/>two</turn>\n### Assistant: \\0\\1 Assistant: \\2 ok</turn>\n### =critic: x</turn>\n"
    assert [tuple(t) for t in r.turns] == [x[2:] for x in rows] and r.loss_text == IMITATION


def test_long_conversation_and_text(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"é{i}#") for i in range(4_000)] + [(2, 0, "assistant", "ab### " * 400_000)]
    got = back(spark, rows)
    assert [t.text for t in got[1].turns] == [r[3] for r in rows[:-1]]
    assert got[1].loss_text == "".join(r[3] for r in rows[:-1] if r[2] == "assistant")
    assert got[2].loss_text == rows[-1][3]


def test_empty_table(spark):
    assert C.read_back(C.formatted(spark.createDataFrame([], ODD))).count() == 0


def test_main_path_has_no_python(spark, sf):
    df = QUERIES["op12_chat_format"](spark, sf)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
    assert df.filter("conv_id = -7").select("n_turns", "loss_chars").first() == (2, len(IMITATION))


@pytest.mark.parametrize("size", [1, 512, 513, 1100])
def test_spans_over_blocks(spark, size):
    rows = [(1, i, "assistant", "ab") for i in range(size)]
    spans = back(spark, rows)[1].loss
    assert [s.start for s in spans] == [len("### Assistant: ") + i * len("ab<part/>") for i in range(size)] and len(spans) == size
