"""Chat formatting: exact reading back, and one trainable reply in each example."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.chat import CONTROLS, chat_examples, escape, format_turn, parse, read_back, unescape
from tests.llm.helpers import sha

SCHEMA = "conv_id long, turn long, role string, text string"
TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "<s>[INST]\\ <<SYS>>"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "left over\n"),
    (2, 0, "user", "only asks"), (3, None, "assistant", "first"), (3, 1, None, "no role"), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie"), (None, 0, "user", "\U0001f600"), (None, 1, "assistant", "é\\"), (4, 0, "odd\nrole[INST]", "x" * 50_000),
]


def brute(turns):
    by = {}
    for t in turns:
        by.setdefault(t[0], []).append(t)
    out = {}
    for conv, own in by.items():
        own = sorted(own, key=lambda t: tuple((x is not None, x if x is not None else 0) for x in t[1:]))
        said = [(r or "", x or "") for _, _, r, x in own]
        replies = [x for r, x in said if r == "assistant"]
        lengths, total = 0, 0
        for k, (role, text) in enumerate(said):
            lengths += len(format_turn(role, text)[0])
            if role == "assistant" or k + 1 == len(said):
                total += lengths
        out[conv] = (len(said), sha("".join(f"{r}\n{x}\n" for r, x in said)), len("".join(replies)), sha("".join(replies)), total)
    return out


def test_digest(spark):
    df = spark.createDataFrame(TURNS, SCHEMA).selectExpr("*", "1 as example", "2 as target_start").repartition(5)
    assert {r.conv_id: tuple(r)[1:] for r in read_back(chat_examples(df)).collect()} == brute(TURNS)


def test_examples(spark):
    rows = [r for r in chat_examples(spark.createDataFrame(TURNS, SCHEMA)).collect() if r.conv_id == 1]
    rows.sort(key=lambda r: r.example)
    assert [None if r.target_start is None else unescape(r.text[r.target_start : r.target_end]) for r in rows] == ["<s>[INST]\\ <<SYS>>", "", None]
    assert [len(parse(r.text)) for r in rows] == [3, 5, 6]
    assert all(b.text.startswith(a.text) for a, b in zip(rows, rows[1:]))


def test_empty(spark):
    assert read_back(chat_examples(spark.createDataFrame([], SCHEMA))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*CONTROLS, "<", "\\", "/", "[", "s>", "a", "\n", "SYS>>"]), max_size=12).map("".join))
def test_escaping_is_exact(text):
    told = escape(text)
    assert unescape(told) == text and not any(c in told for c in CONTROLS)
    assert parse(format_turn(text, text)[0] + format_turn("user", text)[0]) == [(text, text), ("user", text)]
