"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it as context, and that reply
alone trainable. A turn is written as

    <s> role [INST] text </s>

without the blanks. Inside roles and texts every control string of CONTROLS, of this template or of
another, is broken by a backslash after its first character, and a backslash is doubled, so that
reading back is exact and no text can forge a mark. Turns after the last assistant turn would be in
no example; they come, with everything before them, as one last example without a target.

An example holds its whole context, so a conversation of n assistant turns is written about n / 2
times over: that is what the expansion is. Tasks stream the rows of their conversations in turn
order and hold one conversation's text so far, which is as long as its longest example. Reading
back, each example is cut where it lies to its length and its reply; only those travel, and the whole
text of a conversation's last example.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stage, table

TURN, HEAD, END = "<s>", "[INST]", "</s>"
CONTROLS = (TURN, END, HEAD, "[/INST]", "<<SYS>>", "<</SYS>>")
_special = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_turn = re.compile(f"{re.escape(TURN)}(.*?){re.escape(HEAD)}(.*?){re.escape(END)}", re.DOTALL)
_escaped = re.compile(r"\\(.)", re.DOTALL)
_EXAMPLE = "conv_id long, example int, text string, target_start long, target_end long, last boolean"
_PART = "conv_id long, example int, chars long, reply string, whole string"
_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _special.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The formatted turn, and where its escaped text starts and ends."""
    head, body = TURN + escape(role or "") + HEAD, escape(text or "")
    return head + body + END, len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted text; raises where it isn't one."""
    out, at = [], 0
    while at < len(text):
        m = _turn.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples from rows sorted by conversation and turn."""
    rows: list[tuple] = []
    size, first, conv, prefix, number, open_turns, held = 0, True, None, "", 0, False, None

    def flush() -> pa.RecordBatch:
        nonlocal size
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "example", "text", "target_start", "target_end", "last"])
        rows.clear()
        size = 0
        return out

    def put(last: bool) -> None:
        """The example held back until it is known whether another of its conversation follows."""
        nonlocal held
        if held:
            rows.append((*held, last))
        held = None

    def rest() -> None:
        nonlocal held
        if open_turns:
            put(False)
            held = (conv, number, prefix, None, None)
        put(True)

    for b in batches:
        for c, role, text in zip(b["conv_id"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist(), strict=True):
            if first or c != conv:
                rest()
                first, conv, prefix, number, open_turns = False, c, "", 0, False
            turn, start, end = format_turn(role, text)
            start, end, prefix = len(prefix) + start, len(prefix) + end, prefix + turn
            open_turns = True
            if role == "assistant":
                put(False)
                held = (conv, number, prefix, start, end)
                number, open_turns = number + 1, False
                size += len(prefix)
                if size > 1 << 22:
                    yield flush()
    rest()
    yield flush()


def chat_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, text, target_start, target_end (code points; null without a target), last, written and read back.

    conv_id is a whole number. Rows go by turn, ties by role and text, null turns first. Null roles and texts are empty. Rows
    with a null conv_id make one conversation. Repeated rows are turns of their own. Other columns
    are not read. An empty table gives no rows.
    """
    keys = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
    return stage(rows.mapInArrow(expand, _EXAMPLE), "examples")


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each example its length, its unescaped reply, and, of a conversation's last, the whole text."""
    for b in batches:
        texts, starts, ends, last = (b[k].to_pylist() for k in ("text", "target_start", "target_end", "last"))
        chars = pa.array([len(t) for t in texts], pa.int64())
        replies = pa.array([None if i is None else unescape(t[i:j]) for t, i, j in zip(texts, starts, ends, strict=True)], pa.string())
        whole = pa.array([t if x else None for t, x in zip(texts, last, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([b["conv_id"], b["example"], chars, replies, whole], ["conv_id", "example", "chars", "reply", "whole"])


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from what cut gives, sorted by conversation and number; turns come from the last example."""
    rows: list[tuple] = []
    loss, loss_chars, chars = hashlib.sha256(), 0, 0
    for b in batches:
        for c, n, reply, whole in zip(b["conv_id"].to_pylist(), b["chars"].to_pylist(), b["reply"].to_pylist(), b["whole"].to_pylist(), strict=True):
            chars += n
            if reply is not None:
                loss.update(reply.encode("utf-8", "surrogatepass"))
                loss_chars += len(reply)
            if whole is not None:
                turns, told = parse(whole), hashlib.sha256()
                for role, text in turns:
                    told.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                rows.append((c, len(turns), told.hexdigest(), loss_chars, loss.hexdigest(), chars))
                loss, loss_chars, chars = hashlib.sha256(), 0, 0
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (of all examples of a conversation)."""
    order = [F.col("conv_id").asc_nulls_first(), "example"]
    parts = examples.select("conv_id", "example", "text", "target_start", "target_end", "last").mapInArrow(cut, _PART)
    return parts.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(digest, _DIGEST)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(chat_examples(conversations.unionByName(more)))


OP7_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f as (
  select *, length('<s>' || regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(s>|/s>|<SYS>>|</SYS>>)', '<\\\1', 'g'), '\[(INST\]|/INST\])', '[\\\1', 'g')
    || '[INST]' || regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(s>|/s>|<SYS>>|</SYS>>)', '<\\\1', 'g'), '\[(INST\]|/INST\])', '[\\\1', 'g') || '</s>') as chars,
    row_number() over (partition by conv_id order by turn, role, text) as k from t),
p as (select *, sum(chars) over (partition by conv_id order by k) as prefix, max(k) over (partition by conv_id) as last from f)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(case when role = 'assistant' or k = last then prefix else 0 end) as bigint) as formatted_chars
from p group by conv_id
"""
