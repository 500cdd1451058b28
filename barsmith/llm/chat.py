"""Chat formatting with offset-aligned loss masks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, table

TOKENIZER = "byte_bpe_50k.json"
# The template's control strings.
CONTROL = r"</?s>|\[/?INST\]|\[/?SYS\]|\[/?OUT\]|\[/?ROLE\]"
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "system": ("<s>[SYS] ", " [/SYS]"), "assistant": ("[OUT] ", " [/OUT]</s>")}
_ESCAPE = re.compile(rf"(\\*)({CONTROL})")
_UNESCAPE = re.compile(rf"\\(\\*)({CONTROL})")
#: A control string with no backslash before it is the template's own.
_TURN = re.compile(r"<s>\[INST\] (.*?) (?<!\\)\[/INST\]|<s>\[SYS\] (.*?) (?<!\\)\[/SYS\]|\[OUT\] (.*?) (?<!\\)\[/OUT\]</s>|<s>\[ROLE\] (.*?) (?<!\\)\[/ROLE\](.*?) (?<!\\)</s>", re.DOTALL)


def escape(text: str) -> str:
    """One backslash more before every control string, whatever number stands there."""
    return _ESCAPE.sub(lambda m: "\\" + m[1] + m[2], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1] + m[2], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the assistant texts' spans in it, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        text = escape(text)
        before, after = MARKS.get(role) or (f"<s>[ROLE] {escape(role)} [/ROLE]", " </s>")
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(text)))
        parts += (before, text, after)
        at += len(before) + len(text) + len(after)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted conversation holds."""
    turns = []
    for m in _TURN.finditer(formatted):
        if m[1] is not None:
            turns.append(("user", unescape(m[1])))
        elif m[2] is not None:
            turns.append(("system", unescape(m[2])))
        elif m[3] is not None:
            turns.append(("assistant", unescape(m[3])))
        else:
            turns.append((unescape(m[4]), unescape(m[5])))
    return turns


def load_tokenizer(name: str = TOKENIZER):
    import public_tokenizers
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.encode_special_tokens = True
    # Offsets keep the space that a token begins with.
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
    return tok


def mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens bear loss, and the stretches of text under them.

    A token bears loss when it meets a span. Spans are sorted and disjoint, token starts and ends are
    sorted, so each span finds its first and last token by binary search. The stretch of a span is what its tokens cover of it;
    tokens of one character's bytes share its offsets.
    """
    flags = np.zeros(len(offsets), bool)
    if not offsets:
        return flags, []
    starts, ends = (np.fromiter((o[i] for o in offsets), np.int64, len(offsets)) for i in (0, 1))
    under = []
    for a, b in spans:
        if a == b:
            continue
        first, last = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        if first < last:
            flags[first:last] = True
            under.append((max(a, int(starts[first])), min(b, int(ends[last - 1]))))
    return flags, under


def token_sizes(tok: Any) -> np.ndarray:
    """Bytes of each token of a byte-level vocabulary: its characters stand for one byte each."""
    return np.array([len(tok.id_to_token(i) or "") for i in range(tok.get_vocab_size())], np.int64)


def under_mask(formatted: str, ids: list[int], flags: list[bool], sizes: np.ndarray) -> str:
    """The unescaped text under a loss mask, read back from the output alone.

    The ids' sizes place the tokens in the formatted bytes; what masked tokens cover of the assistant turns that parsing finds is
    the text. A token that begins or ends in a control string's space counts with its part inside the turn.
    """
    raw = formatted.encode()
    under = np.repeat(np.array(flags, bool), sizes[np.array(ids, np.int64)])
    if len(under) != len(raw):
        raise ValueError("the ids do not spell the formatted text")
    out, at, last = [], 0, 0
    for m in _TURN.finditer(formatted):
        if m[3]:
            begin = at + len(formatted[last : m.start(3)].encode())
            at, last = begin + len(m[3].encode()), m.end(3)
            out.append(unescape(bytes(np.frombuffer(raw, np.uint8)[begin:at][under[begin:at]]).decode("utf-8", "replace")))
    return "".join(out)


def format_turns(turns: list[tuple[str, str]], tok: Any) -> dict[str, Any]:
    """Render, encode once, and mask one conversation."""
    formatted, spans = render(turns)
    encoded = tok.encode(formatted, add_special_tokens=False)
    flags, under = mask(encoded.offsets, spans)
    return {"formatted": formatted, "ids": encoded.ids, "mask": flags.tolist(), "loss_spans": [list(x) for x in under]}


SCHEMA = "formatted string, ids array<int>, mask array<boolean>, loss_spans array<array<int>>"


def format_chats(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a conversation: conv_col, formatted, ids, mask, loss_spans (character stretches under the mask, one a non-empty assistant text).

    Turns are ordered by turn, then role and text where turns tie; repeated rows are turns of their own. Null
    texts and roles count as empty; a null conversation id is a conversation. Roles other than user, system and
    assistant are written by name. Rows are hash-partitioned by conversation and read in sorted order, so a task
    holds one conversation at a time, which has to be whole to be encoded once; conversations that happen to be alike don't
    meet. An empty table gives an empty result; other columns don't matter.
    """
    bounded_batches(conversations.sparkSession)
    rows = conversations.select(F.col(conv_col).alias("_ch_id"), F.col(turn_col).alias("_ch_turn"), F.coalesce(F.col(role_col), F.lit("")).alias("_ch_role"), F.coalesce(F.col(text_col), F.lit("")).alias("_ch_text"))
    rows = rows.repartition("_ch_id").sortWithinPartitions("_ch_id", "_ch_turn", "_ch_role", "_ch_text")

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(tokenizer)
        types = [id_arrow, pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.list_(pa.int32()))]
        names = ["_ch_id", "formatted", "ids", "mask", "loss_spans"]
        started, current, turns, ready, size = False, None, [], [], 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[n] for r in ready], t) for n, t in zip(names, types, strict=True)], names)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if started and conv != current:
                    ready.append({"_ch_id": current} | format_turns(turns, tok))
                    size += len(ready[-1]["formatted"])
                    turns = []
                    if size > 1_000_000:
                        yield out()
                        ready, size = [], 0
                started, current = True, conv
                turns.append((role, text))
        if started:
            ready.append({"_ch_id": current} | format_turns(turns, tok))
            yield out()

    id_type = rows.schema["_ch_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(id_type)
    return rows.mapInArrow(formatted, f"_ch_id {id_type.simpleString()}, {SCHEMA}").withColumnRenamed("_ch_id", conv_col)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what the formatted output of all conversations, and conversation -1, holds when it is read back."""
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = token_sizes(load_tokenizer())
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for text, ids, flags in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                turns = parse(text)
                loss = under_mask(text, ids, flags, sizes)
                read = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
                for c, v in zip(cols, read, strict=True):
                    c.append(v)
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return format_chats(chats.unionByName(extra)).select("conv_id", "formatted", "ids", "mask").mapInArrow(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: DuckDB: what reading back must give; formatted_chars follows from the template.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '</?s>|\[/?INST\]|\[/?SYS\]|\[/?OUT\]|\[/?ROLE\]'))
  + CASE role WHEN 'user' THEN 18 WHEN 'system' THEN 16 WHEN 'assistant' THEN 17
    ELSE 23 + length(role) + len(regexp_extract_all(role, '</?s>|\[/?INST\]|\[/?SYS\]|\[/?OUT\]|\[/?ROLE\]')) END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
