"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole: each turn is ``<|turn|>role<|sep|>text<|end|>`` and a line break, led
by ``<s>`` and closed by ``</s>``. Control strings inside roles and texts are escaped by a backslash after
their first character, one more than are there already, which is undone in reading. The rendered text is
encoded once, with the characters that each token covers. The spans of assistant texts and the spans of tokens
are both in order, so binary search finds the tokens that meet each span; the mask is the part of those tokens
inside the span, so a token that reaches over a turn's edge is cut there.

Rows of a conversation are ordered by turn, then role and text; a null turn comes first and repeated rows are
turns of their own. Null roles and texts count as empty. Rows with a null conv_id form one conversation.
Very long texts are encoded in full. An empty table has an empty result. Other columns are not carried, as
rows of a conversation become one.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

TURN, SEP, END, BEGIN, CLOSE = "<|turn|>", "<|sep|>", "<|end|>", "<s>", "</s>"
_CONTROL = re.compile(r"([<\[])(\\*)((?:\|turn\||\|sep\||\|end\||\|endoftext\||/?s)>|/?INST\]|<SYS>>|</SYS>>|/?TOOL\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)((?:\|turn\||\|sep\||\|end\||\|endoftext\||/?s)>|/?INST\]|<SYS>>|</SYS>>|/?TOOL\])")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the span of each turn's text in it."""
    out, at, spans = [BEGIN], len(BEGIN), []
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SEP}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at = spans[-1][1] + len(END) + 1
    out.append(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, as they were before escaping."""
    if not (formatted.startswith(BEGIN) and formatted.endswith(CLOSE)):
        raise ValueError("not a formatted conversation")
    turns = []
    for part in formatted[len(BEGIN) : -len(CLOSE)].split(TURN)[1:]:
        role, _, rest = part.partition(SEP)
        turns.append((unescape(role), unescape(rest[: -len(END) - 1])))
    return turns


def mask_spans(offsets: np.ndarray, spans: Sequence[tuple[int, int]]) -> np.ndarray:
    """(token, start, end) rows of the part of each token that lies in one of ``spans``; both are in order."""
    starts, ends = offsets[:, 0], offsets[:, 1]
    lo, hi = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
    first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
    count = np.maximum(last - first, 0)
    token = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    own = np.repeat(np.arange(len(lo)), count)
    a, b = np.maximum(starts[token], lo[own]), np.minimum(ends[token], hi[own])
    return np.stack([token, a, b], 1)[a < b]


def masked(text: str, starts: np.ndarray, stops: np.ndarray) -> list[str]:
    """The text under a mask, one string for each run of it; characters of several tokens count once."""
    if not len(starts):
        return []
    reach = np.maximum.accumulate(stops)
    begin = np.flatnonzero(np.concatenate(([True], starts[1:] > reach[:-1])))
    return [text[a:b] for a, b in zip(starts[begin].tolist(), reach[np.append(begin[1:], len(starts)) - 1].tolist(), strict=True)]


@dataclass(frozen=True)
class Formatted:
    text: str
    ids: list[int]
    mask: np.ndarray


class Formatter:
    def __init__(self, tokenizer_path: str, learned: tuple[str, ...] = ("assistant",)):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        self.tokenizer, self.learned = Tokenizer.from_file(tokenizer_path), frozenset(learned)
        # offsets with the white space that a token begins with
        self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        self.tokenizer.encode_special_tokens = True

    def format(self, conversations: list[list[tuple[str, str]]]) -> list[Formatted]:
        rendered = [render(turns) for turns in conversations]
        coded = self.tokenizer.encode_batch([text for text, _ in rendered], add_special_tokens=False)
        out = []
        for turns, (text, spans), code in zip(conversations, rendered, coded, strict=True):
            wanted = [s for (role, _), s in zip(turns, spans, strict=True) if role in self.learned]
            out.append(Formatted(text, code.ids, mask_spans(np.array(code.offsets, np.int64).reshape(-1, 2), wanted)))
        return out


def _formatter(tokenizer_path: str, learned: tuple[str, ...]):
    @F.pandas_udf(T.StructType.fromDDL("formatted string, ids array<int>, mask_token array<int>, mask_start array<int>, mask_stop array<int>"))
    def format_turns(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        formatter = Formatter(tokenizer_path, learned)
        for series in batches:
            rows = []
            for turns in series:
                (f,) = formatter.format([[(t["role"] or "", t["text"] or "") for t in turns]])
                mask = f.mask.astype(np.int32)
                rows.append((f.text, np.array(f.ids, np.int32), mask[:, 0].copy(), mask[:, 1].copy(), mask[:, 2].copy()))
            yield pd.DataFrame(rows, columns=["formatted", "ids", "mask_token", "mask_start", "mask_stop"])

    return format_turns


def format_conversations(df: DataFrame, tokenizer_path: str, *, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation of ``df`` (conv_id, turn, role, text): formatted text, token ids and loss mask.

    The mask is three arrays: a token, and the begin and end of the part of the formatted text that it stands
    for inside a learned turn.
    """
    small_batches(df.sparkSession)
    turns = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select("conv_id", _formatter(tokenizer_path, learned)("turns").alias("f")).select("conv_id", "f.*")


@F.pandas_udf(T.StructType([T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]))
def digest(formatted: pd.Series, start: pd.Series, stop: pd.Series) -> pd.DataFrame:
    """What can be read back from a formatted conversation and its mask."""
    rows = []
    for text, begins, ends in zip(formatted, start, stop, strict=True):
        turns = parse(text)
        loss = "".join(map(unescape, masked(text, begins, ends)))
        said = "".join(f"{role}\n{t}\n" for role, t in turns)
        rows.append((len(turns), hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
