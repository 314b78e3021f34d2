"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole: each turn is ``### <role>: <text></turn>``
and a newline, where a backslash is put before every ``###``, ``</turn>``, colon with a
space, and backslash in roles and texts, so that marks are never mistaken for text
and the escapes can be undone.  The whole rendering is encoded once with offsets; the
sorted spans of the turns that count for the loss are intersected with the sorted
spans of the tokens by binary search.  A token that only touches a turn carries the
part of it that lies inside, so the mask is exact to the character even where a
token crosses a turn's border.

Edge cases: turns are ordered by (turn, role, text), nulls first; a null role or text
is empty; repeated rows are turns of their own; rows with a null conv_id form one
conversation; a very long conversation is rendered and encoded whole, in one row; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEARNED = ("assistant",)
CONVERSATIONS_AT_ONCE = 128
_MARKS = r"\\|###|</turn>|: "  # a backslash, the head, the foot, and what ends a role
_ESCAPE = re.compile(_MARKS)
_UNESCAPE = re.compile(rf"\\({_MARKS})")
_PLAIN = rf"(?:[^\\#<:]++|\\(?:{_MARKS})|(?!{_MARKS})[#<:])*+"
_TURN = re.compile(rf"### ({_PLAIN}): ({_PLAIN})</turn>\n")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def render(turns: list[tuple[str, str]], learned=LEARNED) -> tuple[str, np.ndarray]:
    """The text of a conversation, and the spans (start, stop) of the learned turns."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"### {escape(role)}: "
        body = escape(text)
        if role in learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + len(parts[-1])
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from a rendering."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def mask(tokens: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (start, stop) against disjoint sorted spans -> (token, start, stop): the
    part of each token that lies in a span.  Both sides are sorted, so each span finds
    its first and last token by binary search."""
    first = np.searchsorted(tokens[:, 1], spans[:, 0], "right")
    last = np.searchsorted(tokens[:, 0], spans[:, 1], "left")
    n = np.maximum(last - first, 0)
    token = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    span = np.repeat(np.arange(len(spans)), n)
    return token, np.maximum(tokens[token, 0], spans[span, 0]), np.minimum(tokens[token, 1], spans[span, 1])


def masked_text(formatted: str, start: np.ndarray, stop: np.ndarray) -> str:
    """All characters under the mask, once each: several tokens may share one character."""
    some = start < stop
    start, stop = start[some], stop[some]
    start = np.maximum(start, np.r_[0, np.maximum.accumulate(stop)][:-1])  # from where the tokens before end
    some = start < stop
    start, stop = start[some], stop[some]
    new = np.r_[True, start[1:] != stop[:-1]][: len(start)]
    return "".join(formatted[a:b] for a, b in zip(start[new].tolist(), stop[np.r_[new[1:], True][: len(new)]].tolist()))


def lists(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column as arrays, without a Python object per number."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b] for a, b in zip(at, at[1:])]


def formatted(conversations: DataFrame, tokenizer_file: str, learned=LEARNED) -> DataFrame:
    """A row per conversation: formatted text, token ids, and for each token the
    characters of it that count for the loss (loss_start, loss_stop; equal if none)."""

    def run(batches):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_file)
        tok.encode_special_tokens = True
        for batch in batches:
            for b in (batch.slice(i, CONVERSATIONS_AT_ONCE) for i in range(0, batch.num_rows, CONVERSATIONS_AT_ONCE)):
                texts, spans = [], []
                for turns in b.column(1).to_pylist():
                    t, s = render([(x["role"], x["text"]) for x in turns], learned)
                    texts.append(t)
                    spans.append(s)
                ids, starts, stops = [], [], []
                for t, s in zip(texts, spans):
                    e = tok.encode(t, add_special_tokens=False)
                    own = np.fromiter(chain.from_iterable(e.offsets), np.int64).reshape(-1, 2)
                    token, lo, hi = mask(own, s)
                    start = own[:, 0].astype(np.int32)
                    stop = start.copy()
                    start[token], stop[token] = lo, hi
                    ids.append(np.array(e.ids, np.int32))
                    starts.append(start)
                    stops.append(stop)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), *(pa.array(x, pa.list_(pa.int32())) for x in (ids, starts, stops))], ["conv_id", "formatted", "ids", "loss_start", "loss_stop"])

    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    kind = whole.schema["conv_id"].dataType.simpleString()
    return whole.mapInArrow(run, f"conv_id {kind}, formatted string, ids array<int>, loss_start array<int>, loss_stop array<int>")


def read_back(output: DataFrame) -> DataFrame:
    """What the output of ``formatted`` holds: turns, and the text under the loss mask."""

    def run(batches):
        for b in (x.slice(i, CONVERSATIONS_AT_ONCE) for x in batches for i in range(0, x.num_rows, CONVERSATIONS_AT_ONCE)):
            rows = []
            for conv, text, start, stop in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), lists(b.column(3)), lists(b.column(4))):
                turns = parse(text)
                loss = unescape(masked_text(text, start, stop))
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    kind = output.schema["conv_id"].dataType.simpleString()
    return output.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
