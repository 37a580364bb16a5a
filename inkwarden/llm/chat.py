"""Chat formatting: conversations as token sequences with a loss mask that is aligned by offsets."""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols, default_path
from .common import settle, whole

#: The template. A turn is HEAD, its role in one line, END_HEAD, its text, FOOT. Only `_escaped` strings can look like a mark inside a text.
HEAD, END_HEAD, FOOT = "<turn ", ">\n", "</turn>\n"
_TURN = re.compile(r"<turn ([^\n]*)>\n(.*?)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"<\\(\\*/?turn)")
_ROLE_ESCAPE = re.compile(r"\\(.)")
_BREAK = re.compile(r"\n(?=\S)")

SEGMENT = "conv_id bigint, task int, k int, edge boolean, text string, ids array<int>, loss array<struct<first:int,stop:int,lead:int,tail:int>>"
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, loss_tokens bigint"


def escaped(text: Column) -> Column:
    r"""`<turn` and `</turn` get a backslash after `<`, and one more where they already have some, so `unescaped` can take it back."""
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1", text)


def role_line(role: Column) -> Column:
    r"""A role as one line: backslashes doubled, line feeds as `\n`."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def role_of(line: str) -> str:
    return _ROLE_ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], line)


class Codec:
    """The tokenizer of a worker process, and the bytes of its tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's string inside a text is ordinary text
        symbols = byte_symbols()
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = token.encode() if token in special else bytes(symbols[c] for c in token)
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, text: str, chars: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(ids, end of each token in UTF-8 bytes) of a text.

        Offsets are in bytes, since byte-level tokens may split a character. Very long texts are encoded in parts that end with a
        line feed before a non-space character, where the pattern in front of the merges always cuts, so ids are those of the whole.
        """
        parts, at = [], 0
        while len(text) - at > chars:
            found = _BREAK.search(text, at + chars)
            if found is None:
                break
            parts.append(text[at : found.end()])
            at = found.end()
        parts.append(text[at:])
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)])
        return ids, np.cumsum(self.sizes[ids])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def masked(spans: list[tuple[int, int]], ends: np.ndarray) -> list[tuple[int, int, int, int]]:
    """For each of the sorted byte spans: its tokens [first, stop), and the bytes of the first and the last that lie outside of it.

    Both borders are found by binary search in the sorted token offsets. An empty span has no tokens.
    """
    begin, end = np.array(spans, np.int64).reshape(-1, 2).T
    starts = np.concatenate([[0], ends[:-1]])
    first, stop = np.searchsorted(ends, begin, "right"), np.searchsorted(starts, end, "left")
    return [(int(f), int(s), int(b - starts[f]), int(ends[s - 1] - e)) if b < e else (int(f), int(f), 0, 0) for f, s, b, e in zip(first, stop, begin, end)]


def formatted(rows: DataFrame, path: str | None = None, loss_role: str = "assistant", chars: int = 1 << 20) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as stored segments: text, ids and, for each turn of `loss_role`, the masked tokens.

    Turns are rendered by column expressions, dealt by ranges of (conv_id, turn) and sorted there, so a conversation that holds
    a third of all rows is spread over tasks. A task renders each conversation whole and encodes it once; only where a range
    ends, or beyond `chars` characters, a conversation goes on in another segment. Segments begin with a turn, where the
    tokenizer always cuts, so their ids in order are those of the whole. `edge` marks conversations that may have several.

    Turns go by number, nulls first; ties by role, then text; repeated rows all count. Null role or text is empty; null conv_id is a
    conversation of its own. Extra columns are ignored. No rows in, no rows out.
    """
    path = path or default_path()
    role, text = whole(F.col("role")), whole(F.col("text"))
    turns = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    turns = turns.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id", (F.col("role") == loss_role).alias("loss"), F.concat(F.lit(HEAD), role_line(F.col("role")), F.lit(END_HEAD)).alias("head"), escaped(F.col("text")).alias("body")
    )

    def segment(conv, k, edge, pieces, spans, made):
        text = "".join(pieces)
        ids, ends = codec(path).encode(text)
        made.append((conv, TaskContext.get().partitionId(), k, edge, text, ids, masked(spans, ends)))

    def batch(made):
        conv, task, k, edge, texts, ids, loss = zip(*made)
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
        kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("first", "stop", "lead", "tail")]))
        loss = pa.array([[dict(zip(("first", "stop", "lead", "tail"), m)) for m in ms] for ms in loss], kind)
        columns = [pa.array(conv, pa.int64()), pa.array(task, pa.int32()), pa.array(k, pa.int32()), pa.array(edge, pa.bool_()), pa.array(texts, pa.string()), ids, loss]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "task", "k", "edge", "text", "ids", "loss"])

    def render(batches):
        now, pieces, spans, size, chars_now, k, edge, made, weight = object(), [], [], 0, 0, 0, True, [], 0
        for b in batches:
            for conv, loss, head, body in zip(*(c.to_pylist() for c in b.columns)):
                if pieces and (conv != now or chars_now > chars):
                    edge = edge or conv == now
                    segment(now, k, edge, pieces, spans, made)
                    weight += chars_now
                    k, edge = (k + 1, True) if conv == now else (0, False)
                    pieces, spans, size, chars_now = [], [], 0, 0
                    if weight > 1 << 22:
                        yield batch(made)
                        made, weight = [], 0
                now = conv
                at, length = size + len(head.encode()), len(body.encode())
                if loss:
                    spans.append((at, at + length))
                pieces += [head, body, FOOT]
                size, chars_now = at + length + len(FOOT), chars_now + len(head) + len(body) + len(FOOT)
        if pieces:
            segment(now, k, True, pieces, spans, made)
            yield batch(made)

    return settle(turns.mapInArrow(render, SEGMENT), "chat-formatted")


def read_back(segments: DataFrame, path: str | None = None) -> DataFrame:
    """What the stored conversations hold, one row each: turns parsed from the text, loss text decoded from the masked tokens.

    Conversations of one segment are read where they lie. The others, at most two a task of `formatted` and the very long
    ones, meet by conv_id and stream through in order, so no task holds one whole (a digest of a conversation has to
    see its turns one after the other). A text that the template does not give is an error.
    """
    path = path or default_path()

    def digests(batches):
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        state, done = None, []
        for b in batches:
            vocabulary = codec(path).bytes
            text_at, ids_at = b.column(1), b.column(2)
            for i, (conv, loss) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist())):
                if state is None or conv != state[0]:
                    if state is not None:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                text, at = text_at[i].as_py(), 0
                for m in _TURN.finditer(text):
                    if m.start() != at:
                        raise ValueError(f"conversation {conv} is not of the template's form")
                    at = m.end()
                    state[1] += 1
                    state[2].update(f"{role_of(m[1])}\n{unescaped(m[2])}\n".encode())
                if at != len(text):
                    raise ValueError(f"conversation {conv} is not of the template's form")
                ids = ids_at[i].values.to_numpy()
                for m in loss:
                    said = b"".join([vocabulary[t] for t in ids[m["first"] : m["stop"]].tolist()])
                    said = unescaped(said[m["lead"] : len(said) - m["tail"]].decode())
                    state[3] += len(said)
                    state[4].update(said.encode())
                    state[7] += m["stop"] - m["first"]
                state[5] += len(text)
                state[6] += len(ids)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, [x.hexdigest() if hasattr(x, "hexdigest") else x for x in s])) for s in done], out)
                done = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, [x.hexdigest() if hasattr(x, "hexdigest") else x for x in state]))], out)

    out = pa.schema([(n, pa.string() if kind == "string" else pa.int64()) for n, kind in (c.split() for c in DIGESTS.split(", "))])
    columns = ["conv_id", "text", "ids", "loss"]
    alone = segments.filter(~F.col("edge")).select(columns)
    apart = segments.filter("edge").repartition("conv_id").sortWithinPartitions("conv_id", "task", "k").select(columns)
    return alone.mapInArrow(digests, DIGESTS).unionByName(apart.mapInArrow(digests, DIGESTS))


def chat_round_trip(rows: DataFrame, path: str | None = None) -> DataFrame:
    """`read_back` of `formatted`: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    return read_back(formatted(rows, path), path).drop("n_tokens", "loss_tokens")
