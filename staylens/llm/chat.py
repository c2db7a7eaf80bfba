"""Chat formatting: turns of a conversation assembled column-wise into one text, with a loss mask, and read back.

    <s>[INST]role
    text[/INST][INST]role
    text[/INST]</s>

A control string inside a role or text gets a backslash after its first sign (one more, if it has some), so it is no
longer one and can be restored; a role's line ends and backslashes are written \\n and \\\\.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field

BEGIN, OPEN, MIDDLE, CLOSE, END = b"<s>", b"[INST]", b"\n", b"[/INST]", b"</s>"
#: A control string, or one that was escaped.
CONTROL = r"(\[|<)(\\*)(/?INST\]|/?s>)"
_ESCAPED = re.compile(r"(\[|<)\\(\\*)(/?INST\]|/?s>)")


def _escape(text: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(text, ""), CONTROL, r"\1\\\2\3")


def _escape_role(role: pa.Array) -> pa.Array:
    role = pc.replace_substring(pc.fill_null(role, ""), "\\", "\\\\")
    return _escape(pc.replace_substring(role, "\n", "\\n"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Start and bytes of a string column."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    return starts, np.frombuffer(data or b"", np.uint8)


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray, learn: str) -> tuple[pa.Array, pa.Array]:
    """Formatted conversations and the byte spans of texts whose role is `learn`. first: rows at which conversations begin.

    The lengths of all segments give their offsets; constant and variable segments are scattered into one buffer.
    """
    n = len(texts)
    role_at, role_bytes = _parts(_escape_role(roles))
    text_at, text_bytes = _parts(_escape(texts))
    role_size, text_size = np.diff(role_at), np.diff(text_at)
    opens, closes = np.zeros(n, np.int64), np.zeros(n, np.int64)
    opens[first] = len(BEGIN)
    last = np.append(first[1:], n) - 1
    closes[last] = len(END)
    row_size = opens + len(OPEN) + role_size + len(MIDDLE) + text_size + len(CLOSE) + closes
    row_at = np.cumsum(row_size) - row_size
    out = np.empty(int(row_size.sum()), np.uint8)

    def constant(piece: bytes, at: np.ndarray) -> None:
        out[at[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)

    def variable(data: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> None:
        shift = np.repeat(at - start, size)
        source = np.arange(len(shift)) + start[0]
        out[source + shift] = data[source]

    constant(BEGIN, row_at[first])
    at = row_at + opens
    constant(OPEN, at)
    at = at + len(OPEN)
    variable(role_bytes, role_at[:-1], role_size, at)
    at = at + role_size
    constant(MIDDLE, at)
    text_to = at + len(MIDDLE)
    variable(text_bytes, text_at[:-1], text_size, text_to)
    at = text_to + text_size
    constant(CLOSE, at)
    constant(END, (at + len(CLOSE))[last])

    offsets = np.append(row_at[first], len(out))
    formatted = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.large_string())
    taught = pc.fill_null(pc.equal(roles, learn), False).to_numpy(zero_copy_only=False)
    base = np.repeat(row_at[first], np.diff(np.append(first, n)))
    spans = pa.StructArray.from_arrays([pa.array(x[taught], pa.int64()) for x in (text_to - base, text_to + text_size - base)], ["start", "end"])
    cut = np.concatenate([[0], np.cumsum(np.add.reduceat(taught.astype(np.int64), first))]).astype(np.int32)
    return formatted.cast(pa.string()), pa.ListArray.from_arrays(cut, spans)


def _format(learn: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def made() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        roles, texts = (rows.column(x).combine_chunks() if rows.column(x).num_chunks != 1 else rows.column(x).chunk(0) for x in ("role", "text"))
        keys = rows.column("conv_id").to_pylist()
        first = np.array([i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]], np.int64)
        formatted, spans = assemble(roles, texts, first, learn)
        ids = rows.column("conv_id").take(pa.array(first)).combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(np.append(first, len(keys))), pa.int64()), formatted, spans], ["conv_id", "n_turns", "formatted", "loss_spans"])

    for batch in batches:
        keys = batch.column("conv_id").to_pylist()
        if not keys:
            continue
        cut = len(keys) - 1  # the last conversation may go on in the next batch
        while cut and keys[cut - 1] == keys[-1]:
            cut -= 1
        if cut or held and held[-1].column("conv_id")[0].as_py() != keys[0]:
            held.append(batch.slice(0, cut))
            held = [x for x in held if x.num_rows]
            yield from made()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from made()


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted and loss_spans (byte ranges of the texts to learn from).

    turns has conv_id, turn, role and text; further columns are left alone. Turns stand in order of turn, then role and
    text; nulls come first. A null role or text is empty, rows of a null conv_id are one conversation, repeated rows are
    repeated turns, an empty table gives no rows. A conversation is one value, so it has to fit a worker; a partition
    is streamed in sorted batches and holds one batch and one unfinished conversation at a time.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    schema = T.StructType([field(turns, "conv_id"), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(lambda it: _format(learn, it), schema)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    inner = formatted[len(BEGIN) : -len(END)]
    out = []
    for turn in inner.split(OPEN.decode())[1:]:
        role, _, text = turn.removesuffix(CLOSE.decode()).partition("\n")
        out.append((unescape_role(role), unescape(text)))
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
            turns = read_back(text)
            data = text.encode()
            learnt = "".join(unescape(data[s["start"] : s["end"]].decode()) for s in spans)
            told = "".join(f"{role}\n{t}\n" for role, t in turns)
            rows.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the result of format_chats(): digests of its turns and of the text under its mask."""
    schema = T.StructType([field(formatted, "conv_id"), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_digests, schema)


def with_example(turns: DataFrame) -> DataFrame:
    """The turns and conversation -1, whose texts look like control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    more = turns.sparkSession.range(2).select(F.lit(-1).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(more)
