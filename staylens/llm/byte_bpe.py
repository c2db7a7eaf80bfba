"""Byte-level BPE: pre-token boundaries by an associative scan of transition functions, cached pair merging, decoding.

A text is an array of codepoints, each mapped to one of eleven symbols by class arrays and the classes of its
neighbours. An automaton of eight states says where a pre-token begins. The functions that strings of symbols work on
its states form a small monoid; composing them is associative, so the state before each codepoint comes from a blocked
prefix scan over table look-ups, without a loop over codepoints and without a regular expression.
"""

from __future__ import annotations

import base64
import functools
import heapq
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import field, lists, pieces, str_texts

# States: after a token that nothing joins, in letters, in digits, in other signs, after a space that the next run joins, in white space, one or two letters of a contraction to come.
_E, _L, _N, _O, _P, _W, _C1, _C2 = range(8)
# Symbols: letter, digit, other, apostrophe with one or two letters of a contraction after it, space or other white space before white space or the end, the same before anything else, start of a text.
_SL, _SN, _SO, _SA1, _SA2, _SPM, _SWM, _SPL, _SWL, _RESET = range(10)
#: Fixed: codepoints that \s matches.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BLOCK = 128
_CACHE = 400_000
_SLICE = 1 << 20
_NEVER = 1 << 62


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token begins at this codepoint."""
    if symbol == _RESET:
        return _E, True
    if symbol == _SL:
        if state in (_C1, _C2):
            return (_E if state == _C1 else _C1), False
        return _L, state not in (_L, _P)
    if symbol == _SN:
        return _N, state not in (_N, _P)
    if symbol in (_SO, _SA1, _SA2):
        if state in (_O, _P) or symbol == _SO:
            return _O, state not in (_O, _P)
        return (_C1 if symbol == _SA1 else _C2), True
    if symbol in (_SPM, _SWM):
        return _W, state != _W
    return (_P if symbol == _SPL else _E), True


@functools.cache
def _tables() -> tuple[np.ndarray, ...]:
    """Class of each codepoint; composition, state after and generator of the monoid; begin by state and symbol."""
    kind = np.full(0x110000, _SO, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            kind[c] = _SL if k == "L" else _SN
    kind[_WHITE] = _SWM
    kind[0x20] = _SPM
    gens = [tuple(_step(s, x)[0] for s in range(8)) for x in range(10)]
    seen = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *gens]))}
    todo = list(seen)
    while todo:
        f = todo.pop()
        for g in gens:
            if (h := tuple(g[s] for s in f)) not in seen:
                seen[h] = len(seen)
                todo.append(h)
    every = list(seen)
    compose = np.array([[seen[tuple(g[s] for s in f)] for g in every] for f in every], np.uint8)
    begins = np.array([[_step(s, x)[1] for x in range(10)] for s in range(8)], bool)
    return kind, compose, np.array(every, np.uint8), np.array([seen[g] for g in gens], np.uint8), begins


def _scan(f: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Exclusive prefix composition: blocks side by side, one step for each place in a block, then the blocks' totals."""
    n = len(f)
    if n <= _BLOCK:
        out = np.zeros(n, np.uint8)
        for i in range(1, n):
            out[i] = compose[out[i - 1], f[i - 1]]
        return out
    rows = -(-n // _BLOCK)
    padded = np.zeros(rows * _BLOCK, np.uint8)  # 0 is the identity
    padded[:n] = f
    by_place = np.ascontiguousarray(padded.reshape(rows, _BLOCK).T)
    before = np.empty_like(by_place)
    flat, width, held = compose.ravel(), np.uint16(len(compose)), np.zeros(rows, np.uint8)
    for i in range(_BLOCK):
        before[i] = held
        held = flat[held * width + by_place[i]]
    lead = _scan(held, compose)
    return flat[(lead * width)[None, :] + before].T.reshape(-1)[:n]


def boundaries(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in UTF-8, byte start and end of each pre-token, and the number of pre-tokens of each text."""
    kind, compose, after, generator, begins = _tables()
    joined = "".join("\n" + x for x in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sym = kind[points]
    solid = np.append((sym[1:] != _SPM) & (sym[1:] != _SWM), False)
    sym[solid & (sym == _SPM)] = _SPL
    sym[solid & (sym == _SWM)] = _SWL
    quote = np.flatnonzero(points[:-2] == 0x27)
    a, b = points[quote + 1], points[quote + 2]
    sym[quote[np.isin(a, [ord(x) for x in "stmd"])]] = _SA1
    sym[quote[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = _SA2
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    marks = np.append(np.cumsum(sizes) - sizes, len(points) - 1)
    sym[marks] = _RESET
    before = _scan(generator[sym], compose)
    start = np.flatnonzero(begins[after[:, _E]].ravel()[before * np.uint16(10) + sym])
    raw = joined.encode()
    at = start
    if len(raw) != len(points):  # a byte that doesn't continue a codepoint begins one
        at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[start]
    real = np.ones(len(start), bool)
    real[np.searchsorted(start, marks)] = False
    keep = np.flatnonzero(real)
    counts = np.diff(np.searchsorted(start[keep], marks))
    return raw, at[keep], at[keep + 1], counts


class Merger:
    """Pre-token bytes to its ids as little-endian 32-bit integers; what is asked for is kept, up to a number of entries."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.kept: dict[bytes, bytes] = {}

    def look_up(self, wanted: list[bytes]) -> list[bytes]:
        got = list(map(self.kept.get, wanted))
        if None in got:
            new = {x: self.ids(x) for x in {x for x, y in zip(wanted, got, strict=True) if y is None}}
            got = [new[x] if y is None else y for x, y in zip(wanted, got, strict=True)]
            if len(self.kept) + len(new) > _CACHE:
                self.kept.clear()
            self.kept.update((x, y) for x, y in new.items() if len(x) <= 64)
        return got

    def ids(self, piece: bytes) -> bytes:
        whole = self.ranks.get(piece)
        found = [whole] if whole is not None else self.merge_short(piece) if len(piece) <= 40 else self.merge(piece)
        return struct.pack(f"<{len(found)}I", *found)

    def merge_short(self, piece: bytes) -> list[int]:
        """The same as merge() without a heap, which is faster for few parts."""
        rank = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank.get(piece[i : i + 2], _NEVER) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) != _NEVER:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank.get(parts[i] + parts[i + 1], _NEVER)
            if i:
                pairs[i - 1] = rank.get(parts[i - 1] + parts[i], _NEVER)
        return [rank[x] for x in parts]

    def merge(self, piece: bytes) -> list[int]:
        """Join the pair of lowest rank, leftmost first, until none is left: a heap over linked parts."""
        rank, n = self.ranks, len(piece)
        end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = right[i]
            if j >= n or end[i] == 0 or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := rank.get(piece[i : end[right[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[right[i]]))
            if (h := left[i]) >= 0 and (r := rank.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = right[i]
        return out


@functools.cache
def merger(path: str) -> Merger:
    """One for each worker process and vocabulary, so that its cache outlives a task."""
    return Merger(path)


@functools.cache
def _spelling(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, with start and length by id."""
    spelled = {i: b for b, i in merger(path).ranks.items()}
    top = max(spelled, default=-1) + 1
    size = np.array([len(spelled.get(i, b"")) for i in range(top)], np.int64)
    return np.frombuffer(b"".join(spelled.get(i, b"") for i in range(top)), np.uint8), np.cumsum(size) - size, size


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and the number of ids of each text."""
    known = merger(path)
    raw, start, end, counts = boundaries(texts)
    got = known.look_up([raw[a:b] for a, b in zip(start.tolist(), end.tolist())])  # noqa: B905
    size = np.fromiter(map(len, got), np.int64, len(got)) // 4
    total = np.concatenate([[0], np.cumsum(size)])
    cut = np.concatenate([[0], np.cumsum(counts)])
    return np.frombuffer(b"".join(got), "<u4").astype(np.int32), np.diff(total[cut])


def _encode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = _spelling(path)[2]
    for whole in batches:
        for batch in pieces(whole, "text", _SLICE):
            ids, counts = encode_texts(str_texts(batch.column(1)), path)
            ends = np.cumsum(size[ids])
            first = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])[:-1]]
            ends = (ends - np.repeat(first, counts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(ids, counts, pa.int32()), lists(ends, counts, pa.int32())], ["doc_id", "ids", "ends"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and ends (the byte offset in the UTF-8 text at which each token ends) for each row of docs.

    docs has doc_id and text; further columns are left alone. Null and empty texts have no ids, null doc_ids stay null,
    repeated rows each give a row. path: a file of ranks that the workers can read. A text of any length is taken
    whole; the work needs memory in proportion to the longest text or 1 MB, whichever is more.
    """
    docs = docs.select("doc_id", "text")
    schema = T.StructType([field(docs, "doc_id"), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(lambda it: _encode(path, it), schema)


def decode_ids(ids: np.ndarray, counts: np.ndarray, ends: np.ndarray, path: str) -> pa.Array:
    """The bytes of each text, written into one buffer at the offsets that encoding kept."""
    spelled, where, size = _spelling(path)
    cut = np.concatenate([[0], np.cumsum(counts)])
    some = counts > 0
    totals = np.zeros(len(counts), np.int64)
    totals[some] = ends[cut[1:][some] - 1]
    offsets = np.concatenate([[0], np.cumsum(totals)])
    if np.any(size[ids] <= 0) or np.any(np.diff(np.concatenate([[0], np.cumsum(size[ids])])[cut]) != totals):
        raise ValueError("ids and offsets do not belong together")
    width = size[ids]
    to = ends + np.repeat(offsets[:-1], counts) - width
    out = spelled[np.repeat(where[ids] - to, width) + np.arange(int(offsets[-1]))]
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def _decode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 1000):
            batch = whole.slice(i, 1000)
            counts = np.diff(batch.column("ids").offsets.to_numpy())
            ids, ends = (batch.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("ids", "ends"))
            yield pa.RecordBatch.from_arrays([*batch.columns, decode_ids(ids, counts, ends.astype(np.int64), path)], [*batch.schema.names, "decoded"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `decoded`, the bytes that ids spell, to the result of encode()."""
    return encoded.mapInArrow(lambda it: _decode(path, it), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """decode(encode(docs)) in one Python worker, so that ids are not sent out and back in between."""
    docs = docs.select("doc_id", "text")
    schema = T.StructType([field(docs, "doc_id"), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return docs.mapInArrow(lambda it: _decode(path, _encode(path, it)), schema)
