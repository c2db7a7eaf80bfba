"""Token ids in sorted-string-table shards, keyed by document.

A shard holds documents in ascending doc_id order: data blocks with prefix-compressed keys, an index of each block's
first key, a Bloom filter of the keys, and a footer of fixed size that tells where these lie. A key is the doc_id as
eight big-endian bytes with the sign turned, so that bytes sort as numbers do; a null doc_id has the empty key and
comes first. Looking a document up reads the footer, index and filter, bisects the index and scans one block.
"""

from __future__ import annotations

import functools
import struct
import unicodedata
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import pieces, shared_folder, write_shared

MAGIC = b"SSTOKEN1"
_FOOTER = struct.Struct("<QQQQQQQII8s")  # index at, size; filter at, size; documents, ids, bytes of an id; crc of index, of filter
_BLOCK_BYTES = 64 << 10
_RESTART = 16
#: Words, letter runs and sign runs that a worker keeps, each.
_CACHE = 500_000
#: A word of signs, letters and signs; an apostrophe before letters may belong to them.
_PARTS = r"^(?P<head>[!-&(-/:-@\[-`{-~]*)(?P<base>\pL+)(?P<tail>[!-/:-@\[-`{-~]*)$"
#: Letters below have had one normal form, lower case and class in all versions of Unicode that matter.
_STEADY = "\u0600"


def _strings(column: pa.Array) -> list[str | None]:
    return column.to_numpy(zero_copy_only=False).tolist()


@functools.cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class WordEncoder:
    """The tokenizers library behind a cache of words.

    The vocabulary's pre-tokeniser drops white space and never joins across it, so a text's ids are those of its words.
    A word of signs, letters and signs is three pre-tokens if the letters are letters still after the vocabulary's
    normaliser (NFC, then lower case); its letters go to the library in their normal form, many at a time, and a token
    that ends a word says where to cut. All other words go to the library as they stand.
    """

    def __init__(self, path: str):
        self.model, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = None
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.width = np.dtype("<u2") if len(self.ends) <= 1 << 16 else np.dtype("<u4")
        self.kept: dict[str, bytes] = {"": b""}
        self.letters: dict[str, bytes | None] = {}
        self.signs: dict[str, bytes] = {"": b""}

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes | None]:
        """Ids of words in normal form; None where a word is not one pre-token."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.width)
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) == len(words) and cut[-1] == len(ids):
            data, at = ids.tobytes(), [0, *(cut * self.width.itemsize).tolist()]
            return [data[i:j] for i, j in pairwise(at)]
        return self._together(words[: len(words) // 2]) + self._together(words[len(words) // 2 :]) if len(words) > 1 else [None]

    @staticmethod
    def _normal(base: str) -> str | None:
        """The letters after the normaliser; None if they may not be letters to the library then."""
        if base.isascii():
            return base.lower()
        normal = unicodedata.normalize("NFC", base)
        low = normal.lower()
        # a sigma's lower case depends on its place in Python, not in the library
        return low if low.isalpha() and max(low) < _STEADY and "\u03a3" not in normal else None

    def _learn(self, words: list[str]) -> list[bytes]:
        if len(self.letters) > _CACHE:
            self.letters = {}
        if len(self.signs) > _CACHE:
            self.signs = {"": b""}
        column = pa.array(words, pa.string())
        parts = pc.extract_regex(column, _PARTS)
        parts = pc.if_else(pc.match_substring(column, "<|"), None, parts)  # may begin the name of a special token
        base = pc.struct_field(parts, "base").dictionary_encode()
        normal = list(map(self._normal, _strings(base.dictionary)))
        fresh = sorted({x for x in normal if x is not None} - self.letters.keys())
        for i in range(0, len(fresh), 4096):
            some = fresh[i : i + 4096]
            self.letters.update(zip(some, self._together(some), strict=True))
        learnt = [None if x is None else self.letters[x] for x in normal]
        heads, tails = (_strings(pc.struct_field(parts, x)) for x in ("head", "tail"))
        signs = list(({*heads, *tails} - {None}) - self.signs.keys())
        self.signs.update(zip(signs, self._alone(signs), strict=True))
        sign = self.signs
        at = pc.fill_null(base.indices, -1).to_numpy().tolist()
        learnt.append(None)  # what is not made so
        got = [None if (x := learnt[i]) is None else sign[h] + x + sign[t] for h, i, t in zip(heads, at, tails, strict=True)]
        rest = iter(self._alone([w for w, x in zip(words, got, strict=True) if x is None]))
        return [next(rest) if x is None else x for x in got]

    def _ids(self, words: list[str]) -> list[bytes]:
        got = list(map(self.kept.get, words))
        unknown = [w for w, x in zip(words, got, strict=True) if x is None]
        if unknown:
            new = self._learn(unknown)
            if len(self.kept) + len(new) > _CACHE:
                self.kept = {"": b""} | {w: x for w, x in zip(words, got, strict=True) if x is not None}
            self.kept.update(zip(unknown, new, strict=True))
            rest = iter(new)
            got = [next(rest) if x is None else x for x in got]
        return got

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian integers of self.width; a null has none. Each distinct word is looked up once."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        ids = self._ids(_strings(coded.dictionary))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width.itemsize
        at = coded.indices.to_numpy()
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        place = np.repeat(((np.cumsum(size) - size)[at] - ends[:-1]).astype(kind), n)
        place += np.arange(ends[-1], dtype=kind)
        flat = np.frombuffer(b"".join(ids), self.width).take(place)
        return [flat[i:j].tobytes() for i, j in pairwise(ends[split.offsets.to_numpy()].tolist())]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """encode_column() of a list of texts in UTF-8."""
        return self.encode_column(pa.array(texts, pa.binary()).cast(pa.string()))


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _shared_prefix(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(7)]


def bloom(keys: list[bytes]) -> bytes:
    """Ten bits a key, seven probes."""
    bits = max(64, 10 * len(keys))
    out = np.zeros(-(-bits // 8) * 8, np.uint8)  # one byte a bit until packed; a shard's documents are bounded
    for k in keys:
        out[_probes(k, bits)] = 1
    return struct.pack("<Q", bits) + np.packbits(out, bitorder="little").tobytes()


class ShardWriter:
    """Appends documents in key order; close() writes index, filter and footer."""

    def __init__(self, out, width: np.dtype):
        self.out, self.width, self.at = out, width, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.n_ids = 0
        self.zip = zstandard.ZstdCompressor(3)
        self._new()

    def _new(self) -> None:
        self.block, self.restarts, self.n, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, ids: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys out of order")
        if self.n % _RESTART == 0:
            self.restarts.append(len(self.block))
            same = 0
            if not self.n:
                self.first = key
        else:
            same = _shared_prefix(self.last, key)
        self.block += _varint(same) + _varint(len(key) - same) + _varint(len(ids)) + key[same:] + ids
        self.keys.append(key)
        self.last, self.n, self.n_ids = key, self.n + 1, self.n_ids + len(ids) // self.width.itemsize
        if len(self.block) >= _BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.n:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            data = self.zip.compress(raw)
            data += struct.pack("<I", zlib.crc32(data))
            self.out.write(data)
            self.index.append((self.first, self.at, len(data)))
            self.at += len(data)
            self._new()

    def close(self) -> int:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQ", a, n) for k, a, n in self.index)
        told = bloom(self.keys)
        foot = _FOOTER.pack(self.at, len(index), self.at + len(index), len(told), len(self.keys), self.n_ids, self.width.itemsize, zlib.crc32(index), zlib.crc32(told), MAGIC)
        self.out.write(index + told + foot)
        return self.at + len(index) + len(told) + len(foot)


class Shard:
    """Reads a shard through an object with size() and read_at(n, at), such as an Arrow file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        foot = bytes(file.read_at(_FOOTER.size, size - _FOOTER.size)) if size >= _FOOTER.size else b""
        if foot[-8:] != MAGIC:
            raise ValueError("not a shard, or cut off")
        index_at, index_size, told_at, told_size, self.n_docs, self.n_ids, width, index_crc, told_crc, _ = _FOOTER.unpack(foot)
        self.width = np.dtype(f"<u{width}")
        index, self.told = bytes(file.read_at(index_size, index_at)), bytes(file.read_at(told_size, told_at))
        if zlib.crc32(index) != index_crc or zlib.crc32(self.told) != told_crc:
            raise ValueError("index or filter is damaged")
        self.firsts, self.blocks, i = [], [], 0
        while i < len(index):
            n = index[i]
            self.firsts.append(index[i + 1 : i + 1 + n])
            self.blocks.append(struct.unpack_from("<QQ", index, i + 1 + n))
            i += 17 + n

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        at, size = self.blocks[k]
        data = bytes(self.file.read_at(size, at))
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("block is damaged")
        raw = zstandard.ZstdDecompressor().decompress(data[:-4])
        stop = len(raw) - 4 - 4 * struct.unpack("<I", raw[-4:])[0]
        i, key = 0, b""
        while i < stop:
            got = []
            for _ in range(3):
                n = shift = 0
                while True:
                    b = raw[i]
                    i += 1
                    n |= (b & 127) << shift
                    shift += 7
                    if b < 128:
                        break
                got.append(n)
            same, rest, size = got
            key = key[:same] + raw[i : i + rest]
            i += rest
            yield key, raw[i : i + size]
            i += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def may_have(self, key: bytes) -> bool:
        bits = struct.unpack_from("<Q", self.told)[0]
        return all(self.told[8 + (p >> 3)] >> (p & 7) & 1 for p in _probes(key, bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document of that doc_id."""
        key, out = key_of(doc_id), []
        if not self.blocks or not self.may_have(key):
            return out
        k = max(0, bisect_right(self.firsts, key) - 1)
        while k and self.firsts[k] == key:  # repeated keys may begin in an earlier block
            k -= 1
        for j in range(k, len(self.blocks)):
            if self.firsts[j] > key:
                break
            out += [np.frombuffer(v, self.width) for x, v in self.block(j) if x == key]
        return out


def _filed(folder: str, path: str, end_id: int, most_bytes: int, most_docs: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write the documents of a partition to shards of about most_bytes; a shard gets its name when it is whole."""
    fs, base = pafs.FileSystem.from_uri(folder)
    part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
    coder, shard, done = _encoder(path), None, []
    tail = np.array([end_id], coder.width).tobytes()

    def close() -> None:
        size = shard.close()
        shard.out.close()
        name = f"{base}/part-{part:06d}-{len(done):06d}-{attempt}.sst"
        fs.move(f"{base}/.{attempt}", name)
        done.append((name, part, len(done), len(shard.keys), shard.n_ids, size))

    for whole in batches:
        for batch in pieces(whole, "text"):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode_column(batch.column("text")), strict=True):
                if shard is None:
                    shard = ShardWriter(fs.open_output_stream(f"{base}/.{attempt}", compression=None), coder.width)
                shard.add(key_of(doc_id), ids + tail)
                if shard.at >= most_bytes or len(shard.keys) >= most_docs:
                    close()
                    shard = None
    if shard is not None:
        close()
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.string(), *[pa.int64()] * 5))], ["path", "part", "place", "n_docs", "n_ids", "n_bytes"])


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = 2, most_bytes: int = 64 << 20, most_docs: int = 1_000_000) -> DataFrame:
    """Encode every text and write shards in ascending order of doc_id; returns path, part, place, n_docs, n_ids, n_bytes of each.

    docs has doc_id (whole numbers) and text; further columns are left alone. Null and empty texts have the end id
    alone; null doc_ids come first; rows of one doc_id stand in order of the first 16 characters of their texts, then
    of a digest; repeated rows each have their ids. Rows are dealt out by ranges of these and the row number, so the
    rows without a doc_id, or with one, are no single task however many there are. A range's shards (numbered by place) begin anew at most_bytes or
    most_docs and precede those of the next range; an empty table gives no shard. path is the vocabulary, a file that
    the workers can read. The table that is returned writes when it is read, so write it down once.
    """
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.substring("text", 1, 16).alias("_head"), F.xxhash64("text").alias("_digest")).withColumn("_row", F.monotonically_increasing_id())
    order = ("doc_id", "_head", "_digest", "_row")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(lambda it: _filed(folder, path, end_id, most_bytes, most_docs, it), "path string, part long, place long, n_docs long, n_ids long, n_bytes long")


_READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def _read(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, _ = pafs.FileSystem.from_uri(folder)
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            with fs.open_input_file(path) as file:
                shard = Shard(file)
                for k in range(len(shard.blocks)):
                    keys, values = zip(*shard.block(k), strict=True)
                    ids = [np.frombuffer(v, shard.width).astype("<u4").tobytes() for v in values]
                    n = np.array([len(x) // 4 for x in ids], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([id_of(x) for x in keys], pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(ids, pa.binary())], _READ.names)
                    start += int(n.sum())


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of each document.

    manifest is what write_shards() returned, written down; the ids before each shard are summed over it, a row for
    each shard. Without a shard there are no rows; null doc_ids and repeated rows come back as they were written.
    """
    before = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("start"))
    return files.repartition(max(1, min(manifest.count(), 100_000)), "path").mapInArrow(lambda it: _read(folder, it), _READ)


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the documents to shards in the shared folder and read those back; see write_shards() and read_shards()."""
    folder = shared_folder(docs.sparkSession)
    return read_shards(write_shared(write_shards(docs, path, folder, end_id)), folder)
