"""URL filters over a sorted digest array.

A list entry is a host and a path in one string, like example.com/en/. The 64-bit xxhash of every entry goes to files of
sorted digests, followed by the entries themselves, one file for each range of hashes; tasks build them from a sorted
exchange. A list of one file is shipped to each executor once and mapped into memory, so its pages are shared by all
workers of a machine; of a longer list each task maps the file of its range, and the candidates are dealt out by range. A
URL's candidates (its host and every parent domain, with the path cut to each length that the list has) are hashed and
found by a vectorised binary search; the stored string is compared before an entry counts, so a collision can't decide.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw_texts, shared_folder, write_shared

#: Host and path after the first "://".
PARTS = r"(?s)^.*?://(?P<host>[^/?#]*)(?P<path>[^?#]*)"
_VERDICTS = ("allow", "block")


def hashed(strings: list[bytes]) -> np.ndarray:
    """64-bit xxhash of each string, as signed integers."""
    return np.array([xxhash.xxh64_intdigest(x) for x in strings], np.uint64).view(np.int64)


def write_digests(entries: dict[bytes, str], path: str) -> None:
    """Write a small list to one file."""
    strings = list(entries)
    keys = hashed(strings)
    order = np.argsort(keys, kind="stable")
    with open(path, "wb") as f:
        _write(f, keys[order], [strings[i] for i in order], np.array([_VERDICTS.index(entries[strings[i]]) for i in order], np.uint8))


def _write(out, keys: np.ndarray, strings: list[bytes], verdicts: np.ndarray) -> None:
    """Number of entries, sorted digests, where each entry's string begins, verdicts, and the strings."""
    out.write(np.array([len(keys)], np.int64).tobytes())
    out.write(keys.tobytes())
    out.write(np.cumsum([0, *map(len, strings)], dtype=np.int64).tobytes())
    out.write(verdicts.tobytes())
    out.write(b"".join(strings))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the digest of its entry."""
    for batch in batches:
        made = pa.array(hashed(raw_texts(batch.column("entry"))), pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "digest"])


def with_digest(entries: DataFrame) -> DataFrame:
    """entries with the column digest."""
    return entries.mapInArrow(_digests, T.StructType([*entries.schema.fields, T.StructField("digest", T.LongType())]))


def _range(bits: int) -> Column:
    return F.shiftrightunsigned("digest", 64 - bits).cast("int") if bits else F.lit(0)


def _filed(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write each range of a partition (rows in order of range and digest) to a file; it gets its name when it is whole."""
    fs, base = pafs.FileSystem.from_uri(folder)
    held: list[pa.RecordBatch] = []

    def close() -> tuple[str, int]:
        rows = pa.Table.from_batches(held).combine_chunks()
        at, name = int(rows.column("range")[0].as_py()), uuid.uuid4().hex
        with fs.open_output_stream(f"{base}/.{name}", compression=None) as out:
            _write(out, rows.column("digest").to_numpy(), raw_texts(rows.column("entry").combine_chunks()), rows.column("blocks").to_numpy().astype(np.uint8))
        fs.move(f"{base}/.{name}", f"{base}/digests-{name}")
        held.clear()
        return f"digests-{name}", at

    done = []
    for batch in batches:
        at = batch.column("range").to_numpy()
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
            if not len(part):
                continue
            if held and held[-1].column("range")[-1].as_py() != at[part[0]]:
                done.append(close())
            held.append(batch.slice(int(part[0]), len(part)))
    if held:
        done.append(close())
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.string(), pa.int32()))], ["name", "range"])


class Digests:
    """A file of sorted digests, by its path (mapped into memory) or its bytes."""

    def __init__(self, file: str | np.ndarray):
        data = file if isinstance(file, np.ndarray) else np.memmap(file, np.uint8, "r")
        n = int(data[:8].view(np.int64)[0])
        self.keys = data[8 : 8 + 8 * n].view(np.int64)
        self.ends = data[8 + 8 * n : 16 + 16 * n].view(np.int64)
        self.verdicts = data[16 + 16 * n : 16 + 17 * n]
        self.strings = data[16 + 17 * n :]

    def find(self, wanted: list[bytes]) -> np.ndarray:
        """Entry number of each string, or -1."""
        out = np.full(len(wanted), -1, np.int64)
        asked = hashed(wanted)
        at = np.searchsorted(self.keys, asked)
        todo = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == asked)) if len(self.keys) else []
        for i in todo:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == asked[i]:
                if self.strings[self.ends[k] : self.ends[k + 1]].tobytes() == wanted[i]:
                    out[i] = k
                    break
                k += 1
        return out


@functools.lru_cache(4)
def _mapped(name: str) -> Digests:
    return Digests(SparkFiles.get(name))


@functools.lru_cache(1)
def _opened(folder: str, name: str) -> Digests:
    fs, base = pafs.FileSystem.from_uri(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        return Digests(f"{base}/{name}")
    with fs.open_input_file(f"{base}/{name}") as f:
        return Digests(np.frombuffer(f.read(), np.uint8))


def split_url(urls: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Host, A-Z lower-cased, and path; empty where a URL is null or has no ://."""
    found = pc.extract_regex(urls, PARTS)
    return (pc.fill_null(x, "") for x in (pc.ascii_lower(pc.struct_field(found, "host")), pc.struct_field(found, "path")))


def _parents(host: bytes) -> list[bytes]:
    labels = host.split(b".")
    return [b".".join(labels[i:]) for i in range(len(labels))]


def _rank(entry: bytes) -> tuple[int, int, bytes]:
    """Of the entries that fit the longest wins, of equal ones that of the longer host, then the greater string."""
    return len(entry), len(entry.partition(b"/")[0]), entry


def _judge(name: str | None, lengths: list[int], other: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    listed = _mapped(name) if name else None
    for batch in batches:
        hosts, paths = split_url(batch.column("url"))
        who, wanted = [], []
        for i, (host, path) in enumerate(zip(raw_texts(hosts), raw_texts(paths), strict=True)):
            for x in _candidates(host, path, lengths) if listed else ():
                who.append(i)
                wanted.append(x)
        found = listed.find(wanted) if listed else np.zeros(0, np.int64)
        rule: list[bytes | None] = [None] * batch.num_rows
        verdict = [other] * batch.num_rows
        for j in np.flatnonzero(found >= 0).tolist():
            if rule[who[j]] is None or _rank(wanted[j]) > _rank(rule[who[j]]):
                rule[who[j]] = wanted[j]
                verdict[who[j]] = _VERDICTS[listed.verdicts[found[j]]]
        yield pa.RecordBatch.from_arrays([*batch.columns, hosts, paths, pa.array(rule, pa.binary()).cast(pa.string()), pa.array(verdict, pa.string())], [*batch.schema.names, "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, entries: DataFrame, other: str = "allow", most_mapped: int = 4_000_000) -> DataFrame:
    """page_id, url, host, path, rule (the entry that fits, else null) and verdict of each row of pages.

    entries has entry (host and path, the host in lower case) and verdict (allow or block). An entry fits its host and
    all subdomains, if the URL's path starts with the entry's; the longest wins, of equally long ones that of the longer
    host, then the greater string; where one entry has both verdicts, it blocks. URLs that no entry fits get `other`.
    Null, empty and odd URLs have an empty host and path and fit nothing; an empty list gives `other` throughout;
    repeated rows each give a row; further columns are left alone. Digest files hold most_mapped entries or so (counted
    first): one file is mapped on every executor; with more, candidates are dealt out by range of hashes.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url")
    entries = entries.filter("entry is not null").groupBy("entry").agg(F.max(F.col("verdict") == "block").alias("blocks"))
    entries = write_shared(with_digest(entries))
    cut = F.octet_length(F.regexp_extract("entry", "^[^/]*", 0))
    lengths = sorted(r[0] for r in entries.select((F.octet_length("entry") - cut).alias("n")).distinct().collect())
    schema = T.StructType([*pages.schema.fields, *(T.StructField(x, T.StringType()) for x in ("host", "path", "rule", "verdict"))])
    bits = (max(0, entries.count() - 1) // max(1, most_mapped)).bit_length()
    folder = shared_folder(spark)
    sorted_out = entries.withColumn("range", _range(bits)).repartition(1 << bits, "range").sortWithinPartitions("range", "digest").select("range", "digest", "entry", "blocks")
    files = write_shared(sorted_out.mapInArrow(lambda it: _filed(folder, it), "name string, range int"))
    if bits:
        return _judge_by_range(pages, files, folder, bits, lengths, other, schema)
    first = files.first()
    name = first.name if first else None
    if name:
        spark.sparkContext.addFile(f"{folder}/{name}")
    return pages.mapInArrow(lambda it: _judge(name, lengths, other, it), schema)


def _candidates(host: bytes, path: bytes, lengths: list[int]) -> list[bytes]:
    """What entries would fit: the host and its parents with the path cut to each length."""
    return [p + path[:n] for p in _parents(host) for n in lengths if n <= len(path)] if host else []


def _listed(lengths: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths = split_url(batch.column("url"))
        told = [_candidates(host, path, lengths) for host, path in zip(raw_texts(hosts), raw_texts(paths), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, hosts, paths, pa.array(told, pa.list_(pa.binary()))], [*batch.schema.names, "host", "path", "candidates"])


def _found(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = np.array(batch.column("name").to_pylist(), object)
        wanted = raw_texts(batch.column("entry"))
        entry, blocks = [], []
        for part in np.split(np.arange(len(wanted)), np.flatnonzero(names[1:] != names[:-1]) + 1) if wanted else ():
            digests = _opened(folder, names[part[0]])
            some = [wanted[i] for i in part]
            for x, k in zip(some, digests.find(some).tolist(), strict=True):
                if k >= 0:
                    entry.append(x)
                    blocks.append(bool(digests.verdicts[k]))
        yield pa.RecordBatch.from_arrays([pa.array(entry, pa.binary()), pa.array(blocks, pa.bool_())], ["entry", "blocks"])


def _judge_by_range(pages: DataFrame, files: DataFrame, folder: str, bits: int, lengths: list[int], other: str, schema: T.StructType) -> DataFrame:
    numbered = pages.withColumn("row", F.monotonically_increasing_id())
    wide = T.StructType([*numbered.schema.fields, T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("candidates", T.ArrayType(T.BinaryType()))])
    asked = write_shared(numbered.mapInArrow(lambda it: _listed(lengths, it), wide))
    # a common candidate is asked once
    once = with_digest(asked.select(F.explode("candidates").alias("entry")).distinct()).withColumn("range", _range(bits))
    dealt = once.join(F.broadcast(files), "range").repartition(1 << bits, "range").sortWithinPartitions("name").select("name", "entry")
    fits = dealt.mapInArrow(lambda it: _found(folder, it), "entry binary, blocks boolean")
    told = F.col("entry").cast("string")
    rank = F.struct(F.octet_length("entry").alias("n"), F.octet_length(F.regexp_extract(told, "^[^/]*", 0)).alias("host"), told.alias("entry"), F.when(F.col("blocks"), "block").otherwise("allow").alias("verdict"))
    best = asked.select("row", F.explode("candidates").alias("entry")).join(fits, "entry").groupBy("row").agg(F.max(rank).alias("best"))
    out = asked.join(best, "row", "left").select("page_id", "url", "host", "path", F.col("best.entry").alias("rule"), F.coalesce("best.verdict", F.lit(other)).alias("verdict"))
    return out.select(schema.names)
