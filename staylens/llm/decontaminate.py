"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: each row holds one document's postings, that is its distinct test terms and for
each the ascending word positions. Terms that no test item has can't take part in any match and are not posted. The
test items (bounded in bytes per block, checked) go to the tasks; the documents' postings never leave their row, so a
match needs no shuffle. The frequency of each term over the whole index orders every window's terms; a task takes the
postings of the rarest term, subtracts the term's offset, and intersects with the offset-adjusted lists of the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_shared, field, lists, raw_texts, write_shared

#: Bytes to words: A-Z lower-cased; 0-9, a-z and all bytes from 0x80 belong to words; the rest separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GAP = 1 << 12  # between the positions of two documents of a batch; more than any window with its slop


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class TestSet:
    """Windows of a block of test items: vocabulary, term ids and offsets of each window, its item."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: list[tuple[int, ...]] = []
        self.items: list[str] = []
        seen = set()
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                if (key := (name, tuple(ids[i : i + size]))) not in seen:
                    seen.add(key)
                    self.items.append(name)
                    self.windows.append(key[1])

    def plan(self, frequency: dict[int, int]) -> Plan:
        """What matching needs: each window's terms from the rarest, by step."""
        names = sorted(set(self.items))
        code = {x: i for i, x in enumerate(names)}
        length = np.array([len(w) for w in self.windows], np.int32)
        most = int(length.max(initial=1))
        term = np.full((len(self.windows), most), -1, np.int32)
        offset = np.zeros((len(self.windows), most), np.int16)
        for i, w in enumerate(self.windows):
            order = sorted(range(len(w)), key=lambda k: (frequency.get(w[k], 0), k))
            term[i, : len(w)] = [w[k] for k in order]
            offset[i, : len(w)] = order
        return Plan(names, np.array([code[x] for x in self.items], np.int64), length, term, offset, len(self.vocabulary))


@dataclass
class Plan:
    """Item names; of each window its item, its length, and term and offset by step, rarest first. Arrays alone, 60 bytes a window of ten words."""

    names: list[str]
    item_of: np.ndarray
    length: np.ndarray
    term: np.ndarray
    offset: np.ndarray
    n_terms: int


def _index(held: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary = held.value
    for batch in batches:
        n, terms, counts, places, per = [], [], [], [], []
        for text in raw_texts(batch.column(1)):
            found = words(text)
            ids = np.fromiter(map(vocabulary.get, found, repeat(-1)), np.int32, len(found))
            at = np.flatnonzero(ids >= 0).astype(np.int32)
            order = np.argsort(ids[at], kind="stable")
            distinct, times = np.unique(ids[at], return_counts=True)
            n.append(len(found))
            terms.append(distinct)
            counts.append(times)
            places.append(at[order])
            per.append((len(distinct), len(at)))
        per = np.array(per, np.int64).reshape(-1, 2)
        flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), lists(flat(terms), per[:, 0], pa.int32()), lists(flat(counts), per[:, 0], pa.int32()), lists(flat(places), per[:, 1], pa.int32())],
            ["doc_id", "n_words", "terms", "counts", "positions"],
        )


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        terms, counts = (batch.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("terms", "counts"))
        if len(terms):
            got = np.bincount(terms, counts).astype(np.int64)
            if len(got) > len(total):
                got, total = total, got
            total[: len(got)] += got
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["term", "n"])


def _intersect(tests: Plan, key: np.ndarray, base: int, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and start places where all terms stand at their offsets, give or take slop. key: term * base + place, sorted."""
    first = np.searchsorted(key, np.arange(tests.n_terms + 1, dtype=np.int64) * base)
    windows, starts = [], []
    lead = tests.term[:, 0].astype(np.int64)
    many = first[lead + 1] - first[lead]
    live = np.flatnonzero(many)
    bound = np.cumsum(many[live])
    for cut in np.split(live, np.searchsorted(bound, np.arange(4 << 20, bound[-1] if len(bound) else 0, 4 << 20))):
        w = np.repeat(cut, many[cut])
        at = np.arange(len(w)) - np.repeat(np.cumsum(many[cut]) - many[cut], many[cut]) + first[lead[w]]
        start = key[at] - lead[w] * base - tests.offset[w, 0]
        for k in range(1, tests.term.shape[1]):
            if not len(w):
                break
            term = tests.term[w, k].astype(np.int64)
            want = term * base + start + tests.offset[w, k]
            near = np.searchsorted(key, want - slop)
            ok = (term < 0) | ((near < len(key)) & (key[np.minimum(near, len(key) - 1)] <= want + slop))
            w, start = w[ok], start[ok]
        windows.append(w)
        starts.append(start)
    return (np.concatenate(windows), np.concatenate(starts)) if windows else (np.zeros(0, np.int64),) * 2


def _match(held: Broadcast, slop: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tests: Plan = held.value
    for whole in batches:
        for i in range(0, whole.num_rows, 2000):
            batch = whole.slice(i, 2000)
            size = batch.column("n_words").to_numpy()
            start = np.cumsum(size + _GAP) - size
            end = int(start[-1] + size[-1] + _GAP)
            terms, counts, places = (batch.column(x).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in ("terms", "counts", "positions"))
            per_doc = np.diff(batch.column("positions").offsets.to_numpy())
            key = np.repeat(terms, counts) * end + places + np.repeat(start, per_doc)
            key.sort()
            w, at = _intersect(tests, key, end, slop)
            doc = np.searchsorted(start, at + slop, "right") - 1
            ok = (doc >= 0) & (at + tests.length[w] <= (start + size)[doc] + slop)
            w, at, doc = w[ok], at[ok], doc[ok]
            lo, hi = np.maximum(at, start[doc]), np.minimum(at + tests.length[w], (start + size)[doc])
            edge = np.zeros(end + 1, np.int32)
            np.add.at(edge, lo, 1)
            np.add.at(edge, hi, -1)
            hit = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
            begins, ends = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
            of = np.searchsorted(start, begins, "right") - 1
            n_hit = np.bincount(of, ends - begins, batch.num_rows).astype(np.int64)
            pairs = np.unique(doc * max(1, len(tests.names)) + tests.item_of[w]) if len(w) else np.zeros(0, np.int64)
            n_items = np.bincount(pairs // max(1, len(tests.names)), minlength=batch.num_rows)
            ids = pa.array([tests.names[x] for x in (pairs % max(1, len(tests.names))).tolist()], pa.string())
            cut = np.concatenate([[0], np.cumsum(n_items)]).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (begins - start[of], ends - start[of])], ["start", "end"])
            turn = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.ListArray.from_arrays(cut, ids), pa.ListArray.from_arrays(turn, spans)],
                ["doc_id", "n_words", "n_hit", "item_ids", "spans"],
            )


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Test items in blocks of at most so many bytes, one item at least; a block at a time is on the driver."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    block, held = [], 0
    for r in rows.toLocalIterator():
        if block and held + len(r.t) > block_bytes:
            yield block
            block, held = [], 0
        block.append((r.i, bytes(r.t)))
        held += len(r.t)
    yield block


def find_matches(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, item_ids (sorted as strings), spans (hit word ranges).

    docs has doc_id and text, items has item_id and text; further columns of either are left alone. A window is `size`
    consecutive words of an item; an item of fewer, but not none, is one window. slop 0 finds exact phrases; a larger
    one finds proximity matches, in which each term may stand up to slop words from its place relative to the rarest.
    Null and empty texts have no words and no hits; null ids stay null; repeated rows each give a row; an empty table
    of items gives no hits. Items beyond block_bytes are taken in blocks, each against all documents, and each block's
    matches are written before the next block is read: some 700,000 windows a block are what the driver and the tasks
    hold. Documents are read and posted anew for each block, since only terms that a block has are posted; a benchmark
    of many blocks costs as many reads.
    """
    spark = docs.sparkSession
    if not 0 <= slop < _GAP // 4 or not 0 < size < _GAP // 4:
        raise ValueError("size and slop must be below 1024")
    docs = docs.select("doc_id", "text")
    schema = T.StructType([field(docs, "doc_id"), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    indexed = T.StructType([field(docs, "doc_id"), T.StructField("n_words", T.LongType()), *(T.StructField(x, T.ArrayType(T.IntegerType())) for x in ("terms", "counts", "positions"))])
    blocks = _blocks(items, block_bytes)
    block, following = next(blocks), next(blocks, None)
    if following is not None:
        docs = write_shared(docs.withColumn("doc_id", F.struct("doc_id", F.monotonically_increasing_id().alias("row"))))
        indexed, schema = (T.StructType([field(docs, "doc_id"), *s.fields[1:]]) for s in (indexed, schema))
    parts = []
    while block is not None:
        tests = TestSet(block, size)
        held = spark.sparkContext.broadcast(tests.vocabulary)
        index = write_shared(docs.mapInArrow(lambda it, held=held: _index(held, it), indexed))
        held.destroy()
        counts = index.select("terms", "counts").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
        planned = spark.sparkContext.broadcast(tests.plan({r.term: r.n for r in counts.collect()}))  # at most a row for each term of the block
        matched = index.select("doc_id", "n_words", "terms", "counts", "positions").mapInArrow(lambda it, held=planned: _match(held, slop, it), schema)
        if following is None and not parts:
            return matched
        parts.append(write_shared(matched))
        planned.destroy()
        drop_shared(index)
        block, following = following, next(blocks, None)
    return _merged(parts)


def _merged(parts: list[DataFrame]) -> DataFrame:
    """One row per document from the rows of several blocks: united items and hit ranges."""
    together = parts[0]
    for x in parts[1:]:
        together = together.unionByName(x)
    rows = together.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    grown = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda got, x: F.when(
            (F.size(got) > 0) & (F.element_at(got, -1)["end"] >= x["start"]),
            F.concat(F.slice(got, 1, F.size(got) - 1), F.array(F.struct(F.element_at(got, -1)["start"].alias("start"), F.greatest(F.element_at(got, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(got, F.array(x))),
    )
    rows = rows.withColumn("spans", grown)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return rows.select(F.col("doc_id.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), "item_ids", "spans")
