"""SimHash near-duplicates: 64-bit fingerprints linked at two or fewer differing bits, by pigeonring filtering.

The 64 bits are a ring of m segments, five or more. If two fingerprints differ in at most 2 bits, the pigeonring
principle gives a segment from which every chain of l consecutive segments has at most floor(2 l / m) differing bits:
0, 0, 1, 1, 2 for five segments and l from 1 to 5. The first segments of that chain are equal, (m - 1) / 2 of an odd m, so
a fingerprint is filed under m keys, one for each start: of 26 bits for five segments, 27 for seven, 28 for nine, 29 for
thirteen. More fingerprints take more segments, so that keys stay sparse and the chains stay the filter; inside a key the
longer chains prune the pairs before the full Hamming check.

A key with many fingerprints (a large group of near copies) is not paired. There each fingerprint is filed again, under
itself and under each copy of itself with one bit outside the key's segments turned. Two fingerprints of the key link
exactly if they share such a meeting point, and at most 65 share one, so the work stays in proportion to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_shared, field, join_common, keep_first, pieces, raw_texts, row_key, write_shared

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LINK_BITS, SEED = 2, 42


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segments_for(n: int) -> int:
    """Segments of the ring for n fingerprints: the least odd number, 13 at most, whose keys hold four of them or less on average."""
    for m in (5, 7, 9, 11):
        if n <= 4 << (m - 1) // 2 * 64 // m:
            return m
    return 13


def ring(m: int) -> list[int]:
    """Signed masks of m segments of equal width, give or take a bit."""
    edges = [round(64 * i / m) for i in range(m + 1)]
    return [_signed((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]


def majority(digests: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Bits set in each of the 64 places of 8-byte digests, rows of bytes; added to start."""
    total = np.zeros(64, np.int64) if start is None else start
    for i in range(0, len(digests), 50_000):
        total = total + np.unpackbits(digests[i : i + 50_000], axis=1).sum(axis=0, dtype=np.int64)
    return total


def packed(total: np.ndarray, n: int) -> int:
    """The fingerprint: a bit for each place that over half of n digests set."""
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def fingerprint(text: bytes, width: int = 3) -> int:
    """Signed 64-bit SimHash over shingles of `width` words; no word: zero."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end + 1 - size
    n = max(1, len(words) - width + 1)
    first, last = start[:n].tolist(), end[-n:].tolist()
    total = np.zeros(64, np.int64)
    for i in range(0, n, 50_000):
        cut = [joined[a:b] for a, b in zip(first[i : i + 50_000], last[i : i + 50_000], strict=True)]
        total = majority(np.frombuffer(b"".join(map(xxhash.xxh64_digest, cut, repeat(SEED))), np.uint8).reshape(-1, 8), total)
    return packed(total, n)


def _fingerprints(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(x, width) for x in raw_texts(batch.column("text"))], pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (signed 64-bit SimHash) for each row of docs; a null text has no words."""
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(lambda it: _fingerprints(width, it), T.StructType([field(docs, "doc_id"), T.StructField("fp", T.LongType())]))


def _mask(masks: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in masks]), (at % len(masks) + 1).cast("int"))


def _differ(a: Column, b: Column, mask: Column | None = None) -> Column:
    x = a.bitwiseXOR(b)
    return F.bit_count(x if mask is None else x.bitwiseAND(mask))


def links(prints: DataFrame, most_paired: int = 12, segments: int | None = None) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints: every pair from keys of up to most_paired fingerprints, and
    from larger keys enough true links to join whatever links. prints: one column fp without repeats or nulls; an empty
    table gives no links. segments is an odd number from 5, by the count of fingerprints where it is not given."""
    m = segments or segments_for(prints.count())
    masks = ring(m)
    pair_mask = [reduce(or_, (masks[(i + k) % m] for k in range((m - 1) // LINK_BITS))) for i in range(m)]
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(x)).alias("part")) for i, x in enumerate(pair_mask)])).alias("k")).select("k.start", "k.part", "fp")
    sizes = keyed.groupBy("start", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = write_shared(keyed.join(sizes, ["start", "part"]))

    few = shared.filter(F.col("n") <= most_paired).groupBy("start", "part").agg(F.array_sort(F.collect_list("fp")).alias("fps"))

    def linked(a: Column, b: Column) -> Column:
        kept, spent = b > a, F.lit(0)
        for length in range((m - 1) // LINK_BITS + 1, m + 1):
            spent = spent + _differ(a, b, _mask(masks, F.col("start") + length - 1))
            kept = kept & (spent <= length * LINK_BITS // m)
        return kept & (_differ(a, b) <= LINK_BITS)

    one = few.select("start", F.explode("fps").alias("a"), "fps")
    pairs = one.select("a", F.explode(F.filter("fps", lambda b: linked(F.col("a"), b))).alias("b"))

    turns = F.array(*[F.array(*[F.lit(0), *(F.lit(_signed(1 << j)) for j in range(64) if not pair_mask[i] >> j & 1)]) for i in range(m)])
    many = shared.filter(F.col("n") > most_paired).select("start", "fp", F.explode(F.element_at(turns, F.col("start") + 1)).alias("turn"))
    met = many.groupBy("start", F.col("fp").bitwiseXOR(F.col("turn")).alias("z")).agg(F.array_sort(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    stars = met.select(F.element_at("fps", 1).alias("a"), F.explode(F.slice("fps", 2, F.size("fps"))).alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) for each node of edges (a, b), which may repeat; no edges, no rows.

    Each round takes the smallest label among the neighbours, then the label of the label; a round is written to the
    shared folder and the next starts from there, so the lineage stays short and paths halve in length each round.
    """
    both = write_shared(edges.select("a", "b").union(edges.select("b", "a")))
    labels = write_shared(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    before = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = write_shared(stepped.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")))
        labels = moved.select("node", "label")
        drop_shared(before)
        before = moved
        if moved.filter("label < old").isEmpty():
            drop_shared(both)
            return labels


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) for each row of docs (doc_id, text).

    Copies share a fingerprint and are folded before linking. Null and empty texts have fingerprint zero, linked like
    any other. A null doc_id stays null and is no component_id unless its component has no other; repeated rows each
    give a row; an empty table gives none. Further columns are left alone.
    """
    found = write_shared(fingerprints(docs, width))
    firsts = write_shared(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    labels = components(links(firsts.select("fp")))
    classes = firsts.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    sided = write_shared(classes.join(ids, "label").select("fp", "component_id", "n"))
    return join_common(found, sided, "fp", "n").select("doc_id", "fp", "component_id")


def _row_prints(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            prints = pa.array([fingerprint(x, width) for x in raw_texts(batch.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), prints], ["_row", "doc_id", "key"])


def keep_one(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row of each component, that of the smallest doc_id, with all columns of docs; rows are told apart by doc_id and text.

    Null and empty texts are copies of each other; a null doc_id comes last; of repeated rows one stays; an empty table
    stays empty.
    """
    rows = docs.select(row_key().alias("_row"), "doc_id", "text")
    schema = T.StructType([T.StructField("_row", T.BinaryType()), field(docs, "doc_id"), T.StructField("key", T.LongType())])
    found = write_shared(rows.mapInArrow(lambda it: _row_prints(width, it), schema))
    labels = components(links(found.select(F.col("key").alias("fp")).distinct()))
    return keep_first(docs, found, labels.withColumnRenamed("node", "key"))
